"""Change history and duplication: hotspots, coupling, refactor priorities, exact and near-miss clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_code, is_vendored
from ..plans.iterate import cut
from .graph import weak_components


def edge_rollup(raw: DataFrame) -> DataFrame:
    """One row for each (src, dst) of raw import and call rows (src, dst, line, kind, is_relative, type_checking, is_call):
    relative if any is, type-checking only if all imports are and no call resolves, kinds merged."""
    imports = ~F.col("is_call")
    return raw.groupBy("src", "dst").agg(
        F.coalesce(F.bool_or(F.when(imports, F.col("is_relative"))), F.lit(False)).alias("is_relative"),
        F.bool_and(F.when(F.col("is_call"), False).otherwise(F.col("type_checking"))).alias("type_checking_only"),
        F.array_sort(F.array_compact(F.collect_list(F.when(imports, F.col("line"))))).alias("lines"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.array_compact(F.collect_list(F.when(F.col("is_call"), F.col("line"))))).alias("call_lines"),
        F.count_if("is_call").alias("call_count"),
    )


def call_stats(edges: DataFrame) -> DataFrame:
    """call_edges, calls, calls_per_edge over edges that carry calls only."""
    c = F.col("call_count")
    return edges.agg(F.count_if(c > 0).alias("call_edges"), F.coalesce(F.sum("call_count"), F.lit(0)).alias("calls"), F.coalesce(F.try_divide(F.sum("call_count"), F.count_if(c > 0)), F.lit(0.0)).alias("calls_per_edge"))


def hotspots(files: DataFrame, top_n: int | None = None) -> DataFrame:
    """module, cc_sum, churn, score = cc_sum * churn where both are positive; score desc, churn desc, module."""
    h = files.where("cc_sum > 0 AND churn > 0").select("module", "cc_sum", "churn", (F.col("cc_sum") * F.col("churn")).alias("score"))
    return h.orderBy(F.desc("score"), F.desc("churn"), "module").limit(top_n) if top_n else h


def fold_renames(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """changes (commit_id, path) with path followed through renames (old_path, new_path) to its last name, however long the
    chain; a cycle stops before it comes back to a name, and links of one old name go to the greatest new name."""
    r = cut(renames.groupBy("old_path").agg(F.max("new_path").alias("new_path")).where("old_path <> new_path"))
    names = r.select(F.col("old_path").alias("path"), F.col("new_path").alias("last"), F.array("old_path", "new_path").alias("seen"))
    nxt = r.select(F.col("old_path").alias("o"), F.col("new_path").alias("n"))
    while True:
        go = F.col("n").isNotNull() & ~F.array_contains("seen", F.coalesce("n", "last"))
        names = names.join(nxt, names["last"] == nxt["o"], "left").select("path", F.when(go, F.col("n")).otherwise(F.col("last")).alias("last"), F.when(go, F.array_append("seen", F.col("n"))).otherwise(F.col("seen")).alias("seen"), go.alias("moved"))
        names = cut(names)
        if names.where("moved").isEmpty():
            break
    names = names.select(F.col("path").alias("p"), "last")
    return changes.join(names, changes["path"] == names["p"], "left").select("commit_id", F.coalesce("last", "path").alias("path"))


def churn_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count_distinct("commit_id").alias("churn"))


def capped(changes: DataFrame, max_files: int = 30) -> DataFrame:
    """Changes (commit_id, file) of commits of at most max_files distinct files: sweeping commits go before any other filter."""
    n = changes.groupBy("commit_id").agg(F.count_distinct("file").alias("n")).where(F.col("n") <= max_files).select(F.col("commit_id").alias("c"))
    return changes.join(n, changes["commit_id"] == n["c"], "left_semi")


def file_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file").agg(F.count_distinct("commit_id").alias("n"))


def pair_support(changes: DataFrame) -> DataFrame:
    """a, b, support with a < b. A commit has at most max_files files after capped(), which bounds its pairs."""
    a = changes.select("commit_id", F.col("file").alias("a")).distinct()
    b = a.select(F.col("commit_id").alias("c2"), F.col("a").alias("b"))
    return a.join(b, (a["commit_id"] == b["c2"]) & (a["a"] < b["b"])).groupBy("a", "b").agg(F.count("*").alias("support"))


def coupling(changes: DataFrame, edges: DataFrame | None = None, min_support: int = 5, min_confidence: float = 0.5, max_files: int = 30) -> DataFrame:
    """a, b, support, confidence (support over the rarer file's count) of pairs that change together without an edge either way."""
    if not 0 < min_confidence <= 1 or min_support < 1:
        raise ValueError("min_support is at least 1 and min_confidence in (0, 1]")
    c = capped(changes, max_files)
    n = file_counts(c)
    na, nb = n.select(F.col("file").alias("fa"), F.col("n").alias("na")), n.select(F.col("file").alias("fb"), F.col("n").alias("nb"))
    p = pair_support(c).where(F.col("support") >= min_support)
    p = p.join(na, p["a"] == na["fa"]).join(nb, p["b"] == nb["fb"])
    p = p.withColumn("confidence", F.try_divide(F.col("support"), F.least("na", "nb"))).where(F.col("confidence") >= min_confidence)
    if edges is not None:
        e = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
        p = p.join(e, (p["a"] == e["lo"]) & (p["b"] == e["hi"]), "left_anti")
    return p.select("a", "b", "support", "confidence")


def hints(pairs: DataFrame, targets: DataFrame, impacted: DataFrame) -> DataFrame:
    """target, module, support, confidence: partners of targets (node) that are neither targets nor impacted (node)."""
    t = targets.select(F.col("node").alias("t"))
    both = pairs.select(F.col("a").alias("target"), F.col("b").alias("module"), "support", "confidence").unionByName(pairs.select(F.col("b").alias("target"), F.col("a").alias("module"), "support", "confidence"))
    skip = targets.select("node").union(impacted.select("node")).distinct().select(F.col("node").alias("x"))
    return both.join(t, both["target"] == t["t"], "left_semi").join(skip, both["module"] == skip["x"], "left_anti")


def refactor_priorities(hot: DataFrame, risk: DataFrame, min_risk: float = 0.15, floor: float = 0.05) -> DataFrame:
    """module, hotspot, risk, priority, lens: modules that are hotspots or risky; both parts are over the greatest of all."""
    if not 0 <= min_risk <= 1:
        raise ValueError("min_risk is in [0, 1]")
    h = hot.select(F.col("module").alias("hm"), F.col("score").alias("hs"))
    r = risk.select(F.col("node").alias("rm"), F.col("risk").alias("rs"))
    j = h.join(r, h["hm"] == r["rm"], "full_outer").select(F.coalesce("hm", "rm").alias("module"), "hs", F.coalesce("rs", F.lit(0.0)).alias("risk"))
    j = j.where(F.col("hs").isNotNull() | (F.col("risk") >= min_risk))
    top = j.agg(F.max("hs").alias("mh"), F.max("risk").alias("mr"))
    j = j.crossJoin(F.broadcast(top))
    part = F.coalesce(F.try_divide(F.col("hs"), F.col("mh")), F.lit(0.0))
    is_hot, risky = F.coalesce(F.col("hs") >= floor * F.col("mh"), F.lit(False)), F.col("risk") >= min_risk
    return j.select("module", F.coalesce("hs", F.lit(0)).alias("hotspot"), "risk", (part + F.coalesce(F.try_divide("risk", "mr"), F.lit(0.0))).alias("priority"), F.when(is_hot & risky, "fused").when(is_hot, "behavioral").when(risky, "structural").otherwise("weak").alias("lens"))


def rationale(priorities: DataFrame) -> DataFrame:
    """priorities with why: a sentence on what speaks for a module, from its lens, hotspot and risk."""
    hot = F.concat(F.lit("complex and often changed (score "), F.col("hotspot").cast("string"), F.lit(")"))
    risky = F.concat(F.lit("central and unstable (risk "), F.format_number("risk", 2), F.lit(")"))
    why = F.when(F.col("lens") == "fused", F.concat(hot, F.lit(" and "), risky, F.lit(": work here reaches the busiest and the riskiest code at once.")))
    why = why.when(F.col("lens") == "behavioral", F.concat(hot, F.lit(", at the edge of the structure."))).when(F.col("lens") == "structural", F.concat(risky, F.lit(", though seldom changed.")))
    return priorities.withColumn("why", why.otherwise("Below both bounds; ranked by what little there is."))


def exact_clusters(functions: DataFrame, min_size: int = 30, min_members: int = 2) -> DataFrame:
    """shape_hash, members, size, redundancy, exact and what holds for all members (overload, property, vendored, test, trivial,
    same_class) of functions (shape_hash, concrete_hash, size, module, path, qualified_name, decorators, is_trivial) that
    share a shape. same_class: methods of one class of one module."""
    if min_members < 2:
        raise ValueError("min_members is at least 2")
    f = functions.where(F.col("size") >= min_size)
    marked = lambda name: F.exists("decorators", lambda d: F.element_at(F.split(d, r"\."), -1) == name)
    method = F.col("qualified_name").contains(".")
    scope = F.struct("module", F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    g = f.groupBy("shape_hash").agg(
        F.count("*").alias("members"),
        F.min("size").alias("size"),
        (F.min("concrete_hash") == F.max("concrete_hash")).alias("exact"),
        F.bool_and(marked("overload")).alias("overload"),
        F.bool_and(marked("property") & F.col("is_trivial")).alias("property"),
        F.bool_and(is_vendored(F.col("path"))).alias("vendored"),
        F.bool_and(is_test_code(F.col("path"))).alias("test"),
        F.bool_and("is_trivial").alias("trivial"),
        (F.bool_and(method) & (F.min(scope) == F.max(scope))).alias("same_class"),
    )
    return g.where(F.col("members") >= min_members).withColumn("redundancy", F.col("size") * (F.col("members") - 1))


#: Why a cluster is likely meant as it is, in the order in which reasons are given.
VARIANTS = ("overload", "property", "vendored", "test", "trivial", "same_class")


def variant(clusters: DataFrame) -> DataFrame:
    """clusters with variant: the first of VARIANTS that holds for all members, else null."""
    return clusters.withColumn("variant", F.coalesce(*[F.when(F.col(v), F.lit(v)) for v in VARIANTS]))


def independent_clusters(members: DataFrame, changes: DataFrame, min_support: int = 3, min_confidence: float = 0.3, min_evidence: int = 5, max_files: int = 30) -> DataFrame:
    """cluster, independent: of (cluster, file); two files or more, all changed min_evidence times or more, no coupled pair.
    Counts and pairs are of commits of at most max_files files."""
    m = members.select("cluster", "file").distinct()
    focused = capped(changes, max_files)
    n = file_counts(focused).select(F.col("file").alias("f"), "n")
    per = m.join(n, m["file"] == n["f"], "left").groupBy("cluster").agg(F.count("*").alias("files"), F.bool_and(F.coalesce("n", F.lit(0)) >= min_evidence).alias("known"))
    pairs = coupling(changes, None, min_support, min_confidence, max_files)
    a, b = m.select(F.col("cluster").alias("ca"), F.col("file").alias("xa")), m.select(F.col("cluster").alias("cb"), F.col("file").alias("xb"))
    tied = pairs.join(a, pairs["a"] == a["xa"]).join(b, (pairs["b"] == b["xb"]) & (F.col("ca") == b["cb"])).select(F.col("ca").alias("t")).distinct().withColumn("tied", F.lit(True))
    return per.join(tied, per["cluster"] == tied["t"], "left").select("cluster", ((F.col("files") >= 2) & F.col("known") & F.col("tied").isNull()).alias("independent"))


def band_pairs(sizes: DataFrame, threshold: float = 0.85, block: int = 3_500) -> DataFrame:
    """a, b of (id, size) whose sizes are within a factor of 1 / threshold: size bands make the range join an equality join.

    The result grows with the square of a band. Rows of a band are dealt in blocks of about `block`, and each pair of blocks meets
    apart, so a join holds a block at a time (Spark keeps up to 4,096 rows of a key in memory) and a large band is spread over tasks.
    """
    step = math.log(1 / threshold)
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step)
    a = sizes.select(F.col("id").alias("a"), F.col("size").alias("sa"), F.explode(F.array(band, band + 1)).alias("ba"))
    b = sizes.select(F.col("id").alias("b"), F.col("size").alias("sb"), band.alias("bb"))
    blocks = lambda df, on, n: df.groupBy(F.col(on).alias(f"k{n}")).agg(F.ceil(F.count("*") / block).cast("long").alias(n))
    na, nb = blocks(a, "ba", "na"), blocks(b, "bb", "nb")
    grid = cut(na.join(nb, na["kna"] == nb["knb"]).select(F.col("kna").alias("k"), "na", "nb"))  # one row a band
    parts = min(grid.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 1, 2_000)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = a.join(F.broadcast(grid), a["ba"] == grid["k"]).select("a", "sa", "ba", own("a", "na").alias("xa"), each("nb").alias("ya")).repartition(parts, "ba", "xa", "ya")
    y = b.join(F.broadcast(grid), b["bb"] == grid["k"]).select("b", "sb", "bb", each("na").alias("xb"), own("b", "nb").alias("yb")).repartition(parts, "bb", "xb", "yb")
    near = (F.col("sa") >= threshold * F.col("sb")) & ((F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))))
    return x.join(y, (F.col("ba") == F.col("bb")) & (F.col("xa") == F.col("xb")) & (F.col("ya") == F.col("yb")) & near).select("a", "b")


#: 64-bit words of the parity bits that stand for a large bag in the join of candidates.
WORDS = 8


def bag_similarity(bags: DataFrame, threshold: float = 0.85) -> DataFrame:
    """a, b, similarity of (id, token, n): multiset Jaccard at or over threshold t.

    A bag is the set of its token copies (token, 1) to (token, n) as hashes, rarest token first. Of a pair the bag that is not
    larger, of size s, has o = ceil(2t / (1 + t) * s) copies in common with the other at least, so one of its s - o + 1 first
    copies is among the S - ceil(t * S) + 1 first of the other, and two are where both have one more. Pairs whose smaller bag
    is small meet at two such copies, others at one. Where they meet, positions and, for large bags, parity bits of all copies
    bound what can differ, so candidates are few before they are shuffled and compared array with array.
    """
    t = threshold
    # Sizes of the smaller bag up to which a pair meets at two copies, and up to which it may have no more than one in common.
    small, single = int(8 / (1 - t)) if t < 1 else 1 << 30, int((1 + t) / (2 * t) + 1e-9) if t > 0 else 1 << 30
    token = F.when(F.col("token").isNull(), F.xxhash64("id", F.lit("")))  # counts, but is like no other
    rows = bags.where("n > 0").select("id", F.coalesce(token, F.xxhash64("token")).alias("h"), F.col("n").cast("long").alias("n"))
    df = rows.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("df"))
    # Plain rows go to the bag's place; gathered before that, they would travel as lists.
    copies = rows.join(df, rows["h"] == df["k"]).select("id", "df", "h", "n").repartition("id").select("id", "df", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("c"))
    copies = copies.select("id", "df", F.xxhash64("h", "c").alias("c"))
    s = F.col("size")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("c", 6).bitwiseAND(F.lit(WORDS - 1))
    packed = copies.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "c"))).alias("x"), *[F.bit_xor(F.when(word == j, one)).alias(f"w{j}") for j in range(WORDS)]).withColumn("size", F.size("x").cast("long"))
    bits = F.when(s > small, F.array(*[F.coalesce(f"w{j}", F.lit(0).cast("long")) for j in range(WORDS)]))
    alone = F.size(F.filter("x", lambda v: v["df"] == 1)).alias("alone")
    packed = cut(packed.select("id", F.col("x.c").alias("copies"), alone, "size", bits.alias("bits")))
    # The first so many copies but those of tokens that no other bag has, which stand at the very front, with their places.
    first = lambda count: F.filter(F.transform(F.slice("copies", F.lit(1), F.least(count, s).cast("int")), lambda c, k: F.struct(c.alias("c"), k.alias("at"))), lambda v: v["at"] >= F.col("alone"))
    lone = lambda some: F.transform(some, lambda v: F.struct(v["c"].alias("key"), v["at"].alias("at")))
    two = lambda some: F.flatten(F.transform(some, lambda v: F.transform(F.filter(some, lambda w: w["at"] > v["at"]), lambda w: F.struct(F.xxhash64(v["c"], w["c"]).alias("key"), v["at"].alias("at")))))
    least, most = F.ceil(2 * t / (1 + t) * s - 1e-9), F.ceil(t * s - 1e-9)
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    of = lambda keys, k: packed.select(F.col("id").alias(f"i{k}"), s.alias(f"s{k}"), F.col("bits").alias(f"b{k}"), F.explode(keys).alias("e")).select(f"i{k}", f"s{k}", f"b{k}", F.col("e.key").alias(f"k{k}"), F.col("e.at").alias(f"at{k}"))
    x = of(F.when((s > single) & (s <= small), two(first(s - least + 2))).otherwise(lone(first(s - least + 1))), "x")
    y = of(F.concat(F.when((s > small) | (most <= single), lone(first(s - most + 1))).otherwise(none), F.when((s > single) & (most <= small), two(first(s - most + 2))).otherwise(none)), "y")
    room = F.floor((1 - t) / (1 + t) * (F.col("sx") + F.col("sy")) + 1e-9)
    differ = sum((F.bit_count(F.get("bx", F.lit(j)).bitwiseXOR(F.get("by", F.lit(j)))) for j in range(WORDS)), F.lit(0))
    order = (F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("ix") < F.col("iy")))
    # What stands before the first copy that a pair shares is not shared, so at that one the places are within what may differ.
    fits = (F.col("sx") >= t * F.col("sy") - 1e-9) & (F.col("atx") + F.col("aty") <= room) & F.coalesce(differ <= room, F.lit(True))
    pairs = x.join(y, (F.col("kx") == F.col("ky")) & order & fits).select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"))
    pairs = cut(pairs.distinct())
    ids = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    mine = packed.select("id", "copies", "size").join(F.broadcast(ids) if ids.count() <= 500_000 else ids, F.col("id") == ids["k"], "left_semi")
    with_ = lambda k: mine.select(F.col("id").alias(f"i{k}"), F.col("copies").alias(f"c{k}"), F.col("size").alias(f"s{k}"))
    pa, pb = with_("a"), with_("b")
    both = pairs.join(pa, pairs["a"] == pa["ia"]).join(pb, pairs["b"] == pb["ib"]).select("a", "b", F.size(F.array_intersect("ca", "cb")).cast("long").alias("i"), "sa", "sb")
    return both.withColumn("similarity", F.col("i") / (F.col("sa") + F.col("sb") - F.col("i"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_miss(functions: DataFrame, bags: DataFrame, threshold: float = 0.85, min_size: int = 30) -> DataFrame:
    """component, members, size (upper median), similarity (least edge), redundancy: near-misses among functions of sized shapes that occur once."""
    f = functions.where(F.col("size") >= min_size)
    once = f.groupBy("shape_hash").agg(F.count("*").alias("k"), F.first("fn_id").alias("f1")).where("k = 1").select("f1")
    mine = bags.join(once, bags["id"] == once["f1"], "left_semi")
    edges = cut(bag_similarity(mine, threshold))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    comp = weak_components(nodes, edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    c1 = comp.select(F.col("node").alias("n1"), F.col("component"))
    least = edges.join(c1, edges["a"] == c1["n1"]).groupBy("component").agg(F.min("similarity").alias("similarity"))
    s = functions.select(F.col("fn_id").alias("fid"), "size")
    per = c1.join(s, c1["n1"] == s["fid"]).groupBy("component").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("size")).alias("sizes"))
    out = per.join(least, "component").withColumn("size", F.get("sizes", F.floor(F.col("members") / 2).cast("int")))
    return out.select("component", "members", "size", "similarity", (F.col("size") * (F.col("members") - 1)).alias("redundancy"))
