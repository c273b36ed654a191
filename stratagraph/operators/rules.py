"""Layer rules, snapshots, diffs, ratchets, gates and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import dotted_glob
from .graph import instability, reachable


def assign_layers(nodes: DataFrame, layers: dict[str, list[str]], name: str = "name") -> DataFrame:
    """node, name, layer (null outside all); a name in two layers is an error."""
    hit = lambda ps: F.lit(False) if not ps else F.col(name).rlike("|".join(dotted_glob(p) for p in ps))
    found = F.array_compact(F.array(*[F.when(hit(ps), F.lit(layer)) for layer, ps in layers.items()]))
    out = nodes.withColumn("__found", found)
    twice = out.where(F.size("__found") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][name]} is in more than one layer: {twice[0]['__found']}")
    return out.withColumn("layer", F.get("__found", F.lit(0))).drop("__found")


def violations(edges: DataFrame, layered: DataFrame, forbid: DataFrame) -> DataFrame:
    """from_layer, to_layer, src, dst of edges between layers (node, layer) that forbid (from_layer, to_layer) names."""
    a, b = layered.select(F.col("node").alias("n1"), F.col("layer").alias("la")), layered.select(F.col("node").alias("n2"), F.col("layer").alias("lb"))
    f = forbid.select(F.col("from_layer").alias("fl"), F.col("to_layer").alias("tl")).distinct()
    j = edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).join(f, (F.col("la") == f["fl"]) & (F.col("lb") == f["tl"]))
    return j.select(F.col("fl").alias("from_layer"), F.col("tl").alias("to_layer"), "src", "dst")


def required_reach(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """node: sources that reach no target; one that is a target itself passes. A rule without sources or targets is dead and
    gives one row of null."""
    if sources.isEmpty() or targets.isEmpty():
        return sources.sparkSession.range(1).select(F.lit(None).cast(dict(sources.dtypes)["node"]).alias("node"))
    ok = reachable(edges, targets, reverse=True).select(F.col("node").alias("ok"))
    return sources.select("node").join(ok, F.col("node") == ok["ok"], "left_anti")


def sdp_violations(nodes: DataFrame, edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """src, dst, src_i, dst_i of edges to a less stable node: I(dst) > I(src) + tolerance."""
    if not 0 <= tolerance <= 1:
        raise ValueError("tolerance is in [0, 1]")
    i = instability(nodes, edges)
    a, b = i.select(F.col("node").alias("n1"), F.col("instability").alias("src_i")), i.select(F.col("node").alias("n2"), F.col("instability").alias("dst_i"))
    return edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).where(F.col("dst_i") > F.col("src_i") + tolerance).select("src", "dst", "src_i", "dst_i")


def coverage(edges: DataFrame, layered: DataFrame, forbid: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """modules, layered, ruled, edges, governed, external_governed, coverage: how much the rules see; ratios over nothing are 0.
    layered: (node, layer) of the modules in scope; external: the same of names outside, those in a layer count as governed ends."""
    ruled = forbid.select(F.col("from_layer").alias("r")).union(forbid.select("to_layer")).distinct()
    n = layered.join(ruled, layered["layer"] == ruled["r"], "left").agg(F.count("*").alias("modules"), F.count("layer").alias("layered"), F.count("r").alias("ruled"))
    a, b = layered.select(F.col("node").alias("n1"), F.col("layer").alias("la")), layered.select(F.col("node").alias("n2"), F.col("layer").alias("lb"))
    e = edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).agg(F.count("*").alias("edges"), F.count_if(F.col("la").isNotNull() & F.col("lb").isNotNull()).alias("governed"))
    out = n.crossJoin(e)
    if external is None:
        out = out.withColumn("external_governed", F.lit(0).cast("long"))
    else:
        x = external.where("layer IS NOT NULL").select(F.col("node").alias("x"))
        out = out.crossJoin(edges.join(a.where("la IS NOT NULL"), edges["src"] == a["n1"], "left_semi").join(x, edges["dst"] == x["x"], "left_semi").agg(F.count("*").alias("external_governed")))
    return out.withColumn("coverage", F.coalesce(F.try_divide("governed", "edges"), F.lit(0.0)))


def unmatchable(nodes: DataFrame, patterns: list[str]) -> list[tuple[str, str]]:
    """(pattern, what would do) of patterns that reach below a name from outside (nodes: node, external): the graph keeps the
    first part of such names only, so they can never match."""
    rows = [(p, p.split(".")[0], f"{p.split('.')[0]}.**") for p in dict.fromkeys(patterns) if "*" not in p.split(".")[0]]
    given = nodes.sparkSession.createDataFrame([r for r in rows if r[0] not in (r[1], r[2])], "pattern string, root string, instead string")
    outer = nodes.where("external").select("node")
    return sorted((r["pattern"], r["instead"]) for r in given.join(outer, given["root"] == outer["node"], "left_semi").collect())


def in_scope(nodes: DataFrame, roots: set[str] | None) -> DataFrame:
    """nodes with outside: whether the first part of the name is none of the roots that the layers' patterns bound."""
    return nodes.withColumn("outside", F.lit(False) if not roots else ~F.substring_index("node", ".", 1).isin(*sorted(roots)))


def exact_pattern_hints(layered: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """layer, pattern, suggestion, n: patterns without a star whose descendants stand in no layer, as the pattern names one module."""
    rows = [(layer, p, f"{p}.**") for layer, ps in layers.items() for p in ps if "*" not in p]
    known = layered.sparkSession.createDataFrame(rows, "layer string, pattern string, suggestion string")
    bare = layered.where("layer IS NULL").select("node")
    j = known.join(bare, F.startswith(bare["node"], F.concat(known["pattern"], F.lit("."))))  # a few patterns of a configuration
    return j.groupBy("layer", "pattern", "suggestion").agg(F.count("*").alias("n"))


def layer_sizes(layered: DataFrame, declared: list[str]) -> DataFrame:
    """layer, n for every declared layer, 0 for those without modules."""
    d = layered.sparkSession.createDataFrame([(x,) for x in declared], "layer string")
    n = layered.groupBy(F.col("layer").alias("l")).agg(F.count("*").alias("n"))
    return d.join(n, d["layer"] == n["l"], "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))


def gate(**counts: int) -> dict:
    """passed, and the kinds of findings that failed it."""
    failed = sorted(k for k, n in counts.items() if n)
    return {"passed": not failed, "failed": failed}


def set_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: added or resolved."""
    on = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    as_other = lambda df: df.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    a, b = after.select(*keys).distinct(), before.select(*keys).distinct()
    xb, xa = as_other(before), as_other(after)
    return a.join(xb, on(a, xb), "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(xa, on(b, xa), "left_anti").withColumn("change", F.lit("resolved")))


def reach_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, within, must_reach, module, change of required-reach findings. A rule that is dead after (a row of null module)
    judged no module, so its rows before are neither resolved nor kept."""
    keys = ["source", "within", "must_reach", "module"]
    diff = set_diff(before, after, keys)
    dead = after.where("module IS NULL").select(*[F.col(k).alias(f"d_{k}") for k in keys[:3]]).distinct()
    same = [diff[k].eqNullSafe(dead[f"d_{k}"]) for k in keys[:3]]
    return diff.where("change = 'added'").unionByName(diff.where("change = 'resolved'").join(dead, same, "left_anti"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """src, dst, change (added, removed, weight_changed), old, new of two edge sets with call_count."""
    a = before.select("src", "dst", F.col("call_count").alias("old"))
    b = after.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("call_count").alias("new"))
    j = a.join(b, (a["src"] == b["s2"]) & (a["dst"] == b["d2"]), "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "weight_changed")
    return j.select(F.coalesce("src", "s2").alias("src"), F.coalesce("dst", "d2").alias("dst"), kind.alias("change"), "old", "new").where("change IS NOT NULL")


def back_edges(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """src, dst of edges within a component from the later to the earlier name: those that point back in a topological order."""
    a, b = sccs.select(F.col("node").alias("n1"), F.col("scc").alias("s1")), sccs.select(F.col("node").alias("n2"), F.col("scc").alias("s2"))
    return edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).where("s1 = s2 AND src > dst").select("src", "dst")


def simulate(edges: DataFrame, add: DataFrame | None, remove: DataFrame | None) -> DataFrame:
    """edges after a delta, as a lazily composed frame; (src, dst) of add come with no calls unless there already. A pair that
    is both added and removed is neither."""
    if (add is None or add.isEmpty()) and (remove is None or remove.isEmpty()):
        raise ValueError("a delta adds or removes at least one edge")
    out = edges.select("src", "dst", "call_count")
    pairs = lambda df: df.select("src", "dst").distinct()
    a, r = (None if df is None else pairs(df) for df in (add, remove))
    if a is not None and r is not None:
        a, r = a.subtract(r), r.subtract(a)
    if r is not None:
        r = r.select(F.col("src").alias("rs"), F.col("dst").alias("rd"))
        out = out.join(r, (out["src"] == r["rs"]) & (out["dst"] == r["rd"]), "left_anti")
    if a is not None:
        have = edges.select(F.col("src").alias("hs"), F.col("dst").alias("hd"))
        out = out.unionByName(a.join(have, (a["src"] == have["hs"]) & (a["dst"] == have["hd"]), "left_anti").withColumn("call_count", F.lit(0).cast("long")))
    return out


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows without repeats of keys, each at its first place by order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def classify_delta(edges: DataFrame, nodes: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """op, src, dst, outcome: skipped (an unknown end), rejected (both added and removed), no_op (there already, or not there to
    remove) or applied. Repeats count once."""
    e = edges.select(F.col("src").alias("es"), F.col("dst").alias("ed")).distinct().withColumn("there", F.lit(True))
    n1, n2 = nodes.select(F.col("node").alias("n1")), nodes.select(F.col("node").alias("n2"))
    ops = add.select(F.lit("add").alias("op"), "src", "dst").unionByName(remove.select(F.lit("remove").alias("op"), "src", "dst")).distinct()
    twice = ops.groupBy(F.col("src").alias("ts"), F.col("dst").alias("td")).agg((F.count("*") > 1).alias("both"))
    j = ops.join(e, (ops["src"] == e["es"]) & (ops["dst"] == e["ed"]), "left").join(n1, ops["src"] == n1["n1"], "left").join(n2, ops["dst"] == n2["n2"], "left")
    j = j.join(twice, (ops["src"] == twice["ts"]) & (ops["dst"] == twice["td"]))
    known = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    there = F.coalesce("there", F.lit(False))
    return j.select("op", "src", "dst", F.when(~known, "skipped").when(F.col("both"), "rejected").when((F.col("op") == "add") == there, "no_op").otherwise("applied").alias("outcome"))


def delta_coverage(outcomes: DataFrame) -> DataFrame:
    """applied, no_op, rejected, skipped, coverage: complete if no part was skipped, partial if some part was answered (applied
    or no_op), else none."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    coverage = F.when(n("skipped") == 0, "complete").when(n("applied") + n("no_op") > 0, "partial").otherwise("none")
    return outcomes.agg(*[n(o).alias(o) for o in ("applied", "no_op", "rejected", "skipped")], coverage.alias("coverage"))


def ratchet_cycles(baseline: DataFrame, current: DataFrame, known: DataFrame, self_loops: DataFrame) -> DataFrame:
    """scc, carried of current cycles (scc, node): carried iff the members that the baseline knew are not none and lie in one
    baseline cycle; a self-loop only if that edge existed (node)."""
    k = known.select(F.col("node").alias("k")).distinct()
    b = baseline.select(F.col("scc").alias("bs"), F.col("node").alias("bn"))
    size = current.groupBy(F.col("scc").alias("c")).agg(F.count("*").alias("size"), F.min("node").alias("only"))
    seen = current.join(k, current["node"] == k["k"], "left_semi")
    n = seen.groupBy(F.col("scc").alias("c1")).agg(F.count("*").alias("n"))
    within = seen.join(b, seen["node"] == b["bn"]).groupBy("scc", "bs").agg(F.count("*").alias("m")).groupBy(F.col("scc").alias("c2")).agg(F.max("m").alias("m"))
    loops = self_loops.select(F.col("node").alias("l")).distinct()
    j = size.join(n, size["c"] == n["c1"], "left").join(within, size["c"] == within["c2"], "left").join(loops, size["only"] == loops["l"], "left")
    return j.select(F.col("c").alias("scc"), F.when(F.col("size") == 1, F.col("l").isNotNull()).otherwise(F.coalesce(F.col("m") == F.col("n"), F.lit(False))).alias("carried"))


def closing_edges(current: DataFrame, edges: DataFrame, baseline: DataFrame, old_edges: DataFrame) -> DataFrame:
    """scc, src, dst: of each current cycle (scc, node) the edges that closed it. An edge between two members of one baseline
    cycle, or one that was in a baseline cycle, did not; a cycle without any other has all its edges named."""
    of = lambda df, k: df.select(F.col("node").alias(f"n{k}"), F.col("scc").alias(f"s{k}"))
    a, b, c, d = of(current, 1), of(current, 2), of(baseline, 3), of(baseline, 4)
    e = edges.select("src", "dst").distinct().join(a, F.col("src") == a["n1"]).join(b, (F.col("dst") == b["n2"]) & (F.col("s1") == b["s2"]))
    e = e.join(c, F.col("src") == c["n3"], "left").join(d, F.col("dst") == d["n4"], "left")
    o = old_edges.select(F.col("src").alias("os"), F.col("dst").alias("od")).distinct().withColumn("old", F.lit(True))
    e = e.join(o, (F.col("src") == o["os"]) & (F.col("dst") == o["od"]), "left")
    closes = F.col("old").isNull() & ~F.coalesce(F.col("s3") == F.col("s4"), F.lit(False))
    e = e.select(F.col("s1").alias("scc"), "src", "dst", closes.alias("closes"))
    some = e.where("closes").select(F.col("scc").alias("some")).distinct()
    j = e.join(some, e["scc"] == some["some"], "left")
    return j.where(F.col("closes") | F.col("some").isNull()).select("scc", "src", "dst")


def ungoverned(violations_before: DataFrame, nodes: DataFrame, layered: DataFrame, forbid: DataFrame) -> DataFrame:
    """from_layer, to_layer, src, dst of violations recorded before whose modules still exist but which today's rules would not
    flag: the rule is gone, or an end stands in another layer now. Not a fix, as the import may still be there."""
    n1, n2 = nodes.select(F.col("node").alias("k1")), nodes.select(F.col("node").alias("k2"))
    v = violations_before.select("from_layer", "to_layer", "src", "dst").distinct()
    v = v.join(n1, v["src"] == n1["k1"], "left_semi").join(n2, v["dst"] == n2["k2"], "left_semi")
    a, b = layered.select(F.col("node").alias("n1"), F.col("layer").alias("la")), layered.select(F.col("node").alias("n2"), F.col("layer").alias("lb"))
    f = forbid.select(F.col("from_layer").alias("fl"), F.col("to_layer").alias("tl")).distinct().withColumn("ruled", F.lit(True))
    j = v.join(a, v["src"] == a["n1"], "left").join(b, v["dst"] == b["n2"], "left").join(f, (v["from_layer"] == f["fl"]) & (v["to_layer"] == f["tl"]), "left")
    held = F.col("ruled").isNotNull() & F.col("la").eqNullSafe(F.col("from_layer")) & F.col("lb").eqNullSafe(F.col("to_layer"))
    return j.where(~held).select("from_layer", "to_layer", "src", "dst")


def ratchet_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """from_layer, to_layer, src, dst, carried of the violations after: carried if the same was recorded before."""
    keys = ["from_layer", "to_layer", "src", "dst"]
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in keys]).distinct().withColumn("was", F.lit(True))
    a = after.select(*keys).distinct()
    return a.join(b, [a[k] == b[f"b_{k}"] for k in keys], "left").select(*keys, F.col("was").isNotNull().alias("carried"))


def score_gate(history: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """day, overall, delta, passed: against the row before; the first passes with delta null."""
    w = Window.orderBy("day")
    h = history.withColumn("delta", F.col("overall") - F.lag("overall").over(w))
    return h.select("day", "overall", "delta", F.coalesce(F.col("delta") >= -tolerance, F.lit(True)).alias("passed"))


GLYPHS = "▁▂▃▄▅▆▇█"


def trend(history: DataFrame, last: int = 20) -> DataFrame:
    """day, overall, low, high, level (0 to 7, half to even), glyph of the last rows."""
    rows = history.orderBy(F.desc("day")).limit(last)
    ends = rows.agg(F.min("overall").alias("low"), F.max("overall").alias("high"))
    j = rows.crossJoin(F.broadcast(ends))
    level = F.coalesce(F.bround(F.try_divide(F.col("overall") - F.col("low"), F.col("high") - F.col("low")) * 7, 0), F.lit(0.0)).cast("int")
    return j.select("day", "overall", "low", "high", level.alias("level"), F.substring(F.lit(GLYPHS), level + 1, F.lit(1)).alias("glyph"))
