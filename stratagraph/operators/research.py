"""Questions asked of many projects at once: reach that siblings do not share, detectors of a domain core, agreement of labelers,
and copies of a function that a duplicate search should find."""

from __future__ import annotations

import ast
import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreed(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, agreed of two labelers' (id, label): whether both say TRUE; ids that either calls UNSCORABLE are left out. Labelers
    that saw different ids are refused."""
    o = b.select(F.col("id").alias("o"), F.col("label").alias("other"))
    j = a.join(o, a["id"] == o["o"], "full_outer")
    differ = j.where("id IS NULL OR o IS NULL").count()
    if differ:
        raise ValueError(f"the labelers saw different ids: {differ} of them")
    return j.where("label <> 'UNSCORABLE' AND other <> 'UNSCORABLE'").select("id", ((F.col("label") == "TRUE") & (F.col("other") == "TRUE")).alias("agreed"))


#: The bars of a generator's precision and of the share that only it finds, and the least evidence for a verdict.
PASS_PRECISION, KILL_PRECISION, PASS_SHARE, KILL_SHARE = 0.60, 0.40, 0.30, 0.10
LEAST_SCORED, LEAST_SCORED_REPOS = 30, 10
LEAST_UNITS, LEAST_UNIT_REPOS, LEAST_UNIT_CHANGES = 40, 15, 20


def found_share(pairs: DataFrame, truth: DataFrame, one: str, other: str) -> DataFrame:
    """units, only_one, only_other, both, repos, changes, measurable, share of pairs (id, unit, repo, change, generators, exact)
    judged by truth (id, agreed): units with a true pair that is not exact, by which of two generators found them; share is
    that of the first alone, null without units."""
    t = truth.where("agreed").select(F.col("id").alias("t"))
    good = pairs.where("NOT exact").join(t, pairs["id"] == t["t"], "left_semi")
    u = good.groupBy("unit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("generators")))).alias("by"))
    n = lambda g: F.count_if(F.array_compact(F.col("by")) == F.array(F.lit(g)))
    a = u.agg(F.count("*").alias("units"), n(one).alias("only_one"), n(other).alias("only_other")).crossJoin(good.agg(F.count_distinct("repo").alias("repos"), F.count_distinct("change").alias("changes")))
    enough = (F.col("units") >= LEAST_UNITS) & (F.col("repos") >= LEAST_UNIT_REPOS) & (F.col("changes") >= LEAST_UNIT_CHANGES)
    return a.select("units", "only_one", "only_other", (F.col("units") - F.col("only_one") - F.col("only_other")).alias("both"), "repos", "changes", enough.alias("measurable"), F.try_divide("only_one", "units").alias("share"))


def share_verdict(scored: int, repos: int, precision: tuple[float | None, float | None], measurable: bool, share: tuple[float | None, float | None]) -> str:
    """pass, kill, null or not_measurable out of the intervals of precision and share. A bar is crossed only by a whole interval;
    either kills, both must pass."""
    if scored < LEAST_SCORED or repos < LEAST_SCORED_REPOS:
        return "not_measurable"
    (p_low, p_high), (s_low, s_high) = precision, share if measurable else (None, None)
    if (p_high is not None and p_high < KILL_PRECISION) or (s_high is not None and s_high < KILL_SHARE):
        return "kill"
    if not measurable:
        return "not_measurable"
    return "pass" if (p_low or 0.0) >= PASS_PRECISION and (s_low or 0.0) >= PASS_SHARE else "null"


def gap_table(rows: DataFrame, top: int, full: float = 10.0) -> DataFrame:
    """path, score, lines, share, running: the rows (path, score, lines) that cost most against a full score, by lines times
    distance; ties by path. Shares are of the cost of all rows, 0 where there is none."""
    cost = (F.lit(full) - F.col("score")) * F.col("lines")
    best = rows.withColumn("cost", cost).orderBy(F.desc("cost"), "path").limit(top)
    j = best.crossJoin(F.broadcast(rows.agg(F.sum(cost).alias("whole")))).withColumn("share", F.coalesce(F.try_divide("cost", "whole"), F.lit(0.0)))
    w = Window.orderBy(F.desc("cost"), "path").rowsBetween(Window.unboundedPreceding, 0)  # over top rows
    return j.select("path", "score", "lines", "share", F.sum("share").over(w).alias("running"))


def sibling_reach(nodes: DataFrame, reach: DataFrame, min_siblings: int = 6, band: tuple[float, float] = (0.2, 0.8), min_side: int = 2) -> DataFrame:
    """package, siblings, reaching, targets, kind: of packages with min_siblings modules or more, the sets of siblings that reach
    the same targets outside the package. kind is fired where the set's share lies in band with min_side on either side,
    control below the band; others are left out. reach: (src, dst) of all paths; targets that hold the package don't count."""
    up = F.regexp_replace("node", r"\.[^.]*$", "")
    known = nodes.select(F.col("node").alias("k"))
    kids = nodes.select("node", up.alias("package")).where(F.col("node").contains("."))
    kids = kids.join(known, kids["package"] == known["k"], "left_semi")
    many = kids.groupBy(F.col("package").alias("p")).agg(F.count("*").alias("siblings")).where(F.col("siblings") >= min_siblings)
    kids = kids.join(many, kids["package"] == many["p"]).drop("p")
    inner = reach.join(known, reach["dst"] == known["k"], "left_semi")
    hit = kids.join(inner, kids["node"] == inner["src"]).where(~F.startswith(F.concat("package", F.lit(".")), F.concat("dst", F.lit("."))))
    hit = hit.where(F.regexp_replace("dst", r"\.[^.]*$", "") != F.col("package"))
    per = hit.groupBy("package", "siblings", "dst").agg(F.sort_array(F.collect_set("node")).alias("set"))
    classes = per.groupBy("package", "siblings", "set").agg(F.count("*").alias("targets"))
    k, n = F.size("set"), F.col("siblings")
    fired = (k / n).between(*band) & (F.least(k, n - k) >= min_side)
    out = classes.select("package", "siblings", k.cast("long").alias("reaching"), "targets", F.when(fired, "fired").when(k / n < band[0], "control").alias("kind"))
    return out.where("kind IS NOT NULL")


def domain_detectors(nodes: DataFrame, edges: DataFrame, infra: list[str], tokens: list[str]) -> DataFrame:
    """detector, domain, violations. A module is of the domain if it imports nothing outside (purity), carries one of tokens in
    its name (naming), is imported within and imports nothing within (position), or imports only its own first two parts
    (relaxed); a violation is one that imports an infra package too."""
    known = nodes.select(F.col("node").alias("k")).distinct()
    e = edges.select("src", "dst").distinct().join(known.withColumnRenamed("k", "ks"), F.col("src") == F.col("ks"), "left_semi")
    e = e.join(known, e["dst"] == known["k"], "left").withColumn("inner", F.col("k").isNotNull())
    two = lambda c: F.substring_index(c, ".", 2)
    out = e.groupBy(F.col("src").alias("o")).agg(
        F.count_if(~F.col("inner")).alias("outside"),
        F.count_if("inner").alias("within"),
        F.count_if(F.col("inner") & (two("src") != two("dst"))).alias("far"),
        F.bool_or(~F.col("inner") & F.substring_index("dst", ".", 1).isin(infra)).alias("infra"),
    )
    into = e.where("inner").select(F.col("dst").alias("i")).distinct()
    j = nodes.select("node").distinct().join(out, F.col("node") == out["o"], "left").join(into, F.col("node") == into["i"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    used, named = F.col("i").isNotNull(), F.arrays_overlap(F.split("node", r"[._]"), F.array(*[F.lit(t) for t in tokens]))
    domains = {"purity": zero("outside"), "naming": named, "position": used & zero("within"), "relaxed": used & zero("far")}
    bad = F.coalesce("infra", F.lit(False))
    each = F.array(*[F.struct(F.lit(k).alias("detector"), c.alias("domain"), (c & bad).alias("bad")) for k, c in domains.items()])
    return j.select(F.explode(each).alias("x")).groupBy("x.detector").agg(F.count_if("x.domain").alias("domain"), F.count_if("x.bad").alias("violations"))


def clone_variants(source: str) -> dict[str, str | None]:
    """Copies of the one function in source, by what was done to it; None where that can't be done."""
    origin = ast.parse(source).body[0]

    def made(change) -> str | None:
        fn = copy.deepcopy(origin)
        return ast.unparse(ast.fix_missing_locations(fn)) if change(fn) is not False else None

    def renamed(fn):
        for n in ast.walk(fn):
            if isinstance(n, ast.Name | ast.arg):
                field = "id" if isinstance(n, ast.Name) else "arg"
                setattr(n, field, getattr(n, field) + "_x")

    def flipped(fn):
        pairs = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq}
        for n in ast.walk(fn):
            if isinstance(n, ast.BinOp) and type(n.op) in pairs:
                n.op = pairs[type(n.op)]()
                return True
            if isinstance(n, ast.Compare) and type(n.ops[0]) in pairs:
                n.ops[0] = pairs[type(n.ops[0])]()
                return True
        return False

    two = len(origin.body) > 1
    return {
        "identical": made(lambda fn: True),
        "renamed": made(renamed),
        "inserted": made(lambda fn: fn.body.insert(0, ast.parse("_gap = 0").body[0])),
        "deleted": made(lambda fn: fn.body.pop() if two else False),
        "reordered": made(lambda fn: fn.body.insert(0, fn.body.pop(1)) if two else False),
        "flipped": made(flipped),
    }


def bag_similarity_of(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two maps of token to count."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    n = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    total = lambda f: F.aggregate(keys, F.lit(0), lambda s, k: s + f(n(a, k), n(b, k)))
    return F.try_divide(total(F.least), total(F.greatest))


def clone_recall(spark, sources: list[str], floor: float = 0.85) -> DataFrame:
    """variant, clones, exact, near: of the variants of the functions in sources, how many a search by shape finds, and how many
    one by token bags at floor."""
    from ..functions.pyparse import parse

    rows = []
    for s in sources:
        seed = parse(s.encode())["functions"][0]
        for kind, text in clone_variants(s).items():
            if text is not None:
                other = parse(text.encode())["functions"][0]
                rows.append((kind, seed["shape_hash"] == other["shape_hash"], seed["tokens"], other["tokens"]))
    df = spark.createDataFrame(rows, "variant string, same boolean, a map<string,int>, b map<string,int>")
    return df.groupBy("variant").agg(F.count("*").alias("clones"), F.count_if("same").alias("exact"), F.count_if(bag_similarity_of(F.col("a"), F.col("b")) >= floor).alias("near"))
