"""Transitive contracts between sets of modules, affected tests, summaries of diffs, and name suggestions."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import dotted_glob, file_glob
from ..functions.paths import is_run_test
from ..plans.iterate import cut
from .graph import cycles, reachable, scc, shortest_chains


def matching(nodes: DataFrame, patterns: list[str]) -> DataFrame:
    """node: those whose dotted name one of patterns matches."""
    return nodes.select("node").where(F.col("node").rlike("|".join(dotted_glob(p) for p in patterns)) if patterns else F.lit(False)).distinct()


def forbidden(nodes: DataFrame, edges: DataFrame, sources: list[str], targets: list[str]) -> DataFrame:
    """source, target, chain: sources that reach a target over any number of edges, by a shortest chain."""
    s, t = matching(nodes, sources), matching(nodes, targets)
    found = shortest_chains(edges, t, reverse=True).where("dist > 0").join(s.withColumnRenamed("node", "s"), F.col("node") == F.col("s"), "left_semi")
    return found.select(F.col("node").alias("source"), F.col("root").alias("target"), F.reverse("chain").alias("chain"))


def layered(nodes: DataFrame, edges: DataFrame, layers: list[list[str]]) -> DataFrame:
    """Chains from a lower layer to one above it; layers go from the highest to the lowest."""
    out = None
    for k in range(1, len(layers)):
        part = forbidden(nodes, edges, layers[k], [p for up in layers[:k] for p in up])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else forbidden(nodes, edges, [], [])


def independent(nodes: DataFrame, edges: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Chains between groups that must not reach each other."""
    out = forbidden(nodes, edges, [], [])
    for k, g in enumerate(groups):
        out = out.unionByName(forbidden(nodes, edges, g, [p for j, o in enumerate(groups) if j != k for p in o]))
    return out


def protected(nodes: DataFrame, edges: DataFrame, guarded: list[str], allowed: list[str]) -> DataFrame:
    """src, dst of direct edges into guarded modules from others than allowed ones and themselves."""
    g = matching(nodes, guarded).withColumnRenamed("node", "g")
    ok = matching(nodes, guarded + allowed).withColumnRenamed("node", "ok")
    return edges.join(g, edges["dst"] == g["g"], "left_semi").join(ok, edges["src"] == ok["ok"], "left_anti").select("src", "dst")


def sibling_cycles(nodes: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    """members, n_edges: children of a package that reach each other over any number of siblings, directly or through their own
    modules."""
    child = lambda c: F.regexp_extract(c, "^" + re.escape(parent) + r"\.([^.]+)", 1)
    e = cut(edges.select(child("src").alias("src"), child("dst").alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct())
    children = nodes.select(child("node").alias("node")).where("node <> ''").distinct()
    return cycles(scc(children, e), e)


def matched_nothing(nodes: DataFrame, expressions: list[str]) -> list[str]:
    """Expressions without a module: a contract that names one of them verifies nothing."""
    return [p for p in expressions if matching(nodes, [p]).isEmpty()]


def affected(modules: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 5, test_filter: str | None = None) -> DataFrame:
    """node, dist, test: modules that reach a changed one (path) within depth, and tests under the directory of an affected
    conftest.py. A filter that matches no file is refused."""
    if depth < 1:
        raise ValueError("depth is at least 1")
    named = modules.where("path IS NOT NULL")
    is_test = F.col("path").rlike(file_glob(test_filter)) if test_filter else is_run_test(F.col("path"))
    if test_filter and named.where(is_test).isEmpty():
        raise ValueError(f"{test_filter!r} matches no file")
    c = changed.select(F.col("path").alias("cp")).distinct()
    seeds = named.join(c, named["path"] == c["cp"], "left_semi").select("node")
    hit = reachable(edges, seeds, reverse=True, depth=depth).select(F.col("node").alias("h"), "dist")
    all_ = named.select("node", "path", is_test.alias("test"))
    got = all_.join(hit, all_["node"] == hit["h"])
    conf = got.where("path RLIKE '(^|/)conftest[.]py$'").select(F.regexp_replace("path", "conftest[.]py$", "").alias("dir"), F.col("dist").alias("cd"))
    under = all_.where("test AND NOT path RLIKE '(^|/)(conftest|__init__)[.]py$'")
    # conf is at most a handful of directories.
    spread = under.join(conf, F.startswith(under["path"], conf["dir"])).groupBy("node", "test").agg(F.min("cd").alias("dist"))
    both = got.select("node", "test", "dist").unionByName(spread.select("node", "test", "dist"))
    return both.groupBy("node", "test").agg(F.min("dist").alias("dist")).select("node", "dist", "test")


def diff_items(diffs: dict[str, DataFrame]) -> DataFrame:
    """kind, change, description, members of the rows of set differences (with column change): cycles (members), violations
    (from_layer, to_layer, src, dst), sdp (src, dst) and reach (source, must_reach, module; a null module is a dead rule)."""
    made = {
        "cycles": lambda d: (F.concat(F.lit("cycle of "), _listed("members")), F.col("members")),
        "violations": lambda d: (F.concat_ws("", "src", F.lit(" -> "), "dst", F.lit(" ("), "from_layer", F.lit(" -> "), "to_layer", F.lit(")")), F.array("src", "dst")),
        "sdp": lambda d: (F.concat_ws("", "src", F.lit(" rests on less stable "), "dst"), F.array("src", "dst")),
        "reach": lambda d: (F.when(F.col("module").isNull(), F.concat_ws("", F.lit("rule cannot be checked: "), "source", F.lit(" must reach "), "must_reach")).otherwise(F.concat_ws("", "module", F.lit(" must reach "), "must_reach")), F.array_compact(F.array("module"))),
    }
    out = None
    for kind, df in diffs.items():
        text, members = made[kind](df)
        part = df.select(F.lit(kind).alias("kind"), "change", text.alias("description"), members.cast("array<string>").alias("members"))
        out = part if out is None else out.unionByName(part)
    return out


def headline(changes: dict[str, tuple[int, int]], deltas: dict[str, float]) -> str:
    """One line on a diff: the overall change, the three parts of the score that moved by 0.01 or more, and what was added and
    resolved of each kind (kind: (added, resolved))."""
    moved = [f"{k} {v:+.2f}" for k, v in deltas.items() if k != "overall" and abs(v) >= 0.01]
    score = f"score {deltas['overall']:+.3f}" + (f" ({', '.join(moved[:3])})" if moved else "") if "overall" in deltas else "no score to compare"
    return "; ".join([score, *(f"{k} +{a}/-{r}" for k, (a, r) in changes.items() if a or r)])


def _listed(members: str, most: int = 5) -> Column:
    more = F.size(members) - most
    return F.concat(F.array_join(F.slice(members, 1, most), ", "), F.when(more > 0, F.concat_ws("", F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def diff_summary(items: DataFrame, member_risk: DataFrame, deltas: dict[str, float], top_n: int = 10, change: str | None = None) -> DataFrame:
    """kind, description, risk of a diff's findings: items (kind, description, members) at the greatest risk of their members
    (node, risk; 0 if unknown), and score parts at five times their change, within 1. Riskiest first, then by description.
    With change "added" (regressions) or "resolved" (improvements) only such items and drops or gains of the score count."""
    if top_n < 1:
        raise ValueError("top_n is at least 1")
    if change is not None:
        items = items.where(F.col("change") == change)
        deltas = {k: v for k, v in deltas.items() if (v < 0) == (change == "added")}
    r = member_risk.select("node", "risk")
    e = items.select("kind", "description", F.explode_outer("members").alias("m"))
    per = e.join(r, e["m"] == r["node"], "left").groupBy("kind", "description").agg(F.coalesce(F.max("risk"), F.lit(0.0)).alias("risk"))
    least = 0.01 if change is None else 0.0
    moved = [("score", f"{k} {v:+.3f}", min(1.0, 5 * abs(v))) for k, v in deltas.items() if v and abs(v) >= least]
    if moved:
        per = per.unionByName(items.sparkSession.createDataFrame(moved, "kind string, description string, risk double"))
    return per.orderBy(F.desc("risk"), "description").limit(top_n)


def near_names(names: DataFrame, wanted: str, floor: float = 0.8, margin: float = 0.1, limit: int = 5) -> list[str]:
    """suggestions() over a table of names (node), compared where they are; only the best come to the driver."""
    inside = names.where(F.col("node").contains(wanted)).select("node").distinct().orderBy("node").limit(limit).collect()
    if inside:
        return [r["node"] for r in inside]

    def like(batches):
        for pdf in batches:
            yield pdf.assign(s=[difflib.SequenceMatcher(None, wanted, n).ratio() for n in pdf["node"]])

    scored = names.select(F.col("node").cast("string").alias("node")).distinct().mapInPandas(like, "node string, s double").where(F.col("s") >= floor)
    best = [(-r["s"], r["node"]) for r in scored.orderBy(F.desc("s"), "node").limit(limit).collect()]
    return [n for s, n in best if -s >= -best[0][0] - margin]


def suggestions(names: list[str], wanted: str, floor: float = 0.8, margin: float = 0.1, limit: int = 5) -> list[str]:
    """Known names near a wanted one: those that contain it first, else the most similar within margin of the best."""
    inside = sorted(n for n in names if wanted in n)
    if inside:
        return inside[:limit]
    scored = sorted(((-difflib.SequenceMatcher(None, wanted, n).ratio(), n) for n in names))
    best = -scored[0][0] if scored else 0
    return [n for s, n in scored if -s >= floor and -s >= best - margin][:limit]


def path_hints(modules: DataFrame, wanted: str) -> list[str]:
    """Paths of modules (node, path) near a path that is none. The path is read as a module name, without the folders that the
    layout puts ahead of names; that lead is learnt from the modules, the longest that fits counts."""
    if not wanted.endswith(".py"):
        return []
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.py$", ""), "(^|/)__init__$", "")
    named = modules.where("path IS NOT NULL").select("node", "path", bare(F.col("path")).alias("b"), F.translate("node", ".", "/").alias("n"))
    lead = named.where(F.col("b").endswith(F.col("n"))).select(F.expr("substring(b, 1, length(b) - length(n))").alias("lead")).distinct()
    fits = lead.where(F.startswith(F.lit(wanted), F.col("lead"))).orderBy(F.desc(F.length("lead"))).limit(1).collect()
    name = re.sub(r"(^|/)__init__$", "", wanted[: -len(".py")])[len(fits[0]["lead"]) if fits else 0 :].replace("/", ".")
    found = near_names(named.select("node"), name)
    at = {r["node"]: r["path"] for r in named.where(F.col("node").isin(found)).select("node", "path").collect()} if found else {}
    return [at[n] for n in found]


def smells(facts: DataFrame, args: int = 6, lines: int = 100, nesting: int = 4, cyclomatic: int = 10) -> DataFrame:
    """module, qualified_name, and what a function has too much of."""
    f = facts.select(F.col("qualname").alias("module"), F.explode("functions").alias("f")).select("module", "f.*")
    tests = {"many_args": F.col("n_args") > args, "long": F.col("end_line") - F.col("line") + 1 > lines, "deep": F.col("nesting") > nesting, "complex": F.col("cyclomatic") > cyclomatic}
    return f.select("module", "qualified_name", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()])).alias("smells")).where(F.size("smells") > 0)


def hint_coverage(facts: DataFrame) -> DataFrame:
    """hinted, places, coverage: annotated arguments and results over all."""
    f = facts.select(F.explode("functions").alias("f")).agg(F.sum("f.n_hinted").alias("hinted"), F.sum(F.col("f.n_args") + 1).alias("places"))
    return f.select(F.coalesce("hinted", F.lit(0)).alias("hinted"), F.coalesce("places", F.lit(0)).alias("places"), F.coalesce(F.try_divide("hinted", "places"), F.lit(0.0)).alias("coverage"))


def classes(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("qualname").alias("module"), F.explode("classes").alias("c")).select("module", "c.*")


def model_census(facts: DataFrame, base: str = "BaseModel") -> DataFrame:
    """models, frozen, tuple_fields, list_fields of the classes that derive from base over any number of steps."""
    from .census import base_family

    c = classes(facts)
    pairs = c.select(F.col("name").alias("cls"), F.explode("bases").alias("b")).select("cls", F.element_at(F.split("b", r"\."), -1).alias("base"))
    family = base_family(pairs, base).where(F.col("cls") != base).select(F.col("cls").alias("k"))
    return c.join(family, c["name"] == family["k"], "left_semi").agg(F.count("*").alias("models"), F.count_if("frozen").alias("frozen"), F.coalesce(F.sum("n_tuple"), F.lit(0)).alias("tuple_fields"), F.coalesce(F.sum("n_list"), F.lit(0)).alias("list_fields"))


def shared_constants(facts: DataFrame, min_count: int = 2) -> DataFrame:
    """name, n, distribution of constants that classes set under one name."""
    from .census import value_distribution

    return value_distribution(facts.select(F.explode("constants").alias("c")).select("c.name", "c.value"), min_count)


def export_gaps(facts: DataFrame) -> DataFrame:
    """module, missing: names that __all__ lists and the module neither defines nor imports."""
    listed = facts.select("qualname", F.explode("assigned").alias("a")).where("a.name = '__all__'").select(F.col("qualname").alias("module"), F.explode("a.listed").alias("name"))
    has = F.array_union(F.array_union(F.transform("functions", lambda f: f["name"]), F.transform("classes", lambda c: c["name"])), F.array_union(F.transform("assigned", lambda a: a["name"]), F.flatten(F.transform("imports", lambda i: F.transform(i["names"], lambda n: n["alias"])))))
    own = facts.select(F.col("qualname").alias("m"), F.explode(has).alias("n"))
    return listed.join(own, (listed["module"] == own["m"]) & (listed["name"] == own["n"]), "left_anti").groupBy("module").agg(F.sort_array(F.collect_list("name")).alias("missing"))


def errors_census(facts: DataFrame) -> DataFrame:
    """error, places, modules of raised errors."""
    e = facts.select(F.col("qualname").alias("module"), F.explode("raised").alias("r"))
    return e.groupBy(F.col("r.error").alias("error")).agg(F.count("*").alias("places"), F.count_distinct("module").alias("modules"))


def module_view(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """node, imports, imported_by of one module; an unknown name is refused with the names near it."""
    one = nodes.where(F.col("node") == name)
    if one.isEmpty():
        near = near_names(nodes, name)
        raise ValueError(f"no module {name!r}" + (f"; near: {', '.join(near)}" if near else ""))
    both = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return both.agg(F.lit(name).alias("node"), F.sort_array(F.collect_set(F.when(F.col("src") == name, F.col("dst")))).alias("imports"), F.sort_array(F.collect_set(F.when(F.col("dst") == name, F.col("src")))).alias("imported_by"))


def header_facts(edges: DataFrame, layered: DataFrame) -> DataFrame:
    """node, layer, imports, imported_by: what a derived module header says."""
    o = edges.groupBy(F.col("src").alias("o")).agg(F.sort_array(F.collect_set("dst")).alias("imports"))
    i = edges.groupBy(F.col("dst").alias("i")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"))
    j = layered.join(o, layered["node"] == o["o"], "left").join(i, layered["node"] == i["i"], "left")
    none = F.array().cast("array<string>")
    return j.select("node", "layer", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def top_risks(risk: DataFrame, k: int = 5) -> DataFrame:
    w = Window.orderBy(F.desc("risk"), "node")
    return risk.orderBy(F.desc("risk"), "node").limit(k).withColumn("rank", F.row_number().over(w))
