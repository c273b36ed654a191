"""Queries of parsing, resolution, contracts, snapshots and deltas: over a generated package, and over the trade graph under
dotted names (r<region>.n<nation>)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behavior, census, contracts, research, resolve, rules
from ..operators import graph as g
from ..sources import tree
from . import fixtures as x
from .queries_relations import FORBID, LAYERED, SNAP, forbid, halves, layered

Q, S = {}, {}


def q(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)


@q("s4_parse", f"WITH {x.GEN} SELECT 'gen.m' || k AS qualname, 2 + 2 * (z % 2 = 0)::INTEGER AS imports, (z % 2 = 0)::INTEGER AS guarded, z % 5 + 1 + (z % 3 = 0)::INTEGER AS calls, z % 3 = 0 AS main, 1 + 2 * (z % 5) AS cyclomatic FROM gen")
def _(s, d):
    f = tree.parsed(x.sources(s, d)).where("NOT is_package")
    return f.select("qualname", F.size("imports").alias("imports"), F.size(F.filter("imports", lambda i: i["type_checking"])).alias("guarded"), F.size("calls").alias("calls"), F.col("has_main_guard").alias("main"), F.get("functions", F.lit(0))["cyclomatic"].alias("cyclomatic"))


@q("g1_module_graph", f"WITH {x.GEN}, e AS (SELECT k, 'os' AS dst, false AS tc, 0 AS c FROM gen UNION ALL SELECT k, 'typing', false, 0 FROM gen WHERE z % 2 = 0 UNION ALL SELECT k, 'gen.m' || t, false, z % 5 + 1 FROM gen UNION ALL SELECT k, 'gen.m' || u, true, 0 FROM gen WHERE z % 2 = 0 AND u <> t) SELECT 'gen.m' || k AS src, dst, tc AS type_checking_only, c::BIGINT AS call_count FROM e")
def _(s, d):
    return resolve.module_graph(tree.parsed(x.sources(s, d)))[1].select("src", "dst", "type_checking_only", "call_count")


@q("s10_entrypoints", f"WITH {x.GEN} SELECT 'gen.m' || k AS qualname, CASE WHEN z % 3 = 0 THEN 'main guard' ELSE 'script go' END AS reason FROM gen WHERE z % 3 = 0 OR k = 4")
def _(s, d):
    return tree.entrypoints(tree.parsed(x.sources(s, d)), [("go", "gen.m4"), ("outer", "gen.gone")])


@q("s20_refresh", f"WITH {x.GEN} SELECT 'gen.m' || k AS qualname, z % 3 = 0 AS main FROM gen UNION ALL SELECT 'gen', false")
def _(s, d):
    found = x.sources(s, d)
    cache = tree.refresh(found, tree.parsed(found.limit(0)).withColumn("sha", F.lit("")))
    # Half of the cache is stale, and is parsed anew.
    old = cache.withColumn("sha", F.when(F.col("has_main_guard"), F.lit("old")).otherwise(F.col("sha")))
    return tree.refresh(found, old).select("qualname", F.col("has_main_guard").alias("main"))


@q("t20_hint_coverage", f"WITH {x.GEN} SELECT 0::BIGINT AS hinted, 3 * count(*) AS places, 0.0 AS coverage FROM gen")
def _(s, d):
    return contracts.hint_coverage(tree.parsed(x.sources(s, d)))


NAMED = f"{x.F1}, nm AS (SELECT n_nationkey::BIGINT AS k, 'r' || n_regionkey || '.n' || n_nationkey AS node, n_regionkey AS r FROM nation), e AS (SELECT a.node AS src, b.node AS dst, call_count, a.r AS ra, b.r AS rb FROM trade JOIN nm a ON src = a.k JOIN nm b ON dst = b.k)"
CLO = f"WITH RECURSIVE {NAMED}, clo AS (SELECT src, dst FROM e UNION SELECT clo.src, e.dst FROM clo JOIN e ON clo.dst = e.src)"


def named(s, d):
    n = x.nations(s, d).select("node", F.concat(F.lit("r"), F.col("grp").cast("string"), F.lit(".n"), F.col("node").cast("string")).alias("name"))
    a, b = n.select(F.col("node").alias("ka"), F.col("name").alias("a")), n.select(F.col("node").alias("kb"), F.col("name").alias("b"))
    e = x.trade_graph(s, d)
    return n.select(F.col("name").alias("node")), e.join(a, e["src"] == a["ka"]).join(b, e["dst"] == b["kb"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), "call_count")


def dist_to(targets: str, sources: str) -> str:
    """Sources that reach a target, with the number of edges."""
    sources = f"split_part(node, '.', 1) = '{sources}'"
    return f"WITH RECURSIVE {NAMED}, w AS (SELECT node, 0 AS n FROM nm WHERE {targets} UNION SELECT src, n + 1 FROM w JOIN e ON dst = node WHERE n < 25) SELECT node AS source, min(n) AS dist FROM w WHERE {sources} GROUP BY 1 HAVING min(n) > 0"


def chained(df):
    return df.select("source", (F.size("chain") - 1).alias("dist"))


@q("r6_forbidden", dist_to("r = 1", "r0"))
def _(s, d):
    return chained(contracts.forbidden(*named(s, d), ["r0.**"], ["r1.**"]))


@q("r6_layered", "SELECT * FROM (" + dist_to("r = 0", "r1") + ") UNION ALL SELECT * FROM (" + dist_to("r IN (0, 1)", "r2") + ")")
def _(s, d):
    return chained(contracts.layered(*named(s, d), [["r0.**"], ["r1.**"], ["r2.**"]]))


@q("r6_independent", "SELECT * FROM (" + dist_to("r = 3", "r2") + ") UNION ALL SELECT * FROM (" + dist_to("r = 2", "r3") + ")")
def _(s, d):
    return chained(contracts.independent(*named(s, d), [["r2.**"], ["r3.**"]]))


@q("r6_protected", f"WITH {NAMED} SELECT src, dst FROM e WHERE rb = 1 AND ra NOT IN (1, 2)")
def _(s, d):
    return contracts.protected(*named(s, d), ["r1.**"], ["r2.*"])


@q("r6_sibling_cycles", f"WITH RECURSIVE {NAMED}, c AS (SELECT DISTINCT 'r' || ra AS a, 'r' || rb AS b FROM e WHERE ra <> rb), clo AS (SELECT a, b FROM c UNION SELECT clo.a, c.b FROM clo JOIN c ON clo.b = c.a), m AS (SELECT p.a AS node, min(p.b) AS low, list(DISTINCT p.b ORDER BY p.b) AS l FROM clo p JOIN clo o ON p.a = o.b AND p.b = o.a WHERE p.a <> p.b OR p.a = p.b GROUP BY 1) SELECT DISTINCT array_to_string(l, ',') AS members FROM m WHERE len(l) > 1")
def _(s, d):
    n, e = named(s, d)
    inside = lambda c: F.concat(F.lit("all."), F.col(c))
    return contracts.sibling_cycles(n.select(inside("node").alias("node")), e.select(inside("src").alias("src"), inside("dst").alias("dst"), "call_count"), "all").select(F.array_join("members", ",").alias("members"))


@q("r7_vacuity", "SELECT 'r9.**' AS pattern UNION ALL SELECT 'r0.*.x'")
def _(s, d):
    n, _ = named(s, d)
    return s.createDataFrame([(p,) for p in contracts.matched_nothing(n, ["r0.**", "r9.**", "r0.*.x", "r1.n*"])], "pattern string")


@q("g26_affected", f"WITH RECURSIVE {NAMED}, w AS (SELECT node, 0 AS n FROM nm WHERE k IN (1, 2) UNION SELECT src, n + 1 FROM w JOIN e ON dst = node WHERE n < 2) SELECT node, min(n) AS dist, split_part(node, '.', 1) = 'r0' AS test FROM w GROUP BY 1")
def _(s, d):
    n, e = named(s, d)
    path = F.concat(F.when(F.col("node").startswith("r0."), F.lit("tests/")).otherwise(F.lit("src/")), F.translate("node", ".", "/"), F.lit(".py"))
    m = n.withColumn("path", path)
    changed = m.where(F.col("node").endswith(".n1") | F.col("node").endswith(".n2")).select("path")
    return contracts.affected(m, e, changed, 2)


@q("g28_near_names", f"WITH {NAMED} SELECT node FROM nm WHERE contains(node, '.n1') ORDER BY node LIMIT 5")
def _(s, d):
    return s.createDataFrame([(n,) for n in contracts.near_names(named(s, d)[0], ".n1")], "node string")


@q("g22_header_facts", f"WITH {NAMED} SELECT node, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = node), '') AS imports, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = node), '') AS imported_by FROM nm")
def _(s, d):
    n, e = named(s, d)
    return contracts.header_facts(e, n.withColumn("layer", F.lit(None).cast("string"))).select("node", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"))


@q("t18_sibling_reach", CLO + ", kid AS (SELECT node, 'r' || r AS package, count(*) OVER (PARTITION BY r) AS n FROM nm), h AS (SELECT package, n, clo.dst, string_agg(DISTINCT node, ',' ORDER BY node) AS st, count(DISTINCT node) AS k FROM kid JOIN clo ON node = clo.src WHERE split_part(clo.dst, '.', 1) <> package GROUP BY 1, 2, 3), c AS (SELECT package, n, k, st, count(*) AS targets FROM h GROUP BY 1, 2, 3, 4) SELECT package, n AS siblings, k AS reaching, targets, CASE WHEN k / n BETWEEN 0.2 AND 0.9 AND least(k, n - k) >= 1 THEN 'fired' ELSE 'control' END AS kind FROM c WHERE (k / n BETWEEN 0.2 AND 0.9 AND least(k, n - k) >= 1) OR k / n < 0.2")
def _(s, d):
    n, e = named(s, d)
    # The packages themselves are modules too, without edges.
    every = n.unionByName(n.select(F.substring_index("node", ".", 1).alias("node")).distinct())
    return research.sibling_reach(every, g.closure(e), min_siblings=2, band=(0.2, 0.9), min_side=1)


DET = "o AS (SELECT node, (SELECT count(*) FROM e WHERE src = node AND rb < 3) AS within, (SELECT count(*) FROM e WHERE src = node AND rb >= 3) AS outside, (SELECT count(*) FROM e WHERE src = node AND rb < 3 AND dst <> node) AS far, EXISTS (SELECT 1 FROM e WHERE src = node AND rb = 3) AS infra, EXISTS (SELECT 1 FROM e WHERE dst = node AND ra < 3) AS used FROM nm WHERE r < 3)"


@q("t19_detectors", f"WITH {NAMED}, {DET}, f AS (SELECT *, outside = 0 AS purity, node LIKE '%.n1' OR node LIKE '%.n2' AS naming, used AND within = 0 AS position, used AND far = 0 AS relaxed FROM o) SELECT 'purity' AS detector, count(*) FILTER (purity) AS domain, count(*) FILTER (purity AND infra) AS violations FROM f UNION ALL SELECT 'naming', count(*) FILTER (naming), count(*) FILTER (naming AND infra) FROM f UNION ALL SELECT 'position', count(*) FILTER (position), count(*) FILTER (position AND infra) FROM f UNION ALL SELECT 'relaxed', count(*) FILTER (relaxed), count(*) FILTER (relaxed AND infra) FROM f")
def _(s, d):
    n, e = named(s, d)
    return research.domain_detectors(n.where("node < 'r3'"), e, ["r3"], ["n1", "n2"])


@q("t24_clone_recall", "SELECT * FROM (VALUES ('identical', 2, 2, 2), ('renamed', 2, 2, 2), ('inserted', 2, 0, 1), ('deleted', 1, 0, 1), ('reordered', 1, 0, 1), ('flipped', 2, 0, 1)) v(variant, clones, exact, near)")
def _(s, d):
    long = "def f(a, b):\n    total = a + b\n" + "".join(f"    if a > {k}:\n        total = total * b\n" for k in range(8)) + "    return total\n"
    return research.clone_recall(s, [long, "def g(a):\n    return a + 1\n"])


# Changes of findings.


@q("u2_reach_diff", "WITH o AS (SELECT 'r' || o_custkey % 9 AS rule, 'm' || o_custkey % 97 AS m, o_orderpriority[1] <= '3' AS old FROM orders), b AS (SELECT DISTINCT rule, m FROM o WHERE old), a AS (SELECT DISTINCT rule, m FROM o WHERE NOT old AND rule <> 'r4' UNION SELECT 'r4', NULL) SELECT rule AS source, m AS module, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT rule, m, 'resolved' FROM (FROM b EXCEPT FROM a) WHERE rule <> 'r4'")
def _(s, d):
    o = x.table(s, d, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 9).cast("string")).alias("source"), F.lit("").alias("within"), F.lit("t").alias("must_reach"), F.concat(F.lit("m"), (F.col("o_custkey") % 97).cast("string")).alias("module"), (F.substring("o_orderpriority", 1, 1) <= "3").alias("old"))
    dead = s.createDataFrame([("r4", "", "t", None)], "source string, within string, must_reach string, module string")
    return rules.reach_diff(o.where("old").drop("old"), o.where("NOT old AND source <> 'r4'").drop("old").unionByName(dead)).select("source", "module", "change")


@q("r14_closing_edges", f"WITH {SNAP}, base AS (SELECT DISTINCT src % 5 AS scc, src AS node FROM e WHERE half = 0 AND src < 30), cur AS (SELECT DISTINCT src % 4 AS scc, src AS node FROM e), w AS (SELECT a.scc, e.src, e.dst, NOT EXISTS (SELECT 1 FROM e o WHERE o.half = 0 AND o.src = e.src AND o.dst = e.dst) AND NOT coalesce((SELECT scc FROM base WHERE node = e.src) = (SELECT scc FROM base WHERE node = e.dst), false) AS closes FROM (SELECT DISTINCT src, dst FROM e WHERE half = 1) e JOIN cur a ON e.src = a.node JOIN cur b ON e.dst = b.node AND a.scc = b.scc) SELECT scc, src, dst FROM w WHERE closes OR scc NOT IN (SELECT scc FROM w WHERE closes)")
def _(s, d):
    old, new = halves(s, d)
    scc = lambda df, k: df.select((F.col("src") % k).alias("scc"), F.col("src").alias("node")).distinct()
    return rules.closing_edges(scc(old.unionByName(new), 4), new, scc(old.where("src < 30"), 5), old)


VIO = f"v AS (SELECT fl AS from_layer, tl AS to_layer, src, dst FROM trade JOIN n a ON src = a.node JOIN n b ON dst = b.node JOIN f ON a.layer = fl AND b.layer = tl)"


@q("r15_ratchet_violations", f"WITH {LAYERED}, {FORBID}, {VIO} SELECT *, src < 12 AS carried FROM v")
def _(s, d):
    v = rules.violations(x.trade_graph(s, d), layered(s, d), forbid(s, d))
    return rules.ratchet_violations(v.where("src < 12"), v)


@q("r15_ungoverned", f"WITH {LAYERED}, {FORBID}, {VIO} SELECT * FROM v WHERE src <> 7 AND dst <> 7 AND (from_layer = 'AFRICA' OR src = 6 OR dst = 6)")
def _(s, d):
    lay, f = layered(s, d), forbid(s, d)
    v = rules.violations(x.trade_graph(s, d), lay, f)
    moved = lay.withColumn("layer", F.when(F.col("node") == 6, F.lit("ELSEWHERE")).otherwise(F.col("layer")))
    return rules.ungoverned(v, x.nations(s, d).where("node <> 7"), moved, f.where("from_layer <> 'AFRICA'"))


@q("r21_improvements", f"WITH {SNAP}, a AS (SELECT DISTINCT src, dst FROM e WHERE half = 0), b AS (SELECT DISTINCT src, dst FROM e WHERE half = 1), z AS (FROM a EXCEPT FROM b) SELECT 'sdp' AS kind, src || ' rests on less stable ' || dst AS description, greatest(src, dst) / 100 AS risk FROM z ORDER BY risk DESC, description LIMIT 10")
def _(s, d):
    text = lambda df: df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    old, new = halves(s, d)
    risk = s.range(100).select(F.col("id").cast("string").alias("node"), (F.col("id") / 100).alias("risk"))
    items = contracts.diff_items({"sdp": rules.set_diff(text(old), text(new), ["src", "dst"])})
    return contracts.diff_summary(items, risk, {"depth": -0.5}, 10, "resolved")


DELTA = f"{x.F1}, ad AS (SELECT DISTINCT c_custkey % 27 AS src, c_nationkey::BIGINT AS dst FROM customer), rm AS (SELECT DISTINCT s_suppkey % 26 AS src, s_nationkey::BIGINT AS dst FROM supplier), op AS (SELECT 'add' AS op, * FROM ad UNION ALL SELECT 'remove', * FROM rm), oc AS (SELECT op, src, dst, CASE WHEN src > 24 OR dst > 24 THEN 'skipped' WHEN (src, dst) IN (FROM ad) AND (src, dst) IN (FROM rm) THEN 'rejected' WHEN (op = 'add') = ((src, dst) IN (SELECT (src, dst) FROM trade)) THEN 'no_op' ELSE 'applied' END AS outcome FROM op)"


def delta(s, d):
    c, p = x.table(s, d, "customer"), x.table(s, d, "supplier")
    return c.select((F.col("c_custkey") % 27).alias("src"), F.col("c_nationkey").cast("long").alias("dst")), p.select((F.col("s_suppkey") % 26).alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


@q("g32_outcomes", f"WITH {DELTA} SELECT op, src, dst, outcome FROM oc")
def _(s, d):
    return rules.classify_delta(x.trade_graph(s, d), x.nations(s, d), *delta(s, d))


@q("g32_coverage", f"WITH {DELTA} SELECT count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'no_op') AS no_op, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'skipped') AS skipped, CASE WHEN bool_and(outcome <> 'skipped') THEN 'complete' WHEN bool_or(outcome IN ('applied', 'no_op')) THEN 'partial' ELSE 'none' END AS coverage FROM oc")
def _(s, d):
    return rules.delta_coverage(rules.classify_delta(x.trade_graph(s, d), x.nations(s, d), *delta(s, d)))


@q("g32_after", f"WITH {DELTA} SELECT src, dst FROM trade WHERE (src, dst) NOT IN (SELECT (src, dst) FROM oc WHERE op = 'remove' AND outcome = 'applied') UNION SELECT src, dst FROM oc WHERE op = 'add' AND outcome = 'applied'")
def _(s, d):
    known = lambda df: g.induced(df, x.nations(s, d))
    add, remove = delta(s, d)
    return rules.simulate(x.trade_graph(s, d), known(add), known(remove)).select("src", "dst")


@q("u8_ordered_distinct", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1")
def _(s, d):
    o = x.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first"))
    return rules.ordered_distinct(o, ["o_custkey"], "first")


@q("u6_agreement", "SELECT doc_id AS id, quality = 1 AND toxic = 0 AS agreed FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(s, d):
    of = lambda c, good: x.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col(c).isNull(), "UNSCORABLE").when(F.col(c) == good, "TRUE").otherwise("FALSE").alias("label"))
    return research.agreed(of("quality", 1), of("toxic", 0))


@q("r4_external_coverage", f"WITH {LAYERED}, {FORBID}, l AS (SELECT node, CASE WHEN layer <> 'ASIA' THEN layer END AS layer FROM n WHERE node < 20), w AS (SELECT node, layer FROM n WHERE node >= 20 AND layer <> 'EUROPE') SELECT (SELECT count(*) FROM l) AS modules, (SELECT count(layer) FROM l) AS layered, count(*) FILTER (a.node IS NOT NULL AND b.node IS NOT NULL) AS edges, count(*) FILTER (a.layer IS NOT NULL AND b.layer IS NOT NULL) AS governed, count(*) FILTER (a.layer IS NOT NULL AND w.node IS NOT NULL) AS external_governed FROM trade LEFT JOIN l a ON src = a.node LEFT JOIN l b ON dst = b.node LEFT JOIN w ON dst = w.node")
def _(s, d):
    lay = layered(s, d)
    inside = lay.where("node < 20").withColumn("layer", F.when(F.col("layer") != "ASIA", F.col("layer")))
    out = lay.where("node >= 20").withColumn("layer", F.when(F.col("layer") != "EUROPE", F.col("layer")))
    return rules.coverage(x.trade_graph(s, d), inside, forbid(s, d), out).select("modules", "layered", "edges", "governed", "external_governed")


@q("r4_pattern_hints", f"WITH {NAMED} SELECT 'a' AS layer, 'r0' AS pattern, 'r0.**' AS suggestion, count(*) AS n FROM nm WHERE r = 0 HAVING count(*) > 0")
def _(s, d):
    lay = rules.assign_layers(named(s, d)[0].withColumn("name", F.col("node")), {"a": ["r0"], "b": ["r1.**"]}).select("node", "layer")
    return rules.exact_pattern_hints(lay, {"a": ["r0"], "b": ["r1.**"]})


@q("a7_fold_renames", "WITH RECURSIVE r AS (SELECT s_suppkey AS o, CASE WHEN s_suppkey % 40 = 39 THEN s_suppkey - 39 + 40 ELSE s_suppkey + 1 END AS n FROM supplier WHERE s_suppkey % 40 <> 0), w AS (SELECT o AS p, n AS last FROM r UNION SELECT p, n FROM w JOIN r ON last = o), l AS (SELECT p, max(last) AS last FROM w GROUP BY 1), c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS f FROM lineitem) SELECT coalesce(last, f) AS path, count(DISTINCT k) AS churn FROM c LEFT JOIN l ON f = p GROUP BY 1")
def _(s, d):
    k = F.col("s_suppkey")
    r = x.table(s, d, "supplier").where(k % 40 != 0).select(k.alias("old_path"), (k + 1).alias("new_path"))
    return behavior.churn_counts(behavior.fold_renames(x.order_suppliers(s, d).withColumnRenamed("file", "path"), r))


@q("c2_base_family", "WITH RECURSIVE e AS (SELECT 'k' || o_orderkey AS cls, 'k' || o_custkey AS base FROM orders), w AS (SELECT 'k1' AS cls UNION SELECT e.cls FROM w JOIN e ON e.base = w.cls) SELECT cls FROM w")
def _(s, d):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    return census.base_family(x.table(s, d, "orders").select(key("o_orderkey").alias("cls"), key("o_custkey").alias("base")), "k1")


@q("c5_helpers", "WITH p AS (SELECT p_brand AS module, split_part(p_name, ' ', 1) AS stem, split_part(p_name, ' ', 2) AS tail FROM part) SELECT module, stem, string_agg(DISTINCT tail, ',' ORDER BY tail) AS surfaces FROM p GROUP BY 1, 2 HAVING count(DISTINCT tail) >= 2")
def _(s, d):
    p = x.table(s, d, "part").select(F.col("p_brand").alias("module"), F.translate("p_name", " ", "_").alias("name"))
    return census.helper_families(p).withColumn("surfaces", F.array_join("surfaces", ","))


@q("c5_mirrored", "SELECT p_name AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS surfaces FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def _(s, d):
    p = x.table(s, d, "part").select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"))
    return census.mirrored_families(p).withColumn("surfaces", F.array_join("surfaces", ","))


@q("x1_camel_suffix", "SELECT p_partkey, upper(split_part(p_name, ' ', -1)[1]) || split_part(p_name, ' ', -1)[2:] AS suffix FROM part")
def _(s, d):
    return x.table(s, d, "part").select("p_partkey", census.camel_suffix(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("suffix"))
