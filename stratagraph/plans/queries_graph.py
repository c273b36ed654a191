"""Queries of graph operators over the fixture graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import rules
from . import fixtures as x
from .iterate import cut

Q, S = {}, {}


def q(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)

NODES = "SELECT s_suppkey AS node, s_nationkey::BIGINT AS grp FROM supplier"
SCC = x.CLOSURE + f""", n AS ({NODES}), mutual AS (SELECT a.src AS node, min(a.dst) AS low FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
sc AS (SELECT n.node, least(coalesce(low, n.node), n.node) AS scc, low IS NOT NULL AS cyclic FROM n LEFT JOIN mutual ON n.node = mutual.node)"""


@q("g15_instability", f"WITH {x.F1}, o AS (SELECT src, count(*) AS ce FROM trade GROUP BY 1), i AS (SELECT dst, count(*) AS ca FROM trade GROUP BY 1) SELECT n_nationkey::BIGINT AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) END, 6) AS instability FROM nation LEFT JOIN o ON src = n_nationkey LEFT JOIN i ON dst = n_nationkey")
def _(s, d):
    return g.instability(x.nations(s, d), x.trade_graph(s, d)).withColumn("instability", r6("instability"))


@q("a5_degrees", f"WITH {x.F4}, n AS (SELECT src AS node FROM ev UNION SELECT dst FROM ev) SELECT node, (SELECT count(*) FROM ev WHERE dst = node) AS fan_in, (SELECT count(*) FROM ev WHERE src = node) AS fan_out FROM n")
def _(s, d):
    e = x.event_graph(s, d)
    return g.degrees(g.nodes_of(e), e)


@q("a6_gini", "WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini FROM r GROUP BY 1")
def _(s, d):
    return g.gini(x.table(s, d, "part"), "p_retailprice", ["p_brand"]).withColumn("gini", r6("gini"))


@q("g19_equality", f"WITH {x.F2}, o AS (SELECT s_suppkey, (SELECT count(*) FROM sup WHERE src = s_suppkey) AS v FROM supplier), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM o) SELECT round(1 - sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS equality FROM r")
def _(s, d):
    return g.gini(g.degrees(x.suppliers(s, d), x.supplier_graph(s, d)), "fan_out").select(r6(1 - F.col("gini")).alias("equality"))


@q("g4_closure", x.CLOSURE + " SELECT src, dst FROM clo")
def _(s, d):
    return g.closure(x.supplier_graph(s, d))


@q("g5_propagation", x.CLOSURE + f", n AS ({NODES}), a AS (SELECT dst, count(*) AS k FROM clo WHERE src <> dst GROUP BY 1) SELECT node, coalesce(k, 0) + 1 AS reached_by, round((coalesce(k, 0) + 1) / (SELECT count(*) FROM n), 6) AS propagation FROM n LEFT JOIN a ON node = dst")
def _(s, d):
    return g.propagation(x.suppliers(s, d), g.closure(x.supplier_graph(s, d))).withColumn("propagation", r6("propagation"))


@q("g8_scc_closure", SCC + " SELECT * FROM sc")
def _(s, d):
    e = x.supplier_graph(s, d)
    return g.scc(x.suppliers(s, d), e, g.closure(e))


@q("g8_scc_colouring", SCC + " SELECT * FROM sc")
def _(s, d):
    return g.scc(x.suppliers(s, d), x.supplier_graph(s, d), most=0)


@q("g8_scc", SCC + " SELECT * FROM sc")
def _(s, d):
    return g.scc(x.suppliers(s, d), x.supplier_graph(s, d))


@q("g4_closure_doubling", x.CLOSURE + " SELECT src, dst FROM clo")
def _(s, d):
    return g.closure(x.supplier_graph(s, d), most=0)


@q("g8_cycles", SCC + ", e AS (SELECT s1.scc, count(*) AS n_edges FROM sup JOIN sc s1 ON src = s1.node JOIN sc s2 ON dst = s2.node WHERE s1.scc = s2.scc GROUP BY 1) SELECT sc.scc, string_agg(node::VARCHAR, ',' ORDER BY node) AS members, count(*) AS size, max(n_edges) AS n_edges FROM sc JOIN e ON sc.scc = e.scc WHERE cyclic GROUP BY 1")
def _(s, d):
    e = x.supplier_graph(s, d)
    return g.cycles(g.scc(x.suppliers(s, d), e), e).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@q("g9_condensation", SCC + " SELECT DISTINCT a.scc AS src, b.scc AS dst FROM sup JOIN sc a ON src = a.node JOIN sc b ON dst = b.node WHERE a.scc <> b.scc")
def _(s, d):
    e = x.supplier_graph(s, d)
    return g.condensation(g.scc(x.suppliers(s, d), e), e)


@q("g18_acyclicity", SCC + " SELECT count(*) FILTER (cyclic) AS tangled, round(1 - count(*) FILTER (cyclic) / count(*), 6) AS acyclicity FROM sc")
def _(s, d):
    return g.scc(x.suppliers(s, d), x.supplier_graph(s, d)).agg(F.count_if("cyclic").alias("tangled"), r6(1 - F.count_if("cyclic") / F.count("*")).alias("acyclicity"))


DEEP = "WITH RECURSIVE " + x.F3 + f", n AS ({NODES}), p AS (SELECT node, 0 AS depth FROM n UNION SELECT dst, depth + 1 FROM p JOIN dag ON src = node)"


@q("g11_depths", DEEP + " SELECT node, max(depth) AS depth FROM p GROUP BY 1")
def _(s, d):
    return g.depths(x.suppliers(s, d), x.supplier_dag(s, d))


@q("g10_longest_path", DEEP + " SELECT max(depth) AS depth, round(1 / (1 + max(depth) / 8), 6) AS score FROM p")
def _(s, d):
    return g.depths(x.suppliers(s, d), x.supplier_dag(s, d)).agg(F.max("depth").alias("depth")).withColumn("score", r6(1 / (1 + F.col("depth") / 8)))


@q("g6_bounded_ancestors", "WITH RECURSIVE " + x.F2 + ", b AS (SELECT 1::BIGINT AS node, 0 AS dist UNION SELECT src, dist + 1 FROM b JOIN sup ON dst = node WHERE dist < 5) SELECT node, min(dist) AS dist FROM b GROUP BY 1")
def _(s, d):
    return g.reachable(x.supplier_graph(s, d), x.suppliers(s, d).where("node = 1"), reverse=True, depth=5)


@q("f5_focus", "WITH RECURSIVE " + x.F2 + ", b AS (SELECT 1::BIGINT AS node, 0 AS dist UNION SELECT dst, dist + 1 FROM b JOIN sup ON src = node WHERE dist < 2), k AS (SELECT DISTINCT node FROM b) SELECT src, dst, call_count FROM sup WHERE src IN (FROM k) AND dst IN (FROM k)")
def _(s, d):
    return g.focus(x.supplier_graph(s, d), x.suppliers(s, d).where("node = 1"), 2, "out")


@q("f4_focus_both", "WITH RECURSIVE " + x.F2 + ", u AS (SELECT src AS a, dst AS b FROM sup UNION SELECT dst, src FROM sup), b AS (SELECT 1::BIGINT AS node, 0 AS dist UNION SELECT u.b, dist + 1 FROM b JOIN u ON u.a = node WHERE dist < 1), k AS (SELECT DISTINCT node FROM b) SELECT src, dst, call_count FROM sup WHERE src IN (FROM k) AND dst IN (FROM k)")
def _(s, d):
    return g.focus(x.supplier_graph(s, d), x.suppliers(s, d).where("node = 1"), 1)


@q("g7_chains", "WITH RECURSIVE " + x.F2 + ", w AS (SELECT 1::BIGINT AS node, 0 AS n UNION SELECT src, n + 1 FROM w JOIN sup ON dst = node WHERE n < (SELECT count(*) FROM supplier)) SELECT node, min(n) AS dist, min(n) AS edges, 1::BIGINT AS root FROM w GROUP BY 1")
def _(s, d):
    e = x.supplier_graph(s, d)
    c = g.shortest_chains(e, x.suppliers(s, d).where("node = 1"))
    # Of each chain the steps that are edges.
    steps = c.select("node", "dist", "root", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("chain") - 1), lambda k: F.struct(F.get("chain", k).alias("b"), F.get("chain", k + 1).alias("a")))).alias("step"))
    e = e.select(F.col("src").alias("es"), F.col("dst").alias("ed")).withColumn("there", F.lit(1))
    j = steps.join(e, (F.col("step.a") == e["es"]) & (F.col("step.b") == e["ed"]), "left")
    return j.groupBy("node", "dist", "root").agg(F.count("there").cast("int").alias("edges"))


@q("g25_impact", x.CLOSURE + f", n AS ({NODES}), a AS (SELECT DISTINCT src FROM clo WHERE dst IN (1, 2) AND src NOT IN (1, 2)) SELECT 2::BIGINT AS changed, count(*) AS impacted, round((2 + count(*)) / (SELECT count(*) FROM n), 6) AS propagation_cost FROM a")
def _(s, d):
    n = x.suppliers(s, d)
    hit = g.reachable(x.supplier_graph(s, d), n.where("node IN (1, 2)"), reverse=True)
    return hit.agg(F.count_if(F.expr("dist = 0")).alias("changed"), F.count_if(F.expr("dist > 0")).alias("impacted")).crossJoin(n.agg(F.count("*").alias("n"))).select("changed", "impacted", r6((F.col("changed") + F.col("impacted")) / F.col("n")).alias("propagation_cost"))


@q("g16_edit_risk", x.CLOSURE + f""", n AS ({NODES}), a AS (SELECT dst, count(*) AS k FROM clo WHERE src <> dst GROUP BY 1), o AS (SELECT src, count(*) AS ce FROM sup GROUP BY 1), i AS (SELECT dst, count(*) AS ca FROM sup GROUP BY 1)
SELECT node, round(pow((coalesce(k, 0) + 1) / t * coalesce(ca, 0) / (t - 1) * CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) END, 1.0 / 3), 6) AS risk
FROM n LEFT JOIN a ON node = a.dst LEFT JOIN o ON node = o.src LEFT JOIN i ON node = i.dst, (SELECT count(*) AS t FROM n)""")
def _(s, d):
    e = x.supplier_graph(s, d)
    return g.edit_risk(x.suppliers(s, d), e, g.closure(e)).withColumn("risk", r6("risk"))


PR = "WITH RECURSIVE " + x.F1 + """, k AS (SELECT src, count(*) AS k FROM trade GROUP BY 1), n AS (SELECT n_nationkey::BIGINT AS node, k.k FROM nation LEFT JOIN k ON src = n_nationkey),
e AS (SELECT trade.src, dst, k.k FROM trade JOIN k ON trade.src = k.src),
p AS (SELECT 0 AS i, node, 1.0::DOUBLE / 25 AS rank FROM n UNION ALL
 SELECT i + 1, n.node, 0.15 / 25 + 0.85 * (coalesce((SELECT sum(q.rank / e.k) FROM p q JOIN e ON q.node = e.src WHERE e.dst = n.node), 0) + (SELECT coalesce(sum(q.rank), 0) FROM p q JOIN n m ON q.node = m.node WHERE m.k IS NULL) / 25)
 FROM (SELECT DISTINCT i FROM p) z, n WHERE i < 10)
SELECT node, round(rank, 6) AS rank FROM p WHERE i = 10"""


@q("g17_pagerank", PR)
def _(s, d):
    return g.pagerank(x.nations(s, d), x.trade_graph(s, d), iterations=10, tol=0.0).select("node", r6("rank").alias("rank"))


@q("g17_pagerank_rounds", PR)
def _(s, d):
    return g.pagerank(x.nations(s, d), x.trade_graph(s, d), iterations=10, tol=0.0, most=0).select("node", r6("rank").alias("rank"))


MOD = "a AS (SELECT p.grp AS g1, q.grp AS g2, {w} AS w FROM {e} JOIN n p ON src = p.node JOIN n q ON dst = q.node), t AS (SELECT sum(w) AS m, sum(w) FILTER (g1 = g2) AS s FROM a), o AS (SELECT g1, sum(w) AS w FROM a GROUP BY 1), i AS (SELECT g2, sum(w) AS w FROM a GROUP BY 1), z AS (SELECT coalesce(s, 0) / m - (SELECT coalesce(sum(o.w * i.w), 0) FROM o JOIN i ON g1 = g2) / (m * m) AS q FROM t) SELECT round(q, 6) AS q, round(greatest(0, least(1, (q + 0.5) / 1.5)), 6) AS score FROM z"


@q("g13_modularity", f"WITH {x.F1}, n AS (SELECT n_nationkey::BIGINT AS node, n_regionkey AS grp FROM nation), " + MOD.format(w="1.0::DOUBLE", e="trade"))
def _(s, d):
    return g.modularity(x.trade_graph(s, d), x.nations(s, d)).select(r6("q").alias("q"), r6("score").alias("score"))


@q("g14_modularity_weighted", f"WITH {x.F1}, n AS (SELECT n_nationkey::BIGINT AS node, n_regionkey AS grp FROM nation), " + MOD.format(w="greatest(call_count, 1)::DOUBLE", e="trade"))
def _(s, d):
    return g.modularity(x.trade_graph(s, d), x.nations(s, d), weighted=True).select(r6("q").alias("q"), r6("score").alias("score"))


@q("g13_communities")
def _(s, d):
    return g.greedy_communities(x.nations(s, d), x.trade_graph(s, d))


@q("g33_components", "WITH RECURSIVE " + x.F3 + f", n AS ({NODES}), u AS (SELECT src AS a, dst AS b FROM dag UNION SELECT dst, src FROM dag), c AS (SELECT node, node AS m FROM n UNION SELECT u.b, c.m FROM c JOIN u ON c.node = u.a) SELECT node, min(m) AS component FROM c GROUP BY 1")
def _(s, d):
    return g.weak_components(x.suppliers(s, d), x.supplier_dag(s, d))


@q("g33_components_spread", S["g33_components"])
def _(s, d):
    return g.weak_components(x.suppliers(s, d), x.supplier_dag(s, d), most=0)


@q("g11_depths_relaxed", S["g11_depths"])
def _(s, d):
    return g.depths(x.suppliers(s, d), x.supplier_dag(s, d), most=0)


@q("g6_ancestors_rounds", S["g6_bounded_ancestors"])
def _(s, d):
    return g.reachable(x.supplier_graph(s, d), x.suppliers(s, d).where("node = 1"), reverse=True, depth=5, most=0)


@q("g21_score", SCC + f""", co AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM sup JOIN sc a ON src = a.node JOIN sc b ON dst = b.node WHERE a.scc <> b.scc),
p AS (SELECT DISTINCT scc AS node, 0 AS depth FROM sc UNION SELECT co.dst, depth + 1 FROM p JOIN co ON co.src = p.node),
od AS (SELECT s_suppkey, (SELECT count(*) FROM sup WHERE src = s_suppkey) AS v FROM supplier), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM od),
{MOD.format(w="1.0::DOUBLE", e="sup").split(" SELECT round(q, 6)")[0]},
ax AS (SELECT greatest(0, least(1, (q + 0.5) / 1.5)) AS modularity, (SELECT 1 - count(*) FILTER (cyclic) / count(*) FROM sc) AS acyclicity, (SELECT 1 / (1 + max(depth) / 8) FROM p) AS depth, (SELECT 1 - sum((2 * i - n - 1) * v) / (max(n) * sum(v)) FROM r) AS equality FROM z)
SELECT round(modularity, 6) AS modularity, round(acyclicity, 6) AS acyclicity, round(depth, 6) AS depth, round(equality, 6) AS equality, 1.0::DOUBLE AS complexity, round(pow(modularity * acyclicity * depth * equality, 0.2), 6) AS overall FROM ax""")
def _(s, d):
    n, e = x.suppliers(s, d), cut(x.supplier_graph(s, d))
    out = g.score(n, e, cut(g.scc(n, e)), n)
    return out.select(*[r6(c).alias(c) for c in ("modularity", "acyclicity", "depth", "equality")], "complexity", r6("overall").alias("overall"))


TREE = """t AS (SELECT 'region.' || r_name AS q FROM region UNION ALL SELECT 'region.' || r_name || '.nation.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'region.' || r_name || '.nation.' || n_name || '.supplier.s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def schema_tree(s, d):
    r, n, p = x.table(s, d, "region"), x.table(s, d, "nation"), x.table(s, d, "supplier")
    rn = F.concat(F.lit("region."), F.col("r_name"))
    nn = F.concat(rn, F.lit(".nation."), F.col("n_name"))
    a = r.select(rn.alias("node"))
    b = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    c = p.join(n, p["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return a.union(b.select(nn)).union(c.select(F.concat(nn, F.lit(".supplier.s"), F.col("s_suppkey").cast("string"))))


@q("g22_init_edges", f"WITH {TREE}, u AS (SELECT q, unnest(list_transform(range(1, len(string_split(q, '.'))), lambda k: array_to_string(string_split(q, '.')[1:k], '.'))) AS up FROM t) SELECT q AS src, up AS dst FROM u WHERE up IN (SELECT q FROM t)")
def _(s, d):
    return g.init_edges(schema_tree(s, d))


@q("f3_package_filter", f"WITH {TREE} SELECT q AS node FROM t WHERE q = 'region.ASIA' OR starts_with(q, 'region.ASIA.')")
def _(s, d):
    return g.package_filter(schema_tree(s, d), "node", "region.ASIA")


@q("f6_dotted_glob", f"WITH {TREE} SELECT q AS node FROM t WHERE regexp_full_match(q, 'region\\.[^.]+\\.nation\\.[^.]+(\\.[^.]+)*')")
def _(s, d):
    from ..functions.globs import dotted_glob

    return schema_tree(s, d).where(F.col("node").rlike(dotted_glob("region.*.nation.*.**")))


DSM = f"WITH {x.F1}, pos AS (SELECT n_nationkey::BIGINT AS node, n_regionkey AS grp, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS pos FROM nation), cell AS (SELECT a.pos AS row, b.pos AS col, call_count AS weight, a.grp AS g1, b.grp AS g2 FROM trade JOIN pos a ON src = a.node JOIN pos b ON dst = b.node)"


@q("g29_dsm", DSM + " SELECT row, col, weight FROM cell")
def _(s, d):
    from ..operators.dsm import dsm

    return dsm(x.nations(s, d), x.trade_graph(s, d))[1].select("row", "col", "weight")


@q("g30_dsm_summary", DSM + " SELECT (SELECT count(*) FROM pos) AS modules, (SELECT count(DISTINCT grp) FROM pos) AS groups, count(*) AS cells, count(*) FILTER (row > col) AS back_edges, count(*) FILTER (g1 <> g2) AS cross_group FROM cell")
def _(s, d):
    from ..operators.dsm import dsm, summary

    return summary(*dsm(x.nations(s, d), x.trade_graph(s, d)))


@q("t13_dsm_signals", DSM + " SELECT round(count(*) FILTER (row > col) / count(*), 6) AS feedback, round(avg(abs(row - col)), 6) AS bandwidth, round(count(*) FILTER (g1 = g2) / count(*), 6) AS inside FROM cell")
def _(s, d):
    from ..operators.dsm import dsm, signals

    return signals(*dsm(x.nations(s, d), x.trade_graph(s, d))).select(r6("feedback").alias("feedback"), r6("bandwidth").alias("bandwidth"), r6("inside").alias("inside"))


@q("g12_topological_groups", SCC + ", s AS (SELECT scc, count(*) AS n FROM sc GROUP BY 1) SELECT node, CASE WHEN n > 1 THEN 'SCC-' || sc.scc ELSE 'DAG' END AS grp FROM sc JOIN s ON sc.scc = s.scc")
def _(s, d):
    from ..operators.dsm import topological_groups

    return topological_groups(g.scc(x.suppliers(s, d), x.supplier_graph(s, d)))




@q("g31_dsm_diff", f"""WITH m AS (SELECT l_orderkey AS o, l_suppkey AS f FROM lineitem), e AS (SELECT o % 2 AS half, least(n.r, 5) AS src, s_nationkey::BIGINT AS dst, count(*) AS call_count FROM m JOIN supplier ON f = s_suppkey JOIN (SELECT o_orderkey, o_custkey % 7 AS r FROM orders WHERE o_orderstatus <> 'P') n ON o = o_orderkey GROUP BY 1, 2, 3),
b AS (SELECT * FROM e WHERE half = 0), a AS (SELECT * FROM e WHERE half = 1)
SELECT coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst, CASE WHEN b.src IS NULL THEN 'added' WHEN a.src IS NULL THEN 'removed' ELSE 'weight_changed' END AS change, b.call_count AS old, a.call_count AS new FROM b FULL JOIN a ON a.src = b.src AND a.dst = b.dst WHERE b.src IS NULL OR a.src IS NULL OR a.call_count <> b.call_count""")
def _(s, d):
    li, sp = x.table(s, d, "lineitem"), x.table(s, d, "supplier")
    o = x.table(s, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.least(F.col("o_custkey") % 7, F.lit(5)).cast("long").alias("src"))
    e = li.join(sp, li["l_suppkey"] == sp["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy((F.col("l_orderkey") % 2).alias("half"), "src", F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("call_count"))
    return rules.edge_diff(e.where("half = 0"), e.where("half = 1"))


@q("g32_simulate_back_edges", SCC.replace("sup AS (SELECT * FROM (", "sup AS (SELECT 5::BIGINT AS src, 1::BIGINT AS dst, 0::BIGINT AS call_count, 1::BIGINT AS rn UNION SELECT * FROM (") + " SELECT src, dst FROM sup JOIN sc a ON src = a.node JOIN sc b ON dst = b.node WHERE a.scc = b.scc AND src > dst")
def _(s, d):
    n, e = x.suppliers(s, d), x.supplier_graph(s, d)
    after = cut(rules.simulate(e, s.createDataFrame([(5, 1)], "src long, dst long"), None))
    return rules.back_edges(after, g.scc(n, after))


@q("t14_scc_metrics", SCC + ", z AS (SELECT scc, count(*) AS n FROM sc GROUP BY 1) SELECT max(n) AS largest, count(*) AS components, count(*) FILTER (n > 1) AS tangles FROM z")
def _(s, d):
    z = g.scc(x.suppliers(s, d), x.supplier_graph(s, d)).groupBy("scc").agg(F.count("*").alias("n"))
    return z.agg(F.max("n").alias("largest"), F.count("*").alias("components"), F.count_if(F.expr("n > 1")).alias("tangles"))


@q("t16_partition_coverage", f"WITH {x.F1} SELECT round(count(*) FILTER (a.n_regionkey = b.n_regionkey) / count(*), 6) AS inside FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey")
def _(s, d):
    from ..operators.dsm import dsm, signals

    return signals(*dsm(x.nations(s, d), x.trade_graph(s, d))).select(r6("inside").alias("inside"))


@q("t18_reach_classes", x.CLOSURE + f", n AS ({NODES}), k AS (SELECT node, (SELECT string_agg(DISTINCT grp::VARCHAR, ',' ORDER BY grp::VARCHAR) FROM clo JOIN n m ON clo.dst = m.node WHERE clo.src = n.node) AS reach FROM n) SELECT reach, count(*) AS members FROM k WHERE reach IS NOT NULL GROUP BY 1")
def _(s, d):
    c = g.closure(x.supplier_graph(s, d))
    n = x.suppliers(s, d)
    k = c.join(n, c["dst"] == n["node"]).groupBy("src").agg(F.array_join(F.sort_array(F.collect_set(F.col("grp").cast("string"))), ",").alias("reach"))
    return k.groupBy("reach").agg(F.count("*").alias("members"))


@q("g23_summary", f"WITH {x.F1} SELECT (SELECT count(*) FROM nation) AS modules, count(*) AS edges, count(DISTINCT dst) AS targets, (SELECT count(*) FROM (SELECT dst FROM trade GROUP BY 1 HAVING count(*) >= 3)) AS hubs, max(call_count) AS most_calls FROM trade")
def _(s, d):
    e = x.trade_graph(s, d)
    hubs = e.groupBy("dst").agg(F.count("*").alias("n")).agg(F.count_if(F.expr("n >= 3")).alias("hubs"))
    return x.nations(s, d).agg(F.count("*").alias("modules")).crossJoin(e.agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"), F.max("call_count").alias("most_calls"))).crossJoin(hubs).select("modules", "edges", "targets", "hubs", "most_calls")
