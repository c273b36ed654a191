"""Queries of joins, aggregates, windows, rules, history, duplicates, censuses and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.globs import file_glob
from ..operators import behavior as b
from ..operators import census, rules, stats
from ..operators import graph as g
from . import fixtures as x
from .queries_graph import TREE, schema_tree

Q, S = {}, {}


def q(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


t = x.table
r6 = lambda c: F.round(c, 6)


@q("a1_edge_rollup", "SELECT l_suppkey AS src, l_partkey % 50 AS dst, bool_or(l_discount > 0.05) FILTER (l_returnflag <> 'R') IS TRUE AS is_relative, bool_and(CASE WHEN l_returnflag = 'R' THEN false ELSE l_tax > 0.02 END) AS type_checking_only, count(*) FILTER (l_returnflag = 'R') AS call_count, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, count(*) FILTER (l_returnflag <> 'R') AS n_lines FROM lineitem GROUP BY 1, 2")
def _(s, d):
    raw = t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.05).alias("is_relative"), (F.col("l_tax") > 0.02).alias("type_checking"), (F.col("l_returnflag") == "R").alias("is_call"))
    return b.edge_rollup(raw).select("src", "dst", "is_relative", "type_checking_only", "call_count", F.array_join("kinds", ",").alias("kinds"), F.size("lines").cast("long").alias("n_lines"))


@q("a2_cc_rollup", "SELECT p_brand AS module, count(*) AS function_count, sum(p_size)::BIGINT AS cc_sum, max(p_size)::BIGINT AS cc_max, round(avg(p_size), 6) AS cc_mean FROM part GROUP BY 1")
def _(s, d):
    return t(s, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("function_count"), F.sum("p_size").alias("cc_sum"), F.max("p_size").cast("long").alias("cc_max"), r6(F.avg("p_size")).alias("cc_mean"))


@q("a3_project_cc", "SELECT count(*) AS functions, round(avg(p_size), 6) AS mean, max(p_size)::BIGINT AS top, round(CASE WHEN count(*) < 20 THEN 1 ELSE 1 - greatest(0, least(1, (avg(p_size) - 1) / 8)) END, 6) AS axis FROM part")
def _(s, d):
    a = Q["a2_cc_rollup"](s, d).agg(F.sum("function_count").alias("functions"), F.try_divide(F.sum("cc_sum"), F.sum("function_count")).alias("mean"), F.max("cc_max").alias("top"))
    return a.select("functions", r6("mean").alias("mean"), "top", r6(g.complexity_axis(F.col("mean"), F.col("functions"))).alias("axis"))


@q("a4_call_stats", f"WITH {x.F2} SELECT count(*) FILTER (call_count > 0) AS call_edges, sum(call_count)::BIGINT AS calls, round(sum(call_count) / count(*) FILTER (call_count > 0), 6) AS calls_per_edge FROM sup")
def _(s, d):
    return b.call_stats(x.supplier_graph(s, d)).withColumn("calls_per_edge", r6("calls_per_edge"))


@q("b1_hotspots", f"WITH {x.F7} SELECT module, cc_sum, churn, cc_sum * churn AS score FROM ch WHERE cc_sum > 0 AND churn > 0")
def _(s, d):
    return b.hotspots(x.churn(s, d))


@q("b1_hotspots_top", f"WITH {x.F7} SELECT module, cc_sum, churn, cc_sum * churn AS score FROM ch WHERE cc_sum > 0 AND churn > 0 ORDER BY score DESC, churn DESC, module LIMIT 20")
def _(s, d):
    return b.hotspots(x.churn(s, d), 20)


CAP = "os0 AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS f FROM lineitem), cap AS (SELECT o FROM os0 GROUP BY 1 HAVING count(*) <= 6), c AS (SELECT * FROM os0 WHERE o IN (FROM cap)), n AS (SELECT f, count(*) AS n FROM c GROUP BY 1), p AS (SELECT u.f AS a, v.f AS b, count(*) AS support FROM c u JOIN c v ON u.o = v.o AND u.f < v.f GROUP BY 1, 2)"


@q("b3_sweep_cap", f"WITH {CAP} SELECT count(*) AS changes, count(DISTINCT o) AS commits FROM c")
def _(s, d):
    return b.capped(x.order_suppliers(s, d), 6).agg(F.count("*").alias("changes"), F.count_distinct("commit_id").alias("commits"))


@q("a8_pair_support", f"WITH {CAP} SELECT a, b, support FROM p WHERE support >= 2")
def _(s, d):
    return b.pair_support(b.capped(x.order_suppliers(s, d), 6)).where("support >= 2")


@q("b2_coupling", f"WITH {x.F2}, {CAP} SELECT a, b, support, round(support / least(na.n, nb.n), 6) AS confidence FROM p JOIN n na ON a = na.f JOIN n nb ON b = nb.f WHERE support >= 5 AND support / least(na.n, nb.n) >= 0.01 AND NOT EXISTS (SELECT 1 FROM sup WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def _(s, d):
    return b.coupling(x.order_suppliers(s, d), x.supplier_graph(s, d), 5, 0.01, 6).withColumn("confidence", r6("confidence"))


@q("b4_hints", f"WITH {CAP}, k AS (SELECT a, b, support, support / least(na.n, nb.n) AS confidence FROM p JOIN n na ON a = na.f JOIN n nb ON b = nb.f WHERE support >= 3 AND support / least(na.n, nb.n) >= 0.01), u AS (SELECT a AS target, b AS module, support, confidence FROM k UNION ALL SELECT b, a, support, confidence FROM k) SELECT target, module, support, round(confidence, 6) AS confidence FROM u WHERE target IN (1, 2, 3) AND module NOT IN (1, 2, 3, 4, 5)")
def _(s, d):
    n = x.suppliers(s, d)
    k = b.coupling(x.order_suppliers(s, d), None, 3, 0.01, 6)
    return b.hints(k, n.where("node IN (1, 2, 3)"), n.where("node IN (4, 5)")).withColumn("confidence", r6("confidence"))


@q("b5_refactor", f"WITH {x.F7}, h AS (SELECT module, cc_sum * churn AS hs FROM ch WHERE cc_sum > 0 AND churn > 0), r AS (SELECT p_partkey AS rm, (p_partkey % 100) / 100 AS rs FROM part), j AS (SELECT coalesce(module, rm) AS module, hs, coalesce(rs, 0) AS risk FROM h FULL JOIN r ON module = rm), k AS (SELECT * FROM j WHERE hs IS NOT NULL OR risk >= 0.15), m AS (SELECT max(hs) AS mh, max(risk) AS mr FROM k) SELECT module, coalesce(hs, 0) AS hotspot, risk, round(coalesce(hs / mh, 0) + risk / mr, 6) AS priority, CASE WHEN coalesce(hs >= 0.05 * mh, false) AND risk >= 0.15 THEN 'fused' WHEN coalesce(hs >= 0.05 * mh, false) THEN 'behavioral' WHEN risk >= 0.15 THEN 'structural' ELSE 'weak' END AS lens FROM k, m")
def _(s, d):
    h = b.hotspots(x.churn(s, d))
    r = t(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 100 / 100).alias("risk"))
    return b.refactor_priorities(h, r).withColumn("priority", r6("priority"))


@q("b6_lens_counts", S["b5_refactor"].replace("SELECT module, coalesce(hs, 0) AS hotspot", "SELECT lens, count(*) AS n FROM (SELECT module, coalesce(hs, 0) AS hotspot") + ") GROUP BY 1")
def _(s, d):
    return Q["b5_refactor"](s, d).groupBy("lens").agg(F.count("*").alias("n"))


DUP = f"WITH {x.F8}, c AS (SELECT shape_hash, count(*) AS members, min(size) AS size, count(DISTINCT concrete_hash) = 1 AS exact, bool_and(decorator = 'typing.overload') AS overload, bool_and(decorator = 'property' AND is_trivial) AS property, bool_and(regexp_matches(path, '(^|/)(vendored|third_party)/')) AS vendored, bool_and(regexp_matches(path, '(^|/)tests/|(^|/)test_[^/]*$')) AS test, bool_and(is_trivial) AS trivial, bool_and(contains(qualified_name, '.')) AND count(DISTINCT module || ':' || split_part(qualified_name, '.', 1)) = 1 AS same_class FROM fn WHERE size >= 30 GROUP BY 1 HAVING count(*) >= 2)"
VARIANT = "CASE WHEN overload THEN 'overload' WHEN property THEN 'property' WHEN vendored THEN 'vendored' WHEN test THEN 'test' WHEN trivial THEN 'trivial' WHEN same_class THEN 'same_class' ELSE 'none' END"


@q("d1_exact_clusters", DUP + " SELECT *, size * (members - 1) AS redundancy FROM c")
def _(s, d):
    return b.exact_clusters(x.functions(s, d))


@q("d2_same_class", DUP + " SELECT same_class, count(*) AS clusters, sum(members)::BIGINT AS members FROM c GROUP BY 1")
def _(s, d):
    return b.exact_clusters(x.functions(s, d)).groupBy("same_class").agg(F.count("*").alias("clusters"), F.sum("members").alias("members"))


@q("d3_variants", DUP + f" SELECT {VARIANT} AS variant, exact, count(*) AS n FROM c GROUP BY 1, 2")
def _(s, d):
    return b.variant(b.exact_clusters(x.functions(s, d))).groupBy(F.coalesce("variant", F.lit("none")).alias("variant"), "exact").agg(F.count("*").alias("n"))


@q("d4_independent", f"WITH {CAP}, m AS (SELECT s_nationkey AS cluster, s_suppkey AS file FROM supplier), per AS (SELECT cluster, count(*) AS files, bool_and(coalesce(n, 0) >= 5) AS known FROM m LEFT JOIN n ON file = f GROUP BY 1), tied AS (SELECT DISTINCT ma.cluster FROM p JOIN n na ON a = na.f JOIN n nb ON b = nb.f JOIN m ma ON a = ma.file JOIN m mb ON b = mb.file AND ma.cluster = mb.cluster WHERE support >= 3 AND support / least(na.n, nb.n) >= 0.02) SELECT cluster::BIGINT AS cluster, files >= 2 AND known AND cluster NOT IN (FROM tied) AS independent FROM per")
def _(s, d):
    m = x.suppliers(s, d).select(F.col("grp").alias("cluster"), F.col("node").alias("file"))
    return b.independent_clusters(m, x.order_suppliers(s, d), 3, 0.02, 5, 6)


@q("d6_tier_totals", DUP + " SELECT count(*) AS clusters, count(*) FILTER (exact) AS exact, sum(members)::BIGINT AS members, sum(size * (members - 1))::BIGINT AS redundancy FROM c")
def _(s, d):
    c = b.exact_clusters(x.functions(s, d))
    return c.agg(F.count("*").alias("clusters"), F.count_if("exact").alias("exact"), F.sum("members").alias("members"), F.sum("redundancy").alias("redundancy"))


BAGS = "bag AS (SELECT o AS id, f AS token, count(*) AS n FROM (SELECT l_orderkey AS o, l_suppkey AS f FROM lineitem) GROUP BY 1, 2)"


def order_bags(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("token")).agg(F.count("*").alias("n"))


@q("a13_bag_jaccard", f"WITH {BAGS}, sz AS (SELECT id, sum(n) AS s FROM bag GROUP BY 1), i AS (SELECT u.id AS a, v.id AS b, sum(least(u.n, v.n)) AS i FROM bag u JOIN bag v ON u.token = v.token AND u.id < v.id GROUP BY 1, 2) SELECT a, b, round(i / (sa.s + sb.s - i), 6) AS similarity FROM i JOIN sz sa ON a = sa.id JOIN sz sb ON b = sb.id WHERE i / (sa.s + sb.s - i) >= 0.8")
def _(s, d):
    return b.bag_similarity(order_bags(s, d), 0.8).withColumn("similarity", r6("similarity"))


@q("d5_near_miss")
def _(s, d):
    f = x.functions(s, d)
    # Texts are dealt by document once, so that their words need not be.
    tokens = t(s, d, "documents").select(F.col("doc_id").alias("id"), "text").repartition("id").select("id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    return b.near_miss(f, tokens)


@q("j5_band_join", "SELECT u.p_partkey AS a, v.p_partkey AS b FROM part u JOIN part v ON u.p_size >= 0.85 * v.p_size AND (u.p_size < v.p_size OR (u.p_size = v.p_size AND u.p_partkey < v.p_partkey))")
def _(s, d):
    return b.band_pairs(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")))


@q("j2_anti_join", f"WITH {x.F1} SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE NOT EXISTS (SELECT 1 FROM trade WHERE (src = a.n_nationkey AND dst = b.n_nationkey) OR (dst = a.n_nationkey AND src = b.n_nationkey))")
def _(s, d):
    n = x.nations(s, d)
    p = n.select(F.col("node").alias("a"), F.col("grp").alias("ga")).join(n.select(F.col("node").alias("b"), F.col("grp").alias("gb")), F.expr("ga = gb AND a < b"))
    e = x.trade_graph(s, d).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return p.join(e, (F.col("a") == e["lo"]) & (F.col("b") == e["hi"]), "left_anti").select("a", "b")


@q("j8_longest_prefix", "WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS target FROM pages), k AS (SELECT DISTINCT regexp_extract(target, '^([^.]+\\.[^.]+)', 1) AS node FROM h) SELECT target, CASE WHEN regexp_extract(target, '^([^.]+\\.[^.]+)', 1) IN (SELECT node FROM k) THEN regexp_extract(target, '^([^.]+\\.[^.]+)', 1) ELSE string_split(target, '.')[1] END AS prefix FROM h")
def _(s, d):
    h = t(s, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("target")).distinct()
    return census.longest_prefix(h, h.select(F.regexp_extract("target", r"^([^.]+\.[^.]+)", 1).alias("node")).distinct())


@q("j9_interval_join", "SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 3600 AND a.event_type = 'error' GROUP BY 1")
def _(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    hour, w = F.floor(F.col("u") / 3_600_000_000), 3_600_000_000
    a = e.where("event_type = 'error'").select("event_id", "user_id", "u", F.explode(F.array(hour - 1, hour, hour + 1)).alias("h"))
    o = e.select(F.col("user_id").alias("u2"), F.col("u").alias("t2"), hour.alias("h2"))
    return a.join(o, (F.col("user_id") == F.col("u2")) & (F.col("h") == F.col("h2")) & (F.abs(F.col("u") - F.col("t2")) <= w)).groupBy("event_id").agg(F.count("*").alias("near"))


@q("j10_asof", "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT user_id, ts, max(event_id) AS cid FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT e.event_id, (SELECT max_by(c.cid, c.ts) FROM c WHERE c.user_id = e.user_id AND c.ts < e.ts) AS last_click FROM e")
def _(s, d):
    e = t(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    k = e.where("event_type IN ('error', 'click')").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_type")
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    return k.withColumn("last", F.max(click).over(w)).where("event_type = 'error'").select("event_id", F.col("last.event_id").alias("last_click"))


@q("j12_left_default", f"WITH {x.F7} SELECT module, churn FROM ch")
def _(s, d):
    return x.churn(s, d).select("module", "churn")


@q("a10_home", "WITH n AS (SELECT p_type AS family, p_brand AS module, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, module) AS rn, sum(n) OVER (PARTITION BY family) AS members FROM n) SELECT family, members::BIGINT AS members, module AS home, round(n / members, 6) AS home_share FROM r WHERE rn = 1 AND members >= 2")
def _(s, d):
    return census.families(t(s, d, "part").select(F.col("p_type").alias("family"), F.col("p_brand").alias("module"))).withColumn("home_share", r6("home_share"))


@q("c1_naming_families", "WITH m AS (SELECT split_part(p_name, ' ', -1) AS family, p_brand AS module FROM part), n AS (SELECT family, module, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, module) AS rn, sum(n) OVER (PARTITION BY family) AS members FROM n) SELECT upper(family[1]) || family[2:] AS family, members::BIGINT AS members, module AS home, round(n / members, 6) AS home_share FROM r WHERE rn = 1")
def _(s, d):
    p = t(s, d, "part").select(census.camel_suffix(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("family"), F.col("p_brand").alias("module"))
    return census.families(p).withColumn("home_share", r6("home_share"))


@q("a11_value_distribution", "WITH c AS (SELECT p_brand AS name, p_type AS value, count(*) AS k FROM part GROUP BY 1, 2) SELECT name, sum(k)::BIGINT AS n, string_agg(value || '=' || k, ',' ORDER BY k DESC, value) AS distribution FROM c GROUP BY 1 HAVING sum(k) >= 2")
def _(s, d):
    return census.value_distribution(t(s, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("value")))


@q("c4_registries", "SELECT p_type AS ctor, count(*) AS entries, count(DISTINCT p_brand) AS modules FROM part GROUP BY 1 HAVING count(*) >= 3")
def _(s, d):
    return census.registries(t(s, d, "part").select(F.col("p_type").alias("ctor"), F.col("p_name").alias("name"), F.col("p_brand").alias("module")))


@q("c5_consumers", "SELECT l_returnflag AS home, l_partkey AS name, count(DISTINCT l_suppkey) AS importers FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) BETWEEN 2 AND 5")
def _(s, d):
    return census.consumers(t(s, d, "lineitem").select(F.col("l_returnflag").alias("home"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("importer")))


@q("c6_import_homes", "WITH d AS (SELECT p_name, count(DISTINCT p_brand) AS k, min(p_brand) AS o FROM part GROUP BY 1) SELECT p.p_name AS name, coalesce(CASE WHEN p_partkey % 7 = 0 THEN p_brand END, CASE WHEN k = 1 THEN o END) AS home FROM part p LEFT JOIN d ON p.p_name = d.p_name")
def _(s, d):
    p = t(s, d, "part")
    return census.import_homes(p.select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).alias("source")), p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("module")))


@q("c9_partial_coverage", "WITH e AS (SELECT DISTINCT p_type AS grp, p_brand AS name FROM part), f AS (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#35') SELECT grp, count(*) AS n, count(f.p_brand) AS covered, coalesce(string_agg(name, ',' ORDER BY name) FILTER (f.p_brand IS NULL), '') AS missing FROM e LEFT JOIN f ON name = f.p_brand GROUP BY 1 HAVING count(f.p_brand) >= 0.5 * count(*) AND count(f.p_brand) < count(*)")
def _(s, d):
    p = t(s, d, "part")
    return census.partly_covered(p.select(F.col("p_type").alias("grp"), F.col("p_brand").alias("name")), p.where("p_brand < 'Brand#35'").select(F.col("p_brand").alias("name")))


NAMES = "nm AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pkg.tests.' WHEN 1 THEN '.tools.' WHEN 2 THEN 'pkg.v1.' WHEN 3 THEN 'pkg.' WHEN 4 THEN 'pkg.v1.sub.' ELSE 'pkg.sub.' END || source || doc_id % 13 AS q FROM documents)"


def dotted_names(s, d):
    i = F.col("doc_id")
    lead = F.element_at(F.array(*[F.lit(p) for p in ("pkg.tests.", ".tools.", "pkg.v1.", "pkg.", "pkg.v1.sub.", "pkg.sub.")]), (i % 6 + 1).cast("int"))
    return t(s, d, "documents").select("doc_id", F.concat(lead, "source", (i % 13).cast("string")).alias("node"))


SHADOW = NAMES + ", u AS (SELECT DISTINCT q, string_split(q, '.') AS p FROM nm), i AS (SELECT DISTINCT p[1] AS top, p[1] || '.' || p[2] AS root, array_to_string(p[3:], '.') AS x FROM u WHERE len(p) >= 3), z AS (SELECT root, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM u WHERE p[1] = top AND q = top || '.' || x AND NOT starts_with(q, root || '.'))) AS k FROM i GROUP BY 1), sh AS (SELECT root FROM z WHERE n >= 5 AND k >= 0.5 * n)"


@q("c10_shadow_roots", f"WITH {SHADOW} SELECT root FROM sh")
def _(s, d):
    return census.shadow_roots(dotted_names(s, d))


@q("c10_partition", f"WITH {SHADOW} SELECT part, count(*) AS n FROM (SELECT CASE WHEN q[1] = '.' THEN 'nonsource' WHEN regexp_matches(q, '(^|\\.)tests\\.') THEN 'test' WHEN EXISTS (SELECT 1 FROM sh WHERE starts_with(q, root || '.')) THEN 'shadowed' ELSE 'censused' END AS part FROM nm) GROUP BY 1")
def _(s, d):
    n = dotted_names(s, d)
    roots = census.shadow_roots(n)
    n = n.join(F.broadcast(roots), F.startswith(n["node"], F.concat(roots["root"], F.lit("."))), "left")  # a few packages
    return n.groupBy(census.partition_of(F.col("node"), F.col("root").isNotNull()).alias("part")).agg(F.count("*").alias("n"))


@q("x6_doc_names", "WITH h AS (SELECT page_id, list_concat(regexp_extract_all(html, '`{1,2}\\s*([A-Za-z_][\\w.-]*)\\s*`{1,2}', 1), list_concat(regexp_extract_all(' ' || regexp_replace(html, '[^\\w-]', '  ', 'g') || ' ', '[^\\w-]([a-z][a-z0-9]*(?:-[a-z0-9]+)+)[^\\w-]', 1), regexp_extract_all(html, '\\[([A-Za-z_][\\w.-]*)\\]', 1))) AS v FROM pages) SELECT page_id, len(list_distinct(list_transform(v, lambda z: string_split(z, '.')[-1])))::INTEGER AS names FROM h")
def _(s, d):
    return t(s, d, "pages").select("page_id", F.size(census.doc_names(F.col("html"))).alias("names"))


@q("x6_doc_links", "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT link) AS names FROM h GROUP BY 1")
def _(s, d):
    h = t(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return h.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("names"))


@q("a12_external_deps", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def _(s, d):
    return t(s, d, "pages").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


quoted = lambda xs: "[" + ", ".join(f"'{v}'" for v in xs) + "]"
GLOBS = {"**/*.py": "([^/]+/)*[^/]*\\.py", "src/**": "src/.*", "src/**.py": "src/[^/]*\\.py", "s*/d?/**/web*": "s[^/]*/d[^/]/([^/]+/)*web[^/]*", "*.py": "[^/]*\\.py"}


@q("f7_file_glob", f"WITH {x.F8}, g AS (SELECT unnest({quoted(GLOBS)}) AS pattern, unnest({quoted(GLOBS.values())}) AS re) SELECT pattern, count(*) FILTER (regexp_full_match(path, re)) AS n FROM fn, g GROUP BY 1")
def _(s, d):
    p = x.functions(s, d)
    each = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col("path").rlike(file_glob(k)).alias("hit")) for k in GLOBS])
    return p.select(F.explode(each).alias("g")).groupBy("g.pattern").agg(F.count_if("g.hit").alias("n"))


@q("f8_test_paths", f"WITH {x.F8} SELECT path, regexp_matches(path, '(^|/)(tests?/|test_[^/]*$|[^/]*_test\\.py$|conftest\\.py$)') AS code, regexp_matches(path, '(^|/)(tests/|(test_[^/]*|[^/]*_test)\\.py$)') AS run, regexp_matches(path, '(^|/)(tests/|test_[^/]*$|[^/]*_test\\.py$)') AS scan, count(*) AS n FROM fn WHERE path IS NOT NULL GROUP BY 1")
def _(s, d):
    p = x.functions(s, d).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))
    return p.select("path", paths.is_test_code(F.col("path")).alias("code"), paths.is_run_test(F.col("path")).alias("run"), paths.is_conventional_test(F.col("path")).alias("scan"), "n")


@q("f8_test_modules", f"WITH {NAMES} SELECT q AS node, regexp_matches(q, '(^|\\.)tests\\.') AS test FROM (SELECT DISTINCT q FROM nm WHERE q IS NOT NULL)")
def _(s, d):
    return dotted_names(s, d).where("node IS NOT NULL").select("node", paths.is_test_module(F.col("node")).alias("test")).distinct()


@q("f9_vendored", f"WITH {x.F8} SELECT count(*) FILTER (regexp_matches(path, '(^|/)(vendored|third_party)/')) AS vendored, count(*) AS n FROM fn")
def _(s, d):
    return x.functions(s, d).agg(F.count_if(paths.is_vendored(F.col("path"))).alias("vendored"), F.count("*").alias("n"))


@q("f12_changed_files", "SELECT k AS changed, CASE WHEN p_partkey IS NULL THEN 'unresolved' WHEN p_size > 40 THEN 'deleted' ELSE 'resolved' END AS state FROM (SELECT DISTINCT o_custkey AS k FROM orders) LEFT JOIN part ON p_partkey = k * 3")
def _(s, d):
    c, p = t(s, d, "orders").select(F.col("o_custkey").alias("changed")).distinct(), t(s, d, "part")
    return c.join(p, F.col("changed") * 3 == p["p_partkey"], "left").select("changed", F.when(F.col("p_partkey").isNull(), "unresolved").when(F.col("p_size") > 40, "deleted").otherwise("resolved").alias("state"))


LAYERED = f"{x.F1}, n AS (SELECT n_nationkey::BIGINT AS node, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey)"


def layered(s, d):
    n, r = t(s, d, "nation"), t(s, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("node"), F.col("r_name").alias("layer"))


def forbid(s, d):
    r = t(s, d, "region").select(F.col("r_name").alias("from_layer"), F.col("r_regionkey").alias("k"))
    o = t(s, d, "region").select(F.col("r_name").alias("to_layer"), F.col("r_regionkey").alias("m"))
    return r.join(o, F.expr("m = (k + 1) % 5 AND k < 2"))


FORBID = "f AS (SELECT a.r_name AS fl, b.r_name AS tl FROM region a JOIN region b ON b.r_regionkey = (a.r_regionkey + 1) % 5 AND a.r_regionkey < 2)"


@q("r1_violations", f"WITH {LAYERED}, {FORBID} SELECT fl AS from_layer, tl AS to_layer, src, dst FROM trade JOIN n a ON src = a.node JOIN n b ON dst = b.node JOIN f ON a.layer = fl AND b.layer = tl")
def _(s, d):
    return rules.violations(x.trade_graph(s, d), layered(s, d), forbid(s, d))


@q("r2_required_reach", "WITH RECURSIVE " + LAYERED + ", ok AS (SELECT node FROM n WHERE node IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION SELECT src FROM trade JOIN ok ON dst = node) SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_regionkey = 0 AND n_nationkey NOT IN (SELECT node FROM ok)")
def _(s, d):
    n = x.nations(s, d)
    return rules.required_reach(x.trade_graph(s, d), n.where("grp = 0"), n.where("grp = 1"))


@q("r3_sdp", f"WITH {x.F1}, i AS (SELECT n_nationkey AS node, (SELECT count(*) FROM trade WHERE src = n_nationkey) AS ce, (SELECT count(*) FROM trade WHERE dst = n_nationkey) AS ca FROM nation), v AS (SELECT node, CASE WHEN ce + ca = 0 THEN 0 ELSE ce / (ce + ca) END AS v FROM i) SELECT src, dst, round(a.v, 6) AS src_i, round(b.v, 6) AS dst_i FROM trade JOIN v a ON src = a.node JOIN v b ON dst = b.node WHERE b.v > a.v + 0.1")
def _(s, d):
    return rules.sdp_violations(x.nations(s, d), x.trade_graph(s, d), 0.1).withColumns({"src_i": r6("src_i"), "dst_i": r6("dst_i")})


@q("r4_coverage", f"WITH {LAYERED}, {FORBID}, u AS (SELECT fl FROM f UNION SELECT tl FROM f), l AS (SELECT node, CASE WHEN node % 5 = 0 THEN NULL ELSE layer END AS layer FROM n) SELECT (SELECT count(*) FROM l) AS modules, (SELECT count(layer) FROM l) AS layered, (SELECT count(*) FROM l WHERE layer IN (FROM u)) AS ruled, count(*) AS edges, count(*) FILTER (a.layer IS NOT NULL AND b.layer IS NOT NULL) AS governed, round(count(*) FILTER (a.layer IS NOT NULL AND b.layer IS NOT NULL) / count(*), 6) AS coverage FROM trade JOIN l a ON src = a.node JOIN l b ON dst = b.node")
def _(s, d):
    lay = layered(s, d).withColumn("layer", F.when(F.col("node") % 5 != 0, F.col("layer")))
    return rules.coverage(x.trade_graph(s, d), lay, forbid(s, d)).withColumn("coverage", r6("coverage")).drop("external_governed")


@q("a9_layer_sizes", "SELECT r_name AS layer, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 10 GROUP BY 1 UNION ALL SELECT 'EMPTY', 0")
def _(s, d):
    names = ["EMPTY", *sorted(r[0] for r in t(s, d, "region").select("r_name").limit(100).collect())]
    return rules.layer_sizes(layered(s, d).where("node > 10"), names)


@q("j6_layer_assignment", f"WITH {TREE} SELECT q AS name, CASE WHEN q LIKE 'region.ASIA%' THEN 'asia' WHEN q LIKE 'region.EUROPE%' THEN 'europe' END AS layer FROM t")
def _(s, d):
    n = schema_tree(s, d).withColumn("name", F.col("node"))
    return rules.assign_layers(n, {"asia": ["region.ASIA.**"], "europe": ["region.EUROPE.**"]}).select("name", "layer")


SNAP = "e AS (SELECT DISTINCT o_custkey % 50 AS src, l_suppkey % 50 AS dst, year(o_orderdate) % 2 AS half FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45)"


def halves(s, d):
    o, li = t(s, d, "orders"), t(s, d, "lineitem").where("l_quantity > 45")
    e = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.col("o_custkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"), (F.year("o_orderdate") % 2).alias("half")).distinct()
    return e.where("half = 0").select("src", "dst"), e.where("half = 1").select("src", "dst")


@q("r11_diff", f"WITH {SNAP}, a AS (SELECT src, dst FROM e WHERE half = 0), b AS (SELECT src, dst FROM e WHERE half = 1) SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'resolved' FROM (FROM a EXCEPT FROM b)")
def _(s, d):
    return rules.set_diff(*halves(s, d), ["src", "dst"])


@q("u5_three_way", f"WITH {SNAP}, k AS (SELECT src, dst, bool_or(half = 0) AS l, bool_or(half = 1) AS r FROM e GROUP BY 1, 2) SELECT CASE WHEN l AND r THEN 'both' WHEN l THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM k GROUP BY 1")
def _(s, d):
    a, c = halves(s, d)
    k = a.withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(c.withColumn("l", F.lit(0)).withColumn("r", F.lit(1))).groupBy("src", "dst").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return k.groupBy(F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side")).agg(F.count("*").alias("n"))


@q("r13_ratchet", "WITH b AS (SELECT n_regionkey AS scc, n_nationkey AS node FROM nation WHERE n_nationkey < 20), c AS (SELECT n_nationkey // 3 AS scc, n_nationkey AS node FROM nation), s AS (SELECT c.scc, count(b.node) AS n FROM c LEFT JOIN b ON c.node = b.node GROUP BY 1), w AS (SELECT scc, max(m) AS m FROM (SELECT c.scc, b.scc AS bs, count(*) AS m FROM c JOIN b ON c.node = b.node GROUP BY 1, 2) GROUP BY 1), z AS (SELECT scc, count(*) AS k FROM c GROUP BY 1) SELECT z.scc::BIGINT AS scc, CASE WHEN k = 1 THEN false ELSE coalesce(m = n, false) END AS carried FROM z JOIN s ON z.scc = s.scc LEFT JOIN w ON z.scc = w.scc")
def _(s, d):
    n = x.nations(s, d)
    base = n.where("node < 20").select(F.col("grp").alias("scc"), "node")
    return rules.ratchet_cycles(base, n.select(F.floor(F.col("node") / 3).cast("long").alias("scc"), "node"), base, n.where("node < 0"))


@q("r17_score_gate", f"WITH {x.F12}, k AS (SELECT day, overall, overall - lag(overall) OVER (ORDER BY day) AS delta FROM hist) SELECT day, overall, round(delta, 6) AS delta, coalesce(delta >= -0.02, true) AS passed FROM k")
def _(s, d):
    return rules.score_gate(x.history(s, d)).withColumn("delta", r6("delta"))


@q("r18_trend", f"WITH {x.F12}, k AS (SELECT day, overall FROM hist ORDER BY day DESC LIMIT 20), e AS (SELECT min(overall) AS low, max(overall) AS high FROM k) SELECT day, overall, low, high, round_even((overall - low) / (high - low) * 7, 0)::INTEGER AS level, substr('▁▂▃▄▅▆▇█', round_even((overall - low) / (high - low) * 7, 0)::INTEGER + 1, 1) AS glyph FROM k, e")
def _(s, d):
    return rules.trend(x.history(s, d))


@q("w2_top_k_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def _(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t(s, d, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "p_retailprice")


@q("w6_average_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part")
def _(s, d):
    return stats.average_ranks(t(s, d, "part"), "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


@q("w7_cumulative_share", "SELECT p_brand, round(sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER (), 6) AS share FROM (SELECT p_brand, sum(p_size) AS v FROM part GROUP BY 1)")
def _(s, d):
    c = t(s, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("v"))
    return c.select("p_brand", r6(F.sum("v").over(Window.orderBy(F.desc("v"), "p_brand").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy())).alias("share"))


@q("w8_trailing_windows", "WITH m AS (SELECT max(ts::DATE) AS top FROM events) SELECT k::INTEGER AS days, count(*) AS n FROM events, m, (VALUES (1), (7), (30)) v(k) WHERE ts::DATE > top - k::INTEGER GROUP BY 1")
def _(s, d):
    e = t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("day").alias("top")))).withColumn("days", F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))))
    return e.where("day > date_sub(top, days)").groupBy("days").agg(F.sum("c").alias("n"))


@q("w9_share_of_max", f"WITH {x.F7} SELECT module, round(cc_sum * churn / max(cc_sum * churn) OVER (), 6) AS part FROM ch WHERE cc_sum > 0 AND churn > 0")
def _(s, d):
    h = b.hotspots(x.churn(s, d))
    return h.crossJoin(F.broadcast(h.agg(F.max("score").alias("top")))).select("module", r6(F.col("score") / F.col("top")).alias("part"))


@q("w10_carry_forward", "SELECT event_id, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@q("u4_pool_pairs", "WITH a AS (SELECT l_suppkey AS k, 'x' AS gen, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, 'y', l_quantity FROM lineitem WHERE l_returnflag = 'A') SELECT k, string_agg(DISTINCT gen, ',' ORDER BY gen) AS tags, max(v) AS best FROM a GROUP BY 1")
def _(s, d):
    li = t(s, d, "lineitem")
    part = lambda f, g: li.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k"), F.lit(g).alias("gen"), F.col("l_quantity").alias("v"))
    return part("R", "x").unionByName(part("A", "y")).groupBy("k").agg(F.array_join(F.sort_array(F.collect_set("gen")), ",").alias("tags"), F.max("v").alias("best"))


@q("a17_threshold_grid", f"WITH {CAP}, g AS (SELECT * FROM (VALUES (2), (3), (5), (8)) v(floor)) SELECT floor::INTEGER AS floor, count(*) AS pairs FROM p JOIN g ON support >= floor GROUP BY 1")
def _(s, d):
    p = b.pair_support(b.capped(x.order_suppliers(s, d), 6)).groupBy("support").agg(F.count("*").alias("n"))
    return p.select("n", F.explode(F.filter(F.array(*[F.lit(k) for k in (2, 3, 5, 8)]), lambda k: k <= F.col("support"))).alias("floor")).groupBy("floor").agg(F.sum("n").alias("pairs"))


@q("t1_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(s, d):
    return stats.pearson(t(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(r6("r").alias("r"))


@q("t2_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part) SELECT round(corr(x, y), 6) AS r FROM r")
def _(s, d):
    return stats.spearman(t(s, d, "part"), "p_size", "p_retailprice").select(r6("r").alias("r"))


WILSON = "round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high"


@q("t3_wilson", f"SELECT p_brand, k, n, {WILSON} FROM (SELECT p_brand, count(*) FILTER (p_size > 25) AS k, count(*) AS n, count(*) FILTER (p_size > 25) / count(*) AS p, 1.959963984540054 AS z FROM part GROUP BY 1)")
def _(s, d):
    c = t(s, d, "part").groupBy("p_brand").agg(F.count_if(F.expr("p_size > 25")).alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return c.select("p_brand", "k", "n", r6(lo).alias("low"), r6(hi).alias("high"))


@q("t6_kappa", "WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS a, count(*) FILTER (quality = 1) AS q1, count(*) FILTER (toxic = 1) AS t1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), e AS (SELECT n, a / n AS agree, (q1 * t1 + (n - q1) * (n - t1)) / (n * n) AS expected FROM c) SELECT n, round(agree, 6) AS agree, round(expected, 6) AS expected, round((agree - expected) / (1 - expected), 6) AS kappa FROM e")
def _(s, d):
    k = stats.kappa(t(s, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL"), "quality", "toxic")
    return k.select("n", *[r6(c).alias(c) for c in ("agree", "expected", "kappa")])


@q("t8_ols_slope", f"WITH {x.F12} SELECT round(regr_slope(n, overall), 6) AS slope FROM hist")
def _(s, d):
    return stats.ols_slope(x.history(s, d), "overall", "n").select(r6("slope").alias("slope"))


@q("t9_set_jaccard", f"WITH {SNAP}, k AS (SELECT src, list_distinct(list(dst) FILTER (half = 0)) AS a, list_distinct(list(dst) FILTER (half = 1)) AS b FROM e GROUP BY 1) SELECT src, round(coalesce(len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0), 1), 6) AS jaccard FROM k")
def _(s, d):
    a, c = halves(s, d)
    e = a.withColumn("half", F.lit(0)).unionByName(c.withColumn("half", F.lit(1)))
    k = e.groupBy("src").agg(F.collect_set(F.when(F.col("half") == 0, F.col("dst"))).alias("a"), F.collect_set(F.when(F.col("half") == 1, F.col("dst"))).alias("b"))
    return k.select("src", r6(stats.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


COS = "p AS (SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


def vectors(s, d):
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.where("id % 20 = 0")


@q("t10_nearest", f"WITH {COS} SELECT q AS id, v AS neighbour, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS rn FROM p) WHERE rn = 1")
def _(s, d):
    return stats.nearest(*vectors(s, d), "label")


@q("t11_calibrate", f"WITH {COS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS rn FROM p) WHERE rn <= 5), c AS (SELECT s, count(*) AS m FROM r GROUP BY 1), u AS (SELECT s, sum(m) OVER (ORDER BY s DESC) AS upto FROM c) SELECT max(s) AS cutoff FROM u WHERE upto / (SELECT count(DISTINCT q) FROM r) >= 2")
def _(s, d):
    return stats.calibrate(stats.nearest(*vectors(s, d), "label", k=5), "id", "similarity", 2.0, 5)


@q("t5_bootstrap")
def _(s, d):
    return stats.cluster_bootstrap(t(s, d, "part"), "p_brand", "p_size")


@q("t15_aggregators", "WITH a AS (SELECT p_partkey, [p_size / 50, (p_partkey % 10 + 1) / 10, 0.5] AS v FROM part) SELECT p_partkey, round(list_avg(v), 6) AS arith, round(list_min(v), 6) AS least, round(pow(list_product(v), 1.0 / 3), 6) AS geo, round(3 / list_sum(list_transform(v, lambda z: 1 / z)), 6) AS harmonic FROM a")
def _(s, d):
    p = t(s, d, "part").select("p_partkey", F.array((F.col("p_size") / 50).cast("double"), ((F.col("p_partkey") % 10 + 1) / 10).cast("double"), F.lit(0.5)).alias("v"))
    return p.select("p_partkey", *[r6(c).alias(k) for k, c in stats.aggregators(F.col("v")).items()])


@q("t17_weighted_mean", "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("mean"))


@q("t22_transcripts", "WITH c AS (SELECT conv_id, turn, role, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS first FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (turn < first) AS before_first FROM c GROUP BY 1")
def _(s, d):
    c = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"), F.collect_list("turn").alias("all"))
    return c.select("conv_id", "turns", F.coalesce(F.size(F.filter("all", lambda k: k < F.col("first"))), F.lit(0)).cast("long").alias("before_first"))


@q("t25_percentiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY 1")
def _(s, d):
    return t(s, d, "part").groupBy("p_brand").agg(r6(F.percentile("p_retailprice", 0.5)).alias("median"), r6(F.percentile("p_retailprice", 0.9)).alias("p90"))


@q("t23_layered_graph", "SELECT 'L' || k || '.m' || i AS src, 'L' || (k - 1) || '.m' || i AS dst FROM range(1, 4) a(k), range(0, 50) b(i)")
def _(s, d):
    n = s.range(150).select((F.floor(F.col("id") / 50) + 1).alias("k"), (F.col("id") % 50).alias("i"))
    name = lambda k: F.concat(F.lit("L"), k.cast("string"), F.lit(".m"), F.col("i").cast("string"))
    return n.select(name(F.col("k")).alias("src"), name(F.col("k") - 1).alias("dst"))


@q("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM k GROUP BY user_id, k")
def _(s, d):
    from ..streaming.debounce import sessions

    return sessions(t(s, d, "events"), "user_id", "2 hours").select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), "n")
