"""Relations over the star-schema tables that stand for graphs, commits, functions and histories; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("call_count"), "dst")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, call_count: a nation to the two nations that sell most lines to its customers."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    j = li.join(s, F.col("l_suppkey") == s["s_suppkey"]).join(o, F.col("l_orderkey") == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"])
    return _top(j.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("call_count")), 2)


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("grp"), F.col("n_name").alias("name"))


def order_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file")).distinct()


#: Lines a task takes in supplier_graph; their pairs, and the counts of these, follow.
LINES = 200_000


def supplier_graph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, call_count: a supplier to the two that stand most often in the same order. Orders are dealt in so many parts
    that one holds some LINES lines, and so are pairs by their first, which is how all further steps want them."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("f")).where("o IS NOT NULL")
    parts = li.count() // LINES + 1
    of = li.repartition(parts, "o").groupBy("o").agg(F.collect_set("f").alias("fs")).where(F.size("fs") > 1)
    pairs = of.select("fs", F.explode("fs").alias("src")).select("src", F.explode("fs").alias("dst")).where("src <> dst")
    return _top(pairs.repartition(parts, "src").groupBy("src", "dst").agg(F.count("*").alias("call_count")), 2)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("grp"))


def supplier_dag(spark: SparkSession, d: str) -> DataFrame:
    """The edges of supplier_graph that ascend."""
    return supplier_graph(spark, d).where("src < dst")


def event_graph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, call_count: consecutive event types of a user, self-loops included."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("call_count"))


#: Folders of the functions' files, by the key modulo their number.
FOLDERS = ("src/", "src/tests/", "vendored/", "lib/test_", "src/third_party/")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """fn_id, shape_hash, concrete_hash, size, module, path, qualified_name, decorators, is_trivial: a document as a function body.
    Its first letter decides on the decorator, its length on the class and whether it is trivial, its language on the folder."""
    t = F.coalesce("text", F.lit(""))
    first, size = F.lower(F.substring(F.trim(t), 1, 1)), F.size(F.split(F.trim(t), " "))
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.length(t) % len(FOLDERS) + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("fn_id"),
        F.md5(F.regexp_replace(F.lower(t), "[0-9]+", "#")).alias("shape_hash"),
        F.md5(t).alias("concrete_hash"),
        size.cast("long").alias("size"),
        F.col("source").alias("module"),
        F.concat(folder, F.col("lang"), F.lit("/"), F.col("source"), F.lit(".py")).alias("path"),
        F.concat(F.when(F.length(t) % 3 != 0, F.concat(F.lit("C"), (F.length(t) % 3).cast("string"), F.lit("."))).otherwise(F.lit("")), F.lit("f"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.when(first < "f", F.array(F.lit("typing.overload"))).when(first < "m", F.array(F.lit("property"))).otherwise(F.array().cast("array<string>")).alias("decorators"),
        (F.length(t) % 2 == 0).alias("is_trivial"),
    )


def churn(spark: SparkSession, d: str) -> DataFrame:
    """module, cc_sum, churn: a part, its size and its lines."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("module"), F.col("p_size").cast("long").alias("cc_sum"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("churn"))
    return p.join(n, p["module"] == n["k"], "left").select("module", "cc_sum", F.coalesce("churn", F.lit(0)).alias("churn"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """day, overall, n: a score for each day of events."""
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("overall"), F.count("*").alias("n"))


F1 = """trade AS (SELECT * FROM (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS call_count,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) WHERE rn <= 2)"""
F2 = """os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS f FROM lineitem),
sup AS (SELECT * FROM (SELECT a.f AS src, b.f AS dst, count(*) AS call_count, row_number() OVER (PARTITION BY a.f ORDER BY count(*) DESC, b.f) AS rn
  FROM os a JOIN os b ON a.o = b.o AND a.f <> b.f GROUP BY 1, 2) WHERE rn <= 2)"""
F3 = F2 + ", dag AS (SELECT src, dst, call_count FROM sup WHERE src < dst)"
F4 = """ev AS (SELECT src, dst, count(*) AS call_count FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2)"""
F7 = """ch AS (SELECT p_partkey AS module, p_size::BIGINT AS cc_sum, coalesce(n, 0) AS churn FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
F8 = r"""fn0 AS (SELECT *, coalesce(text, '') AS t, length(coalesce(text, '')) AS nt, lower(trim(coalesce(text, ''))[1]) AS a FROM documents),
fn AS (SELECT doc_id AS fn_id, md5(regexp_replace(lower(t), '[0-9]+', '#', 'g')) AS shape_hash, md5(t) AS concrete_hash,
  len(string_split(trim(t), ' '))::BIGINT AS size, source AS module, (['src/', 'src/tests/', 'vendored/', 'lib/test_', 'src/third_party/'])[nt % 5 + 1] || lang || '/' || source || '.py' AS path,
  CASE WHEN nt % 3 <> 0 THEN 'C' || nt % 3 || '.' ELSE '' END || 'f' || doc_id AS qualified_name,
  CASE WHEN a < 'f' THEN 'typing.overload' WHEN a < 'm' THEN 'property' ELSE '' END AS decorator, nt % 2 = 0 AS is_trivial FROM fn0)"""
F12 = """hist AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS overall, count(*) AS n FROM events GROUP BY 1)"""
#: All nodes that reach and are reached in supplier_graph.
CLOSURE = "WITH RECURSIVE " + F2 + ", clo AS (SELECT src, dst FROM sup UNION SELECT clo.src, sup.dst FROM clo JOIN sup ON clo.dst = sup.src)"


#: A package of one generated module for each part: what each imports, guards and calls follows from its key k and size z.
GEN = "gen AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 7 + 1 AS t, p_partkey % 5 + 1 AS u FROM part)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """qualname, rel_path, is_package, content of the package gen and its modules m1, m2, ..."""
    k, z = F.col("p_partkey"), F.col("p_size")
    m = lambda n: F.concat(F.lit("m"), n.cast("string"))
    text = F.concat(
        F.lit("import os.path\n"),
        F.when(z % 2 == 0, F.concat(F.lit("from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from gen import "), m(k % 5 + 1), F.lit("\n"))).otherwise(""),
        F.lit("from gen."), m(k % 7 + 1), F.lit(" import f as g\n\n\ndef f(a, b):\n"),
        F.repeat(F.lit("    if a and b:\n        g(a)\n"), (z % 5).cast("int")),
        F.lit("    return g(b)\n"),
        F.when(z % 3 == 0, F.lit("\n\nif __name__ == '__main__':\n    f(1, 2)\n")).otherwise(""),
    )
    one = table(spark, d, "part").select(F.concat(F.lit("gen."), m(k)).alias("qualname"), F.concat(F.lit("gen/"), m(k), F.lit(".py")).alias("rel_path"), F.lit(False).alias("is_package"), F.encode(text, "UTF-8").alias("content"))
    top = spark.createDataFrame([("gen", "gen/__init__.py", True, bytearray(b""))], "qualname string, rel_path string, is_package boolean, content binary")
    return one.unionByName(top)
