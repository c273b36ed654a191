"""What grows with the input stays in parts: partitions, kept rows and plans of steps that once did not."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from stratagraph.operators import behavior, graph, stats
from stratagraph.plans import fixtures
from stratagraph.sources import tree

SMALL = "/root/testdata/sf0.01"


def kept_by(monkeypatch, module):
    """The DataFrames that module keeps from now on."""
    kept, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    return kept


def test_supplier_graph_in_parts_that_grow_with_its_lines(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 5_000)
    got = fixtures.supplier_graph(spark, SMALL)
    assert got.rdd.getNumPartitions() == 60_000 // 5_000 + 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    assert {tuple(r) for r in got.collect()} == set(con.execute(f"WITH {fixtures.F2} SELECT src, dst, call_count FROM sup").fetchall())


def test_closure_keeps_words_not_pairs(spark, monkeypatch):
    kept, rng = kept_by(monkeypatch, graph), random.Random(3)
    pairs = {(k, (k + 1) % 12) for k in range(12)} | {(1000 + rng.randrange(90), 1000 + rng.randrange(90)) for _ in range(240)}
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= more
    got = graph.closure(spark.createDataFrame(sorted(pairs), "src long, dst long"), most=0)
    assert {tuple(r) for r in got.collect()} == want
    assert max(df.count() for df in kept) < len(want) / 10


def test_components_of_a_closure_without_a_join_of_it(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("e", "c"), ("c", "f"), ("f", "c")], "src string, dst string")
    n = graph.nodes_of(e).union(spark.createDataFrame([("x",)], "node string"))
    s = graph.scc(n, e, graph.closure(e, most=0).localCheckpoint())
    assert {tuple(r) for r in s.collect()} == {("a", "a", True), ("b", "a", True), ("c", "c", True), ("f", "c", True), ("d", "d", True), ("e", "e", False), ("x", "x", False)}
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_sources_of_one_file_are_parsed_by_all_cores(spark):
    found = spark.range(40, numPartitions=1).select(F.concat(F.lit("p.m"), F.col("id")).alias("qualname"), F.concat(F.lit("p/m"), F.col("id"), F.lit(".py")).alias("rel_path"), F.lit(False).alias("is_package"), F.encode(F.concat(F.lit("import os\nX = 'a'\n\n\ndef f(a: int) -> int:\n    g(a)\n    if a: exit("), F.col("id") % 3, F.lit(")\n")), "UTF-8").alias("content"))
    got = tree.parsed(found)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.qualname, r.gates[0].code, r.functions[0].n_hinted, r.functions[0].tokens["If"], r.imports[0].module) for r in got.collect()) == sorted((f"p.m{k}", k % 3, 2, 1, "os") for k in range(40))


def test_nearest_compares_few_pairs_as_columns(spark, monkeypatch):
    """As pairs of columns all of a group were compared before; ties, copies and odd vectors come out as then."""
    rng, compared, cosine = random.Random(8), [], stats.cosine
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: seen.add(1) or v, "double")
    monkeypatch.setattr(stats, "cosine", lambda a, b: compared.append(1) or count(cosine(a, b)))
    rows = [(i, [rng.random() - 0.5 for _ in range(6)], i % 2) for i in range(300)] + [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 1) for i in range(300, 360)]
    rows += [(400, None, 0), (401, [0.0] * 6, 0), (402, [1.0, 2.0], 0), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, g int")
    for k in (1, 3):
        got = {(r.id, r.neighbour, r.similarity) for r in stats.nearest(df, df.where("id % 20 = 0"), "g", k).collect()}
        want, vectors = set(), {i: (v, g) for i, v, g in rows}
        like = lambda a, b: round(sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) ** 0.5 * sum(q * q for q in b) ** 0.5), 6) if a and b and len(a) == len(b) and None not in a + b and any(a) and any(b) else None
        for i, (v, g) in vectors.items():
            if i % 20 == 0:
                others = [(like(v, w), j) for j, (w, h) in vectors.items() if h == g and j != i]
                want |= {(i, j, s) for s, j in sorted(others, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:k]}
        assert got == want
    assert compared and seen.value < 3_500


def test_a_band_is_spread_over_blocks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 2, 9, 10, 11, 40, 45, 47, 50])) for i in range(120)]
    got = behavior.band_pairs(spark.createDataFrame(rows, "id long, size long"), block=5)
    want = sorted((i, j) for i, s in rows for j, t in rows if s >= 0.85 * t and (s < t or (s == t and i < j)))
    assert sorted(map(tuple, got.collect())) == want
    assert got.rdd.glom().map(len).filter(lambda n: n > 0).count() > 20
