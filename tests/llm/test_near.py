from __future__ import annotations

import random

import numpy as np

from stratagraph.llm import near_dedup
from stratagraph.llm.common import Scratch
from stratagraph.llm.components import components

from .data import frame, prose, texts, words


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same or (both and 100 * both >= 85 * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)] if sets[k] else i) for k, (i, _, _) in enumerate(rows) if i is not None)


def compare(spark, rows, **how):
    got = near_dedup.near_duplicates(frame(spark, rows), **how).where("doc_id IS NOT NULL").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_like_brute_force(spark):
    compare(spark, texts())


def chain(n=40, seed=5):
    """Each text is near the next, the ends are far apart; and a hot group of texts that share most words."""
    rng = random.Random(seed)
    w, rows = prose(rng, 150).split(), []
    for k in range(n):
        w = [*w[:-3], prose(rng, 1), *w[-2:]] if k % 2 else [prose(rng, 1), *w[1:]]
        rows.append((1000 - k, " ".join(w), "a"))
    return rows


def test_chain_and_shuffled_joins(spark):
    compare(spark, chain() + texts(3)[:10], broadcast_rows=0)


def test_all_pairs_of_the_last_round(spark):
    compare(spark, chain(16) + texts(3)[:6], pivot_rounds=0)


def edited(t: str, n: int) -> str:
    w = t.split()
    return " ".join([*w[:-n], *["edit"] * n])


def test_one_id_with_two_texts(spark):
    """Each text of an id keeps its own links, and the id joins them."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 120) for _ in range(3))
    compare(spark, [(7, a, "x"), (7, b, "x"), (8, edited(a, 2), "x"), (9, edited(b, 2), "x")])
    compare(spark, [(7, a, "x"), (7, b, "x"), (3, edited(a, 2), "x"), (9, edited(b, 2), "x"), (12, c, "x"), (9, c, "y")], broadcast_rows=0)


def test_rows_without_an_id(spark):
    rng = random.Random(10)
    a, b = prose(rng, 120), prose(rng, 120)
    rows = [(5, a, "x"), (None, edited(a, 3), "x"), (4, edited(a, 6), "x"), (None, b, "x"), (None, edited(b, 2), "x")]
    for sent in (0, 100):
        got = near_dedup.near_duplicates(frame(spark, rows), broadcast_rows=sent).collect()
        assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(map(str, [(5, 4, False), (None, 4, False), (4, 4, True), (None, None, True), (None, None, True)]))


def test_drop_leaves_one_of_each(spark):
    rows = texts()
    out = near_dedup.drop_near_duplicates(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    kept = {r.doc_id for r in out.where("doc_id IS NOT NULL").collect()}
    assert kept == {i for i, _, c in expected(rows) if i == c}


def test_empty(spark):
    assert near_dedup.near_duplicates(frame(spark).limit(0)).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(1, None, None), (2, "", "a")])).where("n_shingles = 0 AND kept").count() == 2


def test_signatures_of_near_sets_lie_within_the_radius():
    rng, far = np.random.default_rng(3), 0
    for _ in range(200):
        s = rng.integers(0, 2**63, 400, np.uint64)
        t = np.concatenate([s[32:], rng.integers(0, 2**63, 32, np.uint64)])  # similarity 0.85
        far += (near_dedup.signature(s) != near_dedup.signature(t)).sum() > near_dedup.RADIUS
    assert far == 0


def test_components_like_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, k) for k in range(300, 360)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    scratch = Scratch(spark, "test")
    got = components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()
    want = {x: c for x, c in low.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert {r.node: r.component for r in got} == want
    scratch.drop()


def test_each_pair_has_one_first_slot(spark):
    """Against a plain reading of the signatures: of the keys that two share, one is first, and only within the radius."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**16, 60, np.uint16)
    sigs = []
    for k in range(40):
        s = base.copy()
        hit = rng.choice(60, rng.integers(0, 26), replace=False)
        s[hit] = rng.integers(0, 2**16, len(hit), np.uint16)
        sigs.append(s)
    classes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "rep long, signature binary")
    keys = near_dedup._keys(classes).join(near_dedup._planes(classes).withColumnRenamed("p_rep", "rep"), "rep")
    other = keys.selectExpr("key AS k", "rep AS b", "planes AS b_planes")
    got = keys.join(other, (keys["key"] == other["k"]) & (keys["rep"] < other["b"])).where(near_dedup._first_slot("slot", "planes", "b_planes")).select("rep", "b").collect()
    want = set()
    for a in range(40):
        for b in range(a + 1, 40):
            differ = (sigs[a] != sigs[b]).reshape(12, 5).sum(axis=1)
            if differ.sum() <= near_dedup.RADIUS and differ.min() <= 1:
                want.add((a, b))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert all((sigs[a] != sigs[b]).sum() > near_dedup.RADIUS for a in range(40) for b in range(a + 1, 40) if (a, b) not in want)
