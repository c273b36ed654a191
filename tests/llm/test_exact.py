from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import exact_dedup, exchange, golomb

from .data import SPACE, frame, texts


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert (golomb.decode(golomb.encode(a)) == a).all()


def test_golomb_is_small():
    a = np.unique(np.random.default_rng(1).integers(0, 2**40, 20_000, np.uint64))
    assert len(golomb.encode(a)) < 0.6 * a.nbytes


def test_exchange_like_counting(spark):
    """Hashes that occur again are told, however rows lie in blocks and blocks in files, and with blocks merged."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(-(2**63), 2**63, rng.integers(0, 6)).tolist() for _ in range(120)]
    for k in range(0, 120, 3):
        lists[k] += lists[(k * 7) % 120][:1] + (lists[k][:1] if k % 2 else [])
    counts = defaultdict(int)
    for x in lists:
        for h in x:
            counts[h] += 1
    table = spark.createDataFrame([(k % 9, k, x) for k, x in enumerate(lists)], "block long, doc_id long, hashes array<long>").repartition(5)
    want = {k: [counts[h] > 1 for h in x] for k, x in enumerate(lists)}
    for given in (table, exchange.merged(table, 120, sum(map(len, lists)), 2)):
        for owners in (1, 7):
            assert {r.doc_id: r.hits for r in exchange.repeated(given, owners).collect()} == want
    assert exchange.merged(table, 120, 400, 2).select("block").distinct().count() == 3
    assert exchange.repeated(table.limit(0), 3).count() == 0


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for i, t, _ in rows:
        norm = SPACE.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else i
        out.append((i, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_like_brute_force(spark):
    got = exact_dedup.exact_duplicates(frame(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected(texts()), key=key)


def test_without_broadcast(spark):
    rows = texts() + [(500 + k, "a third of all rows\nis this", "a") for k in range(30)] + [(None, "no  id", "a"), (None, "no id", "b")]
    for how in (exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates):
        a, b = how(frame(spark, rows), broadcast_rows=0).collect(), how(frame(spark, rows)).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_drop_keeps_one_of_each(spark):
    docs = frame(spark)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    kept = [SPACE.sub(" ", r.text or "") for r in out.collect()]
    assert len(kept) == len(set(kept)) == len({SPACE.sub(" ", t or "") for _, t, _ in texts()})


def test_repeated_ids_with_one_text_leave_one_row(spark):
    rows = [(3, "a  b c", "x"), (3, "a b c", "y"), (4, "a b\tc", "z"), (5, "else", "x"), (None, "n  n", "x"), (None, "n n", "x"), (6, None, "x"), (7, "", "x")]
    for rows_sent in (0, 1000):
        out = exact_dedup.drop_exact_duplicates(frame(spark, rows), broadcast_rows=rows_sent).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, SPACE.sub(" ", r.text or "")) for r in out) == [(-1, "n n"), (3, "a b c"), (5, "else"), (6, "")]
    marks = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in marks if r.kept) == ["3", "3", "5", "6", "None", "None"]


def test_empty(spark):
    assert exact_dedup.exact_duplicates(frame(spark).limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(frame(spark).limit(0)).count() == 0
