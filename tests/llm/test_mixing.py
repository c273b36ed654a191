from __future__ import annotations

import math

import pytest

from stratagraph.llm import mixing

from .data import frame, texts, words


def targets(sizes):
    """By repeated sharing, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 5, None: 5, "z": 5, "q": 500}, {"a": 0, "b": 7}, {None: 3}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_takes_what_it_should(spark):
    rows = [(k, t, s) for k, (_, t, s) in enumerate(texts()) if t is None or len(words(t)) < 10_000]
    got = mixing.fair_queue(frame(spark, rows)).collect()
    size = {k: len(words(t)) for k, t, _ in rows}
    assert {r.doc_id: r.size for r in got} == size
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size
        per.setdefault(r.source, []).append(r)
    want = targets({s: sum(r.size for r in rs) for s, rs in per.items()})
    for s, rs in per.items():
        assert math.isclose(rs[0].target, want[s], abs_tol=1e-6)
        assert abs(sum(r.taken for r in rs) - want[s]) <= 2 * max(r.size for r in got)


def queue(got, most=2):
    """Words taken by (doc_id, h, order among equal rows), by one sorted list of all copies."""
    copies, per = [], {}
    for r in got:
        per.setdefault(r.source, []).append(r)
    for rs in per.values():
        end = 0
        for n, r in enumerate(sorted(rs, key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0))):
            end += r.size
            if r.size:
                copies += [((end + k * r.source_size) / r.target, r.h, -(2**63) if r.doc_id is None else r.doc_id, k, n, r.source, r) for k in range(most)]
    run, taken, budget = 0, {}, sum(rs[0].target for rs in per.values())
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        run += r.size
        if run - r.size / 2 <= budget:
            taken[(r.doc_id, r.h)] = taken.get((r.doc_id, r.h), 0) + r.size
    return taken


@pytest.mark.parametrize("share", [0.4, 1.5, 1.9])
def test_takes_like_one_sorted_list(spark, share):
    rows = [(k if k % 9 else None, t, s) for k, (_, t, s) in enumerate(texts())] + [(7, "one id", "a"), (7, "with two texts", "a"), (8, "equal rows", "b"), (8, "equal rows", "b")]
    got = mixing.fair_queue(frame(spark, rows), share=share).collect()
    taken = {}
    for r in got:
        taken[(r.doc_id, r.h)] = taken.get((r.doc_id, r.h), 0) + r.taken
    assert {k: x for k, x in taken.items() if x} == queue(got)
    assert abs(sum(taken.values()) - share * sum(r.size for r in got)) <= max(r.size for r in got) / 2


def test_reruns_and_slices_agree(spark, monkeypatch):
    docs = frame(spark)
    key = lambda df: sorted(str((r.doc_id, r.taken, r.finish)) for r in df.collect())
    a = key(mixing.fair_queue(docs))
    assert a == key(mixing.fair_queue(docs.repartition(7)))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    assert a == key(mixing.fair_queue(docs))


def test_mix_repeats_rows(spark):
    rows = [(k, t, s) for k, (_, t, s) in enumerate(texts())]
    docs = frame(spark, rows)
    times = {r.doc_id: r.times for r in mixing.fair_queue(docs).collect()}
    out = mixing.mix(docs)
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and {k: got.count(k) for k in times} == times
    again = [(3, "x y", "a"), (3, "x y", "a"), (3, "z y x", "a"), (None, "q r s t", None), (None, "q r s t", None)]
    queue = mixing.fair_queue(frame(spark, again)).collect()
    assert mixing.mix(frame(spark, again)).count() == sum(r.times for r in queue)


def test_empty(spark):
    assert mixing.fair_queue(frame(spark).limit(0)).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).count() == 0
