"""Links of a similarity from 0.80 up to 0.85."""

from __future__ import annotations

import random

import corpus_pipeline
from stratagraph.llm import near_dedup

from .data import frame, prose
from .test_near import shingles


def rows(seed: int = 6) -> list[tuple]:
    """Groups of a text and copies with a changed end: similarities from 0.7 to 1."""
    rng, out = random.Random(seed), []
    for k in range(30):
        w = prose(rng, 104).split()
        for j, cut in enumerate((0, 9, 10, 11, 12, 15)):
            out.append((100 * k + j, " ".join(w[: 104 - cut] + prose(rng, cut).split()), "a"))
    return out


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def expected(docs: list[tuple], percent: int) -> dict[int, int]:
    sets, low = {i: shingles(t) for i, t, _ in docs}, {i: i for i, _, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(docs)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low
    return low


def test_like_brute_force_at_eighty(spark):
    docs = rows()[:60]
    got = near_dedup.near_duplicates(frame(spark, docs), percent=80, pivot_rounds=0).collect()  # all pairs at their first shared key
    assert {r.doc_id: r.component_id for r in got} == expected(docs, 80) != expected(docs, 85)


def test_stage_drops_pairs_from_eighty_percent(spark, tmp_path):
    docs = [r for r in rows() if r[0] % 100 in (0, 3)]
    assert all(0.8 <= similarity(a[1], b[1]) < 0.85 for a, b in zip(docs[::2], docs[1::2], strict=True))
    out = corpus_pipeline.near_stage(spark, frame(spark, docs, extra=False), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _, _ in docs[::2]]


def test_layout_fits_the_threshold():
    assert near_dedup.layout(85) == (near_dedup.CHUNKS, near_dedup.WIDTH) and near_dedup.layout(80) == (15, 4)
    assert near_dedup.beyond(80, near_dedup.RADIUS) > 1e-4 > 1e-5 > near_dedup.beyond(80, 29)
