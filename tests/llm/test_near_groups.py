"""A large group of edits of one text, few of which are near each other."""

from __future__ import annotations

import random

from stratagraph.llm import near_dedup

from .data import frame, prose
from .test_near_eighty import expected


def edits(n: int = 60, seed: int = 21) -> list[tuple]:
    """A text with 4 of 29 places changed to one of three words each: no other copy has all, few have three of the four. Then
    ever shorter beginnings of it, and beginnings of two edits."""
    rng = random.Random(seed)
    base = [f"{w}{k}" for k, w in enumerate(prose(rng, 150).split())]
    out = []
    for k in range(n):
        w = list(base)
        for place in rng.sample(range(29), 4):
            w[5 * place + 4] = f"edit{rng.randrange(3)}"
        out.append((10 + k, " ".join(w), "a"))
    for k in range(8):
        w = out[3 * k][1].split()
        changed = [j for j in range(150) if w[j] != base[j]]
        w[changed[k % 4]] = base[changed[k % 4]]
        out.append((100 + k, " ".join(w), "b"))
    out += [(200 + k, " ".join(base[: 150 - cut]), "c") for k, cut in enumerate((12, 31, 52, 78, 90))]
    out += [(300 + k, " ".join(out[k][1].split()[:cut]), "c") for k, cut in enumerate((140, 122, 118, 60))]
    return out


def test_a_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    made, write = {}, near_dedup.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name.startswith("pairs"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup.Scratch, "write", counted)
    docs = [r for r in edits() if r[0] < 200]  # all of one length
    got = near_dedup.near_duplicates(frame(spark, docs, extra=False), percent=80, pivot_rounds=0).collect()
    want = expected(docs, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(docs) // 2 < len(set(want.values())) < len(docs) - 5
    # Texts of four edits have 20 shingles of their own making, and a link leaves room for 16 that the other lacks: they meet
    # only where they share an edit. Texts of three edits may meet each other besides.
    changed = [{(j, w) for j, w in enumerate(t.split()) if w.startswith("edit")} for _, t, _ in docs]
    may = [(a, b) for a in range(len(docs)) for b in range(a) if changed[a] & changed[b] or max(len(changed[a]), len(changed[b])) < 4]
    assert made["pairs0"] <= len(may) < len(docs) * (len(docs) - 1) // 2 // 4


def test_three_pivots_and_the_rest_like_brute_force(spark):
    for percent in (70, 85):
        docs = edits(30, percent)
        got = near_dedup.near_duplicates(frame(spark, docs, extra=False), percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == expected(docs, percent)
