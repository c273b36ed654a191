from __future__ import annotations

import random
import re

import numpy as np

from stratagraph.llm import chunk_dedup as cd

from .data import frame, prose, texts


def test_gear_like_a_rolling_hash():
    raw = np.frombuffer(prose(random.Random(1), 200).encode(), np.uint8)
    h, out = 0, []
    for b in raw:
        h = (2 * h + int(cd._GEAR[b])) % 2**32
        out.append(h)
    # Bytes further back than the window have been shifted out.
    assert cd.gear(raw).tolist() == out


def test_cuts_cover_the_text_and_keep_their_bounds():
    for t in ["", "a", "x" * 5000, prose(random.Random(2), 5000), "é" * 999]:
        b = t.encode()
        ends = cd.cuts(b)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(b)
        sizes = np.diff([0, *ends])
        assert (sizes <= 128).all() and (sizes[:-1] >= 12).all()


def test_an_insertion_moves_few_chunks():
    b = prose(random.Random(3), 2000).encode()
    chunks = lambda x: {x[s:e] for s, e in zip([0, *cd.cuts(x)], cd.cuts(x), strict=False)}
    assert len(chunks(b) - chunks(b[:5000] + b"inserted" + b[5000:])) <= 6


def test_finds_planted_passages_and_leaves_others(spark):
    rng = random.Random(4)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, 120), "a") for k in range(30)]
    for k in (3, 11, 25):
        rows[k] = (k, f"{prose(rng, 10 + k)} {passage} {prose(rng, 20)}", "a")
    twice = prose(rng, 60)
    rows.append((40, f"{twice} and in between {prose(rng, 9)} {twice}", "a"))
    got = {r.doc_id: r for r in cd.repeated_passages(frame(spark, rows)).collect()}
    assert got.keys() == {3, 11, 25, 40}
    assert got[3].first_doc_ids == [] and got[3].repeated_bytes == 0
    for k in (11, 25):
        assert got[k].first_doc_ids == [3] and got[k].repeated_bytes > 0.6 * len(passage)
    assert [p.first_doc_id for p in got[40].passages if p.earlier] == [40]


def brute(rows, min_words=25):
    """The same answer by dictionaries over all chunks: (row index) -> passages as (start, end, n_words, first_doc_id, earlier)."""
    chunks, places = [], {}
    for n, (i, t, _) in enumerate(rows):
        b = (t or "").encode()
        ends = cd.cuts(b)
        chunks.append([(s, e) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else [])
        for k, (s, e) in enumerate(chunks[-1]):
            places.setdefault(b[s:e], []).append((i is None, i or 0, n, k))
    out = {}
    for n, (i, t, _) in enumerate(rows):
        b, stretch, found = (t or "").encode(), [], []
        for k, (s, e) in enumerate([*chunks[n], (0, 0)]):
            where = places.get(b[s:e], []) if e else []
            if len(where) > 1:
                stretch.append((s, e, min(where), min(where)[2:] == (n, k)))
                continue
            if stretch:
                inside = b[stretch[0][0] : stretch[-1][1]].decode("latin1")
                n_words = len(re.findall(r"[^\x20\x09-\x0D]+", inside))
                if n_words >= min_words:
                    last = None
                    for s2, e2, first, own in stretch:
                        kind = (own, first[:3])
                        if kind == last:
                            found[-1][1] = e2
                        else:
                            found.append([s2, e2, n_words, None if first[0] else first[1], not own])
                        last = kind
            stretch = []
        if found:
            out[n] = (i, [tuple(f) for f in found])
    return sorted(map(str, out.values()))


def test_like_brute_force(spark):
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (30, 55, 80, 300)]
    rows = [(k, " ".join([prose(rng, rng.randint(0, 40)), rng.choice(shared), prose(rng, rng.randint(0, 30)), rng.choice(shared)]), "a") for k in range(25)]
    rows += [(None, f"{shared[1]} {prose(rng, 20)}", "a"), (None, "only rows without an id have this " + (only := prose(rng, 60)), "a"), (None, only, "b")]
    rows += [(3, shared[2], "a"), (3, shared[2][::-1], "a"), (9, shared[3], "a"), (9, shared[3], "a")] + texts()
    # One task, so that row numbers are as listed.
    got = cd.repeated_passages(frame(spark, rows).coalesce(1)).collect()
    assert sorted(str((r.doc_id, [tuple(p) for p in r.passages])) for r in got) == brute(rows)
    for r in got:
        assert r.repeated_bytes == sum(p.end - p.start for p in r.passages if p.earlier)
        assert r.first_doc_ids == sorted({p.first_doc_id for p in r.passages if p.earlier and p.first_doc_id is not None})


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in cd.repeated_passages(frame(spark)).collect()}
    assert not {120, 121, 122, 123, 131} & got.keys()
    assert {0, 100} <= got.keys() or len(texts()[0][1].split()) < 50
    assert cd.repeated_passages(frame(spark).limit(0)).count() == 0
