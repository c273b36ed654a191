from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from stratagraph.llm import pitman_yor as hpy
from stratagraph.llm import seating

from .data import frame, prose, texts, words


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    tokens = [(i, [*words(t), None]) for i, t, _ in rows]
    c = Counter(w for i, ws in tokens if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i is None, i or 0), held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in tokens)


def test_base_like_brute_force(spark):
    got = hpy.score_documents(frame(spark)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == base(texts())
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_learns_what_follows_what(spark):
    rng, follow = random.Random(4), {}
    def sentence():
        w, out = "start", []
        for _ in range(30):
            w = follow.setdefault(w, [prose(rng, 1) for _ in range(2)])[rng.random() < 0.2]
            out.append(w)
        return " ".join(out)
    rows = [(i, sentence(), "a") for i in range(400)]
    got = [r for r in hpy.score_documents(frame(spark, rows)).collect() if r.held_out]
    assert len(got) > 20
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_probabilities_of_a_context_sum_to_one(spark):
    """All texts are one word; P(word | end) over the vocabulary and one unknown word is read off texts that share P(end | word)."""
    rows = [(i, "ab"[i % 3 == 0], "x") for i in range(300)] + [(900 + i, None, "x") for i in range(60)]
    got = {r.doc_id: r for r in hpy.score_documents(frame(spark, rows)).collect()}
    # P(w | end) P(end | w) for both words and P(end | end); the words are always followed by an end.
    total = sum(10 ** got[i].score for i in (0, 1, 900))
    assert 0.9 < total <= 1.0


def exact(d: float, most: int) -> np.ndarray:
    """log d^t S(c, t) by the recurrence, as far as wanted."""
    seating._LOGS.clear()
    out = seating.log_stirling(d, most).copy()
    seating._LOGS.clear()
    return out


def test_table_counts_follow_the_recurrence():
    """Where the series and the saddle point stand in for the recurrence, distributions differ by under 1 %."""
    for d in (0.8, 0.5, 0.25):
        table = exact(d, 1500)
        for c in (513, 900, 1500):
            t = np.arange(1.0, c + 1)
            for lam in (0.01, 1, 30, 300, 3000, 30000):
                p, q = t * math.log(lam) + table[c, 1 : c + 1], seating.log_weight(np.full(c, float(c)), t, np.full(c, math.log(lam)), d)
                p, q = np.exp(p - p.max()), np.exp(q - q.max())
                assert abs(p / p.sum() - q / q.sum()).sum() / 2 < 0.01, (d, c, lam)


def test_drawn_table_counts():
    rng = np.random.default_rng(3)
    for d, c, lam in ((0.8, 2, 0.9), (0.5, 40, 3.0), (0.8, 700, 20.0), (0.8, 5, 1e-12), (0.5, 600, 1e6)):
        table = exact(d, c)
        w = np.arange(1, c + 1) * math.log(lam) + table[c, 1 : c + 1]
        w = np.exp(w - w.max())
        mean = (w * np.arange(1, c + 1)).sum() / w.sum()
        got = seating.draw_tables(np.full(4000, c), np.full(4000, lam), d, rng)
        assert got.min() >= 1 and got.max() <= c and abs(got.mean() - mean) < 0.06 * math.sqrt(mean) + 1e-9
    assert seating.draw_tables(np.array([0, 1, 10**8]), np.array([1.0, 1.0, 2.0]), 0.8, rng)[:2].tolist() == [0, 1]


class Restaurants:
    """The plain sampler: customers leave and sit down one by one, tables are customers of the root."""

    def __init__(self, rows, d=0.8, strength=20.0, root_d=0.5, root_strength=10.0, seed=5):
        self.rng, self.d, self.s, self.rd, self.rs = random.Random(seed), d, strength, root_d, root_strength
        self.pairs = [(u, w) for i, t in rows if not held_out(i) for u, w in self.of(t)]
        self.types = len({w for _, w in self.pairs})
        self.tables: dict = {}
        for u, w in self.pairs:
            self.sit(u, w)

    @staticmethod
    def of(text):
        ws = [*words(text), None]
        return list(zip([None, *ws[:-1]], ws, strict=True))

    def pick(self, sizes):
        return self.rng.choices(range(len(sizes)), sizes)[0]

    def prob(self, u, w):
        """u is "root" for the root."""
        d, s = (self.rd, self.rs) if u == "root" else (self.d, self.s)
        here = self.tables.get(u, {})
        n, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        mine = here.get(w, [])
        up = 1 / (self.types + 1) if u == "root" else self.prob("root", w)
        return (sum(mine) - d * len(mine) + (s + d * t) * up) / (s + n)

    def sit(self, u, w):
        d, s = (self.rd, self.rs) if u == "root" else (self.d, self.s)
        here = self.tables.setdefault(u, {})
        mine, t = here.setdefault(w, []), sum(map(len, here.values()))
        up = 1 / (self.types + 1) if u == "root" else self.prob("root", w)
        k = self.pick([*[n - d for n in mine], (s + d * t) * up])
        if k < len(mine):
            mine[k] += 1
        else:
            mine.append(1)
            if u != "root":
                self.sit("root", w)

    def leave(self, u, w):
        mine = self.tables[u][w]
        k = self.pick(mine)
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            if u != "root":
                self.leave("root", w)

    def scores(self, rows, burn_in=40, samples=160):
        total: Counter = Counter()
        asked = {p for _, t in rows for p in self.of(t)}
        for k in range(burn_in + samples):
            for u, w in self.pairs:
                self.leave(u, w)
                self.sit(u, w)
            if k >= burn_in:
                for p in asked:
                    total[p] += self.prob(*p) / samples
        return {i: sum(math.log10(total[p]) for p in self.of(t)) for i, t in rows}


def small_corpus():
    rng, out = random.Random(8), []
    for i in range(26):
        w, ws = "a", []
        for _ in range(rng.randint(3, 14)):
            w = rng.choice({"a": "bbbc", "b": "aaaad", "c": "abcd", "d": "e"}.get(w, "abcde"))
            ws.append(w)
        out.append((i, " ".join(ws)))
    return out


def test_scores_like_the_plain_sampler(spark):
    """The averaged predictive probabilities agree with those of a sampler that moves customers one at a time."""
    rows = small_corpus()
    for how in ({"strength": 20.0}, {"strength": 0.5, "d": 0.5}):
        want = Restaurants(rows, **how).scores(rows)
        got = {r.doc_id: r for r in hpy.score_documents(frame(spark, [(i, t, "a") for i, t in rows]), burn_in=3, samples=10, **how).collect()}
        off = [abs(got[i].score - want[i]) / got[i].n_tokens for i in want]
        assert max(off) < 0.03 and sum(off) / len(off) < 0.012, off
        spread = sum(abs(want[i] - got[i].base_score) / got[i].n_tokens for i in want) / len(want)
        assert spread > 0.03  # the test tells the model from the base


def test_hot_contexts_go_over_owners(spark):
    """A context with most of the tokens is seated in pieces; the mixture stays a distribution."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"the {rng.choice('abcdefghij')}" for _ in range(20)), "a") for i in range(60)]
    one, many = ({r.doc_id: r.score for r in hpy.score_documents(frame(spark, rows), buckets=b, samples=4).collect()} for b in (1, 16))
    assert all(abs(one[i] - many[i]) < 0.01 * abs(one[i]) + 0.2 for i in one)


def test_packing():
    for a in (np.arange(-5, 500), np.zeros(0, np.int64), np.array([1.5, -2]), np.array([True, False])):
        assert (hpy.unpack(hpy.pack(a), a.dtype) == a).all()


def test_reruns_agree_and_empty(spark):
    docs = frame(spark)
    a, b = (sorted((r.doc_id or -1, r.score) for r in hpy.score_documents(docs).collect()) for _ in range(2))
    assert a == b
    assert hpy.score_documents(docs.limit(0)).count() == 0
    only = hpy.score_documents(frame(spark, [(k, "few words", "a") for k in range(60) if held_out(k)])).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 for r in only)


def peak(body):
    """What the body returns and the most bytes of arrays it held at once."""
    tracemalloc.start()
    out = body()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_bodies_hold_few_copies_of_a_block():
    """A block's pairs and an owner's hold some 40 bytes a token or pair at their peak; whole intermediate arrays took about twice that."""
    rng, n, types = np.random.default_rng(9), 400_000, 60_000
    ids = np.minimum(rng.zipf(1.3, n) - 1, types - 1).astype(np.int32)
    ids[:types] = np.arange(types)
    vocab = rng.permutation(np.unique(rng.integers(1, 1 << 62, types + 100).astype(np.uint64))[:types])
    vocab[0] = hpy.END
    c = np.bincount(ids, minlength=types)[np.argsort(vocab)]
    row = {"sizes": hpy.pack(np.full(n // 200, 200)), "train": hpy.pack(np.ones(n // 200, np.uint8)), "vocab": hpy.pack(vocab), "ids": hpy.pack(ids)}
    told = pd.DataFrame({"owner": [0], "counts": [hpy.pack(c)], "numbers": [hpy.pack(rng.permutation(types))]})
    asked, most = peak(lambda: hpy._pairs(row, told, n, 8, answered=False))
    small = types * 60
    assert most < 40 * n + small
    placed, most = peak(lambda: hpy._pairs(row, told, n, 8, answered=True))
    assert most < 40 * n + small
    # Each token's pair is that of its word and the one before it, and pairs of one owner stand together.
    before = np.concatenate([[0], ids[:-1]])
    assert (asked["u"][placed["pair"]] == before).all() and (asked["w"][placed["pair"]] == ids).all()
    assert (np.bincount(placed["pair"]) == asked["c"]).all() and asked["at"][-1] == len(asked["c"])
    u, m = asked["number"][asked["u"]], len(asked["u"])
    runs = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1])
    part = {"u": hpy.pack(u[runs]), "n": hpy.pack(np.diff(runs, append=m).astype(np.int32)), "w": hpy.pack(asked["number"][asked["w"]])}
    g, most = peak(lambda: hpy._gather(pd.DataFrame([part, part])))
    assert most < 55 * 2 * m
    assert len(g["keys"]) == m and (np.bincount(g["inverse"]) == 2).all() and (g["wlist"][g["keys"][g["inverse"][:m]] & 0xFFFFFFFF] == asked["number"][asked["w"]]).all()


def test_distinct_like_numpy():
    for a in (np.zeros(0, np.int64), np.array([3, 1, 3, 2, 1]), np.array([7], np.uint64)):
        assert all((x == y).all() for x, y in zip(hpy.distinct(a.copy()), np.unique(a, return_inverse=True), strict=True))
