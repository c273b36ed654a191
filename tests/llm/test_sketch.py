from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from stratagraph.llm import scaled_sketch as sk

from .data import frame, prose, texts, words


def edited(rows):
    """By doc_id: text, edited text and next text."""
    order = sorted((i, t or "") for i, t, _ in rows)
    out = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        take = len(t) // 4
        out[i] = (t, t[: len(t) - take] + n[:take], n)
    return out


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_like_brute_force(spark):
    rows = [r for r in texts() if r[0] is not None and r[0] != 132]
    got = {r.doc_id: r for r in sk.sketch_pairs(frame(spark, rows)).collect()}
    want = edited(rows)
    assert got.keys() == want.keys()
    for i, (t, e, n) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for value, other in ((r.near_edited, e), (r.near_next, n)):
            assert 0 <= value <= 1
            if min(len(words(t)), len(words(other))) > 80:
                assert abs(value - like(shingles(t), shingles(other))) < (0.3 if len(words(t)) < 300 else 0.05)
    assert got[0].fingerprint == got[100].fingerprint


def test_native_plan(spark):
    plan = sk.sketch_pairs(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketch_is_what_the_bound_leaves(spark):
    """No hash is kept but by the bound, in texts of any length; a text of n words has n - 4 shingles, one at least."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(n, prose(rng, n)) for n in [400, *range(1, 60)]], "n int, t string")
    all_ = {r.n: r.s for r in sk.with_sketch(rows, "t", "s", bound=2**63 - 1).collect()}
    few = {r.n: r.s for r in sk.with_sketch(rows, "t", "s").collect()}
    assert len(all_[400]) == 396 and 0.1 < len(few[400]) / 396 < 0.4 and all(set(few[n]) <= set(all_[n]) for n in few)
    assert any(not s for s in few.values())
    share = sum(map(len, few.values())) / sum(map(len, all_.values()))
    assert abs(share - 0.25) < 0.05


def test_no_evidence_is_told(spark):
    rows = [(k, w, "a") for k, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split())] + [(50, None, "a"), (51, " ", "b")]
    for r in sk.sketch_pairs(frame(spark, rows)).collect():
        if r.next_evidence == 0:
            assert r.near_next == float(r.doc_id == 50) and r.fingerprint in ("1:", "0:")
        assert (r.edited_evidence == 0) == (r.fingerprint.endswith(":") and r.edited_fingerprint.endswith(":"))
        assert 0 <= r.contained_edited <= 1 and 0 <= r.contained_next <= 1


def test_containment_of_unequal_texts_and_merging(spark):
    long, short = prose(random.Random(6), 4000), None
    short = " ".join(long.split()[100:400])
    df = spark.createDataFrame([(long, short)], "a string, b string")
    df = sk.with_sketch(sk.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(sk.containment("sb", "sa").alias("c"), sk.containment("sa", "sb").alias("d"), (F.array_union("sa", "sb") == F.col("sa")).alias("m")).first()
    assert r.c == 1.0 and 0.02 < r.d < 0.15 and r.m


def test_repeats_nulls_and_empty(spark):
    got = sk.sketch_pairs(frame(spark)).collect()
    assert len(got) == len(texts())
    a, b = (r for r in got if r.doc_id == 132)
    assert a == b
    assert sk.sketch_pairs(frame(spark).limit(0)).count() == 0
    lone = sk.sketch_pairs(frame(spark, [(7, prose(random.Random(3), 60), "a")])).first()
    assert lone.near_next == 1.0
    same = sorted(map(str, sk.sketch_pairs(frame(spark), broadcast_rows=0).collect()))
    assert same == sorted(map(str, got))
