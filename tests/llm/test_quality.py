from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from stratagraph.llm import quality

from .data import frame, prose, texts


def junk(rng, n):
    return " ".join(rng.choice(["!!!", "buy", "###", "xX99", "click", "$$$"]) for _ in range(n))


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, rng.randint(5, 60)) if good else junk(rng, rng.randint(5, 60)), "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, judged):
    rows, labels = judged
    docs = frame(spark, rows)
    got = quality.quality_scores(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    truth = {i: q for i, q, _ in labels}
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, judged):
    rows, labels = judged
    docs = frame(spark, rows)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert (a.weights == b.weights).all()


def plain_features(text):
    """The features of one text, word by word."""
    b = (text or "").encode()
    ws = [w.encode("latin1") for w in re.findall(r"[^\x20\x09-\x0D]+", b.decode("latin1"))]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]
    size, n = max(len(b), 1), len(ws)
    per = max(n, 1)
    alpha = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    upper = lambda c: 65 <= c <= 90
    chars = [0.0] * 129
    for c in b:
        chars[min(c, 128)] += 1
    again = sum(x == y for x, y in zip(low, low[1:], strict=False))
    mean = sum(map(len, ws)) / per
    var = max(sum(len(w) ** 2 for w in ws) / per - mean**2, 0)
    share = lambda f: sum(map(f, ws)) / per
    more = [math.sqrt(again / per), float(again / per > 0.1), math.log1p(len(set(low))) / math.log1p(per), math.log1p(n), mean / 10, math.sqrt(var) / 10]
    more += [share(lambda w: not alpha(w[-1])), share(lambda w: not alpha(w[0])), share(lambda w: upper(w[0]) and upper(w[-1])), share(lambda w: len(w) == 1), share(lambda w: len(w) > 20), b.count(10) / per]
    return np.array([[*(math.sqrt(c / size) for c in chars), *more]])


def test_scores_like_plain_features(spark, judged):
    """The query's scores against features counted word by word and a ranking fitted by plain gradient descent."""
    rows, labels = judged
    rows = rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(texts())]
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    x = np.concatenate([plain_features(t) for i, t, _ in sorted(r for r in rows if r[0] in truth)]).astype("<f4").astype(float)
    y = np.array([truth[i] for i in sorted(truth)])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(5)
    d = z[rng.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    w, rate = np.zeros(quality.N_FEATURES), 1 / (np.linalg.norm(d, 2) ** 2 / 4 / len(d) + 1e-2)
    v = w
    for k in range(600):  # accelerated gradient steps on the logistic loss of the differences
        g = 1e-2 * v - d.T @ (1 / (1 + np.exp(d @ v))) / len(d)
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    ranker = quality.train(docs, lab)
    assert np.abs(ranker.weights - w).max() < 1e-3 * np.abs(w).max() + 1e-4
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, ranker).collect() if r.doc_id is not None}
    cut = np.quantile(z @ w, (y == 0).mean())
    spread = np.median(np.abs(z @ w - cut)) / 2
    for i, t, _ in rows:
        s = np.clip((plain_features(t)[0] - mean) / scale, -8, 8) @ w
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip((s - cut) / spread, -30, 30)))) < 0.02, i


def test_weights_minimise_the_pairs_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, quality.N_FEATURES))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    r = quality.Ranker.learn(x, y, pairs=4000)
    assert abs(r.weights[0]) > 3 * np.abs(r.weights[1:]).max()
    assert abs((r.score(x) < 0.5).mean() - (y == 0).mean()) < 0.02  # the cut is that quantile


def test_awkward_rows(spark, judged):
    rows, labels = judged
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark)
    ranker = quality.train(frame(spark, rows), lab)
    got = quality.quality_scores(docs, ranker).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_quality(docs.unionByName(frame(spark, rows)), lab)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts()) + len(rows)
    assert quality.quality_scores(docs.limit(0), ranker).count() == 0
    none = quality.quality_scores(docs, quality.train(docs, lab.limit(0))).collect()
    assert all(r.score == 0.5 for r in none)
