"""Quality by Bradley-Terry ranking: scores learnt from preference pairs, cut at a quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import give_back, table, text_col

#: Rows of the bounded, documented sample of labelled rows.
SAMPLE_ROWS = 20_000
PAIRS = 40_000
_N_CHARS = 129
N_FEATURES = _N_CHARS + 12


def features(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A row for each document: shares of the characters, then lengths and shapes of words and lines. Nothing but the text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    starts, ends = words.word_spans(off, raw)
    of = np.searchsorted(off, starts, "right") - 1
    kind = np.minimum(raw, 128).astype(np.int64)
    chars = np.bincount(doc * _N_CHARS + kind, minlength=n * _N_CHARS).reshape(n, _N_CHARS)[:, :_N_CHARS].astype(np.float64)
    chars = np.sqrt(chars / np.maximum(size, 1)[:, None])
    count = lambda d: np.bincount(d, minlength=n).astype(np.float64)
    n_words = count(of)
    per = np.maximum(n_words, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(of, length, n) / per
    var = np.maximum(np.bincount(of, length**2, n) / per - mean**2, 0)
    last = raw[ends - 1] if len(ends) else raw[:0]
    first = raw[starts] if len(starts) else raw[:0]
    alpha = lambda b: ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    upper = lambda b: (b >= 65) & (b <= 90)
    lines = np.bincount(doc[raw == 10], minlength=n)
    h = words.hash_spans(raw, starts, ends)
    again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1 if len(h) else np.zeros(0, np.int64)
    order = np.lexsort((h, of))
    fresh = of[order][np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])] if len(h) else of
    more = np.stack(
        [
            np.sqrt(count(of[again]) / per),
            (count(of[again]) / per > 0.1).astype(np.float64),
            np.log1p(count(fresh)) / np.log1p(per),
            np.log1p(n_words),
            mean / 10,
            np.sqrt(var) / 10,
            count(of[~alpha(last)]) / per,
            count(of[~alpha(first)]) / per,
            count(of[upper(first) & upper(last)]) / per,
            count(of[length == 1]) / per,
            count(of[length > 20]) / per,
            lines / per,
        ],
        axis=1,
    )
    return np.concatenate([chars, more], axis=1)


def _rows(batch: pa.RecordBatch):
    off, raw = words.buffer_of(batch.column(1))
    for i, j in words.slices(off, 1 << 20):
        # A million short rows at once would be large in features, so rows count too.
        for a in range(i, j, 512):
            b = min(a + 512, j)
            yield a, b, features(off[a : b + 1] - off[a], raw[off[a] : off[b]])


class Ranker:
    """A linear score of standardised features; learn() fits it on pairs of a preferred and another document."""

    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, seed: int = 5, rounds: int = 25) -> Ranker:
        """x: features, y: 1 where preferred. Bradley-Terry: P(i over j) = sigmoid(s_i - s_j), so the logistic loss acts on
        differences of features. The cut is the quantile of the scores of x that leaves the share of y == 0 below it."""
        mean, scale = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(N_FEATURES)
        z = np.clip((x - mean) / scale, -8, 8)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return cls(mean, scale, np.zeros(N_FEATURES), 0.0, 1.0)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(N_FEATURES)
        loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + ridge * v @ v / 2
        now = loss(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = ridge * w - d.T @ p / pairs
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(N_FEATURES)
            step, size = np.linalg.solve(hessian, gradient), 1.0
            while (new := loss(w - size * step)) > now and size > 1e-6:
                size /= 2
            w, gain, now = w - size * step, now - new, new
            if gain < 1e-7:
                break
        s = z @ w
        cut = np.quantile(s, len(bad) / len(y))
        return cls(mean, scale, w, float(cut), float(max(np.median(np.abs(s - cut)) / 2, 1e-6)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, 0.5 at the cut."""
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.spread, -30, 30)))


def held_out(doc_id, mod: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Ranker:
    """Learns from a sample of labelled rows that are not held out: the sample_rows of least hash of doc_id, spread evenly.
    Rows without a label or a document don't count; with labels of one kind only every score is 0.5."""
    y = labels.where(labels[label].isin(0, 1) & ~held_out(labels["doc_id"])).groupBy(labels["doc_id"].cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    # At most sample_rows rows of two numbers.
    y = F.broadcast(y.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))
    rows = docs.join(y, docs["doc_id"] == y["__id"]).select(y["__id"], text_col(docs, text).alias("text"), y["__y"].cast("long").alias("__y"))

    def run(batches):
        for batch in batches:
            ids, ys = batch.column(0), batch.column(2)
            for a, b, x in _rows(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), ys.slice(a, b - a), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["id", "y", "x"])
        give_back()

    got = rows.mapInArrow(run, "id long, y long, x binary").orderBy("id").collect()
    x = np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
    return Ranker.learn(x, np.array([r.y for r in got], np.int64))


def quality_scores(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Null and empty texts are scored as texts of no words;
    repeated rows get the same score; a null doc_id is not held out; other columns are ignored; an empty table gives an empty
    result."""

    def run(batches):
        for batch in batches:
            for a, b, x in _rows(batch):
                s = ranker.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text scores below the cut, all columns as they were. The score is taken of each row's own
    text, so no join is needed and repeated ids do no harm."""
    ranker = train(docs, labels, text=text)
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(s)), pa.array(s, pa.string())], names=["a", "b"])
            yield pd.Series(np.concatenate([*[ranker.score(x) for _, _, x in _rows(batch)], np.zeros(0)]))
        give_back()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(run, "double")(text_col(docs, text)) >= 0.5)


def op4_quality(spark, sf_dir):
    """Every document with its quality score, learnt from labels of documents that are not held out, and whether it passes the cut."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
