from __future__ import annotations

import random

import public_tokenizers

import corpus_pipeline
from stratagraph.llm import bpe, exact_dedup, mixing, near_dedup, quality

from .data import SPACE, frame, prose, texts, words
from .test_mixing import queue
from .test_near import shingles
from .test_quality import plain_features


def folder(spark, tmp_path, rows, labels):
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(texts()) if t is None or len(t) < 20_000]
    rows += [(500 + k, "!!! $$$ ### " * 9, "b") for k in range(12)] + [(600 + k, prose(rng, 40), "c") for k in range(40)]
    labels = [(i, int(i < 500 or i >= 600), 0) for i, _, _ in rows]
    d = folder(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
    scored, exact, near, mixed = (spark.read.parquet(f"{d}/{k}") for k in range(4))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not {500 + k for k in range(12)} & ids(scored) and len({600 + k for k in range(40)} & ids(scored)) >= 38
    assert exact_dedup.exact_duplicates(exact).where("group_size > 1").count() == 0
    assert near_dedup.near_duplicates(near).where("not kept").count() == 0
    assert ids(mixed) <= ids(near) <= ids(exact) <= ids(scored)
    assert corpus_pipeline.run(spark, d).count() == docs.count() == mixed.count()


def brute(rows, ranker):
    """What each stage leaves of rows (doc_id, text, source), one after the other, by plain lists."""
    kept = [r for r in rows if ranker.score(plain_features(r[1]))[0] >= 0.5]
    yield kept
    first = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(SPACE.sub(" ", r[1] or ""), r)
    kept = list(first.values())
    yield kept
    low = low_ids(kept, 80)
    yield [r for k, r in enumerate(kept) if r[0] is None or not words(r[1]) or low[k] == r[0]]


def low_ids(rows, percent):
    sets, low = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same or (both and 100 * both >= percent * len(sets[a] | sets[b])):
                low = [low[b] if x == low[a] else x for x in low]
    ids = {}
    for k, x in enumerate(low):
        if rows[k][0] is not None:
            ids[x] = min(ids.get(x, rows[k][0]), rows[k][0])
    return [ids.get(x) for x in low]


def test_like_brute_force(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, extra columns of clashing names."""
    rng = random.Random(12)
    rows = texts() + [(700 + k, "!!! $$$ ### " * (5 + k), "b") for k in range(8)] + [(None, None, None), (701, "  ", None), (3, prose(rng, 60), "b"), (None, texts()[0][1], "z")]
    near = prose(rng, 100).split()
    rows += [(800 + k, " ".join([*near[: 100 - k], *prose(rng, k).split()]), "cd"[k % 2]) for k in range(0, 12, 3)]
    labels = [(i, int(not 700 <= i < 800), 0) for i, _, _ in rows if i is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ranker = quality.train(docs, lab)
    key = lambda rs: sorted(str((r[0], r[1], r[2])) for r in rs)
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, ranker), strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        assert key(docs.select("doc_id", "text", "source").collect()) == key(want), name
    taken = queue(mixing.fair_queue(docs).collect())
    mixed = corpus_pipeline.mix_stage(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    enc = bpe.encoder(bpe.rank_file(), public_tokenizers.PATTERN)
    want = sorted(str((r.doc_id, len(enc.encode_ordinary(r.text)))) for r in mixed.collect())
    assert sorted(str((r.doc_id, r.n_tokens)) for r in corpus_pipeline.bpe_stage(spark, mixed, str(tmp_path)).collect()) == want


def test_empty_table(spark, tmp_path):
    d = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
