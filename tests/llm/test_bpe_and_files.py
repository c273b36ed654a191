from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from stratagraph.llm import bpe, token_files
from stratagraph.llm.common import Scratch

from .data import frame, prose, texts

ODD = ["", " ", "  ", "a  b", " \n a", "it's  we'll\t\n\nend ", "x" * 5000, "12345 67,8 90", "ÄÖ ß é́", "  nbsp em", "你好 世界", "😀 😀", "<|endoftext|> now", "hello <|endoftext|> you", "a<|endoftext|>b  <|endoftext|>", "x\u180e y\u200b z\x1c w\x85 v\xa0 u", "\u0000 ​", " trailing ", "a   b"]


def test_digests_like_the_library(spark):
    enc = bpe.encoder(bpe.rank_file(), public_tokenizers.PATTERN)
    rows = texts() + [(200 + k, t, "a") for k, t in enumerate(ODD)]
    got = bpe.bpe_digests(frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pieces_change_nothing():
    enc = bpe.encoder(bpe.rank_file(), public_tokenizers.PATTERN)
    for t in [*ODD, prose(random.Random(1), 3000), "a \n b\t\tc  d " * 500]:
        assert bpe.encode(enc, t, 50).tolist() == enc.encode_ordinary(t)
        assert "".join(bpe.pieces(t, 50)) == t


def test_encode_and_decode_columns(spark):
    docs = frame(spark)
    out = bpe.bpe_decode(bpe.bpe_encode(docs)).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out)
    assert bpe.bpe_digests(docs.limit(0)).count() == 0


def test_cached_encoder_like_the_library():
    lib = Tokenizer.from_file(token_files.tokenizer_file())
    own = token_files.CachedEncoder(token_files.tokenizer_file())
    rng = random.Random(2)
    many = [*ODD, *[prose(rng, 50) for _ in range(20)], *["".join(rng.choice(" \n\tab'1.,é ß…") for _ in range(30)) for _ in range(2000)]]
    for t in many + many:
        assert np.frombuffer(own(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_files_round_trip(spark):
    rows = texts()
    docs, scratch = frame(spark, rows), Scratch(spark, "test")
    folder = scratch.path("ids")
    manifest = token_files.write_token_files(docs, folder, shards=3, most=5000)
    assert manifest.count() > 6  # a task goes on to new shards
    got = token_files.read_token_files(manifest, folder).collect()
    lib = Tokenizer.from_file(token_files.tokenizer_file())
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    some = token_files.read_token_files(manifest, folder, only=[3, 9, 777]).collect()
    assert sorted(r.doc_id for r in some) == [3, 9]
    empty = token_files.write_token_files(docs.limit(0), scratch.path("none"), shards=2)
    assert empty.count() == 0
    scratch.drop()


def shard(frame=64):
    out = io.BytesIO()
    w = token_files.ShardWriter(out, frame=frame)
    docs = {k: np.arange(k * 7 % 40, dtype="<u4").tobytes() for k in range(50)}
    for k, ids in docs.items():
        w.add(None if k == 7 else k, ids)
    w.close()
    return docs, out.getvalue()


def test_reader_takes_only_what_it_needs():
    docs, raw = shard()
    r = token_files.ShardReader(io.BytesIO(raw), len(raw))
    assert r.lost.tolist() == [k == 7 for k in range(50)]
    assert r.document(49) == docs[49] and r.frames_read <= 4
    assert [r.document(k) for k in range(50)] == list(docs.values())


def test_plain_decoder_reads_the_shard():
    docs, raw = shard()
    d = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert d.read() == b"".join(docs.values())


def test_broken_frame_is_told():
    docs, raw = shard()
    r = token_files.ShardReader(io.BytesIO(raw), len(raw))
    r.sums = r.sums ^ 1
    with pytest.raises(ValueError, match="checksum"):
        r.document(49)
    with pytest.raises(ValueError, match="seek table"):
        token_files.ShardReader(io.BytesIO(raw[:-1]), len(raw) - 1)
