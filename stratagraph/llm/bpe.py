"""Byte-level BPE by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship, table, text_col

#: Longer texts are encoded in pieces of about so many characters.
PIECE = 100_000
#: Between a character that isn't white space and one that is, no match of the pattern goes on: white space stands only at the
#: start of its alternatives, and the look-ahead only looks at what follows white space.
_CUT = re.compile(r"(?<=\S)(?=\s)")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """text in parts of about size characters that encode on their own to the same ids. A run without a safe boundary stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), np.uint32)
    return np.concatenate([np.array(enc.encode_ordinary(p), np.uint32) for p in pieces(text, size)])


def decode(enc, ids: np.ndarray, size: int = PIECE) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8 on their own."""
    return b"".join(enc.decode_bytes(ids[i : i + size].tolist()) for i in range(0, len(ids), size))


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with column ids: array<int>. Null text counts as empty and has no ids; an empty table stays empty. The column is
    named ids whatever else docs has; a column of that name is replaced."""
    path, pattern = path or rank_file(), pattern or _pattern()
    ship(docs.sparkSession)
    return docs.withColumn("ids", _encode_udf(path, pattern)(text_col(docs, text)))


def bpe_decode(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with column decoded: binary, the bytes that the ids stand for; null ids give empty bytes."""
    path, pattern = path or rank_file(), _pattern()
    ship(docs.sparkSession)

    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for s in batches:
            yield s.map(lambda x: decode(enc, np.asarray(x if x is not None else [], np.uint32)))

    back.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("decoded", F.pandas_udf(back, "binary")(docs[ids]))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encode_udf(path: str, pattern: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for s in batches:
            yield s.map(lambda t: encode(enc, t).astype(np.int32))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def bpe_digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded again in one pass over whole texts.

    Null and empty texts have no tokens and the digests of no bytes. Repeated rows give repeated results; other columns of
    docs are ignored. Batches go through one at a time and texts one after another, so memory holds one text's ids.
    """
    path, pattern = path or rank_file(), _pattern()
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = encode(enc, t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del enc
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir):
    """Every document with the number and digest of its ids and the digest of the bytes they decode to."""
    return bpe_digests(table(spark, sf_dir, "documents"))
