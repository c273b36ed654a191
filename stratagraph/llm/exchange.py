"""Fingerprint exchange: blocks send sorted Golomb-coded hashes to their owners and get a bitmap of those held more than once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb


def _ranges(values: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's share of the sorted hashes begins; owners hold equal ranges of the hash space."""
    edges = np.array([(k << 64) // owners for k in range(1, owners)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges, "left"), [len(values)]])


def repeated(table: DataFrame, owners: int) -> DataFrame:
    """table: block long, doc_id long, hashes array<long>, each row once. Returns doc_id and hits: array<boolean>, one for
    each hash, true where the same hash occurs elsewhere too (in the row, the block or another block).

    Rows are gathered by block, once for sending and receiving, so a block is whole wherever its rows were read. A block is
    bounded by with_block's input partition and merged(), an owner's range by the number of owners. What travels is the coded
    hashes, one bit for each of them on the way back, and the rows of the block itself; no text does.
    """

    def flat_of(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        lists = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["hashes"]]
        return lists, np.concatenate([*lists, np.zeros(0, np.uint64)])

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(flat_of(pdf)[1], return_counts=True)
        at, block = _ranges(values, owners), int(pdf["block"].iloc[0])
        rows = [(k, block, golomb.encode(values[i:j]), np.packbits(counts[i:j] > 1).tobytes()) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        return pd.DataFrame(rows, columns=["owner", "block", "coded", "own"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [golomb.decode(x) for x in pdf["coded"]]
        own = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(p)).astype(bool) for o, p in zip(pdf["own"], parts, strict=True)]
        values, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[inverse[np.concatenate(own)]] = True
        hit, at, out = twice[inverse], 0, []
        for p in parts:
            out.append(np.packbits(hit[at : at + len(p)]).tobytes())
            at += len(p)
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "bitmap": out})

    def receive(key, mine: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        lists, flat = flat_of(mine)
        values, inverse = np.unique(flat, return_inverse=True)
        at, flags = _ranges(values, owners), np.zeros(len(values), bool)
        for k, bits in zip(maps["owner"], maps["bitmap"], strict=True):
            flags[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[k + 1] - at[k]).astype(bool)
        hit, at, out = flags[inverse], 0, []
        for x in lists:
            out.append(hit[at : at + len(x)])
            at += len(x)
        return pd.DataFrame({"doc_id": mine["doc_id"], "hits": out})

    rows = table.select("block", "doc_id", "hashes")
    sent = rows.groupBy("block").applyInPandas(send, "owner int, block long, coded binary, own binary")
    maps = sent.groupBy("owner").applyInPandas(answer, "block long, owner int, bitmap binary")
    return rows.groupBy("block").cogroup(maps.groupBy("block")).applyInPandas(receive, "doc_id long, hits array<boolean>")


def owners_for(n_hashes: int, least: int) -> int:
    """So many that no owner decodes over two million hashes or so."""
    return max(least, -(-n_hashes // 2_000_000))


def with_block(df: DataFrame) -> DataFrame:
    """The input partition as block. Write the result to a table before use, so that the number is fixed."""
    return df.withColumn("block", F.spark_partition_id().cast("long"))


def merged(table: DataFrame, n_rows: int, n_hashes: int, least: int) -> DataFrame:
    """table with neighbouring blocks taken together, as far as a block then holds some 100,000 rows and two million hashes and
    `least` blocks are left: the number of messages is that of blocks times that of owners."""
    n = table.agg(F.count_distinct("block")).first()[0] or 1
    most = min(100_000 * n // max(n_rows, 1), 2_000_000 * n // max(n_hashes, 1), n // least)
    return table.withColumn("block", F.floor(F.col("block") / max(1, most)))
