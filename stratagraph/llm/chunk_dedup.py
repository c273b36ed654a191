"""Repeated passages by content-defined chunks: a gear rolling hash cuts texts where their content says so."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, give_back, join_counted, shuffle_partitions, table, text_col
from .exchange import merged, owners_for, repeated, with_block

_GEAR = (words.mix(np.arange(7001, 7257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Bytes that the rolling hash looks back on: it is of 32 bits and shifts by one a byte.
WINDOW = 32


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2h + gear[byte] mod 2^32, here by doubling spans instead of byte by byte."""
    h, m = _GEAR[raw], 1
    while m < WINDOW:
        add = np.zeros_like(h)
        add[m:] = h[:-m] << np.uint32(m) if m < len(h) else 0
        h = h + add
        m *= 2
    return h


def cuts(text: bytes, mean: int = 32, least: int = 12, most: int = 128) -> list[int]:
    """Ends of the chunks of text, the last one its length. A cut follows a byte where the hash's upper bits are zero, at
    least `least` and at most `most` bytes after the one before, so an insertion moves only the chunks around it."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    bits = int(mean).bit_length() - 1
    found: list[np.ndarray] = []
    for i in range(0, n, 1 << 20):
        lead = max(0, i - WINDOW)
        h = gear(raw[lead : i + (1 << 20)])[i - lead :]
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + i + 1)
    out, at = [], 0
    for c in np.concatenate(found).tolist() if found else []:
        while c - at > most:
            at += most
            out.append(at)
        if c - at >= least:
            out.append(c)
            at = c
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


_CHUNKED = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("digests", pa.binary()), ("ends", pa.list_(pa.int32())), ("heads", pa.binary()), ("mid", pa.binary())])


def chunked(docs: DataFrame, text: str = "text", **sizes) -> DataFrame:
    """doc_id, hashes (one 64-bit hash for each chunk), digests (16 bytes for each), ends (byte offsets), heads (a byte for
    each: the words that begin in it) and mid (a byte for each: 1 where it begins within a word) of every row."""

    if sizes.get("most", 128) > 510:
        raise ValueError("heads holds the words of a chunk in a byte: most is 510 at most")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, held = [], 0
            for doc_id, t in zip(ids, batch.column(1), strict=True):
                b = t.as_py().encode()
                ends = cuts(b, **sizes)
                starts = [0, *ends[:-1]] if ends else []
                digest = b"".join([xxhash.xxh3_128_digest(b[s:e]) for s, e in zip(starts, ends, strict=True)])
                hashes = np.frombuffer(digest, "<i8")[::2]
                begins, closes = words.word_spans(np.array([0, len(b)]), np.frombuffer(b, np.uint8))
                at = np.searchsorted(begins, np.array([*starts, len(b)]))
                before = at[:-1] - 1  # the last word that begins ahead of the chunk
                mid = (before >= 0) & (np.array(starts, np.int64) < closes[np.maximum(before, 0)]) if len(begins) else np.zeros(len(ends), bool)
                rows.append({"doc_id": doc_id, "hashes": hashes, "digests": digest, "ends": ends, "heads": np.diff(at).astype(np.uint8).tobytes(), "mid": mid.astype(np.uint8).tobytes()})
                held += len(ends)
                if held > 200_000 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKED)
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, hashes array<long>, digests binary, ends array<int>, heads binary, mid binary")


_PASSAGES = "array<struct<start:int,end:int,n_words:int,first_doc_id:long,earlier:boolean>>"


def repeated_passages(docs: DataFrame, text: str = "text", min_words: int = 25, **sizes) -> DataFrame:
    """A row for each row of docs that shares a passage with another place: doc_id, n_bytes, n_chunks, repeated_bytes (of its
    passages that occur earlier too), passages (array of start, end in bytes, n_words, first_doc_id, earlier) and
    first_doc_ids (of the earlier ones, distinct, ascending).

    A repeated stretch is a run of adjacent chunks that all occur elsewhere, of min_words words or more (n_words). Chunks at
    the edges of a passage also hold what stands around it, so a passage of twice min_words words is found for sure in
    practice. A stretch is cut into passages where it changes from first occurrence to copy or the copied document changes.
    The first place of a chunk is that of the smallest doc_id (null comes last), then of the smallest row number, then offset;
    `earlier` is false for the first place itself. Repeats within one document count.

    64-bit hashes of chunks are exchanged as Golomb codes first; only chunks that the bitmaps call repeated travel with their
    128-bit digests. Null and empty texts have no chunks and no row. A row without doc_id is found like any other, with a null
    doc_id; first_doc_id is null where only such rows hold a chunk, and those are not in first_doc_ids. Rows that repeat a
    doc_id are places of their own and have a row each. Other columns are ignored; an empty table gives an empty result.

    Rows are numbered once, in the table of chunks. A chunk with a large share of all places, as a line that every document
    has, is not gathered in one task: its first place is a minimum, and it joins by the executors' own copy.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "chunks")
    all_chunks = scratch.write(with_block(chunked(docs, text, **sizes)).withColumn("row", F.monotonically_increasing_id()), "chunks")
    rows, n = (x or 0 for x in all_chunks.agg(F.count("*"), F.sum(F.size("hashes"))).first())
    sent = merged(all_chunks.select("block", F.col("row").alias("doc_id"), "hashes"), rows, n, 4 * shuffle_partitions(spark))
    hits = repeated(sent, owners_for(n, shuffle_partitions(spark))).where(F.exists("hits", lambda x: x)).select(F.col("doc_id").alias("r"), "hits")
    rows = all_chunks.drop("block", "hashes")
    rows = scratch.write(rows.join(hits, rows["row"] == hits["r"]).drop("r"), "suspects")
    spread = rows.select("row", "doc_id", "digests", F.posexplode("hits").alias("k", "hit")).where("hit")
    spread = spread.select("row", "doc_id", "k", F.expr("substring(digests, 16 * k + 1, 16)").alias("digest"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "k")
    first = spread.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = scratch.write(first, "first")
    n = first.agg(F.sum("places")).first()[0] or 0
    marked = join_counted(spread, ["digest"], first, "places", n, "row").where(F.col("first").isNotNull())
    own = (F.col("first.row") == F.col("row")) & (F.col("first.k") == F.col("k"))
    marked = marked.groupBy("row").agg(F.collect_list(F.struct("k", F.col("first.doc_id").alias("f"), F.col("first.row").alias("fr"), own.alias("own"))).alias("marks"))
    spans = rows.drop("hits", "digests").join(marked.withColumnRenamed("row", "m"), rows["row"] == F.col("m")).drop("m", "row")

    def passages(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64()), ("earlier", pa.bool_())])))])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ends, heads, mid = r["ends"], r["heads"], r["mid"]
                stretches: list[list[dict]] = []
                for m in sorted(r["marks"], key=lambda m: m["k"]):
                    if not stretches or stretches[-1][-1]["k"] + 1 != m["k"]:
                        stretches.append([])
                    stretches[-1].append(m)
                found = []
                for s in stretches:
                    a, b = s[0]["k"], s[-1]["k"]
                    n_words = sum(heads[a : b + 1]) + mid[a]
                    if n_words < min_words:
                        continue
                    runs: list[dict] = []
                    for m in s:
                        kind = (m["own"], m["f"], m["fr"])
                        if not runs or runs[-1]["kind"] != kind:
                            runs.append({"start": ends[m["k"] - 1] if m["k"] else 0, "n_words": n_words, "first_doc_id": m["f"], "earlier": not m["own"], "kind": kind})
                        runs[-1]["end"] = ends[m["k"]]
                    found += [{k: x for k, x in run.items() if k != "kind"} for run in runs]
                if found:
                    out.append({"doc_id": r["doc_id"], "n_bytes": ends[-1], "n_chunks": len(ends), "passages": found})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = spans.select("doc_id", "ends", "heads", "mid", "marks").mapInArrow(passages, f"doc_id long, n_bytes long, n_chunks long, passages {_PASSAGES}")
    found = scratch.write(found, "found")
    out = found.select(
        "doc_id",
        "n_bytes",
        "n_chunks",
        F.aggregate(F.filter("passages", lambda p: p["earlier"]), F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["start"]).alias("repeated_bytes"),
        "passages",
        F.array_sort(F.array_distinct(F.transform(F.filter("passages", lambda p: p["earlier"] & p["first_doc_id"].isNotNull()), lambda p: p["first_doc_id"]))).alias("first_doc_ids"),
    )
    return scratch.tied_to(out)


def op2_chunk_dedup(spark, sf_dir):
    """Every document that repeats or is repeated by a passage of 25 words or more, with the passages."""
    return repeated_passages(table(spark, sf_dir, "documents"))
