"""Token ids as files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A shard holds documents in ascending doc_id order:

    data frames      zstd frames of about FRAME bytes of little-endian unsigned 32-bit ids, each with no need of another
    document index   a skippable frame (magic 0x184D2A50): zstd of int64 doc_ids, int64 id counts, then int64 1 where the doc_id
                     is null (and 0 stands for it)
    seek table       a skippable frame (magic 0x184D2A5E): for each data frame its compressed size, size and the low 32 bits
                     of the XXH64 of its content, then the count of frames, a descriptor byte and the magic 0x8F92EAB1

That is the public seekable format, so a plain zstd decoder gives the ids of the whole shard, and a reader that wants some
documents fetches the tail of the file and then the frames that hold them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, ship, shuffle_partitions, table, text_col

FRAME = 256 << 10
#: A task goes on to another shard when one has so many bytes of ids.
SHARD = 256 << 20
_INDEX, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_SKIP, _ENTRY, _TAIL = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")


class ShardWriter:
    """Writes one shard to a binary file object."""

    def __init__(self, out, level: int = 1, frame: int = FRAME):
        self.out, self.frame = out, frame
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.held, self.size = [], 0
        self.seek: list[bytes] = []
        self.ids, self.counts, self.lost = array("q"), array("q"), array("q")
        self.written = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids as little-endian unsigned 32-bit integers. A long document goes over several frames."""
        self.written += len(ids)
        self.ids.append(doc_id or 0)
        self.lost.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        view = memoryview(ids)
        while len(view):
            part = view[: self.frame - self.size]
            self.held.append(part)
            self.size += len(part)
            view = view[len(part) :]
            if self.size >= self.frame:
                self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.held)
        coded = self.codec.compress(raw)
        self.out.write(coded)
        self.seek.append(_ENTRY.pack(len(coded), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        index = self.codec.compress(b"".join(np.array(x, "<i8").tobytes() for x in (self.ids, self.counts, self.lost)))
        self.out.write(_SKIP.pack(_INDEX, len(index)) + index)
        body = b"".join(self.seek)
        self.out.write(_SKIP.pack(_SEEK, len(body) + _TAIL.size) + body + _TAIL.pack(len(self.seek), 0x80, _FOOT))


class ShardReader:
    """Reads documents of a shard from a seekable binary file, decompressing only the frames that hold them."""

    def __init__(self, file, size: int):
        self.file = file
        self.codec = zstandard.ZstdDecompressor()
        n, flags, magic = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if magic != _FOOT or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - _TAIL.size - n * _ENTRY.size
        entries = np.frombuffer(self._at(start, n * _ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.coded_at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(entries[:, 1])])
        self.sums = entries[:, 2]
        index_at = int(self.coded_at[-1])
        magic, length = _SKIP.unpack(self._at(index_at, _SKIP.size))
        if magic != _INDEX:
            raise ValueError("no document index before the seek table")
        self.ids, self.counts, self.lost = np.frombuffer(self.codec.decompress(self._at(index_at + _SKIP.size, length)), "<i8").reshape(3, -1)
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame, self.content = -1, b""
        self.frames_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        if k != self.frame:
            raw = self.codec.decompress(self._at(int(self.coded_at[k]), int(self.coded_at[k + 1] - self.coded_at[k])), int(self.raw_at[k + 1] - self.raw_at[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.frame, self.content = k, raw
            self.frames_read += 1
        return self.content

    def document(self, k: int) -> bytes:
        """The ids of the k-th document of the shard."""
        at, end = 4 * int(self.begins[k]), 4 * int(self.begins[k + 1])
        out, f = [], int(np.searchsorted(self.raw_at, at, "right")) - 1
        while at < end:
            raw, base = self._frame(f), int(self.raw_at[f])
            out.append(raw[at - base : end - base])
            at = int(self.raw_at[f + 1])
            f += 1
        return b"".join(out)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedEncoder:
    """The tokenizers library's encoding of whole texts, each distinct piece of them encoded once.

    A text is cut where no match of the split pattern goes on, and merges never cross a match: between a character that isn't
    white space and a space, and within such a stretch between ASCII letters, digits and marks of _CUT (no apostrophe, as
    that may begin a match with the letters behind it). Special tokens hold none of these places. So the ids of a text are those
    of its pieces, and the library encodes each new piece as it would a whole text. A text where white space stands before a
    space goes to the library whole.
    """

    MOST = 800_000
    _MARKS = re.escape(",.;:!?()[]{}\"-*#$%&/=+@_")
    _CUT = re.compile(f"(?<=[A-Za-z])(?=[0-9{_MARKS}])|(?<=[0-9])(?=[A-Za-z{_MARKS}])|(?<=[{_MARKS}])(?=[A-Za-z0-9])").split
    #: Not white space to Python, but to some versions of Unicode.
    _UNSURE = ("\u180e", "\u200b")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        lib = Tokenizer.from_file(path)
        self.encode, self.tokenize = lib.encode_batch_fast, lib.model.tokenize
        self.special = [t.content for t in lib.get_added_tokens_decoder().values()]
        self.coded = [struct.pack("<I", k) for k in range(lib.get_vocab_size())]
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _learn(self, stretches: set[str]) -> bool:
        """Holds the ids of stretches of a text, each of which stands behind a space; False if one can't be held.

        ASCII letters, with or without a space ahead, are one match, so they go to the library's model without a split. Byte-level
        BPE writes such letters as they are and the space as a letter of its own.
        """
        tokenize, coded, pieces, held, cut = self.tokenize, self.coded, self.pieces, self.stretches, {}
        if len(pieces) >= self.MOST:
            pieces.clear()
        for p in stretches:
            if p.isascii() and p.isalpha():
                held[p] = b"".join([coded[t.id] for t in tokenize("\u0120" + p)])
            elif not p or p[-1].isspace() or p.endswith(self._UNSURE):
                return False  # the space behind it belongs to the same match
            else:
                cut[p] = self._CUT(" " + p)
        rest = []
        for x in {x for xs in cut.values() for x in xs}.difference(pieces):
            w = x[1:] if x[0] == " " else x
            if w.isascii() and w.isalpha():
                pieces[x] = b"".join([coded[t.id] for t in tokenize(w if w is x else "\u0120" + w)])
            else:
                rest.append(x)
        if rest:
            pieces.update(zip(rest, self._each(rest), strict=True))
        for p, xs in cut.items():
            held[p] = b"".join([pieces[x] for x in xs])
        return True

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        held = self.stretches
        if len(held) >= self.MOST:
            held.clear()
        # Stretches are seldom new, so a text's new ones are found in one set operation.
        new = set(rest).difference(held)
        if first[-1:].isspace() or first.endswith(self._UNSURE) or any(t in text for t in self.special) or (new and not self._learn(new)):
            return self._each([text])[0]
        out = self._each([first])[0] + b"".join(map(held.__getitem__, rest))
        if len(text) > 1 << 20:
            held.clear()  # a very long text may have brought very long stretches
            self.pieces.clear()
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, text: str = "text", shards: int | None = None, most: int = SHARD) -> DataFrame:
    """Encodes every whole text and writes shards of ids to folder, which all executors reach by the same URI.

    Rows are range-partitioned and sorted by doc_id (then text, for repeated ids); rows without doc_id come first and stay
    without. Null text counts as empty and gives end_id alone. Each task streams its shards, of SHARD bytes of ids or little
    more, to names of its own attempt and then renames them, so a lost executor's shards are written again. Returns the
    manifest: shard, path, n_docs, start (ids before it), n_tokens; it has one row a shard and is kept beside the shards. An
    empty table gives an empty manifest; other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    path, shards = path or tokenizer_file(), shards or shuffle_partitions(spark)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, out, made = TaskContext.get(), None, 0
        fs, root = pafs.FileSystem.from_uri(folder)
        encode = encoder(path)

        def close():
            out.close()
            stream.close()
            fs.move(draft, name)
            listed = {"part": task.partitionId(), "shard": made, "path": name, "n_docs": len(out.ids), "n_tokens": out.written // 4}
            return pa.RecordBatch.from_pylist([listed], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/shard-{task.partitionId():06d}-{made:04d}.zst"
                    draft = f"{root}/.draft-{task.taskAttemptId()}-{made}"
                    stream = fs.open_output_stream(draft)
                    out = ShardWriter(stream)
                out.add(doc_id, encode(t.as_py()) + tail)
                if out.written >= most:
                    yield close()
                    out, made = None, made + 1
        if out is not None:
            yield close()
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    # Ranges of doc_id from its quantiles, which takes a scan of that column alone.
    ends = rows.select(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 10_000)).first()[0]
    part = F.lit(0)
    if ends:
        bounds = F.array(*[F.lit(e).cast("long") for e in sorted(set(ends))])
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda e: e < F.col("doc_id"))))
    rows = rows.repartitionById(shards, part.cast("int")).sortWithinPartitions("doc_id", "text")
    made = sorted(rows.mapInArrow(run, "part int, shard int, path string, n_docs long, n_tokens long").collect())
    start, listed = 0, []
    for k, r in enumerate(made):
        listed.append((k, r.path, r.n_docs, start, r.n_tokens))
        start += r.n_tokens
    manifest = spark.createDataFrame(listed, "shard int, path string, n_docs long, start long, n_tokens long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str, only: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids: binary) of the documents of the shards, or of those whose id is in only;
    a doc_id that was null is null again."""
    wanted = None if only is None else np.array(sorted(only), np.int64)

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    shard = ShardReader(f, f.size())
                    picked = np.arange(len(shard.ids)) if wanted is None else np.flatnonzero(np.isin(shard.ids, wanted) & (shard.lost == 0))
                    for i in range(0, len(picked), 1000):
                        k = picked[i : i + 1000]
                        ids = [shard.document(x) for x in k.tolist()]
                        cols = [pa.array(shard.ids[k], mask=shard.lost[k] == 1), pa.array(row["start"] + shard.begins[k]), pa.array(shard.counts[k]), pa.array([zlib.crc32(x) for x in ids], pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])]
                        yield pa.RecordBatch.from_arrays(cols, schema=schema)

    n = max(1, manifest.count())
    # One shard for each task.
    spread = manifest.repartitionByRange(n, "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the files of ids, how many it has and their checksum, read back from the files."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("ids")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(manifest, folder, with_ids=False)
