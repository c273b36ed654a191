"""Shared pieces: scratch tables in the cluster's shared folder, table reading, block-wise task bodies."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a context, so that task bodies can import it wherever they run."""
    sc = spark.sparkContext
    if sc not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        at = os.path.join(tempfile.mkdtemp(prefix="stratagraph-"), "stratagraph.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted((root / "stratagraph").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(at)
        _SHIPPED[sc] = at
    # Texts may be long, so batches hold fewer rows than is usual, unless the session asks for another number.
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    return spark


def give_back() -> None:
    """Returns freed memory of a task body to the system, as workers outlive their tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "stratagraph-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark removes them when the driver has collected what named them, which
    a driver with little garbage of its own may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch
        return


class Scratch:
    """Tables that cut lineage. Those that a result reads stay until the application ends, as frames derived from it may be
    read at any time; the others go once the result is made, all of them at drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.made = 0, []
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)

    def path(self, name: str) -> str:
        self.n += 1
        self.made.append(f"{self.n:02d}-{name}")
        return f"{self.root}/{self.made[-1]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a Parquet table that survives the loss of executors, read again."""
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self) -> None:
        _remove(self.spark, self.root)

    def drop_table(self, df: DataFrame) -> None:
        for f in df.inputFiles()[:1]:
            _remove(self.spark, f.rsplit("/", 1)[0])

    def tied_to(self, df: DataFrame) -> DataFrame:
        """df, with only those of the tables left that it reads."""
        read = {f.split("/")[-2] for f in df.inputFiles() if self.root.rsplit("/", 1)[-1] in f}
        for name in self.made:
            if name not in read:
                _remove(self.spark, f"{self.root}/{name}")
        return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_col(docs: DataFrame, name: str = "text"):
    """The text with null as empty."""
    return F.coalesce(docs[name], F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(left: DataFrame, keys: list[str], right: DataFrame, counted: str, total: int, salt: str, broadcast_rows: int = 0) -> DataFrame:
    """left with the other columns of right, which has one row for each value of keys: a left join that no frequent key skews.

    counted is the column of right with the key's rows in left, total the number of rows in left. Keys of over 1/(4 * partitions)
    of the rows, of which there are at most 4 * partitions, go to all executors; rows that they match are dealt out by salt in
    the shuffled join with the others. Up to broadcast_rows rows the whole of right goes to all executors. Null keys match nothing.
    """
    n = 4 * shuffle_partitions(left.sparkSession)
    others = [c for c in right.columns if c not in keys]
    named = lambda df, tag: df.select(*[F.col(c).alias(f"{c}__{tag}") for c in [*keys, *others]])
    equal = lambda tag: [F.col(k) == F.col(f"{k}__{tag}") for k in keys]
    if broadcast_rows and right.count() <= broadcast_rows:
        return left.join(F.broadcast(named(right, "r")), equal("r"), "left").select(*left.columns, *[F.col(f"{c}__r").alias(c) for c in others])
    hot = F.col(counted) * n > total
    a = left.join(F.broadcast(named(right.where(hot), "h")), equal("h"), "left")
    done = F.col(f"{keys[0]}__h").isNotNull()
    a = a.withColumns({**{f"{k}__s": F.when(~done, F.col(k)) for k in keys}, "salt__s": F.when(done, F.xxhash64(salt)).otherwise(F.lit(0).cast("long"))})
    rest = named(right.where(~hot), "r").withColumn("salt__r", F.lit(0).cast("long"))
    a = a.join(rest, [F.col(f"{k}__s") == F.col(f"{k}__r") for k in keys] + [F.col("salt__s") == F.col("salt__r")], "left")
    return a.select(*left.columns, *[F.coalesce(f"{c}__h", f"{c}__r").alias(c) for c in others])
