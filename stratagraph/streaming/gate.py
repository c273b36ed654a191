"""The score gate over a stream of history rows, and incremental parsing of changed files, each by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def gate_stream(rows: DataFrame, out: str, checkpoint: str, tolerance: float = 0.02, available_now: bool = True) -> StreamingQuery:
    """Writes timestamp, overall, delta, passed to out for each row of a history stream, against the row before it, which may
    be of an earlier batch: the last row so far is kept beside out. A batch that is run again gives the same files."""
    if not 0 <= tolerance <= 1:
        raise ValueError("tolerance is in [0, 1]")

    def batch(df: DataFrame, n: int) -> None:
        from pyspark.sql import Window

        spark = df.sparkSession
        last = None
        if n > 0:
            last = spark.read.parquet(f"{out}/state/{n - 1}").first()
        w = Window.orderBy("timestamp")
        before = F.lag("overall").over(w)
        if last is not None and last["overall"] is not None:
            before = F.coalesce(before, F.lit(last["overall"]))
        d = df.select("timestamp", "overall").withColumn("delta", F.col("overall") - before)
        d.select("timestamp", "overall", "delta", F.coalesce(F.col("delta") >= -tolerance, F.lit(True)).alias("passed")).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        top = df.agg(F.max_by("overall", "timestamp").alias("overall")).first()["overall"]
        spark.createDataFrame([(top if top is not None else (last["overall"] if last else None),)], "overall double").write.mode("overwrite").parquet(f"{out}/state/{n}")

    w = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def sync_stream(files: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls refresh(changed files, batch) for every micro-batch of a file stream until what is there has been read."""
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
