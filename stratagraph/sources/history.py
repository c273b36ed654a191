"""The log of scores: JSON lines that are only appended to, read in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "timestamp": "string", "commit": "string", "branch": "string", "overall": "double", "modularity": "double", "acyclicity": "double", "depth": "double", "equality": "double",
    "complexity": "double", "module_count": "bigint", "edge_count": "bigint", "cycle_count": "bigint", "tangle_ratio": "double", "max_depth": "bigint", "community_count": "bigint",
}
_OPTIONAL = {"complexity", "tangle_ratio", "branch", "commit"}


def _typed(raw: DataFrame) -> DataFrame:
    """Rows of valid lines. A missing complexity stays null, a missing tangle_ratio is 0; a value that is there but of a wrong
    kind, or a whole number that is none, makes the line invalid."""
    v = F.from_json("value", F.lit("map<string,string>"))
    raw = raw.select(v.alias("m")).where("m IS NOT NULL")
    out, fine = [], F.lit(True)
    for name, kind in FIELDS.items():
        text = F.col("m")[name]
        got = text if kind == "string" else text.try_cast("double")
        if kind == "bigint":
            got = F.when(got == F.floor(got), got.cast("bigint"))
        bad = text.isNotNull() & got.isNull()
        fine = fine & ~bad & (F.lit(True) if name in _OPTIONAL else text.isNotNull())
        out.append((F.coalesce(got, F.lit(0.0)) if name == "tangle_ratio" else got).alias(name))
    return raw.where(fine).select(*out)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.text(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.readStream.text(path))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; fields that are null are left out."""
    rows.select(*[F.col(c).cast(k).alias(c) for c, k in FIELDS.items() if c in rows.columns]).coalesce(1).write.mode("append").json(path)
