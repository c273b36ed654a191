"""Exact duplicates by an exchange of Golomb-coded fingerprints, then comparison of the suspects' bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, join_counted, shuffle_partitions, table, text_col
from .exchange import merged, owners_for, repeated, with_block


def _compared(docs: DataFrame, text: str, broadcast_rows: int) -> tuple[Scratch, DataFrame, DataFrame, int]:
    """prints (doc_id and text_sha256 of every row), groups (text_sha256, keep_id, group_size of texts that occur more than
    once), both as tables, and the number of rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = F.regexp_replace(text_col(docs, text), SPACE, " ")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), norm.alias("norm"))
    prints = scratch.write(with_block(source.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))), "prints")
    n = prints.count()
    owners = owners_for(n, shuffle_partitions(spark))
    flagged = repeated(merged(prints.select("block", "doc_id", F.array("h").alias("hashes")), n, n, 4 * shuffle_partitions(spark)), owners)
    suspects = scratch.write(flagged.where(F.col("hits")[0]).select(F.col("doc_id").alias("suspect")).distinct(), "suspects")
    if suspects.count() <= broadcast_rows:
        same = source.join(F.broadcast(suspects), source["doc_id"].eqNullSafe(suspects["suspect"]), "left_semi")
    else:  # rows without an id are all compared, so that null is no frequent key
        same = source.join(suspects, source["doc_id"] == suspects["suspect"], "left_semi").unionByName(source.where("doc_id is null"))
    # The grouping key holds the bytes themselves; partial sums leave one row per text and task before the shuffle.
    groups = same.withColumn("text_sha256", F.sha2("norm", 256)).groupBy("text_sha256", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return scratch, prints.select("doc_id", "text_sha256"), scratch.write(groups.where("group_size > 1").select("text_sha256", "keep_id", "group_size"), "groups"), n


def exact_duplicates(docs: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when they are identical after each run of white space becomes one space. Blocks (input partitions) send
    the 64-bit hashes of their texts, sorted and Golomb-coded, to the owners of hash ranges, who answer with bitmaps of
    those that occur again. Only suspects' texts are compared: they are grouped by their whole normalised bytes, so a
    collision of the 64-bit hash cannot merge two texts.

    Of equal texts the row with the smallest doc_id stays; of repeated rows with that same doc_id all are marked kept and
    each counts in group_size. A null doc_id comes after all others. Null text counts as empty, and all empty texts are one
    group. An empty table gives an empty result. Other columns of docs are ignored, whatever their names. broadcast_rows
    bounds the number of suspects' ids and of groups that are sent to all executors; beyond it they are joined by a shuffle, but
    for those of very many rows.
    """
    scratch, prints, groups, n = _compared(docs, text, broadcast_rows)
    out = join_counted(prints, ["text_sha256"], groups, "group_size", n, "doc_id", broadcast_rows).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    return scratch.tied_to(out)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose text is a later copy, all columns as they were. Of rows that repeat one doc_id and
    normalised text, one stays, whichever. Null texts are empty; rows without doc_id go after all others; an empty table stays
    empty. Groups are sent to all executors only up to broadcast_rows of them, beyond that those of very many rows alone."""
    scratch, prints, groups, n = _compared(docs, text, broadcast_rows)
    marks = join_counted(prints, ["text_sha256"], groups, "group_size", n, "doc_id", broadcast_rows)
    twice = marks.where(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").count().where("count > 1")
    at = "__text_sha256"
    named = groups.select(F.col("text_sha256").alias(at), F.col("keep_id").alias("__keep_id"), F.col("group_size").alias("__group_size"))
    rows = docs.withColumn(at, F.sha2(F.regexp_replace(text_col(docs, text), SPACE, " "), 256))
    rows = join_counted(rows, [at], named, "__group_size", n, "doc_id", broadcast_rows)
    out = rows.where(F.col("__group_size").isNull() | rows["doc_id"].cast("long").eqNullSafe(F.col("__keep_id")))
    if not twice.isEmpty():
        # Rows of a group with the id that stays; the group's first by id only, so no group of other ids is gathered.
        grouped = F.col("__group_size").isNotNull()
        out = out.where(~grouped).unionByName(out.where(grouped).dropDuplicates(["doc_id", at]))
    return scratch.tied_to(out.select(*docs.columns))


def op7_exact_dedup(spark, sf_dir):
    """Every document with the row that stays for it, the size of its group and the digest of its normalised text."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
