"""Threshold-scaled sketches of word shingles, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, shuffle_partitions, table, text_col

#: Hashes under this bound are kept: a quarter of all 64-bit values, in signed order.
BOUND = -(2**63) + 2**62
#: Of a kept hash its lower 40 bits stand in the sketch; the bound is on the upper ones.
_LOW = (1 << 40) - 1


def with_sketch(df: DataFrame, text: str, out: str, k: int = 5, bound: int = BOUND) -> DataFrame:
    """df with out: array<long>, the ascending distinct 40-bit ends of the hashes under bound of the text's k-word shingles, and
    out_n: int, the number of its shingles, repeats included.

    Words are lower-cased. A text of fewer than k words is one shingle; one without words has none. A text whose hashes all lie
    above the bound has an empty sketch: no hash is kept but by the bound. Sketches of equal bound merge by array_union, and
    containment() and likeness() hold between texts of very unequal length.
    """
    w = f"__{out}_words"
    df = df.withColumn(w, F.transform(F.filter(F.split(F.lower(F.col(text)), SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    at = lambda i, d: F.get(F.col(w), i + d)
    many = F.transform(F.slice(F.col(w), 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i, d) for d in range(1, k)]))
    few = F.array(F.aggregate(F.col(w), F.size(w).cast("long"), lambda s, x: F.xxhash64(s, x)))
    n = F.when(F.size(w) >= k, F.size(w) - (k - 1)).otherwise(F.least(F.size(w), F.lit(1)))
    all_of = F.when(F.size(w) >= k, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<long>"))
    kept = F.transform(F.filter(all_of, lambda h: h < F.lit(bound)), lambda h: h.bitwiseAND(F.lit(_LOW)))
    return df.withColumn(out, F.sort_array(F.array_distinct(kept))).withColumn(f"{out}_n", n).drop(w)


def fingerprint(sketch: str) -> Column:
    """The sketch as text: its number of shingles, a colon and 10 hexadecimal digits for each hash."""
    return F.concat(F.col(f"{sketch}_n").cast("string"), F.lit(":"), F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 10, "0")), ""))


def evidence(a: str, b: str) -> Column:
    """Hashes that a likeness of two sketches rests on: those in either. 0 where it rests on none."""
    return (F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))).cast("long")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches. Two texts without words are alike (1); texts of which no hash was kept show
    nothing in common (0, with an evidence of 0)."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    none = F.when((F.col(f"{a}_n") == 0) & (F.col(f"{b}_n") == 0), 1.0).otherwise(0.0)
    return F.when(whole == 0, none).otherwise(F.try_divide(both.cast("double"), whole.cast("double")))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 if none of a was kept."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")))


def successors(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """ids: distinct (doc_id, h) and more columns. Adds next_id and next_h in ascending order; after the last comes the first.

    Rows go to ranges of doc_id; within a range the next row is the next by a window, and a range's last row gets the first
    of the following range from a table of one row a range.
    """
    ranged = scratch.write(ids.repartitionByRange(shuffle_partitions(ids.sparkSession), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    every = Window.orderBy("part")
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("head"))
    row = F.struct("doc_id", "h")
    w = Window.partitionBy("part").orderBy("doc_id", "h")
    nxt = ranged.withColumn("nxt", F.lead(row).over(w)).join(heads, F.col("part") == heads["p"])
    nxt = nxt.withColumn("nxt", F.coalesce("nxt", "head"))
    return nxt.select(*ids.columns, F.col("nxt.doc_id").alias("next_id"), F.col("nxt.h").alias("next_h"))


def sketch_pairs(docs: DataFrame, text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs; for both
    likenesses also the evidence they rest on (edited_evidence, next_evidence) and the share of the document's own shingles in
    the other text (contained_edited, contained_next).

    The edited text has its last floor(n_chars / 4) code points replaced by as many of the next document's first (or all of
    them). The next document follows by ascending doc_id, then hash of the text for rows that repeat an id; the first follows
    the last. Fully equal rows are one place in that order and each gets the same result. Null counts as empty: its own and
    its edited text are empty. A lone document is its own next. An empty table gives an empty result; other columns are
    ignored. Up to broadcast_rows rows the order (ids and lengths, no text) goes to all executors; beyond that it is joined
    by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "sketch")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    order = scratch.write(successors(rows.select("doc_id", "h", "n_chars").distinct(), scratch), "order")
    near = F.broadcast if order.count() <= broadcast_rows else (lambda df: df)
    before = near(order.select(F.col("next_id").alias("ni"), F.col("next_h").alias("nh"), F.col("doc_id").alias("i"), F.col("h").alias("ih"), F.floor(F.col("n_chars") / 4).cast("int").alias("take")))
    following = with_sketch(rows.dropDuplicates(["doc_id", "h"]) if _repeats(rows) else rows, "text", "next_sketch")
    following = following.join(before, (F.col("doc_id").eqNullSafe(F.col("ni"))) & (F.col("h") == F.col("nh"))).select("i", "ih", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head"), "next_sketch", "next_sketch_n")
    both = rows.join(following, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("ih")))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head")))
    both = with_sketch(with_sketch(both, "text", "sketch"), "edited", "edited_sketch")
    out = both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"),
        fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        evidence("sketch", "edited_sketch").alias("edited_evidence"),
        evidence("sketch", "next_sketch").alias("next_evidence"),
        containment("sketch", "edited_sketch").alias("contained_edited"),
        containment("sketch", "next_sketch").alias("contained_next"),
    )
    return scratch.tied_to(out)


def _repeats(rows: DataFrame) -> bool:
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return n["n"] != n["d"]


def op6_scaled_sketch(spark, sf_dir):
    """Fingerprints of every document and of its edited text, with their likeness to each other and to the next document."""
    return sketch_pairs(table(spark, sf_dir, "documents"))
