"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, shuffle_partitions, table, text_col

#: Documents in a slice of a source's shuffled order.
SLICE_ROWS = 2_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target for sizes: (source, source_size), one row for each source.

    Sources by code point (null last) weigh weights in turn and share share times all words. No target exceeds most times its
    source's size; what is above is shared anew by weight among the rest until none is above. That ends where targets are
    min(cap, level * weight) with one level for all, so sources are taken in ascending cap/weight and the level is found from
    running sums over the sources (one row each, never over documents).
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if this source and all after it stay under their caps; the first for which that holds sets it.
    s = s.withColumn("try", F.try_divide("left", "rest")).withColumn("fits", F.col("try") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.first(F.when(F.col("fits"), F.col("try")), ignorenulls=True).over(every))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def fair_queue(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times, finish, h for every row of docs.

    A source's documents stand in a queue shuffled by h, a hash of doc_id, source, text and seed, and all of them again behind it, most
    times in all. The virtual finish time of each such copy is the words of its source up to its end over the source's target.
    All copies of all sources are range-sorted by finish time, and that order is cut at the total budget, the sum of the
    targets: sums for each range find the range that the budget ends in, running sums within it find the copy. The copy under
    way at the cut is taken if half of it or more lies before. finish is that of the first copy; the next is
    source_size / target later.

    Only whole documents are taken: a source is off its target by the document that its queue stands at, and by its share of
    the words that such documents leave over. Reruns agree.

    Null or empty text has size 0 and is taken no words; sources may be null (one source, last). A source of no words has
    target 0 and finish null. Repeated rows are queued each on its own. Columns of docs other than doc_id, text and source
    are ignored. An empty table gives an empty result.

    Running sums are taken in slices of a source's hash range and carried over by a sum for each slice, so that a source
    with any share of the rows is spread over tasks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(text_col(docs, text), F.lit(WORD)).cast("long").alias("size"),
        _place(docs, text, seed).alias("h"),
    )
    rows = scratch.write(rows, "sizes")
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS))
    targets = scratch.write(source_targets(per.drop("n"), weights, share, most).join(per.select(F.col("source").alias("s"), slices.alias("slices")), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    of = targets.withColumnRenamed("source", "s")
    # Slices are equal ranges of the hash; targets holds one row a source, joined on equality with nulls alike.
    rows = rows.join(of, rows["source"].eqNullSafe(of["s"])).drop("s")
    rows = rows.withColumn("slice", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("slices")), F.col("slices") - 1))
    parts = rows.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    parts = parts.withColumn("before", F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice")) - F.col("in_slice"))
    parts = parts.select(F.col("source").alias("s"), F.col("slice").alias("k"), "before")
    queue = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(queue))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["s"]) & (rows["slice"] == parts["k"])).withColumn("end", F.col("before") + F.col("run"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "end", F.try_divide(F.col("end").cast("double"), F.col("target")).alias("finish"), "h")
    rows = scratch.write(rows, "queues")
    cut = _cut(rows, most, scratch)
    took = [((_key(c) <= F.struct(*[F.lit(x).cast(kind).alias(k) for (k, x), kind in zip(cut.items(), ("double", "long", "long", "int"), strict=True)])) if cut else F.lit(False)).cast("long") for c in range(most)]
    times = F.when(F.col("size") > 0, sum(took[1:], took[0])).otherwise(F.lit(0))
    out = rows.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"), "finish", "h")
    return scratch.tied_to(out)


def _place(docs: DataFrame, text: str, seed: int):
    """A row's place in the shuffle."""
    return F.xxhash64(docs["doc_id"].cast("string"), F.lit(seed), docs["source"].cast("string"), docs[text])


def _key(copy: int):
    """The place of a row's copy in the global order."""
    at = F.try_divide((F.col("end") + F.lit(copy) * F.col("source_size")).cast("double"), F.col("target"))
    return F.struct(at.alias("at"), F.col("h").alias("h"), F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.lit(copy).alias("copy"))


def _cut(rows: DataFrame, most: int, scratch: Scratch) -> dict | None:
    """The last copy in the global order of finish times that the total budget takes, None if it takes none."""
    n = shuffle_partitions(rows.sparkSession)
    copies = rows.where("size > 0").select("size", F.explode(F.array(*[_key(c) for c in range(most)])).alias("key")).select("size", "key.*")
    order = ["at", "h", "i", "copy"]
    ranged = scratch.write(copies.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.orderBy("part")) - F.col("words")  # one row a range
    budget = rows.select("source", "target").groupBy("source").agg(F.first("target").alias("target")).agg(F.sum("target")).first()[0]
    # The range in which the budget ends, or the last one; the copy before its first may be the last that is taken.
    at = sums.select("part", before.alias("before")).where(F.col("before") <= F.lit(budget)).orderBy(F.desc("part")).first()
    if at is None:
        return None
    inside = ranged.where(F.col("part") == at["part"]).withColumn("run", at["before"] + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where(F.col("run") - F.col("size") / 2.0 <= F.lit(budget)).orderBy(*[F.desc(c) for c in order]).first()
    if last is None:
        last = ranged.where(F.col("part") < at["part"]).orderBy(*[F.desc(c) for c in order]).first()
    return None if last is None else {k: last[k] for k in order}


def mix(docs: DataFrame, text: str = "text", seed: int = 11, **how) -> DataFrame:
    """docs as the mix takes them, in the order of virtual finish time: each document as often as it is taken, all columns as
    they were. Documents without words are never taken, null sources and null doc_ids are as any other. Rows equal in doc_id,
    source and text are taken each on its own; which of them the other columns come from is open. An empty table stays empty."""
    queue = fair_queue(docs, text=text, seed=seed, **how)
    lap = F.try_divide("source_size", "target")
    copies = queue.where("times > 0").select("doc_id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda c: F.col("finish") + c * lap)).alias("__at"))
    picks = copies.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "__at")
    rows = docs.withColumn("__mix_place", _place(docs, text, seed))
    if queue.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        one = rows
    else:
        one = rows.dropDuplicates(["doc_id", "__mix_place"])
    out = one.join(picks, one["doc_id"].cast("long").eqNullSafe(picks["__id"]) & (one["__mix_place"] == picks["__h"])).orderBy(picks["__at"], picks["__h"])
    return out.select(*[one[c] for c in docs.columns])


def op10_fair_mix(spark, sf_dir):
    """Documents with their size, source size, target and taken words, by the production weights 3, 1, 2, share and limit."""
    return fair_queue(table(spark, sf_dir, "documents"))
