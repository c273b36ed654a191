"""The dependency structure matrix of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut


def dsm(nodes: DataFrame, edges: DataFrame, weight: str = "call_count") -> tuple[DataFrame, DataFrame]:
    """(order: node, grp, pos) by group then name and (cells: row, col, weight, g1, g2). A position needs one order over all
    nodes: ranges of the order are numbered each in its own task and shifted by the sizes of those before."""
    spread = cut(nodes.select("node", "grp").repartitionByRange("grp", "node").sortWithinPartitions("grp", "node").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    shift = sizes.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    order = spread.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("grp", "node"))).join(shift, F.col("part") == F.col("p")).select("node", "grp", (F.col("shift") + F.col("k") - 1).alias("pos"))
    a, b = order.select(F.col("node").alias("n1"), F.col("pos").alias("row"), F.col("grp").alias("g1")), order.select(F.col("node").alias("n2"), F.col("pos").alias("col"), F.col("grp").alias("g2"))
    w = F.lit(1.0) if weight == "imports" else F.col(weight)
    return order, edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).select("row", "col", w.alias("weight"), "g1", "g2")


def summary(order: DataFrame, cells: DataFrame) -> DataFrame:
    return order.agg(F.count("*").alias("modules"), F.count_distinct("grp").alias("groups")).crossJoin(cells.agg(F.count("*").alias("cells"), F.count_if(F.expr("row > col")).alias("back_edges"), F.count_if(F.expr("g1 <> g2")).alias("cross_group")))


def signals(order: DataFrame, cells: DataFrame) -> DataFrame:
    """feedback: share of cells above the order; bandwidth: mean distance from the diagonal; inside: share within groups."""
    n = F.count("*")
    return cells.agg(F.try_divide(F.count_if(F.expr("row > col")), n).alias("feedback"), F.avg(F.abs(F.col("row") - F.col("col"))).alias("bandwidth"), F.try_divide(F.count_if(F.expr("g1 = g2")), n).alias("inside"))


def topological_groups(sccs: DataFrame) -> DataFrame:
    """node, grp: SCC-k (k its least member) for components of several nodes, DAG for single ones."""
    n = sccs.groupBy(F.col("scc").alias("k")).agg(F.count("*").alias("n"))
    return sccs.join(n, sccs["scc"] == n["k"]).select("node", F.when(F.col("n") > 1, F.concat(F.lit("SCC-"), F.col("scc").cast("string"))).otherwise("DAG").alias("grp"))


def ascii_matrix(order: DataFrame, cells: DataFrame, most: int = 80) -> str:
    """The matrix as text; refuses more than most nodes."""
    names = [r["node"] for r in order.orderBy("pos").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} nodes")
    full = {(r["row"], r["col"]) for r in cells.select("row", "col").collect()}
    return "\n".join(f"{n!s:>12} " + "".join("x" if (i, j) in full else "." for j in range(len(names))) for i, n in enumerate(names))
