"""Snapshots of findings and matrices: one JSON document each, and canonical text for comparing."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a snapshot and the columns by which their rows are the same finding.
KEYS = {"cycles": ("members",), "violations": ("from_layer", "to_layer", "src", "dst"), "reach": ("source", "within", "must_reach", "module"), "sdp": ("src", "dst"), "modules": ("node",), "rules": ("kind", "rule")}
_LOOSE = ("lines", "path", "detail")


def take(path: str, parts: dict[str, DataFrame], score: dict | None = None, findings_only: bool = False) -> None:
    """Writes parts (names of KEYS) under path, a table each, with the score beside them. findings_only leaves out the score
    and what moves without a finding changing (lines, paths, details)."""
    for name, df in parts.items():
        if name not in KEYS:
            raise ValueError(f"{name} is no part of a snapshot")
        cols = [c for c in df.columns if not (findings_only and c in _LOOSE)]
        df.select(*cols).orderBy(*[c for c in KEYS[name] if c in cols]).coalesce(1).write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)
    spark = next(iter(parts.values())).sparkSession
    meta = {"snapshot": 1, "findings_only": findings_only} | ({} if findings_only or score is None else {"score": score})
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict | None:
    """The parts and meta of a snapshot; None if there is none, an error if it is something else."""
    try:
        rows = spark.read.text(f"{path}/meta").collect()
    except Exception as e:  # noqa: BLE001 - only a missing path is an answer
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    try:
        meta = json.loads("".join(r.value for r in rows))
    except ValueError:
        meta = None
    if not isinstance(meta, dict) or meta.get("snapshot") != 1:
        raise ValueError(f"{path} is no snapshot")
    out: dict = {"meta": meta}
    for name in KEYS:
        try:
            df = spark.read.json(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if df.columns:
            # A column of nulls only may have no type of its own.
            lost = {k: F.lit(None).cast("string") for k in KEYS[name] if k not in df.columns}
            out[name] = df.withColumns(lost) if lost else df
    return out


def graph_json(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """value: a line of JSON for each node, then for each edge."""
    return modules.select(F.to_json(F.struct(F.lit("node").alias("kind"), "*")).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "*")).alias("value")))


def graph_dot(edges: DataFrame) -> DataFrame:
    """value: the lines of a DOT file between its braces."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.orderBy("src", "dst").select(F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(";")).alias("value"))


def graph_text(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst").select(F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def matrix_json(order: DataFrame, cells: DataFrame, most: int = 2000) -> str:
    """A matrix of at most most nodes as one document; cells beyond most ** 2 / 4 are counted, not listed."""
    names = [[r["node"], r["grp"]] for r in order.orderBy("pos").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} nodes")
    n, bound = cells.count(), max(most, most**2 // 4)
    listed = [[r["row"], r["col"], r["weight"]] for r in cells.orderBy("row", "col").limit(bound).collect()]
    return json.dumps({"matrix": 1, "order": names, "cells": listed, "omitted": max(0, n - bound)})


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(order: node, grp, pos and cells: row, col, weight) of a document that matrix_json wrote; None if there is none, an error
    if it is something else."""
    if not os.path.exists(path):
        return None
    if os.path.isdir(path):
        raise ValueError(f"{path} is a directory, no matrix")
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        order = [(str(n), None if g is None else str(g), k) for k, (n, g) in enumerate(raw["order"])]
        cells = [(int(r), int(c), float(w)) for r, c, w in raw["cells"]]
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError(f"{path} is no matrix: {e}") from e
    return spark.createDataFrame(order, "node string, grp string, pos long"), spark.createDataFrame(cells, "row long, col long, weight double")


def matrix_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """src, dst, change (added, removed, weight_changed), back: cells by the names of their ends; back marks an added one that
    points back in the order after."""

    def named(m, k):
        order, cells = m
        a, b = order.select(F.col("pos").alias("p1"), F.col("node").alias("src")), order.select(F.col("pos").alias("p2"), F.col("node").alias("dst"))
        return cells.join(a, cells["row"] == a["p1"]).join(b, cells["col"] == b["p2"]).select(F.col("src").alias(f"s{k}"), F.col("dst").alias(f"d{k}"), F.col("weight").alias(f"w{k}"), (F.col("row") > F.col("col")).alias(f"back{k}"))

    x, y = named(before, 1), named(after, 2)
    j = x.join(y, (x["s1"] == y["s2"]) & (x["d1"] == y["d2"]), "full_outer")
    change = F.when(F.col("s1").isNull(), "added").when(F.col("s2").isNull(), "removed").when(F.col("w1") != F.col("w2"), "weight_changed")
    return j.select(F.coalesce("s1", "s2").alias("src"), F.coalesce("d1", "d2").alias("dst"), change.alias("change"), (F.col("s1").isNull() & F.coalesce("back2", F.lit(False))).alias("back")).where("change IS NOT NULL")


def matrix_diff_text(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], most: int = 10) -> str:
    """A few lines on what changed between two matrices."""
    d = matrix_diff(before, after)
    n = d.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "weight_changed")], F.count_if("back").alias("back")).first()
    names = lambda a, b: a[0].select("node").join(b[0].select(F.col("node").alias("o")), F.col("node") == F.col("o"), "left_anti").count()
    lines = [f"Matrix: +{n['added']} cells, -{n['removed']} cells, ~{n['weight_changed']} weights, +{names(after, before)} modules, -{names(before, after)} modules."]
    parts = [("New back edges", "back"), ("Added", "change = 'added'")][0 if n["back"] else 1 :][:1] + [("Removed", "change = 'removed'")]
    for title, which in parts:
        rows = d.where(which).orderBy("src", "dst").limit(most + 1).collect()
        if rows:
            total = n["back"] if which == "back" else n[title.lower()]
            lines += [f"{title} ({total}):", *(f"  {r['src']} -> {r['dst']}" for r in rows[:most])]
            lines += [f"  and {total - most} more"] if total > most else []
    return "\n".join(lines)
