"""Change history as a relation: commit_id, ts, path, status, old_path."""

from __future__ import annotations

import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record separator before each commit makes every commit one row of a split text read, whatever the size of the log.
FORMAT = "--format=%x1e%H%x09%cI"
RECORD = "\x1e"


def export(root: str, out: str, since: str | None = None) -> str:
    """Writes the log of the repository at root to the local file out. since is a ref or a date that git understands."""
    window = []
    if since:
        found = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}"], capture_output=True, text=True)
        if found.returncode == 0:
            window = [f"{since}..HEAD"]
        else:
            window = [f"--since={_date(root, since)}"]
    with open(out, "wb") as f:
        subprocess.run(["git", "-C", root, "log", "-M", "--name-status", FORMAT, *window], stdout=f, check=True)
    return out


def _date(root: str, since: str) -> str:
    """since, if git reads a date out of it. Git takes what it can't read for the present moment, so that is refused unless it is
    what since says."""
    told = subprocess.run(["git", "-C", root, "rev-parse", f"--since={since}"], capture_output=True, text=True).stdout.strip()
    age = told.partition("=")[2]
    present = since.strip().lower() in ("now", "today", "0 seconds ago")
    if not age.isdigit() or (abs(int(age) - time.time()) <= 5 and not present):
        raise ValueError(f"{since!r} is neither a ref nor a date")
    return since


def head(root: str) -> tuple[str | None, str | None]:
    """(commit, branch) of the repository at root; a detached head has no branch, no repository neither."""
    ask = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    commit, branch = ask("rev-parse", "HEAD"), ask("symbolic-ref", "--short", "-q", "HEAD")
    return (commit.stdout.strip() if commit.returncode == 0 else None), (branch.stdout.strip() or None)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The relation out of logs written in FORMAT (--name-status -M)."""
    text = spark.read.option("lineSep", RECORD).text(path).where(F.length(F.trim("value")) > 0)
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    e = text.select(F.split(F.get(lines, F.lit(0)), "\t").alias("h"), F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"))
    p = F.split("line", "\t")
    moved = F.size(p) > 2
    return e.select(
        F.get("h", F.lit(0)).alias("commit_id"),
        F.try_to_timestamp(F.get("h", F.lit(1))).alias("ts"),
        F.element_at(p, -1).alias("path"),
        F.substring(F.get(p, F.lit(0)), 1, 1).alias("status"),
        F.when(moved, F.get(p, F.lit(1))).alias("old_path"),
    )


def python_changes(changes: DataFrame, prefix: str = "") -> DataFrame:
    """Changes of Python files, paths under prefix."""
    path = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("path")) if prefix else F.col("path")
    return changes.withColumn("path", path).where(F.col("path").endswith(".py"))


def renames(changes: DataFrame) -> DataFrame:
    """old_path, new_path of renames; copies don't count."""
    return changes.where("status = 'R' AND old_path IS NOT NULL").select("old_path", F.col("path").alias("new_path")).distinct()
