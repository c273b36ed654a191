"""Statistics over relations: correlation, intervals, agreement, neighbours, cut-offs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, null where a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(both).agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))


def average_ranks(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with the average rank of x: ranks are computed over counts of distinct values and joined back."""
    c = df.groupBy(F.col(x).alias("__v")).agg(F.count("*").alias("__m"))
    w = Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn(out, F.sum("__m").over(w) - (F.col("__m") - 1) / 2).drop("__m")
    return df.join(c, df[x] == c["__v"]).drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return pearson(average_ranks(average_ranks(df.select(x, y), x, "__rx"), y, "__ry"), "__rx", "__ry")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval for k of n."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    mid, den = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4 * n * n), F.lit(0.0)))
    return (mid - half) / den, (mid + half) / den


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Interval of the difference of two shares."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1 / n1, k2 / n2
    return p1 - p2 - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), p1 - p2 + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agree, expected, kappa of two raters with labels of any kind."""
    c = df.groupBy(a, b).agg(F.count("*").alias("c"))
    n = c.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    ma, mb = c.groupBy(F.col(a).alias("la")).agg(F.sum("c").alias("ca")), c.groupBy(F.col(b).alias("lb")).agg(F.sum("c").alias("cb"))
    e = ma.join(mb, ma["la"] == mb["lb"]).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("e"))
    j = n.crossJoin(e).select("n", (F.col("same") / F.col("n")).alias("agree"), (F.col("e") / (F.col("n") * F.col("n"))).alias("expected"))
    return j.withColumn("kappa", F.try_divide(F.col("agree") - F.col("expected"), 1 - F.col("expected")))


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided p."""
    n = wins + losses
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n) if n else 1.0


def ols_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(both).agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)).alias("slope"))


def jaccard(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(empty).cast("double")).otherwise(F.try_divide(both, either))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Rows of a block of items and of a block of queries that meet in one task of nearest.
ITEMS, QUERIES = 8_192, 1_024


def nearest(items: DataFrame, queries: DataFrame, group: str, k: int = 1, blocks: int = 16) -> DataFrame:
    """id, neighbour, similarity: the k most similar others of the same group for each query (id, vector); ties to the smaller
    id. All pairs of a group are compared: blocks of its queries meet blocks of its items (`blocks` at least), each pair of blocks in one
    task, which passes on what may be among the k best of the pair; these few are compared as columns. Vectors that are not plain
    (null, not finite, all zero, or not as long as most) are compared as columns with all."""
    longest = items.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).agg(F.max_by("n", F.struct("c", "n"))).first()[0] or 0
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    plain = F.coalesce((F.size("vector") == longest) & (square > 1e-200) & (square < 1e200), F.lit(False))
    sides = lambda df: df.select("id", "vector", F.col(group).alias("g"), plain.alias("plain")).where("g IS NOT NULL")
    i, q = sides(items), sides(queries)
    count = lambda df, per, least: df.where("plain").groupBy("g").agg(F.greatest(F.ceil(F.count("*") / per), F.lit(least)).cast("long").alias("n"))
    ni, nq = count(i, ITEMS, blocks).select(F.col("g").alias("g1"), F.col("n").alias("ni")), count(q, QUERIES, 1).select(F.col("g").alias("g2"), F.col("n").alias("nq"))
    grid = ni.join(nq, ni["g1"] == nq["g2"]).select("g1", "ni", "nq")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda df: df.where("plain").join(grid, F.col("g") == F.col("g1"))
    left = dealt(q).select("g", own("nq").alias("bq"), each("ni").alias("bi"), "id", "vector", F.lit(True).alias("query"))
    right = dealt(i).select("g", each("nq").alias("bq"), own("ni").alias("bi"), "id", "vector", F.lit(False).alias("query"))

    def best_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")  # of equal ones the smaller come first
        is_query = pdf["query"].to_numpy(bool)
        ids, unit = pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
        qi, qv, ii, iv, out = ids[is_query], unit[is_query], ids[~is_query], unit[~is_query], []
        for at in range(0, len(qi), 256):
            if not len(ii):
                break
            some = qi[at : at + 256]
            like = qv[at : at + 256] @ iv.T
            like[some[:, None] == ii[None, :]] = -9.0  # not of itself
            kth = np.partition(like, max(len(ii) - k, 0), axis=1)[:, max(len(ii) - k, 0)]
            # Similarities are rounded to six places in the end, so whatever is within one step of the k-th may stand before it.
            r, c = np.nonzero((like >= kth[:, None] - 1.1e-6) & (like > -8))
            value = like[r, c] * 1e6
            # Of those of one query that surely round to one value, the k smallest ids are enough.
            sure = np.abs(value - np.floor(value) - 0.5) > 1e-3
            t = pd.DataFrame({"r": r, "c": c, "v": np.where(sure, np.round(value), value), "sure": sure})
            t = t[(t.groupby(["r", "v"]).cumcount() < k) | ~t["sure"]]
            out.append(pd.DataFrame({"q": some[t["r"]], "id": ii[t["c"]]}))
        return pd.concat(out) if out else pd.DataFrame({"q": ids[:0], "id": ids[:0]})

    kind = dict(items.dtypes)["id"]
    few = left.unionByName(right).groupBy("g", "bq", "bi").applyInPandas(best_of_block, f"q {kind}, id {kind}")
    of = lambda df, name: df.select(F.col("id").alias(f"{name}k"), F.col("vector").alias(f"{name}v"), F.col("g").alias(f"{name}g"), F.col("plain").alias(f"{name}p"))
    a, c = of(q, "q"), of(i, "i")
    few = few.join(a.where("qp"), few["q"] == F.col("qk")).join(c.where("ip"), (few["id"] == F.col("ik")) & (F.col("qg") == F.col("ig")))
    odd = lambda x, y: x.join(y, (F.col("qg") == F.col("ig")) & (F.col("qk") != F.col("ik")))
    pairs = few.select("qk", "qv", "ik", "iv").unionByName(odd(a.where("NOT qp"), c).select("qk", "qv", "ik", "iv")).unionByName(odd(a.where("qp"), c.where("NOT ip")).select("qk", "qv", "ik", "iv"))
    j = pairs.select("qk", "ik", F.round(cosine(F.col("qv"), F.col("iv")), 6).alias("similarity"))
    w = Window.partitionBy("qk").orderBy(F.desc("similarity"), "ik")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(F.col("qk").alias("id"), F.col("ik").alias("neighbour"), "similarity")


def calibrate(pairs: DataFrame, group: str, value: str, target: float, cap: int = 5) -> DataFrame:
    """cutoff: the largest observed value at which the mean over groups of the counts at or above it, capped, reaches target."""
    w = Window.partitionBy(group).orderBy(F.desc(value))
    r = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    groups = pairs.agg(F.count_distinct(group).alias("groups"))
    per = r.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    run = per.withColumn("upto", F.sum("m").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)))
    return run.crossJoin(F.broadcast(groups)).where(F.col("upto") / F.col("groups") >= target).agg(F.max("v").alias("cutoff"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, resamples: int = 2000, seed: int = 587, part_rows: int = 50_000) -> DataFrame:
    """mean, low, high: 95% interval of the mean by resampling clusters with replacement, as many as there are.

    Sums and counts are taken by cluster first. Clusters stand in parts of about part_rows; how many of a resample's draws
    fall to each part is multinomial and drawn alike in every task, each part makes its own draws, and sums over the parts
    meet by resample, so that any number of clusters will do. Rows without a cluster are one cluster; null values don't count.
    """
    sums = df.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    total = sums.count()
    parts = max(1, -(-total // part_rows))
    sums = sums.select(F.pmod(F.xxhash64(cluster), F.lit(parts)).cast("int").alias("part"), F.coalesce("s", F.lit(0.0)).alias("s"), "n", F.xxhash64(cluster).alias("h"))
    sizes = {r["part"]: r["count"] for r in sums.groupBy("part").count().collect()}  # one row a part
    shares = np.array([sizes.get(p, 0) / max(total, 1) for p in range(parts)])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "s", "n"])
        part, s, n, out = int(pdf["part"].iloc[0]), pdf["s"].to_numpy(), pdf["n"].to_numpy(), []
        for r in range(resamples):
            times = np.random.default_rng([seed, r]).multinomial(total, shares)[part]
            hit = np.random.default_rng([seed, r, part]).integers(0, len(s), times)
            out.append((r, s[hit].sum(), n[hit].sum()))
        return pd.DataFrame(out, columns=["r", "s", "n"])

    drawn = sums.groupBy("part").applyInPandas(draw, "r int, s double, n long")
    m = drawn.groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    ends = m.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ends)


def aggregators(axes: Column) -> dict[str, Column]:
    """Alternative means of an array of axes."""
    n = F.size(axes)
    total = F.aggregate(axes, F.lit(0.0), lambda s, x: s + x)
    prod = F.aggregate(axes, F.lit(1.0), lambda s, x: s * x)
    inv = F.aggregate(axes, F.lit(0.0), lambda s, x: s + F.try_divide(F.lit(1.0), x))
    return {"arith": total / n, "least": F.array_min(axes), "geo": F.pow(prod, 1.0 / n), "harmonic": F.when(F.array_min(axes) <= 0, 0.0).otherwise(F.try_divide(n.cast("double"), inv))}
