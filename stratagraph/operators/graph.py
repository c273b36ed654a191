"""Graph operators over edges (src, dst, call_count) and nodes (node, ...), as joins and aggregates; loops only for fixpoints."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut
from . import small
from .small import MOST, MOST_REACH


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out; a self-loop counts in both, a node without edges has zeros."""
    o = edges.groupBy(F.col("src").alias("o")).agg(F.count("*").alias("fan_out"))
    i = edges.groupBy(F.col("dst").alias("i")).agg(F.count("*").alias("fan_in"))
    j = nodes.select("node").join(o, F.col("node") == o["o"], "left").join(i, F.col("node") == i["i"], "left")
    return j.select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def instability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, ca, ce, instability = ce / (ce + ca), 0 for an isolated node."""
    d = degrees(nodes, edges)
    return d.select("node", F.col("fan_in").alias("ca"), F.col("fan_out").alias("ce"), F.coalesce(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), F.lit(0.0)).alias("instability"))


def gini(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """gini of value (for each group): sum((2i - n - 1) x_i) / (n sum x) over ascending ranks, 0 when empty or all zero.

    Equal values may stand in any order, so values are counted first and the rank of a value follows from running counts:
    the window runs over distinct values, not over rows.
    """
    by = by or []
    c = df.groupBy(*by, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("m").over(w))
    x = F.col(value).cast("double")
    n = F.sum("m")
    # The ranks of a value's m rows sum to m * (2 * upto - m + 1) / 2.
    a = c.groupBy(*by).agg(F.sum(x * F.col("m") * (2 * F.col("upto") - F.col("m") + 1)).alias("r"), F.sum(x * F.col("m")).alias("s"), n.alias("n"))
    return a.select(*by, F.coalesce(F.try_divide(F.col("r") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s")), F.lit(0.0)).alias("gini"))


def _kind(df: DataFrame, col: str) -> str:
    return dict(df.dtypes)[col]


def closure(edges: DataFrame, max_rounds: int | None = None, most: int = MOST_REACH) -> DataFrame:
    """src, dst of all pairs with a path of one edge or more. Graphs of at most `most` edges are closed in one task.

    Larger ones keep for each node the sources that reach it as bits, 64 to a row, and hand on along edges the bits that are new, one
    edge a round: what is kept and shuffled is words, not pairs, and each pair crosses each edge once. Pairs are made at the end.
    """
    edges = cut(edges.select("src", "dst").distinct())
    if edges.count() <= most:
        return small.run(edges, None, small.closure, f"src {_kind(edges, 'src')}, dst {_kind(edges, 'dst')}")
    # Numbers in the order of names, so that neighbours in name share words.
    ids = cut(nodes_of(edges).where("node IS NOT NULL").sort("node").select("node", F.monotonically_increasing_id().alias("id")))
    a, b = ids.select(F.col("node").alias("n1"), F.col("id").alias("s")), ids.select(F.col("node").alias("n2"), F.col("id").alias("t"))
    e = cut(edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).select("s", "t"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    seen = cut(e.groupBy(F.col("t").alias("v"), F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("bits")))
    front, k = seen, 0
    while not front.isEmpty():
        k += 1
        if max_rounds and k > max_rounds:
            raise ValueError("the closure did not settle")
        step = front.join(e, front["v"] == e["s"]).groupBy(F.col("t").alias("v2"), F.col("w").alias("w2")).agg(F.bit_or("bits").alias("got"))
        j = seen.join(step, (seen["v"] == step["v2"]) & (seen["w"] == step["w2"]), "full_outer")
        had, got = F.coalesce("bits", F.lit(0).cast("long")), F.coalesce("got", F.lit(0).cast("long"))
        new = cut(j.select(F.coalesce("v", "v2").alias("v"), F.coalesce("w", "w2").alias("w"), had.bitwiseOR(got).alias("bits"), got.bitwiseAND(F.bitwise_not(had)).alias("fresh")))
        front, seen = new.where("fresh <> 0").select("v", "w", F.col("fresh").alias("bits")), new.select("v", "w", "bits")
    words = ids.groupBy(F.shiftright("id", 6).alias("w2")).agg(F.collect_list(F.struct(F.col("id").bitwiseAND(F.lit(63)).cast("int").alias("k"), "node")).alias("names"))
    d = ids.select(F.col("node").alias("dst"), F.col("id").alias("v2"))
    named = seen.join(d, seen["v"] == d["v2"]).join(words, seen["w"] == words["w2"])
    hit = F.filter("names", lambda x: F.call_function("getbit", F.col("bits"), x["k"]) == 1)
    return named.select(F.explode(F.transform(hit, lambda x: x["node"])).alias("src"), "dst")


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int | None = None, most: int = MOST) -> DataFrame:
    """node, dist from the nearest of seeds (node), seeds at 0: semi-naive breadth-first search, cut off at depth."""
    e = edges.select(F.col("dst" if reverse else "src").alias("a"), F.col("src" if reverse else "dst").alias("b")).distinct()
    e = cut(e)
    if small.fits(e, seeds, most):
        return small.run(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), seeds, small.bfs(depth), f"node {_kind(edges, 'src')}, dist int")
    seen = cut(seeds.select("node").distinct().withColumn("dist", F.lit(0)))
    front, k = seen, 0
    while depth is None or k < depth:
        k += 1
        nxt = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("nxt")).distinct()
        old = seen.select(F.col("node").alias("old"))
        front = cut(nxt.join(old, nxt["nxt"] == old["old"], "left_anti").select(F.col("nxt").alias("node"), F.lit(k).alias("dist")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_chains(edges: DataFrame, seeds: DataFrame, reverse: bool = True, most: int = MOST) -> DataFrame:
    """node, dist, root, chain: for each node reached from seeds the least of its shortest chains, nodes in order from the seed."""
    e = edges.select(F.col("dst" if reverse else "src").alias("a"), F.col("src" if reverse else "dst").alias("b")).distinct()
    e = cut(e)
    if small.fits(e, seeds, most):
        k = _kind(edges, "src")
        return small.run(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), seeds, small.chains, f"node {k}, dist int, root {k}, chain array<{k}>")
    seen = cut(seeds.select("node", F.lit(0).alias("dist"), F.col("node").alias("root"), F.array("node").alias("chain")).distinct())
    front = seen
    while not front.isEmpty():
        nxt = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("n"), (F.col("dist") + 1).alias("dist"), "root", F.concat("chain", F.array("b")).alias("chain"))
        nxt = nxt.groupBy("n").agg(F.min(F.struct("dist", "chain", "root")).alias("x"))
        old = seen.select(F.col("node").alias("old"))
        front = cut(nxt.join(old, nxt["n"] == old["old"], "left_anti").select(F.col("n").alias("node"), "x.dist", "x.root", "x.chain"))
        seen = seen.unionByName(front)
    return seen


def propagation(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """node, reached_by (itself included), propagation = reached_by / N; from a closure."""
    a = reach.where("src <> dst").groupBy(F.col("dst").alias("d")).agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("total"))
    j = nodes.select("node").join(a, F.col("node") == a["d"], "left").crossJoin(F.broadcast(total))
    return j.select("node", (F.coalesce("n", F.lit(0)) + 1).alias("reached_by"), ((F.coalesce("n", F.lit(0)) + 1) / F.col("total")).alias("propagation"))


def scc(nodes: DataFrame, edges: DataFrame, reach: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """node, scc (its least member), cyclic (more than one member or a self-loop).

    Graphs of at most `most` edges: depth-first search in one task. With a closure: mutual reachability. Without: nodes without edges in or out are trimmed, then colours (the greatest
    label that reaches a node) split the rest, and of each colour the nodes that also reach its root are one component.
    """
    if reach is not None:
        # Both directions of a pair meet in one group: no side of a join, of a size that nobody knows, is sent to all.
        sides = reach.groupBy(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).agg(F.count_distinct("src").alias("k"))
        both = sides.where((F.col("k") == 2) | (F.col("low") == F.col("high")))
        mutual = both.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("s"), "low", "high").groupBy("s").agg(F.min("low").alias("low"))
        j = nodes.select("node").join(mutual, F.col("node") == mutual["s"], "left")
        return j.select("node", F.coalesce(F.least("low", "node"), "node").alias("scc"), F.col("low").isNotNull().alias("cyclic"))
    edges = cut(edges.select("src", "dst").distinct())
    if small.fits(edges, nodes, most):
        k = _kind(edges, "src")
        return small.run(edges, nodes, small.scc, f"node {k}, scc {k}, cyclic boolean")
    loops = edges.where("src = dst").select(F.col("src").alias("l")).distinct()
    e = edges.where("src <> dst")
    done = None
    while True:
        while True:  # trim
            n = e.count()
            ins, outs = e.select(F.col("dst").alias("x")).distinct(), e.select(F.col("src").alias("y")).distinct()
            e = cut(e.join(ins, e["src"] == ins["x"], "left_semi").join(outs, e["dst"] == outs["y"], "left_semi"))
            if e.count() == n:
                break
        if n == 0:
            break
        colour = _spread(e, nodes_of(e).withColumn("c", F.col("node")), greatest=True)
        a, b = colour.select(F.col("node").alias("n1"), F.col("c").alias("c1")), colour.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        same = e.join(a, e["src"] == a["n1"]).join(b, e["dst"] == b["n2"]).where("c1 = c2").select("src", "dst", F.col("c1").alias("c"))
        roots = colour.where("node = c").select("node")
        member = reachable(same, roots, reverse=True, most=most).select("node")
        found = cut(member.join(colour.select(F.col("node").alias("m"), "c"), F.col("node") == F.col("m")).select("node", "c"))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("node").alias("g"))
        e = cut(e.join(gone, e["src"] == gone["g"], "left_anti").join(gone, e["dst"] == gone["g"], "left_anti"))
    base = nodes.select("node").join(loops, F.col("node") == loops["l"], "left")
    if done is None:
        return base.select("node", F.col("node").alias("scc"), F.col("l").isNotNull().alias("cyclic"))
    low = done.groupBy("c").agg(F.min("node").alias("low"), F.count("*").alias("k")).select(F.col("c").alias("c3"), "low", "k")
    lab = done.join(low, done["c"] == low["c3"]).select(F.col("node").alias("m"), "low", "k")
    j = base.join(lab, F.col("node") == lab["m"], "left")
    return j.select("node", F.coalesce("low", "node").alias("scc"), ((F.coalesce("k", F.lit(1)) > 1) | F.col("l").isNotNull()).alias("cyclic"))


def _spread(edges: DataFrame, labels: DataFrame, greatest: bool) -> DataFrame:
    """node, c: the greatest (or least) label that reaches each node along edges."""
    pick = F.max if greatest else F.min
    labels = cut(labels.select("node", "c"))
    while True:
        a = labels.select(F.col("node").alias("n1"), F.col("c").alias("c1"))
        got = edges.join(a, edges["src"] == a["n1"]).groupBy("dst").agg(pick("c1").alias("best"))
        best = (F.greatest if greatest else F.least)("c", F.coalesce("best", "c"))
        new = cut(labels.join(got, labels["node"] == got["dst"], "left").select("node", best.alias("c"), (best != F.col("c")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "c")
        if not moved:
            return labels


def weak_components(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """node, component: the least node connected to it, directions ignored."""
    edges = cut(edges.select("src", "dst").distinct())
    if small.fits(edges, nodes, most):
        k = _kind(edges, "src")
        return small.run(edges, nodes, small.weak, f"node {k}, component {k}")
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    return _spread(both, nodes.select("node", F.col("node").alias("c")), greatest=False).select("node", F.col("c").alias("component"))


def cycles(sccs: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """scc, members (ascending), size, n_edges inside: components of min_size or more, and single nodes with a self-loop."""
    m = sccs.where("cyclic").groupBy("scc").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size"))
    a, b = sccs.select(F.col("node").alias("n1"), F.col("scc").alias("s1")), sccs.select(F.col("node").alias("n2"), F.col("scc").alias("s2"))
    inner = edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).where("s1 = s2").groupBy(F.col("s1").alias("k")).agg(F.count("*").alias("n_edges"))
    return m.join(inner, m["scc"] == inner["k"]).where((F.col("size") >= min_size) | (F.col("size") == 1)).select("scc", "members", "size", "n_edges")


def condensation(sccs: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst between components, distinct, none within."""
    a, b = sccs.select(F.col("node").alias("n1"), F.col("scc").alias("s1")), sccs.select(F.col("node").alias("n2"), F.col("scc").alias("s2"))
    return edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).where("s1 <> s2").select(F.col("s1").alias("src"), F.col("s2").alias("dst")).distinct()


def depths(nodes: DataFrame, dag: DataFrame, most: int = MOST) -> DataFrame:
    """node, depth: the longest path that ends at the node of an acyclic graph, by relaxation of the changed nodes."""
    dag = cut(dag.select("src", "dst").distinct())
    if small.fits(dag, nodes, most):
        return small.run(dag, nodes, small.depths, f"node {_kind(dag, 'src')}, depth int")
    best = cut(nodes.select("node", F.lit(0).alias("depth")))
    front = best
    while True:
        f = front.select(F.col("node").alias("n1"), (F.col("depth") + 1).alias("d1"))
        got = dag.join(f, dag["src"] == f["n1"]).groupBy("dst").agg(F.max("d1").alias("d2"))
        new = cut(best.join(got, best["node"] == got["dst"], "left").select("node", F.greatest("depth", F.coalesce("d2", "depth")).alias("depth"), (F.coalesce("d2", F.lit(-1)) > F.col("depth")).alias("moved")))
        front = new.where("moved").select("node", "depth")
        best = new.select("node", "depth")
        if front.isEmpty():
            return best


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tol: float = 1e-6, every: int = 1, most: int = MOST) -> DataFrame:
    """node, rank: power iteration with the mass of nodes without edges out spread evenly; stops when the summed change is under N * tol."""
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank")).limit(0)
    edges = cut(edges.select("src", "dst"))
    if small.fits(edges, nodes, most):
        return small.run(edges, nodes, small.pagerank(damping, iterations, tol), f"node {_kind(edges, 'src')}, rank double")
    out = edges.groupBy(F.col("src").alias("o")).agg(F.count("*").alias("k"))
    e = cut(edges.join(out, edges["src"] == out["o"]).select("src", "dst", (1.0 / F.col("k")).alias("w")))
    dangling = cut(nodes.select("node").join(out, F.col("node") == out["o"], "left_anti").select(F.col("node").alias("x")))
    r = cut(nodes.select("node", F.lit(1.0 / n).alias("rank")))
    for i in range(iterations):
        lost = r.join(dangling, r["node"] == dangling["x"]).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = e.join(r, e["src"] == r["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = r.withColumnRenamed("rank", "old").join(got, r["node"] == got["dst"], "left").crossJoin(F.broadcast(lost))
        new = new.select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "old")
        if (i + 1) % every == 0 or i + 1 == iterations:
            new = cut(new)
            moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            r = new.select("node", "rank")
            if moved < n * tol:
                break
        else:
            r = new.select("node", "rank")
    return r


def modularity(edges: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """q, score = (q + 0.5) / 1.5 within 0 and 1, of a given partition (node, grp) of a directed graph; an edge of no calls weighs 1."""
    w = F.greatest("call_count", F.lit(1)) if weighted else F.lit(1)
    a, b = labels.select(F.col("node").alias("n1"), F.col("grp").alias("g1")), labels.select(F.col("node").alias("n2"), F.col("grp").alias("g2"))
    e = edges.join(a, edges["src"] == a["n1"]).join(b, edges["dst"] == b["n2"]).select("g1", "g2", w.cast("double").alias("w"))
    g = e.select(F.col("g1").alias("g"), F.col("w").alias("o"), F.lit(0.0).alias("i"), F.when(F.col("g1") == F.col("g2"), F.col("w")).otherwise(0.0).alias("s")).unionByName(e.select(F.col("g2").alias("g"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("s")))
    g = g.groupBy("g").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("s").alias("s"))
    m = F.sum("o")
    q = F.coalesce(F.try_divide(F.sum("s"), m) - F.try_divide(F.sum(F.col("o") * F.col("i")), m * m), F.lit(1.0))
    return g.agg(q.alias("q")).select("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("q") + 0.5) / 1.5)).alias("score"))


def greedy_communities(nodes: DataFrame, edges: DataFrame, weighted: bool = False, most: int = 500_000) -> DataFrame:
    """node, community by greedy merging of the pair with the largest gain in modularity, ties to the smallest names; a community is named by its
    least member. Merging is one sequence over the whole graph, so it runs in one task, on a heap of pairs, and refuses graphs of over
    `most` nodes or edges."""
    if nodes.count() > most or edges.count() > most:
        raise ValueError(f"greedy merging takes at most {most} nodes and as many edges")
    kind = dict(nodes.dtypes)["node"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf.src.isna(), "dst"])
        at, e = {n: k for k, n in enumerate(names)}, pdf[pdf.src.notna()]
        m = float(e.w.sum()) or 1.0
        out, inn = [0.0] * len(names), [0.0] * len(names)
        near: list[dict[int, float]] = [{} for _ in names]
        for s, t, w in zip(e.src.map(at), e.dst.map(at), e.w, strict=True):
            out[s] += w
            inn[t] += w
            if s != t:
                near[s][t] = near[t][s] = near[s].get(t, 0.0) + w
        label, changed = list(range(len(names))), [0] * len(names)
        gain = lambda x, y: round(near[x][y] / m - (out[x] * inn[y] + out[y] * inn[x]) / m**2, 12)
        entry = lambda x, y: (-gain(x, y), x, y, changed[x], changed[y])
        heap = [entry(x, y) for x in range(len(names)) for y in near[x] if x < y]
        heapq.heapify(heap)
        while heap:
            less, x, y, cx, cy = heapq.heappop(heap)
            if (cx, cy) != (changed[x], changed[y]) or y not in near[x]:
                continue  # one of the two has grown since
            if less >= 0:
                break
            label[y] = x
            out[x], inn[x] = out[x] + out[y], inn[x] + inn[y]
            changed[x] += 1
            changed[y] = -1
            del near[x][y], near[y][x]
            for z, w in near[y].items():
                near[x][z] = near[z][x] = near[x].get(z, 0.0) + w
                del near[z][y]
            near[y] = {}
            for z in near[x]:
                heapq.heappush(heap, entry(min(x, z), max(x, z)))
        for k in range(len(names)):  # a label points to a smaller place, which is final by then
            label[k] = label[label[k]]
        return pd.DataFrame({"node": names, "community": [names[k] for k in label]})

    w = (F.greatest("call_count", F.lit(1)) if weighted else F.lit(1)).cast("double")
    rows = edges.select("src", "dst", w.alias("w")).unionByName(nodes.select(F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")))
    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(merge, f"node {kind}, community {kind}")


def edit_risk(nodes: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """node, risk = cube root of propagation * fan_in / (N - 1) * instability; no rows for fewer than two nodes."""
    p, i = propagation(nodes, reach), instability(nodes, edges)
    total = nodes.agg(F.count("*").alias("total"))
    j = p.join(i.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2")).crossJoin(F.broadcast(total)).where("total >= 2")
    return j.select("node", F.pow(F.col("propagation") * F.col("ca") / (F.col("total") - 1) * F.col("instability"), F.lit(1.0 / 3)).alias("risk"))


def score(nodes: DataFrame, edges: DataFrame, sccs: DataFrame, communities: DataFrame, complexity: Column | None = None) -> DataFrame:
    """The five axes and overall, their geometric mean: modularity of communities (node, grp), acyclicity, depth, equality, complexity (1 if not given)."""
    n = nodes.agg(F.count("*").alias("n"))
    tangled = sccs.agg(F.count_if("cyclic").alias("tangled"))
    names = sccs.select(F.col("scc").alias("node")).distinct()
    deep = depths(names, condensation(sccs, edges)).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    even = gini(degrees(nodes, edges), "fan_out").select("gini")
    mod = modularity(edges, communities).select("q", F.col("score").alias("modularity"))
    j = n.crossJoin(tangled).crossJoin(deep).crossJoin(even).crossJoin(mod)  # one row each
    j = j.withColumn("acyclicity", 1 - F.coalesce(F.try_divide("tangled", "n"), F.lit(0.0))).withColumn("depth", 1 / (1 + F.col("max_depth") / 8)).withColumn("equality", 1 - F.col("gini")).withColumn("complexity", (complexity if complexity is not None else F.lit(1.0)))
    return j.withColumn("overall", F.pow(F.col("modularity") * F.col("acyclicity") * F.col("depth") * F.col("equality") * F.col("complexity"), F.lit(0.2)))


def complexity_axis(mean_cc: Column, functions: Column) -> Column:
    """1 - clamp((mean - 1) / 8), and 1 for fewer than 20 functions."""
    return F.when(functions < 20, 1.0).otherwise(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean_cc - 1) / 8)))


def package_filter(df: DataFrame, col: str, package: str) -> DataFrame:
    """Rows whose dotted name is package or lies in it."""
    return df.where((F.col(col) == package) | F.col(col).startswith(package + "."))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    a, b = nodes.select(F.col("node").alias("k1")), nodes.select(F.col("node").alias("k2"))
    return edges.join(a, edges["src"] == a["k1"], "left_semi").join(b, edges["dst"] == b["k2"], "left_semi")


def focus(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both") -> DataFrame:
    """The subgraph within hops of seeds along in, out or both directions."""
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    e = edges if direction != "both" else edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return induced(edges, reachable(e, seeds, reverse=direction == "in", depth=hops))


def init_edges(names: DataFrame) -> DataFrame:
    """src, dst: each dotted name to every package above it that is itself a name."""
    parts = F.split("node", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    up = names.where(F.col("node").contains(".")).select("node", F.explode(above).alias("above"))
    known = names.select(F.col("node").alias("k"))
    return up.join(known, up["above"] == known["k"], "left_semi").select(F.col("node").alias("src"), F.col("above").alias("dst"))
