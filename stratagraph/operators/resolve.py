"""From parsed facts to a module graph: import and call targets by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .behavior import edge_rollup
from .census import prefixes


def raw_imports(facts: DataFrame) -> DataFrame:
    """src, stmt, module, level, names, alias, line, type_checking and base: the absolute name that is imported from, null
    past the project's root."""
    i = facts.select(F.col("qualname").alias("src"), "is_package", F.posexplode("imports").alias("stmt", "i")).select("src", "is_package", "stmt", "i.*")
    parts = F.split("src", r"\.")
    package = F.when(F.col("is_package"), parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))
    up = F.size(package) - (F.col("level") - 1)
    relative = F.when(up > 0, F.concat_ws(".", F.array_join(F.slice(package, F.lit(1), F.greatest(up, F.lit(1))), "."), F.when(F.col("module") != "", F.col("module"))))
    i = i.withColumn("base", F.when(F.col("level") > 0, relative).otherwise(F.col("module")))
    return i


def _src_layout(i: DataFrame, known: DataFrame) -> DataFrame:
    """base under src. where src is itself a package and the plain name is not internal."""
    top = F.substring_index("base", ".", 1)
    a, b = known.select(F.col("node").alias("plain")), known.select(F.col("node").alias("under"))
    i = i.join(a, top == a["plain"], "left").join(b, F.concat(F.lit("src."), top) == b["under"], "left")
    moved = (F.col("level") == 0) & F.col("plain").isNull() & F.col("under").isNotNull()
    return i.withColumn("base", F.when(moved, F.concat(F.lit("src."), F.col("base"))).otherwise(F.col("base"))).drop("plain", "under")


def longest_internal(targets: DataFrame, known: DataFrame) -> DataFrame:
    """base, landing: the longest internal prefix of each distinct base, else its first part."""
    t = targets.select("base").where("base IS NOT NULL").distinct()
    e = t.select(F.col("base").alias("b"), F.posexplode(prefixes(F.col("base"))).alias("k", "p"))
    n = known.select(F.col("node").alias("n"))
    hit = e.join(n, e["p"] == n["n"]).groupBy("b").agg(F.max_by("p", "k").alias("hit"))
    return t.join(hit, t["base"] == hit["b"], "left").select("base", F.coalesce("hit", F.substring_index("base", ".", 1)).alias("landing"))


def reexports(imports: DataFrame, known: DataFrame, depth: int = 8) -> DataFrame:
    """pkg, name, target: what packages import from within themselves under a name, followed through further packages up to
    depth steps; a package met again ends the chain."""
    own = imports.where("is_package AND (level > 0 OR base = src OR startswith(base, src || '.'))")
    e = own.select(F.col("src").alias("pkg"), "base", "stmt", F.explode("names").alias("x")).select("pkg", "base", "stmt", "x.name", F.col("x.alias").alias("local"))
    a, b = known.select(F.col("node").alias("sub")), known.select(F.col("node").alias("mod"))
    e = e.join(a, F.concat_ws(".", "base", "name") == a["sub"], "left").join(b, e["base"] == b["mod"], "left")
    e = e.withColumn("target", F.coalesce("sub", "mod")).where("target IS NOT NULL AND target <> pkg")
    m = cut(e.groupBy("pkg", F.col("local").alias("name")).agg(F.max_by("target", "stmt").alias("target")).withColumn("seen", F.array("pkg")))
    base = m.select(F.col("pkg").alias("p2"), F.col("name").alias("n2"), F.col("target").alias("t2"))
    for _ in range(depth):
        j = m.join(base, (m["target"] == base["p2"]) & (m["name"] == base["n2"]), "left")
        go = F.col("t2").isNotNull() & ~F.array_contains("seen", F.coalesce("t2", F.lit("")))
        m = cut(j.select("pkg", "name", F.when(go, F.col("t2")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", "target")).otherwise(F.col("seen")).alias("seen"), go.alias("moved")))
        if m.where("moved").isEmpty():
            break
        m = m.drop("moved")
    return m.select("pkg", "name", "target")


def _routed(imports: DataFrame, known: DataFrame, maps: DataFrame) -> DataFrame:
    """imports by name: name, local, internal (the base is), route (submodule, then re-export, else null)."""
    k = known.select(F.col("node").alias("kb"))
    i = imports.join(k, imports["base"] == k["kb"], "left").withColumn("internal", F.col("kb").isNotNull()).drop("kb")
    n = i.select("*", F.explode_outer("names").alias("x")).select("*", F.col("x.name").alias("name"), F.col("x.alias").alias("local")).drop("x", "names")
    s = known.select(F.col("node").alias("sub"))
    n = n.join(s, F.concat_ws(".", "base", "name") == s["sub"], "left")
    m = maps.select(F.col("pkg").alias("mp"), F.col("name").alias("mn"), F.col("target").alias("mt"))
    n = n.join(m, (n["base"] == m["mp"]) & (n["name"] == m["mn"]), "left")
    return n.withColumn("route", F.when(F.col("internal") & F.col("name").isNotNull(), F.coalesce("sub", "mt"))).drop("sub", "mp", "mn", "mt")


def import_edges(routed: DataFrame, landings: DataFrame) -> DataFrame:
    """src, dst, line, is_relative, type_checking: one row for each target of each statement. A statement of which no name has
    a route goes to the package; names without one go nowhere else."""
    by = ["src", "stmt", "base", "internal", "level", "line", "type_checking"]
    s = routed.where("base IS NOT NULL").groupBy(*by).agg(F.collect_list("route").alias("routes"))
    s = s.join(landings.withColumnRenamed("base", "lb"), s["base"] == F.col("lb"), "left")
    dst = F.when(F.col("internal"), F.when(F.size("routes") > 0, F.col("routes")).otherwise(F.array("base"))).otherwise(F.array("landing"))
    return s.select("src", F.explode(dst).alias("dst"), "line", (F.col("level") > 0).alias("is_relative"), "type_checking")


def bindings(routed: DataFrame, known: DataFrame) -> DataFrame:
    """src, local, target: what each name of a module stands for after its imports; the last binding of a name counts."""
    plain = F.col("name").isNull()
    local = F.when(plain, F.coalesce("alias", F.substring_index("module", ".", 1))).otherwise(F.col("local"))
    meant = F.when(plain & F.col("alias").isNull(), F.when(F.startswith("base", F.lit("src.")) & ~F.startswith("module", F.lit("src.")), F.concat(F.lit("src."), F.substring_index("module", ".", 1))).otherwise(F.substring_index("module", ".", 1))).otherwise(F.col("base"))
    b = routed.where("base IS NOT NULL AND (name IS NOT NULL OR level = 0)").select("src", "stmt", local.alias("local"), meant.alias("base"), "route")
    land = longest_internal(b, known).withColumnRenamed("base", "lb")
    b = b.join(land, b["base"] == land["lb"], "left").withColumn("target", F.coalesce("route", "landing"))
    return b.where("local IS NOT NULL AND local <> ''").groupBy("src", "local").agg(F.max_by("target", "stmt").alias("target"))


def call_edges(facts: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst, line of calls whose head is bound: the deepest internal module along the chain, else what the head stands
    for. A module's calls of itself are left out."""
    c = facts.select(F.col("qualname").alias("src"), F.explode("calls").alias("c")).select(F.col("src").alias("csrc"), "c.*")
    j = c.join(names, (c["csrc"] == names["src"]) & (c["head"] == names["local"]))
    owner = F.slice("chain", F.lit(1), F.greatest(F.size("chain") - 1, F.lit(0)))
    j = j.select("csrc", "line", "target", F.concat_ws(".", "target", F.when(F.size("chain") > 1, F.array_join(owner, "."))).alias("base"))
    land = longest_internal(j, known).withColumnRenamed("base", "lb")
    j = j.join(land, j["base"] == land["lb"])
    dst = F.when(F.length("landing") > F.length("target"), F.col("landing")).otherwise(F.col("target"))
    return j.select(F.col("csrc").alias("src"), dst.alias("dst"), "line").where("src <> dst")


def module_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, edges). modules: node, path, is_package, external, function_count, cc_sum, cc_max, cc_mean; names that are
    only imported are external. edges: src, dst, is_relative, type_checking_only, lines, kinds, call_lines, call_count."""
    known = cut(facts.select(F.col("qualname").alias("node")))  # names only, so that facts are not parsed for each join of them
    imports = cut(_src_layout(raw_imports(facts), known))
    routed = cut(_routed(imports, known, reexports(imports, known)))
    a = import_edges(routed, longest_internal(imports, known)).select("src", "dst", "line", F.lit("import").alias("kind"), "is_relative", "type_checking", F.lit(False).alias("is_call"))
    c = call_edges(facts, bindings(routed, known), known).select("src", "dst", "line", F.lit("call").alias("kind"), F.lit(False).alias("is_relative"), F.lit(False).alias("type_checking"), F.lit(True).alias("is_call"))
    edges = cut(edge_rollup(a.unionByName(c)))
    cc = F.transform("functions", lambda f: f["cyclomatic"])
    n = F.size("functions").cast("long")
    total = F.aggregate(cc, F.lit(0).cast("long"), lambda s, x: s + x)
    inner = facts.select(F.col("qualname").alias("node"), F.col("rel_path").alias("path"), "is_package", F.lit(False).alias("external"), n.alias("function_count"), total.alias("cc_sum"), F.coalesce(F.array_max(cc), F.lit(0)).cast("long").alias("cc_max"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("cc_mean"))
    ends = edges.select(F.col("dst").alias("node")).distinct()
    outer = ends.join(known.withColumnRenamed("node", "k"), ends["node"] == F.col("k"), "left_anti")
    return inner.unionByName(outer.withColumn("external", F.lit(True)), allowMissingColumns=True), edges
