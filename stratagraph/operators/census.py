"""Censuses of names: families and homes, shared values, registries, surfaces, coverage, partitions; stems and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_module

CAMEL = "[A-Z]+(?![a-z])|[A-Z][a-z0-9]*"


def camel_suffix(name: Column) -> Column:
    """The last camel-case part of a name, else the name."""
    parts = F.regexp_extract_all(name, F.lit(CAMEL), F.lit(0))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), name)


def stem(name: Column) -> Column:
    return F.regexp_extract(name, "^(.+)_([^_]+)$", 1)


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, itself last."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def longest_prefix(targets: DataFrame, known: DataFrame) -> DataFrame:
    """target, prefix: the longest dotted prefix of target that is known (node), else its first part."""
    e = targets.select("target", F.posexplode(prefixes(F.col("target"))).alias("k", "p"))
    n = known.select(F.col("node").alias("n"))
    hit = e.join(n, e["p"] == n["n"]).groupBy(F.col("target").alias("t")).agg(F.max_by("p", "k").alias("prefix"))
    t = targets.select("target").distinct()
    return t.join(hit, t["target"] == hit["t"], "left").select("target", F.coalesce("prefix", F.substring_index("target", ".", 1)).alias("prefix"))


def families(members: DataFrame, min_family: int = 2) -> DataFrame:
    """family, members, home, home_share of (family, module): the home holds most members, ties to the first name."""
    n = members.groupBy("family", "module").agg(F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "module")
    home = n.withColumn("rn", F.row_number().over(w)).withColumn("members", F.sum("n").over(Window.partitionBy("family"))).where("rn = 1")
    return home.where(F.col("members") >= min_family).select("family", "members", F.col("module").alias("home"), (F.col("n") / F.col("members")).alias("home_share"))


def value_distribution(rows: DataFrame, min_count: int = 2) -> DataFrame:
    """name, n, distribution (value and count, most frequent first, then by value) of (name, value)."""
    c = rows.groupBy("name", "value").agg(F.count("*").alias("k"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("m"), "value", "k"))), lambda p: F.concat_ws("=", p["value"], p["k"].cast("string")))
    return c.groupBy("name").agg(F.sum("k").alias("n"), F.array_join(pairs, ",").alias("distribution")).where(F.col("n") >= min_count)


def registries(assignments: DataFrame, floor: int = 3) -> DataFrame:
    """ctor, entries, modules of (ctor, name, module) for constructors that are assigned floor times or more."""
    return assignments.groupBy("ctor").agg(F.count("*").alias("entries"), F.count_distinct("module").alias("modules")).where(F.col("entries") >= max(floor, 3))


def consumers(imports: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """home, name, importers of (home, name, importer) for names that least to most modules import."""
    return imports.groupBy("home", "name").agg(F.count_distinct("importer").alias("importers")).where(F.col("importers").between(least, most))


def import_homes(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """name, home: the named source, else the only module that defines it, else null; of uses (name, source) and definitions (name, module)."""
    d = definitions.groupBy(F.col("name").alias("d")).agg(F.count_distinct("module").alias("k"), F.min("module").alias("only"))
    return uses.join(d, uses["name"] == d["d"], "left").select("name", F.coalesce("source", F.when(F.col("k") == 1, F.col("only"))).alias("home"))


def base_family(bases: DataFrame, root: str) -> DataFrame:
    """cls of (cls, base): root and all that inherit from it over any number of steps."""
    from .graph import reachable

    seed = bases.sparkSession.createDataFrame([(root,)], "node string")
    return reachable(bases.select(F.col("base").alias("src"), F.col("cls").alias("dst")), seed).select(F.col("node").alias("cls"))


def partly_covered(expected: DataFrame, found: DataFrame, floor: float = 0.5) -> DataFrame:
    """grp, n, covered, missing of expected (grp, name) against found (name): groups covered by floor or more, not in full."""
    f = found.select(F.col("name").alias("f")).distinct()
    j = expected.distinct().join(f, expected["name"] == f["f"], "left")
    g = j.groupBy("grp").agg(F.count("*").alias("n"), F.count("f").alias("covered"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("f").isNull(), F.col("name")))), ",").alias("missing"))
    return g.where((F.col("covered") >= floor * F.col("n")) & (F.col("covered") < F.col("n")))


def partition_of(qualname: Column, shadowed: Column) -> Column:
    """nonsource (under a dot-directory), test, shadowed or censused, in that order."""
    return F.when(qualname.startswith("."), "nonsource").when(is_test_module(qualname), "test").when(shadowed, "shadowed").otherwise("censused")


def coverage_gaps(members: DataFrame, named: DataFrame, floor: float = 0.5, min_count: int = 2, public_only: bool = False) -> DataFrame:
    """place, grp, n, covered, missing of groups (grp, name) that places (place, name), as documentation folders or __all__ lists,
    name in part: min_count names or more, a share of floor or more, not all. public_only leaves out names that begin with _."""
    m = members.select("grp", "name").distinct()
    m = m.where(~F.col("name").startswith("_")) if public_only else m
    size = m.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("all"))
    hit = m.join(named.select("place", F.col("name").alias("k")).distinct(), F.col("name") == F.col("k"))
    per = hit.groupBy("place", "grp").agg(F.count("*").alias("covered"), F.collect_list("name").alias("have"))
    per = per.join(size, per["grp"] == size["g"]).where((F.col("covered") >= min_count) & (F.col("covered") >= floor * F.col("n")) & (F.col("covered") < F.col("n")))
    return per.select("place", "grp", "n", "covered", F.array_except("all", "have").alias("missing"))


def doc_gaps(members: DataFrame, named: DataFrame, min_documented: int = 2) -> DataFrame:
    """coverage_gaps of public names against documentation, for each group the place that covers most of it (the first by name
    where several do)."""
    w = Window.partitionBy("grp").orderBy(F.desc("covered"), "place")
    return coverage_gaps(members, named, 0.5, min_documented, True).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def shadow_roots(names: DataFrame, min_modules: int = 5, ratio: float = 0.5) -> DataFrame:
    """root of names (node): packages a.b of min_modules names or more below them, a share of ratio or more of which stands
    elsewhere under a too: copies of their parent."""
    parts = F.split("node", r"\.")
    n = names.select("node").distinct().withColumn("parts", parts).where(F.size("parts") >= 2)
    n = n.select("node", F.element_at("parts", 1).alias("top"), F.array_join(F.slice("parts", 1, 2), ".").alias("root"), F.array_join(F.slice("parts", F.lit(2), F.size("parts")), ".").alias("below_top"), F.array_join(F.slice("parts", F.lit(3), F.size("parts")), ".").alias("inner"))
    inner = n.where("inner <> ''").select("top", "root", "inner").distinct()
    # A name a.x.y is outside every root but a.x; a name a.x is outside all, as it is not below a.x.
    other = n.select(F.col("top").alias("t"), F.col("below_top").alias("o"), F.when(F.col("inner") != "", F.col("root")).alias("r")).distinct()
    again = inner.join(other, (inner["top"] == other["t"]) & (inner["inner"] == other["o"]) & ~inner["root"].eqNullSafe(other["r"]), "left_semi").groupBy(F.col("root").alias("r2")).agg(F.count("*").alias("k"))
    per = inner.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_modules)
    return per.join(again, per["root"] == again["r2"]).where(F.col("k") >= ratio * F.col("n")).select("root")


#: What of a document's text names an identifier, and whether only the part behind the last dot counts.
DOC_PATTERNS = (
    (r"(?m)^\s*(?:\.\.\s+(?:auto)?(?:class|exception|function|data|attribute|method|module)::|:::)\s*([\w.]+)", True),
    (r"`{1,2}\s*([A-Za-z_][\w.-]*)\s*`{1,2}", True),
    (r"(?<![\w-])([a-z][a-z0-9]*(?:-[a-z0-9]+)+)(?![\w-])", False),
    (r"\[([A-Za-z_][\w.-]*)\]", True),
)


def doc_names(text: Column) -> Column:
    """Names that a document mentions: directives, code spans, slugs and bracketed names."""
    found = []
    for p, dotted in DOC_PATTERNS:
        hits = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        found.append(F.transform(hits, lambda h: F.element_at(F.split(h, r"\."), -1)) if dotted else hits)
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda x: x != "")))


def helper_families(functions: DataFrame, min_count: int = 2) -> DataFrame:
    """module, stem, surfaces of (module, name): names that differ in their last part only, min_count such parts or more."""
    f = functions.select("module", F.regexp_extract("name", "^(.+)_([^_]+)$", 1).alias("stem"), F.regexp_extract("name", "^(.+)_([^_]+)$", 2).alias("tail")).where("stem <> ''")
    return f.groupBy("module", "stem").agg(F.sort_array(F.collect_set("tail")).alias("surfaces")).where(F.size("surfaces") >= min_count)


def mirrored_families(classes: DataFrame, min_count: int = 2) -> DataFrame:
    """name, surfaces of (module, name): classes that min_count modules or more define under one name."""
    return classes.groupBy("name").agg(F.sort_array(F.collect_set("module")).alias("surfaces")).where(F.size("surfaces") >= min_count)
