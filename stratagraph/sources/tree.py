"""Source trees as relations: files, module names, parsed facts. The parse is the only Python boundary."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import is_conventional_test

#: Directories that are skipped at any depth, and those skipped only where they are no package.
HARD_IGNORED = ("__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", ".git", ".venv", "node_modules")
SOFT_IGNORED = ("build", "dist", "venv", "site-packages")
MAX_MODULES = 10_000

FACTS = """has_errors boolean, has_main_guard boolean,
imports array<struct<module:string,level:int,names:array<struct<name:string,alias:string>>,alias:string,line:int,type_checking:boolean>>,
calls array<struct<head:string,chain:array<string>,line:int>>,
functions array<struct<name:string,qualified_name:string,line:int,end_line:int,cyclomatic:int,size:int,shape_hash:string,concrete_hash:string,decorators:array<string>,is_trivial:boolean,n_args:int,n_hinted:int,nesting:int,tokens:map<string,int>>>,
classes array<struct<name:string,qualified_name:string,line:int,bases:array<string>,frozen:boolean,n_fields:int,n_tuple:int,n_list:int>>,
constants array<struct<cls:string,name:string,value:string>>,
assigned array<struct<name:string,ctor:string,listed:array<string>>>,
raised array<struct<scope:string,error:string,line:int>>,
gates array<struct<function:string,category:string,kind:string,code:int,control:string,is_command:boolean>>"""
#: What documentation is, and the size from which it is left out.
DOC_SUFFIXES = (".rst", ".md")
DOC_MOST = 2_000_000


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """path, rel_path, length, modified of the files under root, on any file system that Spark reaches. Spark's file readers
    pass over names that begin with an underscore, __init__.py among them, so the driver lists names; it reads no content."""
    uri = root if "://" in root else "file://" + os.path.abspath(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(uri)
    found, it = [], top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    base = top.toUri().getPath().rstrip("/") + "/"
    while it.hasNext():
        f = it.next()
        path = f.getPath().toUri()
        if path.getPath().endswith(suffixes):
            found.append((path.toString(), path.getPath()[len(base) :], f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(found, "path string, rel_path string, length long, modified long")


def with_content(listed: DataFrame) -> DataFrame:
    """listed with content, read where the task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for pdf in batches:
            for i in range(0, len(pdf), 200):
                part = pdf[i : i + 200]
                content = []
                for uri in part["path"]:
                    fs, at = FileSystem.from_uri("file://" + uri.split(":", 1)[1] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                    with fs.open_input_stream(at) as f:
                        content.append(f.read())
                yield part.assign(content=content)

    return listed.mapInPandas(run, "path string, rel_path string, length long, modified long, content binary")


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, rel_path, length, modified, content of the files under root, ignored directories left out."""
    out = listing(spark, root, suffixes)
    dirs = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    never = F.array(*[F.lit(d) for d in (*HARD_IGNORED, *exclude)])
    out = out.where(~F.arrays_overlap(dirs, never))
    # A soft name counts only where the directory is no package.
    soft = F.filter(_ancestors(F.col("rel_path")), lambda d: F.element_at(F.split(d, "/"), -1).isin(*SOFT_IGNORED))
    packages = _packages(out)
    held = out.select("rel_path", F.explode(soft).alias("d"))
    bad = held.join(packages, held["d"] == packages["pkg"], "left_anti").select(F.col("rel_path").alias("bad")).distinct()
    return with_content(out.join(bad, out["rel_path"] == bad["bad"], "left_anti"))


def _ancestors(rel_path):
    """Directories above a file, from the outermost."""
    parts = F.split(rel_path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _packages(found: DataFrame) -> DataFrame:
    return found.where(F.col("rel_path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("rel_path", r"/?__init__\.py$", "").alias("pkg")).distinct()


def modules(found: DataFrame, root_name: str = "", roots: tuple[str, ...] = (), max_modules: int = MAX_MODULES) -> DataFrame:
    """qualname, rel_path, is_package, content of files. A package root is a directory with __init__.py whose parent has
    none, or one of roots; the outermost that holds a file names it. Other files are left out, except tests, which are named from the scan root. Two files of one name, or more than
    max_modules (0: no bound), are refused."""
    packages = _packages(found)
    if roots:
        packages = packages.unionByName(found.sparkSession.createDataFrame([(r.strip("/"),) for r in roots], "pkg string")).distinct()
    parent = packages.withColumn("up", F.when(F.col("pkg").contains("/"), F.regexp_replace("pkg", "/[^/]+$", "")).when(F.col("pkg") != "", F.lit("")))
    known = packages.select(F.col("pkg").alias("known"))
    tops = parent.join(known, parent["up"] == known["known"], "left_anti").select(F.col("pkg").alias("top"))
    dirs = found.select("rel_path", F.explode(F.array_union(F.array(F.lit("")), _ancestors(F.col("rel_path")))).alias("d"))
    owner = dirs.join(tops, dirs["d"] == tops["top"]).groupBy(F.col("rel_path").alias("r")).agg(F.min_by("top", F.length("top")).alias("top"))
    j = found.join(owner, found["rel_path"] == owner["r"], "left")
    is_package = F.col("rel_path").rlike(r"(^|/)__init__\.py$")
    bare = F.regexp_replace(F.regexp_replace("rel_path", r"/?__init__\.py$", ""), r"\.py$", "")
    above = F.when(F.col("top").contains("/"), F.regexp_replace("top", "[^/]+$", "")).otherwise("")
    inside = F.substring(bare, F.length(above) + 1, F.length(bare))
    own = F.when(F.col("top") == "", F.concat_ws(".", F.lit(root_name), F.when(bare != "", bare))).otherwise(inside)
    test = is_conventional_test(F.col("rel_path")) & F.forall(F.split(bare, "/"), lambda p: p.rlike(r"^[A-Za-z_]\w*$"))
    name = F.translate(F.when(F.col("top").isNotNull(), own).when(test, bare), "/", ".")
    out = j.select(name.alias("qualname"), "rel_path", is_package.alias("is_package"), "content").where("qualname IS NOT NULL AND qualname <> ''")
    if max_modules and out.limit(max_modules + 1).count() > max_modules:
        raise ValueError(f"more than {max_modules} modules")
    twice = out.groupBy("qualname").agg(F.sort_array(F.collect_set("rel_path")).alias("p")).where(F.size("p") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['qualname']} is the name of {', '.join(twice[0]['p'])}")
    return out


def parsed(found: DataFrame) -> DataFrame:
    """qualname, rel_path, is_package and the facts of each module. Sources are dealt over all cores, as one task may read
    them all, and equal sources of a batch are parsed once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ("qualname", "rel_path", "is_package")
    facts = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratagraph.functions.pyparse import parse

        for batch in batches:
            seen: dict[tuple[bytes, bool], int] = {}
            at = [seen.setdefault((c, p), len(seen)) for c, p in zip(batch["content"].to_pylist(), batch["is_package"].to_pylist(), strict=True)]
            rows = pa.Table.from_pylist([parse(c, p) for c, p in seen], schema=facts).combine_chunks().take(pa.array(at))
            for k, name in enumerate(names):
                rows = rows.add_column(k, name, batch[name])
            yield from rows.combine_chunks().to_batches()

    dealt = found.select(*names, "content").repartition(4 * found.sparkSession.sparkContext.defaultParallelism, "qualname")
    return dealt.mapInArrow(run, "qualname string, rel_path string, is_package boolean, " + FACTS)


def refresh(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Facts of all modules, parsing only those whose content is not in cache (sha, qualname and facts); vanished ones go.
    The result has column sha and is the next cache."""
    now = found.withColumn("sha", F.sha2("content", 256))
    key = now.select(F.col("qualname").alias("q"), F.col("sha").alias("s"))
    kept = cache.join(key, (cache["qualname"] == key["q"]) & (cache["sha"] == key["s"]), "left_semi")
    have = cache.select(F.col("qualname").alias("q"), F.col("sha").alias("s"))
    new = now.join(have, (now["qualname"] == have["q"]) & (now["sha"] == have["s"]), "left_anti")
    sha = new.select(F.col("qualname").alias("q"), "sha")
    fresh = parsed(new)
    return kept.unionByName(fresh.join(sha, fresh["qualname"] == sha["q"]).drop("q"))


def synced(found: DataFrame, path: str) -> DataFrame:
    """Facts of all modules by way of the cache at path: only new and changed sources are parsed, and the cache is written anew
    if it differs. A cache of another layout is left aside."""
    from ..plans.iterate import cut

    spark = found.sparkSession
    empty = parsed(found.limit(0)).withColumn("sha", F.lit(""))
    try:
        cache = spark.read.parquet(path)
    except AnalysisException:
        cache = empty
    if sorted(cache.columns) != sorted(empty.columns):
        cache = empty
    now = cut(refresh(found, cache.select(*empty.columns)))  # read in full before the cache is overwritten
    now.write.mode("overwrite").parquet(path)
    return now.drop("sha")


def entrypoints(facts: DataFrame, scripts: list[tuple[str, str]] | None = None) -> DataFrame:
    """qualname, reason: main guard, a module named __main__, or a declared script (name, module); the first of these reasons
    that holds."""
    from ..plans.iterate import cut

    facts = cut(facts.select("qualname", "has_main_guard"))  # parsed once, not for each reason
    a = facts.where("has_main_guard").select("qualname", F.lit(1).alias("k"), F.lit("main guard").alias("reason"))
    b = facts.where("split_part(qualname, '.', -1) = '__main__'").select("qualname", F.lit(2).alias("k"), F.lit("__main__ module").alias("reason"))
    out = a.unionByName(b)
    if scripts:
        out = out.unionByName(script_modules(facts, scripts).select("qualname", F.lit(3).alias("k"), F.concat(F.lit("script "), F.col("name")).alias("reason")))
    return out.groupBy("qualname").agg(F.min_by("reason", F.struct("k", "reason")).alias("reason"))


def declared_scripts(spark: SparkSession, root: str) -> tuple[list[tuple[str, str]], list[str]]:
    """((name, module) of the scripts that the pyproject.toml files under root declare, files that could not be read)."""
    found, bad = [], []
    listed = listing(spark, root, ("pyproject.toml",)).where(F.col("rel_path").rlike("(^|/)pyproject[.]toml$"))
    never = F.array(*[F.lit(d) for d in HARD_IGNORED])
    listed = listed.where(~F.arrays_overlap(F.split("rel_path", "/"), never))
    for r in with_content(listed).select("rel_path", "content").orderBy("rel_path").collect():  # a few small files
        try:
            data = tomllib.loads(bytes(r["content"]).decode("utf-8"))
        except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
            bad.append(f"{r['rel_path']}: {e}")
            continue
        project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
        for table in (project.get("scripts"), project.get("gui-scripts"), poetry.get("scripts")):
            for name, said in (table or {}).items():
                if isinstance(said, dict):
                    said = said.get("reference") if said.get("type", "console") == "console" else None
                if isinstance(said, str) and said.split(":")[0].strip():
                    found.append((name, said.split(":")[0].strip()))
    return sorted(set(found)), bad


def script_modules(facts: DataFrame, scripts: list[tuple[str, str]]) -> DataFrame:
    """qualname, name: modules that script targets (name, module) mean. A target that is no module loses leading parts, two at
    least left, unless its first part is a name of this project."""
    s = facts.sparkSession.createDataFrame(scripts, "name string, target string")
    known = facts.select("qualname").distinct()
    tops = known.select(F.substring_index("qualname", ".", 1).alias("top")).distinct()
    s = s.join(tops, F.substring_index("target", ".", 1) == tops["top"], "left")
    parts = F.split("target", r"\.")
    least = F.when(F.col("top").isNull(), F.greatest(F.size(parts) - 2, F.lit(0))).otherwise(F.lit(0))
    s = s.select("name", F.posexplode(F.transform(F.sequence(F.lit(0), least), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))).alias("k", "q"))
    hit = s.join(known, s["q"] == known["qualname"]).groupBy("name").agg(F.min_by("qualname", "k").alias("qualname"))
    return hit.select("qualname", "name")


def docs(spark: SparkSession, root: str) -> DataFrame:
    """place, name: identifiers that the documentation under root names, by top-level directory ("." for the root's own files).
    Files of over DOC_MOST bytes and those under ignored or dot-directories are left out."""
    from ..operators.census import doc_names

    dirs = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    listed = listing(spark, root, DOC_SUFFIXES).where((F.col("length") <= DOC_MOST) & ~F.exists(dirs, lambda d: d.startswith(".") | d.isin(*HARD_IGNORED)))
    text = F.decode("content", "UTF-8")
    place = F.when(F.col("rel_path").contains("/"), F.substring_index("rel_path", "/", 1)).otherwise(".")
    return with_content(listed).select(place.alias("place"), F.explode(doc_names(text)).alias("name")).distinct()


def orphan_dirs(found: DataFrame) -> DataFrame:
    """dir: within packages the outermost directories that hold sources but no __init__.py, so contracts over packages never see
    them."""
    packages = _packages(found)
    d = found.select(F.explode(_ancestors(F.col("rel_path"))).alias("d")).distinct()
    up = F.when(F.col("d").contains("/"), F.regexp_replace("d", "/[^/]+$", "")).otherwise("")
    inside = d.join(packages, up == packages["pkg"], "left_semi")
    hidden = ~F.element_at(F.split("d", "/"), -1).rlike(r"^\.|^__pycache__$")
    return inside.where(hidden).join(packages, inside["d"] == packages["pkg"], "left_anti").select(F.col("d").alias("dir"))


def changed_files(spark: SparkSession, root: str, named: list[str], top: str | None = None) -> DataFrame:
    """path, state of files named by a caller or on standard input, relative to root: resolved, or deleted. A name that root has
    not is tried from top, the root of the repository, too. Repeats count once, in the order given."""
    rows = []
    for n in dict.fromkeys(x.strip() for x in named if x.strip()):
        at = n if os.path.isabs(n) else os.path.join(root, n)
        if not os.path.exists(at) and top and not os.path.isabs(n):
            other = os.path.realpath(os.path.join(top, n))
            at = other if os.path.exists(other) and other.startswith(os.path.realpath(root) + os.sep) else at
        rows.append((os.path.relpath(os.path.realpath(at), os.path.realpath(root)), "resolved" if os.path.exists(at) else "deleted"))
    return spark.createDataFrame(rows, "path string, state string")


def namespace_gaps(found: DataFrame, external: DataFrame) -> DataFrame:
    """node, n: external names (node) that are directories without __init__.py above scanned files."""
    packages = _packages(found)
    d = found.select("rel_path", F.explode(_ancestors(F.col("rel_path"))).alias("d"))
    d = d.join(packages, d["d"] == packages["pkg"], "left_anti").select("rel_path", F.element_at(F.split("d", "/"), -1).alias("last"))
    return d.join(external, d["last"] == external["node"]).groupBy("node").agg(F.count_distinct("rel_path").alias("n"))
