"""A scanned project and the questions that can be asked of it; each answer is a DataFrame."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavior, census, contracts, graph, resolve, rules
from ..operators import dsm as matrix
from ..sources import config, gitlog, snapshot, tree
from .iterate import cut


#: Where take() is told to write by habit; each new snapshot overwrites it.
DEFAULT_SNAPSHOT = (".stratagraph", "baseline")


def strict_baseline_problem(path: str) -> str | None:
    """Why path can't hold the baseline of a strict check, None if it can: a file that is written anew for every task would
    carry along whatever came in since."""
    parts = tuple(os.path.realpath(path.removeprefix("file://")).rstrip("/").split("/")[-2:])
    return f"{path} is overwritten by each new snapshot, so it can't hold a strict baseline" if parts == DEFAULT_SNAPSHOT else None


def _at_least(value: float, least: float, name: str) -> None:
    if value < least:
        raise ValueError(f"{name} is at least {least}")


class Project:
    """Parses the tree at root once; the graph and what rests on it are computed when first asked for."""

    def __init__(self, spark: SparkSession, root: str, rules_text: str | None = None, log: str | None = None, cache: str | None = None):
        self.spark, self.root, self.log, self.cache = spark, root, log, cache
        found = None if rules_text is not None else config.discover(root) if os.path.isdir(root) else None
        self.config = config.parse(rules_text if rules_text is not None else open(found).read() if found else "")

    @cached_property
    def files(self) -> DataFrame:
        return tree.files(self.spark, self.root, exclude=self.config.exclude)

    @cached_property
    def facts(self) -> DataFrame:
        name = os.path.basename(os.path.abspath(self.root))
        found = tree.modules(self.files, name, self.config.roots, self.config.max_modules)
        return cut(tree.parsed(found)) if self.cache is None else tree.synced(found, self.cache)

    @cached_property
    def full(self) -> tuple[DataFrame, DataFrame]:
        return resolve.module_graph(self.facts)

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(self.full[0].where("NOT external"))

    @cached_property
    def edges(self) -> DataFrame:
        e = self.full[1].where("NOT type_checking_only") if self.config.exclude_type_checking else self.full[1]
        return cut(graph.induced(e, self.nodes))

    @cached_property
    def sccs(self) -> DataFrame:
        return cut(graph.scc(self.nodes, self.edges))

    @cached_property
    def closure(self) -> DataFrame:
        return cut(graph.closure(self.edges))

    @cached_property
    def layered(self) -> DataFrame:
        return rules.assign_layers(self.nodes.withColumn("name", F.col("node")), self.config.layers).select("node", "layer")

    def cycles(self, min_size: int = 2) -> DataFrame:
        _at_least(min_size, 1, "min_size")
        return graph.cycles(self.sccs, self.edges, min_size)

    def communities(self) -> DataFrame:
        return graph.greedy_communities(self.nodes, self.edges).select("node", F.col("community").alias("grp"))

    def score(self) -> DataFrame:
        cc = self.nodes.agg(F.sum("function_count").alias("k"), F.try_divide(F.sum("cc_sum"), F.sum("function_count")).alias("m")).first()
        axis = graph.complexity_axis(F.lit(cc["m"] or 0.0), F.lit(cc["k"] or 0))
        return graph.score(self.nodes, self.edges, self.sccs, self.communities(), axis)

    def risk(self) -> DataFrame:
        return graph.edit_risk(self.nodes, self.edges, self.closure)

    def impact(self, changed: list[str], max_chains: int = 20) -> DataFrame:
        """node, dist, root, chain of the modules that rest on changed ones, the nearest first; a negative max_chains gives all."""
        if max_chains == 0:
            raise ValueError("max_chains is not 0")
        return self._chains(self._named(changed), max_chains)[0]

    def _chains(self, seeds: DataFrame, max_chains: int) -> tuple[DataFrame, DataFrame]:
        every = cut(graph.shortest_chains(self.edges, seeds, reverse=True).where("dist > 0"))
        ordered = every.orderBy("dist", "node")
        return (ordered if max_chains < 0 else ordered.limit(max_chains)), every

    def blast_radius(self, changed: list[str], max_chains: int = 20) -> dict:
        """What rests on changed modules (names or paths): changed, unresolved with hints, impacted (node), propagation_cost (their
        and the changed ones' share of all), chains, how many chains were left out, and a caveat on an empty answer."""
        known, unknown = self._resolved(changed)
        chains, every = self._chains(known, max_chains)
        impacted, n_changed = every.select("node"), known.count()
        n, total = impacted.count(), self.nodes.count()
        shown = n if max_chains < 0 else min(n, max_chains)
        caveat = "Nothing imports or calls these modules as far as sources tell; what is loaded by name at run time is not seen." if n_changed and not n else None
        return {"changed": known, "unresolved": {u: self._hints(u) for u in unknown}, "impacted": impacted, "propagation_cost": (n_changed + n) / total if total else 0.0, "chains": chains, "chains_omitted": n - shown, "caveat": caveat}

    def summary(self, top_n: int = 10) -> dict:
        """Counts of modules and of edges within and to the outside, and the top_n modules by fan-in, fan-out, rank and risk, each
        with its instability, propagation and risk, and the outside names by the modules that use them."""
        _at_least(top_n, 1, "top_n")
        e, inner = self.full[1], self.nodes.select(F.col("node").alias("k"))
        outside = e.join(inner, e["dst"] == inner["k"], "left_anti").join(inner, e["src"] == inner["k"], "left_semi")
        per = graph.degrees(self.nodes, self.edges)
        facts = graph.instability(self.nodes, self.edges).select("node", "instability")
        facts = facts.join(graph.propagation(self.nodes, self.closure).select("node", "propagation"), "node", "left").join(self.risk().select("node", "risk"), "node", "left")
        facts = cut(facts.join(per, "node").join(graph.pagerank(self.nodes, self.edges), "node", "left"))
        top = lambda by: facts.orderBy(F.desc_nulls_last(by), "node").limit(top_n).select("node", F.col(by).cast("double").alias("value"), "instability", "propagation", "risk")
        used = outside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "node").limit(top_n)
        errors = self.facts.where("has_errors").select(F.col("rel_path").alias("path"))
        return {"modules": self.nodes.count(), "internal_edges": self.edges.count(), "external_edges": outside.count(), "parse_errors": errors, "fan_in": top("fan_in"), "fan_out": top("fan_out"), "pagerank": top("rank"), "edit_risk": top("risk"), "external": used}

    def affected(self, paths: list[str], depth: int = 5, test_filter: str | None = None) -> DataFrame:
        return contracts.affected(self.nodes, self.edges, self.spark.createDataFrame([(p,) for p in paths], "path string"), depth, test_filter)

    def _resolved(self, names: list[str]) -> tuple[DataFrame, list[str]]:
        """Modules (node) by dotted name or path, and the names that are neither, in order and once each."""
        asked = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
        by = self.nodes.select("node", F.explode(F.array_compact(F.array("node", "path"))).alias("key"))
        hit = cut(asked.join(by, asked["asked"] == by["key"]).groupBy("asked").agg(F.min("node").alias("node")))
        found = {r["asked"] for r in hit.select("asked").collect()}  # of the few that were asked for
        return hit.select("node").distinct(), [n for n in dict.fromkeys(names) if n not in found]

    def _hints(self, name: str) -> list[str]:
        return contracts.path_hints(self.nodes, name) or contracts.near_names(self.nodes, name)

    def _named(self, names: list[str]) -> DataFrame:
        """Modules by dotted name or path; one that is neither is refused with the names near it."""
        known, unknown = self._resolved(names)
        if unknown:
            raise ValueError(f"no module {unknown[0]!r}; near: {', '.join(self._hints(unknown[0])) or 'none'}")
        return known

    def graph(self, max_nodes: int = 500, form: str = "frames", internal_only: bool = False):
        """Modules and edges, as frames or as lines (value) of json, dot or text; more than max_nodes modules are refused."""
        forms = {"json": snapshot.graph_json, "dot": lambda _, e: snapshot.graph_dot(e), "text": lambda _, e: snapshot.graph_text(e), "frames": lambda m, e: (m, e)}
        if form not in forms:
            raise ValueError(f"form is one of {', '.join(sorted(forms))}")
        parts = (self.nodes, self.edges) if internal_only else self.full
        n = parts[0].count()
        if n > max_nodes:
            raise ValueError(f"{n} nodes are more than {max_nodes}")
        return forms[form](*parts)

    def dsm(self, group_by: str = "community", weight: str = "imports") -> tuple[DataFrame, DataFrame]:
        grp = {"community": self.communities, "layer": lambda: self.layered.withColumnRenamed("layer", "grp"), "topological": lambda: matrix.topological_groups(self.sccs)}
        if group_by not in grp:
            raise ValueError("group_by is community, layer or topological")
        return matrix.dsm(grp[group_by](), self.edges, weight if weight == "imports" else "call_count")

    def check(self) -> dict:
        """Findings of all rules as frames, and whether they pass. A pattern that can never match is refused."""
        c = self.config
        named = [p for ps in c.layers.values() for p in ps] + [r[k] for r in c.required for k in ("source", "must_reach")]
        for pattern, instead in rules.unmatchable(self.full[0], named):
            raise ValueError(f"{pattern!r} reaches into a package from outside, of which only the first name is kept; use {instead!r}")
        pairs = self.spark.createDataFrame(c.forbid, "from_layer string, to_layer string")
        found = {"violations": rules.violations(self.edges, self.layered, pairs)}
        augmented = self.edges.select("src", "dst").unionByName(graph.init_edges(self.nodes)).distinct()
        reach = [
            rules.required_reach(augmented, contracts.matching(contracts.matching(self.nodes, [r["source"]]), [r.get("within") or "**"]), contracts.matching(self.full[0], [r["must_reach"]])).select(F.lit(r["source"]).alias("source"), F.lit(r.get("within") or "").alias("within"), F.lit(r["must_reach"]).alias("must_reach"), F.col("node").alias("module"))
            for r in c.required
        ]
        for r in reach:
            found["reach"] = found["reach"].unionByName(r) if "reach" in found else r
        if c.sdp_mode != "off":
            found["sdp"] = rules.sdp_violations(self.nodes, self.edges, c.sdp_tolerance)
        counts = {k: df.count() for k, df in found.items() if k != "sdp" or c.sdp_mode == "error"}
        if c.min_layers:
            present = self.layered.where("layer IS NOT NULL").agg(F.count_distinct("layer").alias("n")).first()["n"]
            counts["presence"] = max(0, c.min_layers - present)
        verdict = rules.gate(**counts)
        return found | verdict | {"verified": bool(c.forbid or c.required)}

    def coverage(self) -> dict:
        """How much the rules see: counts (modules, layered, ruled, edges, governed, external_governed, coverage, outside),
        modules in no layer, patterns that name one module only, and whether a clean check of direct edges proves the rules."""
        scoped = cut(rules.in_scope(self.layered, self.config.governed()))
        inside = scoped.where("NOT outside").drop("outside")
        other = rules.assign_layers(self.full[0].where("external").withColumn("name", F.col("node")), self.config.layers).select("node", "layer")
        pairs = self.spark.createDataFrame(self.config.forbid, "from_layer string, to_layer string")
        n = rules.coverage(self.full[1], inside, pairs, other).first().asDict() | {"outside": scoped.where("outside").count()}
        hints = rules.exact_pattern_hints(inside, self.config.layers)
        bare = inside.where("layer IS NULL").select("node")
        unproven = bool(self.config.forbid) and (n["layered"] < n["modules"] or n["governed"] < n["edges"])
        return n | {"unlayered": bare, "hints": hints, "unproven": unproven}

    def snapshot(self) -> dict[str, DataFrame]:
        """The parts of a snapshot (see sources.snapshot.KEYS) of the project as it is."""
        found = self.check()
        keyed = self.cycles(1).select(F.array_join("members", ",").alias("members"))
        empty = lambda ddl: self.spark.createDataFrame([], ddl)
        return {
            "cycles": keyed,
            "violations": found["violations"],
            "reach": found.get("reach", empty("source string, within string, must_reach string, module string")),
            "sdp": found.get("sdp", empty("src string, dst string, src_i double, dst_i double")),
            "modules": self.nodes.select("node", "path"),
            "rules": self.spark.createDataFrame(config.fingerprint(self.config), "kind string, rule string"),
        }

    def take(self, path: str, findings_only: bool = False) -> None:
        """Writes the snapshot and the score to path."""
        score = None if findings_only else {k: v for k, v in self.score().first().asDict().items()}
        snapshot.take(path, self.snapshot(), score, findings_only)

    def diff(self, path: str, top_n: int = 10) -> dict:
        """What changed since the snapshot at path: a set difference for each part, the change of each score where both have one,
        and the riskiest regressions and improvements."""
        before = snapshot.load(self.spark, path)
        if before is None:
            raise ValueError(f"no snapshot at {path}; take one first")
        now, diffs = self.snapshot(), {}
        for kind in ("cycles", "violations", "sdp", "reach"):
            old = before[kind] if kind in before else now[kind].limit(0)
            diffs[kind] = rules.reach_diff(old, now[kind]) if kind == "reach" else rules.set_diff(old, now[kind], list(snapshot.KEYS[kind]))
        if before["meta"].get("findings_only"):
            del diffs["sdp"]
        was, moved = before["meta"].get("score"), {}
        if was:
            score = self.score().first().asDict()
            moved = {k: score[k] - was[k] for k in ("overall", "modularity", "acyclicity", "depth", "equality", "complexity")}
        items = contracts.diff_items({k: d.withColumn("members", F.split("members", ",")) if k == "cycles" else d for k, d in diffs.items()})
        parts = {k: v for k, v in moved.items() if k != "overall"}
        counts = {k: (n.get("added", 0), n.get("resolved", 0)) for k, n in ((k, {r["change"]: r["count"] for r in d.groupBy("change").count().collect()}) for k, d in diffs.items())}
        violated = tuple(sum(counts[k][i] for k in ("violations", "sdp", "reach") if k in counts) for i in (0, 1))
        line = contracts.headline({"cycles": counts["cycles"], "violations": violated}, moved)
        return diffs | {"headline": line, "score": moved, "regressions": contracts.diff_summary(items, self.risk(), parts, top_n, "added"), "improvements": contracts.diff_summary(items, self.risk(), parts, top_n, "resolved")}

    def strict(self, path: str) -> dict:
        """Whether cycles, violations or weaker rules are new against the snapshot at path: refused (why no verdict is possible, or
        None), passed, cycles (members, closing edges), violations, weakened rules, and how many findings were carried."""
        problem = strict_baseline_problem(path)
        before = None if problem else snapshot.load(self.spark, path)
        if before is None or "modules" not in before:
            return {"refused": problem or f"no snapshot with modules at {path}", "passed": False}
        now, text = self.snapshot(), "src string, dst string, from_layer string, to_layer string"
        old_v = before["violations"] if "violations" in before else self.spark.createDataFrame([], text)
        pairs = self.spark.createDataFrame(self.config.forbid, "from_layer string, to_layer string")
        if not old_v.isEmpty():
            dropped = rules.ungoverned(old_v, self.nodes, self.layered, pairs).count()
            if dropped:
                return {"refused": f"the rules no longer cover {dropped} violations of the snapshot whose modules still exist", "passed": False}
        listed = before["cycles"].select(F.split("members", ",").alias("m")) if "cycles" in before else self.spark.createDataFrame([], "m array<string>")
        base = cut(listed.select(F.element_at("m", 1).alias("scc"), F.explode("m").alias("node")))
        cyclic = cut(self.sccs.where("cyclic").select("scc", "node"))
        known = before["modules"].select("node")
        # A baseline names members, not edges; the self-loops it had are its cycles of one.
        loops = listed.where(F.size("m") == 1).select(F.element_at("m", 1).alias("node"))
        judged = cut(rules.ratchet_cycles(base, cyclic, known, loops))
        fresh = judged.where("NOT carried").select(F.col("scc").alias("f"))
        new = cyclic.join(fresh, cyclic["scc"] == fresh["f"], "left_semi")
        closing = rules.closing_edges(new, self.edges, base, loops.select(F.col("node").alias("src"), F.col("node").alias("dst")))
        kept = rules.ratchet_violations(old_v, now["violations"])
        have = before["rules"] if "rules" in before else None
        recorded = None if have is None else [(r["kind"], r["rule"]) for r in have.collect()]  # one row a rule
        weaker = None if recorded is None else self.spark.createDataFrame(config.weakened_since(recorded, self.config), "kind string, rule string")
        out = {"refused": None, "cycles": new.groupBy("scc").agg(F.sort_array(F.collect_list("node")).alias("members")), "closing": closing, "violations": kept.where("NOT carried").drop("carried"), "weakened": weaker, "carried_cycles": judged.where("carried").count(), "carried_violations": kept.where("carried").count()}
        out["hint"] = None if have is not None else "the snapshot records no rules, so weaker rules go unseen; take it anew"
        out["passed"] = out["cycles"].isEmpty() and out["violations"].isEmpty() and (weaker is None or weaker.isEmpty())
        return out

    def changes(self, since: str | None = None) -> DataFrame:
        """commit_id, file of Python files under their last names."""
        if self.log is None:
            raise ValueError("no log was given; write one with gitlog.export")
        log = gitlog.python_changes(gitlog.commits(self.spark, self.log))
        return behavior.fold_renames(log, gitlog.renames(log)).select("commit_id", F.col("path").alias("file")).distinct()

    def hotspots(self, top_n: int | None = 20) -> DataFrame:
        """The top_n files that are both complex and often changed; None gives all, in no order."""
        _at_least(1 if top_n is None else top_n, 1, "top_n")
        n = behavior.file_counts(self.changes()).select(F.col("file").alias("f"), F.col("n").alias("churn"))
        j = self.nodes.join(n, self.nodes["path"] == n["f"]).select(F.col("node").alias("module"), "cc_sum", "churn")
        return behavior.hotspots(j, top_n)

    def coupling(self, min_support: int = 5, min_confidence: float = 0.5, max_files: int = 30) -> DataFrame:
        paths = self.nodes.select(F.col("node").alias("m"), "path")
        # The cap on sweeping commits counts all their files, so it comes before the join to modules.
        c = behavior.capped(self.changes(), max_files)
        c = c.join(paths, c["file"] == paths["path"]).select("commit_id", F.col("m").alias("file"))
        return behavior.coupling(c, self.edges, min_support, min_confidence, max_files).orderBy(F.desc("confidence"), F.desc("support"), "a", "b")

    def refactor(self, min_risk: float = 0.15) -> DataFrame:
        return behavior.rationale(behavior.refactor_priorities(self.hotspots(None), self.risk(), min_risk)).orderBy(F.desc("priority"), F.desc("risk"), F.desc("hotspot"), "module")

    @cached_property
    def functions(self) -> DataFrame:
        f = self.facts.select(F.col("qualname").alias("module"), F.col("rel_path").alias("path"), F.explode("functions").alias("f"))
        return f.select(F.concat_ws(":", "path", "f.line").alias("fn_id"), "module", "path", "f.*")

    def duplicates(self, min_size: int = 30, min_members: int = 2) -> DataFrame:
        _at_least(min_size, 1, "min_size")
        return behavior.variant(behavior.exact_clusters(self.functions, min_size, min_members)).orderBy(F.desc("redundancy"), F.desc("size"), F.desc("members"), "shape_hash")

    def near_duplicates(self, threshold: float = 0.85, min_size: int = 30) -> DataFrame:
        bags = self.functions.select(F.col("fn_id").alias("id"), F.explode("tokens").alias("token", "n"))
        return behavior.near_miss(self.functions, bags, threshold, min_size)

    def simulate(self, add: list[tuple[str, str]], remove: list[tuple[str, str]]) -> dict:
        """The graph after a delta: outcome of each part and how much was answered, hints for ends that are no modules, diff of
        edges, new cycles and back edges, changes of violations and propagation. Ends are names or paths."""
        ends = {n for pair in (*add, *remove) for n in pair}
        paths = {r["path"]: r["node"] for r in self.nodes.where(F.col("path").isin(*ends)).select("path", "node").collect()} if ends else {}
        frame = lambda x: self.spark.createDataFrame([tuple(paths.get(n, n) for n in pair) for pair in x], "src string, dst string")
        known = lambda x: graph.induced(frame(x), self.nodes)
        if not add and not remove:
            raise ValueError("a delta adds or removes at least one edge")
        applied = self.edges.select("src", "dst", "call_count") if known([*add, *remove]).isEmpty() else rules.simulate(self.edges, known(add), known(remove))
        after, pairs = cut(applied), self.spark.createDataFrame(self.config.forbid, "from_layer string, to_layer string")
        sccs = cut(graph.scc(self.nodes, after))
        mean = lambda e: graph.propagation(self.nodes, graph.closure(e)).agg(F.avg("propagation")).first()[0]
        keyed = lambda c: c.select(F.array_join("members", ",").alias("members"))
        return {
            "outcomes": (outcomes := cut(rules.classify_delta(self.edges, self.nodes, frame(add), frame(remove)))),
            "coverage": rules.delta_coverage(outcomes).first().asDict(),
            "unresolved": {n: self._hints(n) for n in self._resolved(sorted(ends))[1]},
            "violations": rules.set_diff(rules.violations(self.edges, self.layered, pairs), rules.violations(after, self.layered, pairs), list(snapshot.KEYS["violations"])),
            "edges": rules.set_diff(self.edges, after, ["src", "dst"]),
            "cycles": rules.set_diff(keyed(self.cycles()), keyed(graph.cycles(sccs, after)), ["members"]),
            "back_edges": rules.set_diff(rules.back_edges(self.edges, self.sccs), rules.back_edges(after, sccs), ["src", "dst"]).where("change = 'added'"),
            "propagation_delta": mean(after) - mean(self.edges),
        }

    def conventions(self, top_n: int = 10, include_tests: bool = False) -> dict:
        """What a project repeats by habit, each part as its first top_n rows and how many there are in all: naming and base
        families, shared constants, registries, helpers, mirrored classes, consumers, gates and errors, gaps in documentation
        and in what is exported, and how modules were set apart."""
        _at_least(top_n, 1, "top_n")
        roots = cut(census.shadow_roots(self.nodes))
        parts = self.facts.join(roots, (F.col("qualname") == roots["root"]) | F.startswith(F.col("qualname"), F.concat(roots["root"], F.lit("."))), "left")
        kind = census.partition_of(F.col("qualname"), F.col("root").isNotNull())
        marked = cut(parts.withColumn("kind", kind).drop("root").dropDuplicates(["qualname"]))
        f = marked.where(F.col("kind").isin(*(("censused", "test") if include_tests else ("censused",)))).drop("kind")
        cls = contracts.classes(f)
        fns = f.select(F.col("qualname").alias("module"), F.explode("functions").alias("f")).select("module", "f.name")
        assigned = f.select(F.col("qualname").alias("module"), F.explode("assigned").alias("a")).where("a.ctor IS NOT NULL").select("module", "a.ctor", "a.name")
        bases = cls.select(F.col("name").alias("cls"), F.explode("bases").alias("b")).select("cls", F.element_at(F.split("b", r"\."), -1).alias("base"))
        local = bases.join(cls.select(F.col("name").alias("own")).distinct(), F.col("base") == F.col("own"), "left_semi")
        lineage = graph.closure(local.select(F.col("base").alias("src"), F.col("cls").alias("dst")).where("src <> dst"))
        members = cut(lineage.select(F.col("src").alias("grp"), F.col("dst").alias("name")).unionByName(lineage.select(F.col("src").alias("grp"), F.col("src").alias("name"))).distinct())
        exported = f.select(F.col("qualname").alias("place"), F.explode("assigned").alias("a")).where("a.name = '__all__'").select("place", F.explode("a.listed").alias("name"))
        defined = cls.select("module", "name").unionByName(fns)
        used = f.select(F.col("qualname").alias("importer"), F.explode("imports").alias("i")).select("importer", F.col("i.module").alias("source"), F.explode("i.names").alias("x")).select("importer", "source", F.col("x.name").alias("name"))
        homes = defined.groupBy(F.col("name").alias("d")).agg(F.collect_set("module").alias("in"))
        at = used.join(homes, used["name"] == homes["d"]).withColumn("home", F.when(F.array_contains("in", F.col("source")), F.col("source")).when(F.size("in") == 1, F.get("in", F.lit(0))))
        gates = f.select(F.col("qualname").alias("module"), F.explode("gates").alias("g")).select("module", "g.*")
        parts = {
            "naming": census.families(cls.select(census.camel_suffix(F.col("name")).alias("family"), "module")).orderBy(F.desc("members"), "family"),
            "bases": members.groupBy("grp").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "grp"),
            "constants": contracts.shared_constants(f).orderBy(F.desc("n"), "name"),
            "registries": census.registries(assigned).orderBy(F.desc("entries"), "ctor"),
            "helpers": census.helper_families(fns).orderBy(F.desc(F.size("surfaces")), "module", "stem"),
            "mirrored": census.mirrored_families(cls.select("module", "name")).orderBy(F.desc(F.size("surfaces")), "name"),
            "consumers": census.consumers(at.where("home IS NOT NULL AND home <> importer").select("home", "name", "importer")).orderBy(F.desc("importers"), "home", "name"),
            "gates": gates.where("category = 'gate'").orderBy("module", "function", "kind", "control"),
            "errors": gates.where("category = 'error'").orderBy("module", "function", "kind", "control"),
            "export_gaps": census.coverage_gaps(members, exported).orderBy(F.desc(F.size("missing")), "place", "grp"),
            "doc_gaps": census.doc_gaps(members, tree.docs(self.spark, self.root)).orderBy(F.desc(F.size("missing")), "place", "grp"),
        }
        held = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}
        return {k: {"rows": df.limit(top_n), "total": df.count()} for k, df in parts.items()} | {"partition": held}

    def brief(self) -> dict:
        """What holds in this project: layers, rules, whether it is acyclic, and its riskiest modules."""
        return {"layers": self.config.layers, "forbid": self.config.forbid, "required": self.config.required, "acyclic": self.cycles().isEmpty(), "risks": [tuple(r) for r in contracts.top_risks(self.risk()).select("node", F.round("risk", 6)).collect()]}
