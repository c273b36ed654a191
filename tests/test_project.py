"""Source trees, resolution, rules and the project as a whole, on tiny trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import pyparse
from stratagraph.functions.globs import covers, dotted_glob, file_glob
from stratagraph.operators import contracts
from stratagraph.plans.project import Project
from stratagraph.sources import config, gitlog, history, snapshot, tree

TREE = {
    "src/app/__init__.py": "from .core import run\n",
    "src/app/core.py": "from app.util import helper\nimport os.path\nfrom . import store as st\n\ndef run(x):\n    if x and helper():\n        return st.load(x)\n    return os.path.join('a')\n",
    "src/app/util.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from app.core import run\n\ndef helper():\n    from app import store\n    return store.load(1)\n",
    "src/app/store/__init__.py": "from .disk import load\n__all__ = ['load', 'gone']\n",
    "src/app/store/disk.py": "import app.util\n\nclass Base: pass\n\nclass Disk(Base):\n    KIND = 'disk'\n\nclass Ram(Disk):\n    KIND = 'ram'\n\ndef load(x):\n    raise KeyError(x)\n",
    "src/app/broken.py": "from app import core\ndef (:\n",
    "src/app/build/out.py": "x = 1\n",
    "tests/test_core.py": "from app import run\n\ndef test_it():\n    run(1)\n\nif __name__ == '__main__':\n    test_it()\n",
    "scripts/tool.py": "import app\n",
    "node_modules/x.py": "import app\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    log = root / "log.txt"
    log.write_text("".join(f"\x1e{k:040d}\t2024-01-0{k % 9 + 1}T00:00:00+00:00\n\nM\tsrc/app/core.py\nM\tsrc/app/util.py\n" for k in range(6)) + "\x1e" + "f" * 40 + "\t2024-02-01T00:00:00+00:00\n\nR090\tsrc/app/old.py\tsrc/app/util.py\n\x1e" + "e" * 40 + "\t2023-02-01T00:00:00+00:00\n\nA\tsrc/app/old.py\n")
    return Project(spark, str(root), "layers: {top: [app.core], low: ['app.store.**', app.util]}\nforbid: [{from: low, to: top}]\nrequired: [{source: app.core, must_reach: app.store.disk}, {source: app.none, must_reach: app.core}]\n", str(log))


def test_names(project):
    got = {r.qualname for r in project.facts.collect()}
    assert got == {"app", "app.core", "app.util", "app.store", "app.store.disk", "app.broken", "tests.test_core"}


def test_edges(project):
    got = {(r.src, r.dst): r for r in project.full[1].collect()}
    assert set(got) == {("app", "app.core"), ("app.core", "app.util"), ("app.core", "os"), ("app.core", "app.store"), ("app.core", "app.store.disk"), ("app.util", "typing"), ("app.util", "app.core"), ("app.util", "app.store"), ("app.store", "app.store.disk"), ("app.store.disk", "app.util"), ("app.broken", "app.core"), ("tests.test_core", "app.core")} - {("app.core", "app.store.disk")}
    assert got["app", "app.core"].is_relative and got["app.util", "app.core"].type_checking_only and not got["app.core", "app.util"].type_checking_only
    assert got["app.core", "app.util"].call_count == 1 and got["app.core", "os"].call_count == 1 and got["app.core", "app.store"].call_count == 1
    assert {r.node for r in project.full[0].where("external").collect()} == {"os", "typing"}


def test_facts(project):
    facts = {r.qualname: r for r in project.facts.collect()}
    assert facts["app.broken"].has_errors and facts["tests.test_core"].has_main_guard
    assert facts["app.core"].functions[0].cyclomatic == 3
    assert {r.qualname: r.reason for r in tree.entrypoints(project.facts, [("go", "app.core")]).collect()} == {"tests.test_core": "main guard", "app.core": "script go"}


def test_cycles_score_and_impact(project):
    assert [r.members for r in project.cycles().collect()] == [["app.core", "app.store", "app.store.disk", "app.util"]]
    s = project.score().first()
    assert 0 < s.overall < 1 and s.acyclicity == pytest.approx(1 - 4 / 7)
    assert {r.node: r.chain for r in project.impact(["src/app/store/disk.py"]).collect()}["app.store"] == ["app.store.disk", "app.store"]
    with pytest.raises(ValueError, match="near: .*app.util"):
        project.impact(["app.utils"])
    with pytest.raises(ValueError, match="near: src/app/util.py"):
        project.impact(["src/app/utils.py"])
    r = project.blast_radius(["app.store.disk", "src/app/nothing.py", "src/app/utils.py"], max_chains=2)
    assert r["chains"].count() == 2 and r["chains_omitted"] == r["impacted"].count() - 2 and r["unresolved"] == {"src/app/nothing.py": [], "src/app/utils.py": ["src/app/util.py"]}
    assert r["propagation_cost"] == pytest.approx((1 + r["impacted"].count()) / 7) and r["caveat"] is None
    assert "run time" in project.blast_radius(["tests.test_core"])["caveat"]
    top = project.summary(2)
    assert (top["modules"], top["internal_edges"], top["external_edges"]) == (7, 9, 2)
    assert [r.node for r in top["fan_in"].collect()] == ["app.core", "app.store"] or top["fan_in"].first().value >= 2
    assert [(r.node, r.value) for r in top["external"].collect()] == [("os", 1), ("typing", 1)] and top["parse_errors"].first().path.endswith("broken.py")
    assert {r.node for r in project.affected(["src/app/util.py"]).where("test").collect()} == {"tests.test_core"}
    with pytest.raises(ValueError):
        project.affected(["src/app/util.py"], test_filter="nothing/**")


def test_check(project):
    c = project.check()
    assert not c["passed"] and c["failed"] == ["reach", "violations"] and "sdp" not in c
    assert [(r.src, r.dst) for r in c["violations"].collect()] == [("app.util", "app.core")]
    assert [(r.source, r.module) for r in c["reach"].collect()] == [("app.none", None)]


def test_history_of_changes(project):
    assert {(r.module, r.churn) for r in project.hotspots().collect()} == {("app.core", 6), ("app.util", 8)}
    assert project.coupling(min_support=5).count() == 0  # an edge joins the two
    assert {r.why.split(" (")[0] for r in project.refactor().collect()} <= {"complex and often changed", "central and unstable", "Below both bounds; ranked by what little there is."} and project.refactor().count() > 0


def test_simulate_equals_an_edit(project):
    out = project.simulate([("app.store.disk", "app.core")], [("app.util", "app.core")])
    assert {(r.op, r.outcome) for r in out["outcomes"].collect()} == {("add", "applied"), ("remove", "applied")}
    assert {(r.src, r.change) for r in out["edges"].collect()} == {("app.store.disk", "added"), ("app.util", "resolved")}
    assert out["coverage"]["coverage"] == "complete" and [(r.src, r.change) for r in out["violations"].collect()] == [("app.store.disk", "added"), ("app.util", "resolved")] or out["violations"].count() == 2
    with pytest.raises(ValueError):
        project.simulate([], [])
    part = project.simulate([("app.nope", "app.core"), ("src/app/util.py", "app.core")], [])
    assert part["coverage"] == {"applied": 0, "no_op": 1, "rejected": 0, "skipped": 1, "coverage": "partial"} and list(part["unresolved"]) == ["app.nope"]
    none = project.simulate([("app.nope", "app.core")], [])
    assert none["coverage"]["coverage"] == "none" and none["edges"].count() == 0
    both = project.simulate([("app.broken", "app.util")], [("app.broken", "app.util")])
    assert both["coverage"]["rejected"] == 2 and both["edges"].count() == 0


def test_census(project):
    f = project.facts
    assert contracts.model_census(f, "Base").first().models == 2
    assert [(r.name, r.distribution) for r in contracts.shared_constants(f).collect()] == [("KIND", "'disk'=1,'ram'=1")]
    assert [(r.module, r.missing) for r in contracts.export_gaps(f).collect()] == [("app.store", ["gone"])]
    assert [(r.error, r.places) for r in contracts.errors_census(f).collect()] == [("KeyError", 1)]
    assert contracts.module_view(project.nodes, project.edges, "app.store").first().imported_by == ["app.core", "app.util"]
    assert contracts.hint_coverage(f).first().coverage == 0.0


def test_contracts(project):
    n, e = project.nodes, project.edges
    assert [tuple(r.chain) for r in contracts.forbidden(n, e, ["tests.**"], ["app.store.disk"]).collect()][0][0] == "tests.test_core"
    assert contracts.independent(n, e, [["app.broken"], ["tests.**"]]).count() == 0
    assert {(r.src, r.dst) for r in contracts.protected(n, e, ["app.store.**"], ["app.core"]).collect()} == {("app.util", "app.store")}
    assert [r.members for r in contracts.sibling_cycles(n, e, "app").collect()] == [["core", "store", "util"]]
    assert contracts.matched_nothing(n, ["app.**", "none.*"]) == ["none.*"]


def test_cached_facts_equal_cold_ones(project):
    found = tree.modules(project.files, "x")
    cache = tree.refresh(found, tree.refresh(found, project.facts.limit(0).withColumn("sha", F.lit(""))).where("qualname <> 'app.core'"))
    cold = {r.qualname: (r.imports, len(r.calls)) for r in project.facts.collect()}
    assert {r.qualname: (r.imports, len(r.calls)) for r in cache.collect()} == cold


def test_colliding_names_are_refused(spark, tmp_path):
    for p in ("a/pkg/__init__.py", "b/pkg/__init__.py"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_text("")
    with pytest.raises(ValueError, match="pkg is the name of"):
        tree.modules(tree.files(spark, str(tmp_path)))


def test_shapes():
    f = lambda src: pyparse.parse(src.encode())["functions"][0]
    a, b, c = f("def f(a):\n    return a + 1"), f("def g(zz):\n    return zz + 2"), f("def f(a):\n    return a - 1")
    assert a["shape_hash"] == b["shape_hash"] != c["shape_hash"] and a["concrete_hash"] != b["concrete_hash"]
    cc = lambda body: f("def f(x):\n    " + body)["cyclomatic"]
    assert [cc("return x"), cc("return x and x and x"), cc("return [y for y in x if y]"), cc("return 1 if x else 2"), cc("assert x")] == [1, 3, 3, 2, 1]
    guard = lambda s: pyparse.parse(s.encode())["has_main_guard"]
    assert guard("if __name__ == '__main__' and x: pass") and not guard("if __name__ == '__main__' or x: pass") and not guard("def f():\n  if __name__ == '__main__': pass")


def test_globs():
    import re

    m = lambda p, s: bool(re.match(dotted_glob(p), s))
    assert m("a.*", "a.b") and not m("a.*", "a.b.c") and m("a.**", "a") and m("a.**", "a.b.c") and m("**.x", "x") and m("**.x", "a.b.x") and not m("a.**", "ab")
    g = lambda p, s: bool(re.match(file_glob(p), s))
    assert g("**.py", "a.py") and not g("**.py", "a/b.py") and g("a/**", "a/b/c.py") and not g("a/**b", "a/x/b") and g("a/**/b", "a/b") and g("a/?.py", "a/b.py")
    assert g("**/t_*.py", "t_a.py") and g("**/t_*.py", "a/b/t_x.py") and not g("*.py", "a/b.py") and g("a+b.py", "a+b.py")
    assert covers("a.**", "a.b.*") and not covers("a.*", "a.**")


def test_configuration():
    with pytest.raises(ValueError, match="did you mean 'layers'"):
        config.parse("layer: {}")
    with pytest.raises(ValueError, match="no layer"):
        config.parse("forbid: [{from: a, to: b}]")
    assert config.parse("sdp: {tolerance: 0.1}").sdp_mode == "off" and config.parse("sdp: {enabled: true}").sdp_mode == "error"
    assert config.parse("layers: {x: [a]}\nmin_layers_present: 1\nexclude_type_checking_imports: true").exclude_type_checking
    for bad in ("sdp: {mode: never}", "exclude: [a/b]", "layers: {x: [a]}\nmin_layers_present: 2", "sdp: {enabled: 1}"):
        with pytest.raises(ValueError):
            config.parse(bad)
    a = config.parse("layers: {x: [a.**], y: [b]}\nforbid: [{from: x, to: y}]")
    b = config.parse("layers: {x: [a.b], y: [b]}\nexclude: [gen]")
    assert config.weakened(a, b) == [("exclude", "gen"), ("forbid", "x -> y"), ("layer", "x: a.**")] and config.weakened(a, a) == []
    assert config.weakened_since(config.fingerprint(a), b) == config.weakened(a, b) and config.weakened_since(config.fingerprint(a), a) == []
    wider = config.parse("layers: {x: [a.**], y: [b, 'b.**']}\nforbid: [{from: x, to: y}]")
    assert config.weakened_since(config.fingerprint(a), wider) == []
    assert a.governed() == {"a", "b"}


def test_history_log(spark, tmp_path):
    good = '{"timestamp": "2024-01-0%d", "overall": %s, "modularity": 1, "acyclicity": 1, "depth": 1, "equality": 1, "module_count": %s, "edge_count": 1, "cycle_count": 0, "max_depth": 2, "community_count": 1}'
    (tmp_path / "h.jsonl").write_text("\n".join([good % (1, "0.5", "3"), "not json", good % (2, '"x"', "3"), good % (3, "0.7", "3.0"), good % (4, "0.7", "3.5")]))
    rows = history.read(spark, str(tmp_path / "h.jsonl")).orderBy("timestamp").collect()
    assert [(r.overall, r.module_count, r.complexity, r.tangle_ratio) for r in rows] == [(0.5, 3, None, 0.0), (0.7, 3, None, 0.0)]
    history.append(spark.createDataFrame(rows, history.read(spark, str(tmp_path / "h.jsonl")).schema), str(tmp_path / "out"))
    assert history.read(spark, str(tmp_path / "out")).count() == 2


def test_gate_stream(spark, tmp_path):
    from stratagraph.streaming.gate import gate_stream

    src = tmp_path / "in"
    src.mkdir()
    line = '{"timestamp": "2024-01-0%d", "overall": %s, "modularity": 1, "acyclicity": 1, "depth": 1, "equality": 1, "module_count": 3, "edge_count": 1, "cycle_count": 0, "max_depth": 2, "community_count": 1}\n'
    for k, v in ((1, 0.5), (2, 0.4)):
        (src / f"{k}.json").write_text(line % (k, v))
        gate_stream(history.read_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/rows")).orderBy("timestamp").collect()
    assert [(r.delta if r.delta is None else round(r.delta, 6), r.passed) for r in got] == [(None, True), (-0.1, False)]


def test_snapshots(project, tmp_path):
    at = str(tmp_path / "snap")
    assert snapshot.load(project.spark, at) is None
    snapshot.take(at, {"cycles": project.cycles(), "modules": project.nodes.select("node", "path")}, {"overall": 0.5}, findings_only=True)
    got = snapshot.load(project.spark, at)
    assert got["modules"].columns == ["node"] and "score" not in got["meta"] and got["cycles"].count() == 1
    assert 'a" -> "b' not in snapshot.graph_dot(project.edges).first().value and snapshot.graph_json(*project.full).count() > 7


def test_git_log(spark, project):
    log = gitlog.commits(spark, project.log)
    assert log.count() == 14 and {tuple(r) for r in gitlog.renames(log).collect()} == {("src/app/old.py", "src/app/util.py")}


def test_diff_against_a_snapshot(project, tmp_path):
    at = str(tmp_path / "base")
    project.take(at)
    d = project.diff(at)
    assert all(d[k].count() == 0 for k in ("cycles", "violations", "sdp", "reach")) and set(d["score"].values()) == {0.0}
    ok = project.strict(at)
    assert ok["passed"] and ok["refused"] is None and (ok["carried_cycles"], ok["carried_violations"]) == (1, 1)
    assert "overwritten" in project.strict(str(tmp_path / ".stratagraph/baseline"))["refused"]
    assert "no snapshot" in project.strict(str(tmp_path / "none"))["refused"]
    with pytest.raises(ValueError, match="no snapshot"):
        project.diff(str(tmp_path / "none"))


@pytest.fixture(scope="module")
def later(spark, project, tmp_path_factory):
    """The tree with a new import that closes a cycle through a module that was in none, and a rule that is gone."""
    root = tmp_path_factory.mktemp("later")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text + ("import app.broken2\n" if name == "src/app/core.py" else ""))
    (root / "src/app/broken2.py").write_text("import app.core\n")
    return root


RULES = "layers: {top: [app.core], low: ['app.store.**', app.util]}\nforbid: [{from: low, to: top}]\nrequired: [{source: app.core, must_reach: app.store.disk}, {source: app.none, must_reach: app.core}]\n"


def test_strict_finds_what_is_new(spark, project, later, tmp_path):
    at = str(tmp_path / "base")
    project.take(at, findings_only=True)
    grown = Project(spark, str(later), RULES).strict(at)
    # A module that the baseline never saw joined a carried cycle: carried, as all members that were known were in one cycle.
    assert grown["passed"] and grown["carried_cycles"] == 1
    weaker = Project(spark, str(later), RULES.replace("{source: app.core, must_reach: app.store.disk}, ", "")).strict(at)
    assert not weaker["passed"] and [r.kind for r in weaker["weakened"].collect()] == ["required"]
    gone = Project(spark, str(later), RULES.replace("forbid: [{from: low, to: top}]\n", "")).strict(at)
    assert not gone["passed"] and "no longer cover 1" in gone["refused"]
    d = Project(spark, str(later), RULES).diff(at)
    assert d["score"] == {} and "sdp" not in d and [(r.change) for r in d["cycles"].orderBy("change").collect()] == ["added", "resolved"]
    assert d["headline"] == "no score to compare; cycles +1/-1"
    assert d["regressions"].first().kind == "cycles" and d["improvements"].first().kind == "cycles"


def test_closing_edges_of_a_new_cycle(spark):
    from stratagraph.operators import rules

    members = lambda *rows: spark.createDataFrame(rows, "scc string, node string")
    pairs = lambda *rows: spark.createDataFrame([tuple(r.split(">")) for r in rows], "src string, dst string")
    got = rules.closing_edges(members(("a", "a"), ("a", "b"), ("a", "c")), pairs("a>b", "b>a", "b>c", "c>a"), members(("a", "a"), ("a", "b")), pairs("a>b"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [("b", "c"), ("c", "a")]
    # All edges are named where none closed it.
    got = rules.closing_edges(members(("a", "a"), ("a", "b")), pairs("a>b", "b>a"), members(("a", "a"), ("a", "b")), pairs())
    assert got.count() == 2


def test_coverage_of_the_rules(project):
    c = project.coverage()
    assert (c["modules"], c["layered"], c["outside"]) == (6, 4, 1) and {r.node for r in c["unlayered"].collect()} == {"app", "app.broken"}
    assert c["unproven"] and c["hints"].count() == 0 and c["coverage"] > 0


def test_gates():
    src = b"""
import sys, click
@click.command()
@click.option("--strict", "-s")
@click.option("--fail-on", "level")
def main(strict, level, path):
    if strict:
        sys.exit(2)
    elif path:
        raise click.UsageError("x")
    else:
        try:
            ctx.exit(code)
        except Exception:
            raise SystemExit
    if settings.ci.fail:
        sys.exit(1 if level else 0)
    def inner():
        sys.exit(9)
sys.exit(main())
"""
    got = [(g["function"], g["category"], g["kind"], g["code"], g["control"], g["is_command"]) for g in pyparse.parse(src)["gates"]]
    assert got == [
        ("main", "gate", "sys.exit", 2, "flag:--strict", True),
        ("main", "error", "UsageError", None, "param:path", True),
        ("main", "gate", "ctx.exit", None, "hardcoded", True),
        ("main", "gate", "SystemExit", None, "hardcoded", True),
        ("main", "gate", "sys.exit", None, "config:settings.ci", True),
        ("inner", "gate", "sys.exit", 9, "hardcoded", False),
    ] or got[4][4].startswith("config:settings.ci")


def test_scripts_and_docs(spark, project, tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\ngo = "acme.app.core:run"\nold = "app.gone:x"\n[tool.poetry.scripts]\nfile = {reference = "x", type = "file"}\ntool = {reference = "app.util:helper"}\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/pyproject.toml").write_text("[project\n")
    scripts, bad = tree.declared_scripts(spark, str(tmp_path))
    assert scripts == [("go", "acme.app.core"), ("old", "app.gone"), ("tool", "app.util")] and len(bad) == 1 and bad[0].startswith("sub/")
    assert {(r.qualname, r.name) for r in tree.script_modules(project.facts, scripts).collect()} == {("app.core", "go"), ("app.util", "tool")}
    for name, text in {"docs/a.rst": ".. autoclass:: app.store.Disk\n``load_all`` and [app.x]\n", "README.md": "use `run-it` or some-slug here", ".hidden/b.md": "`no`", "docs/big.md": "`big`" + " " * 2_000_001}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.place, r.name) for r in tree.docs(spark, str(tmp_path)).collect()} == {("docs", "Disk"), ("docs", "load_all"), ("docs", "x"), (".", "run-it"), (".", "some-slug")}


def test_orphans_and_changed_files(spark, project, tmp_path):
    for name in ("p/__init__.py", "p/a/x.py", "p/b/__init__.py", "p/b/c/y.py", "p/b/c/d/z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert {r.dir for r in tree.orphan_dirs(tree.files(spark, str(tmp_path))).collect()} == {"p/a", "p/b/c"}
    got = tree.changed_files(spark, str(tmp_path / "p"), ["a/x.py", "p/b/__init__.py", "a/gone.py", "a/x.py", ""], str(tmp_path)).collect()
    assert [(r.path, r.state) for r in got] == [("a/x.py", "resolved"), ("b/__init__.py", "resolved"), ("a/gone.py", "deleted")]


def test_matrices_and_pages(spark, project, tmp_path):
    from stratagraph.plans import render

    before = project.dsm("topological")
    text = snapshot.matrix_json(*before)
    (tmp_path / "m.json").write_text(text)
    back = snapshot.read_matrix(spark, str(tmp_path / "m.json"))
    assert snapshot.matrix_diff(before, back).count() == 0 and snapshot.read_matrix(spark, str(tmp_path / "no")) is None
    (tmp_path / "bad.json").write_text("{}")
    for bad in ("bad.json", ""):
        with pytest.raises(ValueError, match="no matrix"):
            snapshot.read_matrix(spark, str(tmp_path / bad))
    fewer = (back[0], back[1].where("NOT (row = 0 AND col = 1)"))
    n = before[1].where("row = 0 AND col = 1").count()
    said = snapshot.matrix_diff_text(fewer, before)
    assert said.startswith(f"Matrix: +{n} cells, -0 cells") and snapshot.matrix_diff_text(before, fewer).startswith(f"Matrix: +0 cells, -{n} cells")
    page = render.matrix_page(*before)
    assert page.count("<rect") == before[1].count() and "app.core" in page
    with pytest.raises(ValueError):
        render.matrix_page(*before, most=2)
    hist = spark.createDataFrame([("2024-01-01", 0.5), ("2024-01-02", 0.7)], "day string, overall double")
    assert render.trend_page(hist).count("<circle") == 2 and "No history" in render.trend_page(hist.limit(0))


def test_notes():
    from stratagraph.plans import notes

    assert notes.refactor_note("fused", 3, 0.15, True, True) is None and notes.refactor_note("structural", 1, 0.15, False, False) is None
    assert "structure alone" in notes.refactor_note("fused", 3, 0.15, False, False)
    assert "v1" in notes.refactor_note("fused", 0, 0.15, True, True, "v1") and "0.15" in notes.refactor_note("structural", 0, 0.15, True, True)
    assert "structural lens" in notes.refactor_note("behavioral", 0, 0.15, False, False) and notes.history_note(True, True) is None
    with pytest.raises(ValueError):
        notes.refactor_note("both", 0, 0.1, True, True)


def test_dates_of_windows(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "-A")
    git("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "one")
    out = str(tmp_path / "log")
    for good in (None, "2001-01-01", "3 weeks ago", "HEAD"):
        gitlog.export(str(tmp_path), out, good)
    for bad in ("garbage", "nodate"):
        with pytest.raises(ValueError, match="neither a ref nor a date"):
            gitlog.export(str(tmp_path), out, bad)


def test_cache_of_facts(spark, project, tmp_path):
    names = lambda p: {r.qualname: len(r.functions) for r in p.facts.collect()}
    cold = names(project)
    for _ in range(2):
        assert names(Project(spark, project.root, "", cache=str(tmp_path / "facts"))) == cold
    assert spark.read.parquet(str(tmp_path / "facts")).count() == len(cold)


def test_forms_of_the_graph(project):
    assert project.graph(form="text", internal_only=True).count() == project.edges.count() and project.graph(form="json").count() > 9
    for bad in ({"form": "xml"}, {"max_nodes": 3}):
        with pytest.raises(ValueError):
            project.graph(**bad)


def test_patterns_that_cannot_match(spark, project):
    with pytest.raises(ValueError, match="use 'os.[*][*]'"):
        Project(spark, project.root, "layers: {x: [os.path.**]}\n").check()
    assert Project(spark, project.root, "layers: {x: [os.**], y: ['**.path']}\n").check()["passed"]


def test_gaps_in_documentation(spark):
    from stratagraph.operators import census

    members = spark.createDataFrame([("Base", n) for n in ("A", "B", "C", "_D")] + [("Whole", "E"), ("Whole", "F"), ("One", "G"), ("One", "H"), ("One", "I")], "grp string, name string")
    named = spark.createDataFrame([("docs", n) for n in "ABEFG"] + [("web", "A"), ("web", "B")], "place string, name string")
    assert [tuple(r) for r in census.doc_gaps(members, named).collect()] == [("docs", "Base", 3, 2, ["C"])]
    assert {(r.place, r.grp, tuple(r.missing)) for r in census.coverage_gaps(members, named).collect()} == {("docs", "Base", ("C", "_D")), ("web", "Base", ("C", "_D"))}


def test_conventions(project):
    c = project.conventions(5)
    assert c["partition"] == {"censused": 6, "test": 1}
    assert [(r.grp, r.members) for r in c["bases"]["rows"].collect()] == [("Base", 3), ("Disk", 2)] and c["bases"]["total"] == 2
    assert [(r.name, r.n) for r in c["constants"]["rows"].collect()] == [("KIND", 2)]
    assert {(r.home, r.name, r.importers) for r in c["consumers"]["rows"].collect()} == {("app.core", "run", 2)} and c["gates"]["total"] == 0
    with pytest.raises(ValueError):
        project.conventions(0)


def test_shares_and_verdicts(spark):
    from stratagraph.operators import research as r

    rows = [(f"p{k}", f"u{k % 40}", f"r{k % 16}", f"c{k % 20}", ["A"] if k % 40 < 10 else ["B"] if k % 40 < 30 else ["A", "B"], False) for k in range(80)] + [("e", "ux", "rx", "cx", ["B"], True)]
    pairs = spark.createDataFrame(rows, "id string, unit string, repo string, change string, generators array<string>, exact boolean")
    truth = spark.createDataFrame([(x[0], True) for x in rows], "id string, agreed boolean")
    got = r.found_share(pairs, truth, "B", "A").first()
    assert (got.units, got.only_one, got.only_other, got.both, got.repos, got.changes, got.measurable, got.share) == (40, 20, 10, 10, 16, 20, True, 0.5)
    assert r.found_share(pairs.limit(0), truth, "B", "A").first().share is None
    v = lambda p, m, s, n=30: r.share_verdict(n, 10, p, m, s)
    assert [v((0.7, 0.8), True, (0.4, 0.5)), v((0.2, 0.39), False, (None, None)), v((0.7, 0.8), True, (0.0, 0.05)), v((0.5, 0.8), True, (0.4, 0.5)), v((0.7, 0.8), False, (0.4, 0.5)), v((0.7, 0.8), True, (0.4, 0.5), 29)] == ["pass", "kill", "kill", "null", "not_measurable", "not_measurable"]
    table = r.gap_table(spark.createDataFrame([("a", 9.0, 100), ("b", 5.0, 10), ("c", 10.0, 999)], "path string, score double, lines long"), 2).collect()
    assert [(x.path, round(x.share, 6), round(x.running, 6)) for x in table] == [("a", round(100 / 150, 6), round(100 / 150, 6)), ("b", round(50 / 150, 6), 1.0)]
