import json

import pytest
from pyspark.sql import functions as F

from tessel.functions import globs
from tessel.operators import combinators, impact, planning, provenance, resolve, widgets
from tessel.plans import backend, code_graph, context, suite
from tessel.sources import documents, repo

CODE = {
    "src/app/main.py": "from src.app.util import load\n\ndef main():\n    return load(1)\n",
    "src/app/util.py": "def load(n):\n    return deep(n)\n\ndef deep(n):\n    return n\n",
    "src/app/other.py": "from src.app.main import main\n\ndef run():\n    main()\n",
    "tests/test_util.py": "from src.app.util import load\n\ndef test_load():\n    load(2)\n",
    "AGENTS.md": "# Rules\n- never touch generated api files\n",
    "Makefile": "test:\n\tpytest\n",
    "docs/plan.md": "---\nsync_targets:\n  - src/app/util.py\nvalidation:\n  - pytest tests/test_util.py\n---\n# Plan\n\nTo do.\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, text in CODE.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return repo.scan_files(spark, f"file://{base}").cache()


@pytest.fixture(scope="module")
def tables(spark, files):
    return {k: v.cache() for k, v in code_graph.build(files).items()}


def paths(spark, *names):
    return spark.createDataFrame([(p,) for p in names], "path string")


def test_change_impact_and_trace(spark, tables):
    got = {r["path"]: (r["kind"], r["confidence"]) for r in impact.change_impact(paths(spark, "src/app/util.py"), tables["bindings"], tables["symbol_edges"], tables["tests"]).collect()}
    assert got == {"src/app/main.py": ("calls", 0.75), "tests/test_util.py": ("covered_by", 0.9)}
    start = tables["symbols"].filter("name = 'run'").select(F.col("symbol_key").alias("node"))
    hops = {r["node"].split("::")[1]: r["hop"] for r in impact.trace(tables["symbol_edges"], start, "callees", 5).collect()}
    assert hops == {"main": 1, "load": 2, "deep": 3}
    assert [r["hop"] for r in impact.trace(tables["symbol_edges"], start, "callees", 5, 2).collect()] == [1, 2]
    back = impact.trace(tables["symbol_edges"], tables["symbols"].filter("name = 'deep'").select(F.col("symbol_key").alias("node")), "callers", 2)
    assert {r["node"].split("::")[1] for r in back.collect()} == {"load", "main", "test_load"}


def test_impact_report(spark, tables):
    parts, report = code_graph.report_impact(tables, "src/app/util.py", "load util")
    kinds = {(r["part"], r["path"]) for r in parts.collect()}
    assert {("callers", "src/app/main.py"), ("tests", "tests/test_util.py")} <= kinds and not any(p == "src/app/util.py" for _, p in kinds)
    rows = {r["role"]: r for r in report.collect()}
    assert rows["all"]["files"] == len({p for _, p in kinds}) and "tests/test_util.py" in rows["test"]["paths"]
    many = spark.createDataFrame([("related", f"src/{i}_page.dart") for i in range(9)] + [("related", f"auth/{i}.py") for i in range(3)], "part string, path string")
    assert {(r["role"], r["files"], r["risk"]) for r in impact.impact_report(many).collect()} == {("widget", 9, "high"), ("role", 3, "medium"), ("all", 12, "high")}
    assert impact.impact_report(many.limit(0)).collect() == []


def test_changed_paths(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, state string")
    got = impact.changed_paths(rows(("a", "merged"), ("b", "merged")), rows(("a", "staged"), (None, "staged")), rows(("c", "untracked")))
    assert {r["path"]: r["states"] for r in got.collect()} == {"a": ["merged", "staged"], "b": ["merged"], "c": ["untracked"]}


def test_context(spark, tables, files):
    memory = planning.remember(spark, "util", "load is slow", ["src/app/util.py"])
    made = context.prepare(tables, context.Task("speed up load in util"), files, memory)
    assert made["mode"] == "discovery" and made["warnings"] == [] and made["memory"].first()["topic"] == "util"
    assert "src/app/util.py" in {r["path"] for r in made["reading_list"].collect()} and {"callees", "reuse_clusters", "tests"} <= set(made["discovery"])
    assert "src/app/util.py" in {r["path"] for r in made["discovery"]["callees"].collect()}
    task = context.Task("repair it", changed=["src/app/main.py"], guard_output="[size] src/app/util.py:2 too long", guard_command="run_size.sh", source_doc="docs/plan.md", profile="brief", status=spark.createDataFrame([("x.py", "modified")], "path string, state string"))
    made = context.prepare(tables, task, files)
    reads = {r["path"]: (r["score"], r["source"], r["context_tier"]) for r in made["reading_list"].collect()}
    assert made["mode"] == "repair" and reads["src/app/util.py"] == (1.0, "guard failure", "core") and reads["src/app/main.py"][:2] == (0.9, "changed file")
    assert made["boundary"].first()["must_edit"] == ["src/app/main.py", "src/app/util.py"] and [r["path"] for r in made["outside"].collect()] == ["x.py"]
    assert made["repair_path"][:2] == ["run run_size.sh", "edit src/app/main.py"] and "routes" not in made and "rules" not in made
    assert "pytest tests/test_util.py" in {r["text"] for r in made["plan"].collect()}
    text = context.render(made)
    assert len(text) <= 2500 and "- src/app/util.py (core): guard failure" in text
    lost = context.prepare(tables, context.Task("x", source_doc="docs/none.md", profile="brief"))
    assert lost["warnings"] == ["docs/none.md was not found"]
    assert "## Modules\n- src/app (source_module): 3" in context.render_map(tables)


def test_project_tools(spark, tmp_path):
    for path, text in CODE.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    p = code_graph.Project(spark, f"file://{tmp_path}/tree", f"file://{tmp_path}/store")
    p.scan()
    assert [r["path"] for r in p.ask("detect_changes", "src/app/util.py")["data"]] == ["tests/test_util.py", "src/app/main.py"]
    assert [r["hop"] for r in p.ask("trace", "run", depth=2)["data"]] == [1, 2]
    out = p.ask("documents", most=0)
    assert out["data"] == [] and out["warnings"] == ["only the first 0 rows are shown"] and out["generated_at"]
    assert "speed" in p.context(context.Task("speed up load", profile="brief"))["data"] and p.store.log("sessions").count() == 1


def test_mutations(spark, files):
    suites = [
        {"id": "edit", "mutations": [{"kind": "change", "path": "src/app/util.py", "text": "def load(n):\n    return n\n\ndef fresh():\n    load(3)\n"}]},
        {"id": "mixed", "mutations": [{"kind": "rename", "path": "src/app/main.py", "to": "src/app/start.py"}, {"kind": "delete", "path": "tests/test_util.py"}, {"kind": "add", "path": "src/app/new.py", "text": "def added():\n    load(4)\n"}]},
    ]
    cases = [{"id": "who", "kind": "callers", "of": "load"}, {"id": "reach", "kind": "impact", "of": "src/app/util.py"}]
    assert code_graph.check_mutations(files, suites, cases).filter("section <> 'code_blocks'").collect() == []
    before, after = code_graph.build(files), code_graph.build(code_graph.mutate(files, suites[0]["mutations"]))
    wrong = {(r["side"], r["key"].split("::")[1]) for r in code_graph.query_differences(before, after, cases[:1]).collect()}
    assert wrong == {("extra", "fresh")}


def test_mutations_as_rows(spark, files, tmp_path):
    """All suites by one join give the trees that one suite after the other gives; a file of suites is read as rows."""
    suites = [
        {"id": "edit", "mutations": [{"kind": "change", "path": "src/app/util.py", "text": "x = 1\n"}, {"kind": "delete", "path": "no/such.py"}]},
        {"id": "mixed", "mutations": [{"kind": "rename", "path": "src/app/main.py", "to": "src/app/start.py"}, {"kind": "delete", "path": "tests/test_util.py"}, {"kind": "add", "path": "src/app/new.py", "text": "def added():\n    load(4)\n"}]},
        {"id": "both", "mutations": [{"kind": "change", "path": "src/app/main.py", "text": "y = 2\n"}, {"kind": "rename", "path": "src/app/main.py", "to": "src/app/util.py"}]},
    ]
    (tmp_path / "suites.json").write_text(json.dumps({"mutations": suites}))
    rows = documents.mutation_suite(spark, f"file://{tmp_path}/suites.json")
    assert rows.count() == 7
    got = {k: {} for k in ("edit", "mixed", "both")}
    for r in code_graph.mutated(files, rows).collect():
        assert r["path"] not in got[r["suite"]]
        got[r["suite"]][r["path"]] = (r["language"], r["size"], r["hash"], r["text"])
    for s in suites[:2]:
        assert got[s["id"]] == {r["path"]: (r["language"], r["size"], r["hash"], r["text"]) for r in code_graph.mutate(files, s["mutations"]).collect()}
    before = {r["path"] for r in files.select("path").collect()}
    assert set(got["both"]) == before - {"src/app/main.py"} and got["both"]["src/app/util.py"][3] == "y = 2\n"
    assert code_graph.mutated(files, rows.limit(0)).collect() == [] and code_graph.mutated(files.limit(0), rows).filter("suite = 'mixed'").count() == 1
    with pytest.raises(ValueError):
        documents.mutation_rows(spark, [{"id": "x", "mutations": [{"kind": "turn", "path": "a"}]}])


def test_snapshot(spark, tables, tmp_path):
    code_graph.export_snapshot(tables, f"file://{tmp_path}/snapshot")
    back = spark.read.option("basePath", f"file://{tmp_path}/snapshot").text(f"file://{tmp_path}/snapshot")
    assert {(r["section"], r["value"]) for r in back.collect()} == {(r["section"], r["row"]) for r in code_graph.snapshot(tables).collect()}


def test_tiers_against_windows(spark):
    """The few top rows get the tiers that ranking every row would give."""
    rows = [(i, (i * 37 % 100) / 100, i % 3 == 0, i % 4 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, score double, core boolean, usable boolean")
    got = {r["k"]: r["tier"] for r in combinators.budgeted_tiers(df, "k", F.col("core"), F.col("usable"), 5, 7, F.desc("score"), F.col("k")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    must = [r[0] for r in order if r[2]][:5]
    should = [r[0] for r in order if r[3] and r[0] not in must][:7]
    rest = [r[0] for r in order if r[0] not in must + should][:7]
    assert len(got) == 200 and {k for k, t in got.items() if t} == {*must, *should, *rest} and all(got[k] == "mustRead" for k in must) and all(got[k] == "shouldInspect" for k in should)


def test_test_targets_by_substring(spark):
    names = ["src/a/session_store.py", "src/b/x.py", "src/zz/abc.py", "lib/abcd/q.py", "tests/test_session.py", "tests/test_ab.py", "tests/test_x.py", "tests/test_none_such.py", "tests/test_.py", "tests/test_ABC.py"]
    got = {r["test_path"]: (r["target_path"], r["confidence"]) for r in resolve.test_targets(paths(spark, *names)).collect()}
    sources = [n for n in names if n.startswith(("src", "lib"))]
    loose = lambda part: min(s for s in sources if part in s.lower())
    assert got == {"tests/test_session.py": (loose("session"), 0.55), "tests/test_ab.py": (loose("ab"), 0.55), "tests/test_x.py": ("src/b/x.py", 0.9), "tests/test_ABC.py": (loose("abc"), 0.55)}


def test_provenance(spark):
    state = spark.createDataFrame([("git_log", None, True), ("weak_match", None, False), ("x", "fresh", True)], "kind string, state string, critical boolean")
    assert provenance.stale_critical(state).first()["stale"] and not provenance.stale_critical(state.filter("kind <> 'git_log'")).first()["stale"] and not provenance.stale_critical(state.limit(0)).first()["stale"]
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    found, total = provenance.file_hashes(files, paths(spark, "./a", "b", "c", "a"), 2)
    assert {r["path"] for r in found.collect()} == {"a", "b"} and tuple(total.first()) == (3, 2, True)
    entry = lambda *r: spark.createDataFrame(list(r), "path string, state string, mode string, size long, modified long, sha256 string")
    one = provenance.worktree_fingerprint(entry(("a", "M", "644", 1, 1, "x"), ("b", "M", "644", 1, 1, "y"), ("c", "D", None, None, None, None)))
    two = provenance.worktree_fingerprint(entry(("a", "M", "644", 1, 1, "x"), ("b", "M", "755", 1, 1, "y"), ("d", "A", "644", 0, 1, "")))
    assert {(r["path"], r["status"]) for r in provenance.worktree_changes(one, two).collect()} == {("b", "changed"), ("c", "deleted"), ("d", "new")}
    assert provenance.overall_fingerprint(one).first() == provenance.overall_fingerprint(one.orderBy(F.desc("path"))).first() != provenance.overall_fingerprint(two).first()
    coverage = lambda *r: tuple(provenance.coverage_summary(spark.createDataFrame(list(r), "path string, status string, freshness string")).first())[:3]
    good, ok = "metadata_match", "no_recorded_issue"
    assert coverage(("a", ok, good)) == ("metadata_only", 0, 0) and coverage(("a", "partial", good), ("b", "skipped", good)) == ("partial", 2, 0)
    assert coverage(("a", "skipped", good)) == ("weak", 1, 0) and coverage(("a", ok, None), ("b", ok, good)) == ("stale", 0, 1) and coverage() == ("unknown", 0, 0)


def test_outside_answers(spark):
    flat = {"cols": ["qn", "label", "file", "lines", "score"], "rows": [["a.b.C", "Class", "x.py", "3-9", 0.5], ["f", None, None, "4", None]]}
    got = provenance.symbol_rows(json.dumps(flat))
    assert got[0] == {"name": "C", "qualified_name": "a.b.C", "kind": "Class", "path": "x.py", "start_line": 3, "end_line": 9, "score": 0.5}
    assert (got[1]["name"], got[1]["kind"], got[1]["start_line"], got[1]["end_line"]) == ("f", "Unknown", 4, 4)
    groups = {"cols": ["name"], "groups": [{"qn_prefix": "p.q", "file": "y.py", "rows": [["g"]]}]}
    assert provenance.symbol_rows(json.dumps(groups))[0] == {"name": "g", "qualified_name": "p.q.g", "kind": "Unknown", "path": "y.py", "start_line": None, "end_line": None, "score": None}
    for bad in ({}, {"cols": ["name"]}, {"cols": ["name"], "rows": [[""]]}, {"cols": ["name"], "groups": [{"rows": [1]}]}):
        with pytest.raises(ValueError):
            provenance.symbol_rows(json.dumps(bad))
    answer = {"file": "a\\b.py", "x": {"path": ["c/d", "plain", ""], "name": "no/t"}, "t": {"cols": ["n", "route_file"], "rows": [["q/r", "e.ts"]]}}
    rows = spark.createDataFrame([(1, json.dumps(answer)), (2, "{bad"), (3, None)], "k int, answer string")
    assert {r["k"]: r["paths"] for r in provenance.harvest_paths(rows, "k", "answer").collect()} == {1: ["a/b.py", "c/d", "e.ts"], 2: [], 3: []}


DART = {
    "frontend/lib/routes.dart": "final a = GoRoute(name: 'home', path: '/home', builder: (c, s) => HomePage());\nfinal b = GoRoute(name: 'bare', path: '/bare', builder: (c, s) => Text('x'));\n",
    "frontend/lib/home_page.dart": "class HomePage extends W {\n  Widget build(C c) {\n    return Column(children: [HomeCard(), SideBox(), HomePage()]);\n  }\n}\n",
    "frontend/lib/home_card.dart": "class HomeCard extends W {\n  Widget build(C c) {\n    return Row(children: [DeepTile(), HomeController()]);\n  }\n}\nclass DeepTile extends W {\n  Widget build(C c) {\n    return Text('t');\n  }\n}\nclass SideBox extends W {\n}\n",
    "frontend/test/home_card_test.dart": "void main() {\n}\n",
}


def test_widget_chains(spark):
    rows = [(p, "dart", len(t), p, t) for p, t in DART.items()]
    made = code_graph.build(spark.createDataFrame(rows, "path string, language string, size long, hash string, text string"))
    files, symbols = spark.createDataFrame([(p, t) for p, t in DART.items()], "path string, text string"), made["symbols"]
    pages = widgets.route_pages(made["routes"], files, symbols)
    assert [(r["route"], r["page"], r["page_path"]) for r in pages.collect()] == [("/home", "HomePage", "frontend/lib/home_page.dart")]
    composes = widgets.composition(made["code_blocks"].filter("kind = 'class'"), symbols)
    assert {(r["from_symbol"], r["to_symbol"]) for r in composes.collect()} == {("HomePage", "HomeCard"), ("HomePage", "SideBox"), ("HomeCard", "DeepTile")}
    chain = widgets.route_chains(pages, composes, made["tests"], "home card").first()
    assert chain["steps"] == ["HomePage", "HomeCard", "DeepTile"] and (chain["depth"], chain["status"], chain["completeness"], chain["coverage"]) == (4, "verified_chain", "complete", "strong")
    assert chain["confidence"] == pytest.approx((0.86 + 0.92 + 0.88 + 0.8) / 4, abs=0.0051) and chain["test_path"] == "frontend/test/home_card_test.dart"
    bare = widgets.route_chains(pages, composes.limit(0), made["tests"].limit(0), "x").first()
    assert (bare["depth"], bare["status"], bare["completeness"], bare["coverage"]) == (2, "partial_chain", "route_and_page", "none")


def test_acceptance(spark):
    files = spark.createDataFrame([("lib/r.dart", "static const base = '/a';\nconst full = '$base/b';\nconst other = 'no';\n")], "path string, text string")
    constants = widgets.route_constants(files)
    assert {(r["name"], r["route"]) for r in constants.collect()} == {("base", "/a"), ("full", "/a/b")}
    manifest = spark.createDataFrame([("f", "coach", "/a/b", "m", "P", ["s"]), ("f", "coach", "/x", "m", "P", []), ("f", "coach", "/x", "m", "Q", [])], "family string, role string, route string, mode string, class string, states array<string>")
    classes = spark.createDataFrame([("P", "lib/p.dart", "class")], "name string, path string, kind string")
    tests = spark.createDataFrame([("t.dart", "lib/p.dart")], "test_path string, target_path string")
    routes = spark.createDataFrame([], "path string, file_path string")
    status = lambda t: [r["status"] for r in widgets.acceptance(manifest, routes, constants, classes, t).orderBy("class", "route").collect()]
    assert status(tests) == ["verified", "partial", "missing"] and status(tests.limit(0)) == ["implemented", "partial", "missing"]


def test_route_block(spark):
    text = "x GoRoute(name: 'a', path: '/a') GoRoute(name: 'b', path: '/b') end"
    rows = spark.createDataFrame([(text, "a", "/a"), (text, "b", "/b"), (text, None, "/b"), (text, "zz", "/zz"), ("GoRoute('q'" + "y" * 5000, "q", None)], "text string, name string, path string")
    got = [r[0] for r in rows.select(widgets.route_block(F.col("text"), F.col("name"), F.col("path"))).collect()]
    assert got[0] == "GoRoute(name: 'a', path: '/a') " and got[1] == got[2] == "GoRoute(name: 'b', path: '/b') end" and got[3] == text and len(got[4]) < 2000


class Outside:
    name = "outside"

    def __init__(self, error=None, ready=True):
        self.error, self.ready = error, ready

    def status(self):
        return {"available": True, "indexed": self.ready, "reason": "still indexing"}

    def search(self, query, limit=20):
        if self.error:
            raise self.error
        return f"found {query}"


def test_router(tables):
    own = backend.Builtin(tables)
    ask = lambda *outside, choice="auto": backend.Router(own, list(outside), choice).ask("search", "load")
    assert ask(Outside()).data == "found load" and ask(Outside(), choice="builtin").backend == "builtin"
    late, broken = ask(Outside(ready=False)), ask(Outside(backend.BackendError("no answer")))
    assert (late.backend, late.fallback) == ("builtin", "outside: still indexing") and broken.fallback == "outside: no answer" and broken.data.first()["name"] == "load"
    for bad in (lambda: ask(Outside(backend.BackendError("damaged", unsafe=True))), lambda: ask(Outside(backend.BackendError("x")), choice="outside"), lambda: ask(choice="none")):
        with pytest.raises(backend.BackendError):
            bad()
    assert own.status() == {"available": True, "indexed": True} and own.architecture("app").first()["core_files"][0] == "src/app/main.py"
    assert [r["path"] for r in own.detect_changes(["src/app/util.py"]).orderBy("path").collect()] == ["src/app/main.py", "tests/test_util.py"]


def test_suite_runner(tables):
    cases = [{"id": 1, "task": "speed up load in util", "expected": [], "forbidden": ["AGENTS.md"]}, {"id": 2, "task": "nothing of this", "expected": ["src/app/util.py"]}]
    got = {r["id"]: r for r in code_graph.evaluate(tables, cases).collect()}
    assert got["1"]["noise_suppression"] == 1.0 and got["2"]["must_read_coverage"] == 0.0 and got["1"]["production_score"] > got["2"]["production_score"]


TASKS = [
    ("a", "speed up load in util", None), ("b", "impact of deep on test api", None), ("c", "entry route for main", None), ("d", None, "full"), ("e", "设计系统 视觉 test load load mains", "full"), ("f", "unmatchedword src reuse", None),
]


@pytest.fixture(scope="module")
def asked(spark, tables):
    return {k: v.cache() for k, v in suite.discover(tables, spark.createDataFrame(TASKS, "case string, task string, mode string")).items()}


@pytest.mark.parametrize("task", TASKS, ids=lambda t: t[0])
def test_suite_equals_one_by_one(tables, asked, task):
    """Every part of a suite's answers has the rows that asking alone gives."""
    case, text, mode = task
    one = code_graph.discover(tables, text or "", mode=mode)
    columns = {"entrypoints": ["type", "symbol", "path", "route_path", "method", "score"], "related": ["path", "score", "reason"], "symbols": ["symbol_key", "path", "score", "method"], "reuse": ["symbol_key", "similarity", "reuse_type", "verdict"], "callees": ["node", "path"], "tests": ["path", "score"], "must_read": ["path", "score", "evidence", "dependency_tier", "selected", "reason", "goes_to"]}
    rows = lambda df, c: sorted(map(str, df.select(*c).collect()))
    for part, c in columns.items():
        assert rows(asked[part].filter(F.col("case") == case), c) == (rows(one[part], c) if part in one else []), part


def test_suite_jobs(spark, tables):
    """Six cases take as many jobs as two, and no case is left out."""

    def jobs(n: int) -> int:
        spark.sparkContext.setJobGroup(f"suite{n}", "")
        got = code_graph.evaluate(tables, [{"id": c, "task": t, "mode": m, "expected": ["src/app/util.py"]} for c, t, m in TASKS[:n]])
        assert got.count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"suite{n}"))

    few, many = jobs(2), jobs(6)
    spark.sparkContext.setJobGroup("", "")
    assert many <= few + 12  # adaptive execution may run a stage of a larger table as a job of its own
    assert code_graph.evaluate(tables, []).collect() == []


def test_stale_edges(files, tables):
    after = code_graph.build(code_graph.mutate(files, [{"kind": "change", "path": "src/app/util.py", "text": "def deep(n):\n    return n\n"}]))
    assert {r["from_symbol"].split("::")[1] for r in code_graph.stale_edges(tables, after).collect()} == {"main", "load", "test_load"}


def test_like(spark):
    rows = spark.createDataFrame([("a%B",), ("AxxB",), ("ab",), ("É_é",)], "t string")
    hits = lambda c: [r[0] for r in rows.filter(c).collect()]
    assert hits(globs.like_text(F.col("t"), "a%b")) == ["a%B", "AxxB", "ab"] and hits(globs.like_text(F.col("t"), "a\\%b")) == ["a%B"] and hits(globs.like_text(F.col("t"), "a__b")) == ["AxxB"]
    assert hits(globs.contains_text(F.col("t"), "%b")) == ["a%B"] and hits(globs.contains_text(F.col("t"), "é")) == ["É_é"]


def test_read_text(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 'é'\n")
    assert repo.read_text(spark, f"file://{tmp_path}", "a.py") == "x = 'é'\n" and repo.read_text(spark, f"file://{tmp_path}", "a.py", 3) is None and repo.read_text(spark, f"file://{tmp_path}", "b.py") is None
