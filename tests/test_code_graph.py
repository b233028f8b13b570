import pytest
from pyspark.sql import functions as F

from tessel.operators import discovery, extract, planning, resolve
from tessel.operators.evaluation import score_cases, slowest_stages, summary
from tessel.plans import code_graph, suite
from tessel.sources import documents, repo

FILES = {
    "frontend/lib/modules/home/home_page.dart": "import 'package:app/modules/home/home_card.dart';\nclass HomePage extends Page {\n  Widget build(Context c) {\n    return HomeCard(title: greet());\n  }\n}\nString greet() => 'hi';\nfinal homeProvider = 1;\nfinal r = GoRoute(\n  name: 'home',\n  path: '/home',\n);\n",
    "frontend/lib/modules/home/home_card.dart": "class HomeCard extends Card {\n  HomeCard build(String title) {\n    return HomeCard();\n  }\n}\n",
    "backend/app/api/users.py": "from app.db import session\n\n@router.get('/users')\n@auth\nasync def list_users(limit: int = 10, q=None) -> list:\n    return load(limit)\n\nclass Store:\n    def load(self, n):\n        return helper(n)\n\ndef load(n):\n    return n\n",
    "backend/app/db.py": "def session():\n    return 1\n\ndef helper(n):\n    if n:\n        return n\n    return 0\n",
    "src/ui/card.tsx": "import { x } from './util';\nexport const CardView = (props: P) => {\n  return useThing(props);\n};\nexport const useThing = (p) => {\n  return p;\n};\nexport class Box {\n  private draw(a, b): void {\n    call(a);\n  }\n}\nexport async function call(a: string) {\n  return a;\n}\n",
    "src/ui/util.ts": "export function x(a) {\n  return a;\n}\n",
    "tests/test_users.py": "def test_list():\n    assert 1\n",
    "README.md": "# App\n## Rules\n- Run tests before commit\nYou must keep the api stable.\nPlain text.\n",
    "Makefile": ".PHONY: x\ntest: deps\n\tpytest\nlint:\n\truff\n",
    "package.json": '{"scripts": {"build": "tsc", "check": "vitest run"}}',
    "pyproject.toml": "[tool]\n",
    "docs/plan.md": "---\nowner_domain: ui\nsync_targets:\n  - src/ui/card.tsx\ndepends_on: [docs/a.md]\nvalidation:\n  - pytest tests/test_users.py\n---\n# Plan\n\nFirst words.\n\n## Sync\nEdit backend/app/db.py now.\n- Run `make test` first\n```bash\n$ npm run build\n```\n",
    "node_modules/a.js": "function no() {}\n",
    "image.png": "x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return base


@pytest.fixture(scope="module")
def files(spark, root):
    return repo.scan_files(spark, f"file://{root}").cache()


@pytest.fixture(scope="module")
def tables(spark, files):
    log = spark.createDataFrame([(0, "src/ui/card.tsx"), (0, "src/ui/util.ts")], "commit_no int, path string")
    return {k: v.cache() for k, v in code_graph.build(files, log).items()}


def test_scan(files):
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == set(FILES) - {"node_modules/a.js", "image.png"}
    assert rows["Makefile"]["language"] == "makefile" and rows["src/ui/card.tsx"]["size"] == len(FILES["src/ui/card.tsx"])


def test_symbols(tables):
    s = {(r["path"].rpartition("/")[2], r["qualified_name"]): r for r in tables["symbols"].collect()}
    assert s["users.py", "Store.load"]["kind"] == "method" and s["users.py", "load"]["kind"] == "function"
    assert s["users.py", "list_users"]["parameters"] == ["limit", "q"] and s["users.py", "list_users"]["return_type"] == "list"
    assert s["card.tsx", "CardView"]["kind"] == "component" and s["card.tsx", "useThing"]["kind"] == "hook"
    assert s["card.tsx", "Box.draw"]["kind"] == "method" and s["card.tsx", "CardView"]["end_line"] == 4
    assert s["home_page.dart", "HomePage.build"]["kind"] == "method" and s["home_page.dart", "greet"]["kind"] == "function" and s["home_page.dart", "homeProvider"]["kind"] == "provider"
    assert extract.extract("a.sql", "sql", "select 1")["symbols"] == [] and extract.extract("a.py", "python", None)["symbols"] == []


def test_routes_and_bindings(tables):
    r = {x["framework"]: x for x in tables["routes"].collect()}
    assert r["fastapi"]["method"] == "GET" and r["fastapi"]["name"] == "list_users" and r["flutter_go_router"]["path"] == "/home"
    b = {x["source_text"]: (x["resolved_path"], x["confidence"], x["imported_name"]) for x in tables["bindings"].collect()}
    assert b["./util"] == ("src/ui/util.ts", 0.85, "util") and b["app.db"] == ("backend/app/db.py", 0.62, "db")
    assert b["package:app/modules/home/home_card.dart"] == ("frontend/lib/modules/home/home_card.dart", 0.78, "home_card")


def test_calls(tables):
    e = {(r["from_symbol"].split("::")[1], r["to_symbol"].split("::")[1]): (r["kind"], r["confidence"]) for r in tables["symbol_edges"].collect()}
    assert e["HomePage.build", "HomeCard"] == ("constructs", 0.75) and e["HomePage.build", "greet"] == ("calls", 0.95)
    assert e["Store.load", "helper"] == ("calls", 0.75) and e["CardView", "useThing"] == ("calls", 0.95)


def test_commands_rules_tests(tables):
    c = {r["command"]: r["category"] for r in tables["commands"].collect()}
    assert c["make test"] == "test" and c["make lint"] == "lint" and c["npm run build"] == "build" and c["npm run check"] == "test" and "pytest" in c and "make .PHONY" not in c
    rules = [(r["title"], r["body"], r["category"]) for r in tables["rules"].collect()]
    assert rules == [("Rules", "Run tests before commit", "test"), ("Rules", "You must keep the api stable.", "backend")]
    t = [tuple(r) for r in tables["tests"].collect()]
    assert t == [("tests/test_users.py", "backend/app/api/users.py", "pytest tests/test_users.py", 0.9)]


def test_documents(tables):
    d = {r["path"]: r for r in tables["documents"].collect()}["docs/plan.md"]
    assert (d["parse_mode"], d["owner_domain"], d["title"], d["summary"]) == ("mixed", "ui", "Plan", "First words.")
    assert {(t["kind"], t["target_path"], t["confidence"]) for t in d["targets"]} >= {("sync_target", "src/ui/card.tsx", 0.95), ("depends_on", "docs/a.md", 0.75), ("sync_target", "backend/app/db.py", 0.62)}
    assert [s["command"] for s in d["steps"]] == ["make test", "npm run build", "pytest tests/test_users.py"]


def test_questions(spark, tables):
    found = code_graph.find_symbol(tables, "Box").collect()
    assert found[0]["name"] == "Box" and found[0]["method"] == "bm25"
    out = code_graph.discover(tables, "change the home page card widget")
    assert out["entrypoints"].first()["path"].startswith("frontend/lib/modules/home/")
    assert "frontend/lib/modules/home/home_card.dart" in {r["path"] for r in out["related"].collect()}
    assert out["must_read"].count() > 0 and out["read_order"].count() > 0
    why = discovery.why_related(spark.createDataFrame([("src/ui/util.ts",)], "target string"), "ui util", tables["symbols"], tables["routes"], tables["edges"]).first()
    assert why["score"] > 0.5 and "graph_proximity" in {e["type"] for e in why["evidence"]}
    hit = {r["path"]: r["distance"] for r in discovery.impact(tables["edges"], "src/ui/util.ts").collect()}
    assert hit["src/ui/card.tsx"] == 1
    modules = {r["root"]: r for r in discovery.module_map(tables["modules"], tables["files"], tables["edges"], tables["tests"]).collect()}
    assert modules["src/ui"]["core_files"] == ["src/ui/card.tsx", "src/ui/util.ts"]
    assert resolve.resolve_symbol(tables["symbols"], "Store.load").first()["kind"] == "method"
    candidates, risks = discovery.reuse(tables["code_blocks"], "home card widget build")
    assert candidates.count() >= 0 and risks.count() >= 0
    languages, counts = discovery.repo_map(tables["files"], tables)
    assert {r["table"] for r in counts.collect()} == set(tables) and languages.count() > 3


def test_suite_of_widgets(spark, tables):
    """Entry points, reuse and gates of two tasks at once are those of each alone."""
    tasks = [("a", "change the home page card widget", None), ("b", "reuse box card view for the backend api users load", "full")]
    both = suite.discover(tables, spark.createDataFrame(tasks, "case string, task string, mode string"))
    columns = {"entrypoints": ["type", "symbol", "path", "route_path", "method", "score"], "reuse": ["symbol_key", "similarity", "reuse_type", "verdict"], "callees": ["node", "path"], "must_read": ["path", "score", "evidence", "selected", "reason", "goes_to"]}
    for case, text, mode in tasks:
        one = code_graph.discover(tables, text, mode=mode)
        for part, c in columns.items():
            rows = lambda df: sorted(map(str, df.select(*c).collect()))  # noqa: B023, E731
            want = rows(one[part])
            assert rows(both[part].filter(F.col("case") == case)) == want and (want or part == "callees"), part


def test_partial_equals_full(spark, files, tmp_path):
    """A rename, a deletion, a changed route and a changed call at once."""
    store = code_graph.incremental.VersionedStore(spark, f"file://{tmp_path}")
    card, util, users = "src/ui/card.tsx", "src/ui/util.ts", "backend/app/api/users.py"
    path, text = F.col("path"), F.col("text")
    new = files.filter(path != "backend/app/db.py").withColumn("path", F.when(path == util, "src/ui/tool.ts").otherwise(path))
    new = new.withColumn("text", F.when(path == users, F.replace(text, F.lit("/users"), F.lit("/people"))).when(path == card, F.replace(text, F.lit("useThing"), F.lit("useOther"))).otherwise(text))
    new = new.withColumn("hash", F.sha1("text")).cache()
    store.publish(code_graph.build(files.withColumn("hash", F.sha1("text"))))
    part, plan = code_graph.update(store.tables(), new)
    assert plan == "partial"
    store.publish(part)
    part = store.tables()
    store.publish(code_graph.build(new))
    assert code_graph.differences(store.tables(), part).filter("hard").collect() == []


def test_project(spark, root, tmp_path):
    p = code_graph.Project(spark, f"file://{root}", f"file://{tmp_path}/store")
    assert p.response([])["index_status"] == "missing"
    assert p.scan()["data"]["plan"] == "full" and p.scan(True)["data"]["plan"] == "none"
    assert p.ask("find_symbol", "helper")["data"][0]["name"] == "helper"
    assert p.ask("repo_map")["index_status"] == "ready"


def test_guard_output(spark):
    log = "[DS-BREAKPOINT] failed\n./frontend/lib/a.dart:12:3 bad  width\nsee scripts/check.py\nnothing\nsee scripts/check.py"
    got = {r["file"]: r for r in documents.parse_guard_output(spark, log).collect()}
    assert (got["frontend/lib/a.dart"]["line"], got["frontend/lib/a.dart"]["column"], got["frontend/lib/a.dart"]["confidence"]) == (12, 3, 0.95)
    assert got["scripts/check.py"]["line"] is None and got["scripts/check.py"]["rule"] == "DS-BREAKPOINT"
    rules = [{"id": "DS_BREAKPOINT", "domain": "ui", "match": {"outputRegex": ["bad +width", "("]}}]
    m = planning.rule_scores(documents.parse_guard_output(spark, log), rules).collect()
    assert {(r["rule_id"], round(r["score"], 2)) for r in m} >= {("DS_BREAKPOINT", 0.99)} or all(r["score"] >= 0.9 for r in m)


def test_manifest():
    pages = documents.manifest_pages("version: 1\npages:\n  - id: home\n    role: coach\n    accept:\n      required: true\n      states:\n        - open\n        - shut\n  - id: other\n    role: athlete\n")
    assert pages == [{"id": "home", "role": "coach", "accept.required": "true", "accept.states": ["open", "shut"]}, {"id": "other", "role": "athlete"}]


def test_planning(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tiers = planning.file_tiers(frame([("a",)], "file string"), frame([("b",)], "path string"), frame([("a",), ("c",)], "path string"), frame([("d", "sync_target", "frontmatter_sync"), ("e", "depends_on", "frontmatter_depends")], "target_path string, kind string, evidence_tier string"))
    assert {r["path"]: r["tier"] for r in tiers.collect()} == {"a": "must_edit", "b": "must_edit", "c": "may_inspect", "d": "may_edit", "e": "reference_only"}
    a = planning.audit(frame([("a",), ("c",), ("z",)], "path string"), tiers, frame([("bash -lc 'pytest'",)], "command string"), frame([("pytest",)], "command string")).first()
    assert (a["errors"], a["warnings"]) == (1, 1) and a["score"] == pytest.approx(1 - 0.35 - 0.12)
    gates = [{"name": "ui", "keywords": ["card", "page"], "positive_paths": ["frontend/**"], "negative_paths": ["backend/**"], "suppress_generic_markdown": True}]
    assert planning.infer_domain(gates, "a card page", ["frontend/a"]) == {"name": "ui", "confidence": pytest.approx(0.56), "evidence": ["keyword:card", "keyword:page", "changed_file:frontend/a"]}
    assert planning.infer_domain(gates, "x") is None and planning.infer_domain(gates, "x", hint="q")["confidence"] == 0.95
    reads = planning.apply_domain_gate(frame([("frontend/a", 0.9), ("backend/b", 0.9), ("x.md", 0.5), ("backend/c", 1.0)], "path string, score double"), gates[0], ["backend/b"])
    assert {r["path"]: round(r["score"], 3) for r in reads.collect()} == {"frontend/a": 0.9, "backend/b": 0.045, "x.md": 0.1, "backend/c": 0.05}
    steps = frame([(1, "edit", "python x.py", "do", 0.5), (2, "edit", "x.py", "again", 0.9), (3, "prepare", None, "read", 0.1)], "ordinal int, phase string, command string, text string, score double")
    out = planning.rerank_steps(planning.dedupe_steps(steps)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["text"]) for r in out] == [(1, "read"), (2, "do Also: again")]
    assert planning.repair_path(["a"], "guard", ["t"]) == ["run guard", "edit a", "run guard", "run t"]


def test_evaluation(spark):
    row = ("c1", ["a", "b"], ["a"], ["b"], 5, ["k"], ["k"], [], [], [], [], [], [], 100)
    names = "id string, found array<string>, expected array<string>, forbidden array<string>, limit int, chain array<string>, wanted_chain array<string>, reuse array<string>, wanted_reuse array<string>, tests array<string>, wanted_tests array<string>, reasons array<string>, wanted_reasons array<string>, latency_ms int"
    r = score_cases(spark.createDataFrame([row], names))
    x = r.first()
    assert x["must_read_precision"] == 0.5 and x["noise_suppression"] == 0.0 and x["production_score"] == pytest.approx(1 - 0.11 - 0.04)
    assert summary(r).first()["cases"] == 1
    assert slowest_stages(spark.createDataFrame([("c", "s", 3), ("d", "s", 4)], "case string, stage string, ms int")).first()["ms"] == 7


def test_profiles(spark):
    profiles = [{"name": "low", "confidence": 0.9, "match": {"any": ["card"]}, "mustRead": ["a.py", "b.py"]}, {"name": "high", "confidence": 0.97, "match": {"all": ["card", "fix"]}, "mustRead": ["c.py"], "suppressPaths": ["b.*"]}]
    chosen = discovery.workflow_profiles(profiles, "Fix card")
    assert [p["name"] for p in chosen] == ["high", "low"] and discovery.workflow_profiles(profiles, "other") == []
    files = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    assert {(r["profile"], r["path"]) for r in discovery.profile_seeds(spark, chosen, files).collect()} == {("low", "a.py")}


def test_worktree(spark):
    got = {r["path"]: r["state"] for r in repo.worktree_status(spark, " M a.py\nA  b.py\n?? c.py\nR  d.py -> e.py").collect()}
    assert got == {"a.py": "modified", "b.py": "staged", "c.py": "untracked", "e.py": "staged"}
