import pytest
from pyspark.sql import functions as F

from tessel.functions import globs, rules, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "want"), [("getUserName", ["get", "user", "name"]), ("a-bc_d", ["bc"]), ("", []), (None, []), ("页面card", ["页面card"])])
def test_tokenize(spark, value, want):
    assert one(spark, value, text.tokenize("x")) == want
    if value is not None:
        assert text.query_tokens(value) == want


def test_score_text(spark):
    assert one(spark, "src/login_page.dart", text.score_text("login page", "x")) == 1.0
    assert one(spark, "src/loginpage.dart", text.score_text("login page", "x")) == 0.25
    assert one(spark, "x", text.score_text("", "x")) == 0.0
    assert one(spark, None, text.score_text("abc", "x")) == 0.0


def test_normalized_tokens_are_constant(spark):
    """With tokens of the normalised text every body has the one token id and the same fingerprint."""
    body = "function foo(a) { return bar(a, 'x', 12) } // z"
    f = one(spark, body, text.fingerprint("x", "normalized"))
    assert f["tokens"] == ["id"] and f["simhash"] != "00000000"
    assert one(spark, "x", text.simhash(F.array(F.lit("id")))) == "fc5dea87"
    assert one(spark, "x", text.simhash(F.array().cast("array<string>"))) == "00000000"


def test_renamed_bodies_have_one_hash(spark):
    a, b, c = (one(spark, s, text.fingerprint("x"))["normalized_hash"] for s in ("return foo(1, 'a'); # c", "return  bar(22, 'b');", "return foo[1, 'a'];"))
    assert a == b != c


def test_simhash_by_hand(spark):
    import hashlib

    words = ["alpha", "beta", "gamma", "delta"]
    votes = [0] * 32
    for w in words:
        d = hashlib.sha1(w.encode()).digest()
        for b in range(32):
            votes[b] += 1 if d[b // 8] & (1 << b % 8) else -1
    want = f"{sum(1 << b for b in range(32) if votes[b] > 0):08x}"
    assert one(spark, "x", text.simhash(F.array(*map(F.lit, words)))) == want


def test_shape_and_calls(spark):
    shape = one(spark, "Column(children: [Text('a'), String()])", text.structural_shape(F.lit("dart"), F.col("x")))
    assert (shape["kind"], shape["tokens"]) == ("flutter_widget", ["Column", "Text"])
    assert one(spark, "if (a) { svc.load(x); print(y) }", text.structural_shape(F.lit("python"), F.col("x")))["shape"] == "service_logic(if>load)"
    assert one(spark, "if (a) foo(bar<int>(1)); foo(2); super(3)", text.call_tokens("x")) == ["foo", "bar"]


@pytest.mark.parametrize(("pattern", "path", "yes"), [("**/x.py", "a/b/x.py", True), ("**/x.py", "x.py", True), ("a/*.py", "a/b/c.py", False), ("a/**", "a/b/c.py", True), ("*.md", "a.md", True)])
def test_globs(spark, pattern, path, yes):
    assert one(spark, path, globs.matches_any(F.col("x"), [pattern])) is yes


def test_glob_without_optional_prefix(spark):
    assert one(spark, "x.py", globs.matches_any(F.col("x"), ["**/x.py"], False)) is False
    assert globs.gitignore_patterns("# c\n!k\nbuild/\n*.log\na/b") == ["build/**", "**/*.log", "a/b"]


@pytest.mark.parametrize(("path", "want"), [("a/b.tsx", "typescript"), ("Makefile", "makefile"), ("x/README", "text"), ("pubspec.yaml", "yaml"), ("a.unknown", "text")])
def test_language(spark, path, want):
    assert one(spark, path, rules.language_of(F.col("x"))) == want


@pytest.mark.parametrize(("path", "want"), [("frontend/lib/modules/core/dash/a.dart", ("core/dash", "frontend/lib/modules/core/dash", "flutter_module")), ("backend/app/api/v1/x.py", ("api/v1", "backend/app/api/v1", "backend_area")), ("src/graph/a.ts", ("graph", "src/graph", "source_module")), ("README.md", None)])
def test_modules(spark, path, want):
    m = one(spark, path, rules.module_of(F.col("x")))
    assert (m and tuple(m)) == want


@pytest.mark.parametrize(
    ("path", "reason"),
    [("e2e/a.dart", "e2e_artifact"), ("x/screenshots/a", "screenshot_artifact"), ("qa/m.txt", "qa_manifest_artifact"), ("backend/a.py", "backend_noise_for_frontend_task"), ("lib/a.g.dart", "generated_api_model"), ("lib/l10n/a.dart", "import_only_l10n_wrapper"), ("lib/logger.dart", "logger_utility"), ("lib/api_error.dart", "api_error_wrapper"), ("lib/auth_user_cache.dart", "auth_cache_dependency"), ("lib/theme/a.dart", "theme_token_support"), ("frontend/lib/modules/design_system/components/b.dart", "design_system_base_component_support"), ("lib/utils/a.dart", "generic_helper"), ("lib/a.dart", "below_must_read_threshold")],
)
def test_suppressions(spark, path, reason):
    assert one(spark, path, rules.suppression(rules.Intent.of("build a card widget"), F.col("x")))["reason"] == reason


def test_later_suppressions(spark):
    intent = rules.Intent.of("xyz")
    tier = lambda t: one(spark, "lib/a.dart", rules.suppression(intent, F.col("x"), F.lit(t)))["reason"]
    assert tier("framework_dependency") == "framework_dependency_only" and tier("supporting_dependency") == "supporting_dependency_only"
    flag = lambda **kw: one(spark, "lib/a.dart", rules.suppression(intent, F.col("x"), **{k: F.lit(v) for k, v in kw.items()}))["reason"]
    assert flag(test_noise=True) == "test_noise" and flag(noisy=True) == "domain_noise" and flag(enough=False) == "insufficient_strong_evidence"
    assert one(spark, "lib/theme/a.dart", rules.suppression(rules.Intent.of("design system token"), F.col("x")))["goes_to"] == "shouldInspect"


def test_commands_and_routes(spark):
    assert one(spark, "bash -lc 'python3 ./scripts/x.py  --a'", text.normalize_command(F.col("x"))) == "scripts/x.py --a"
    assert one(spark, "/a/{athleteId}/b/{slot}", text.route_template(F.col("x"))) == "/a/:id/b/:slot"
    assert one(spark, '["a", "b"]', text.json_strings(F.col("x"))) == ["a", "b"] and one(spark, "nope", text.json_strings(F.col("x"))) == []
    assert one(spark, "x", text.chain_confidence(F.array(F.lit(4), F.lit(4)))) == 0.98 and one(spark, "x", text.chain_confidence(F.array().cast("array<int>"))) == 0.0
