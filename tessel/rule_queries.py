"""Queries of rules, combinators, maintenance, planning and evaluation on the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import globs, rules, text
from .operators import combinators, discovery, duplicates, evaluation, impact, incremental, planning, provenance, widgets
from .queries import PATHS, SQL_PATHS, _paths, query, sql_score
from .sources import documents


def sql_cases(cases, otherwise: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v!r}' for c, v in cases)} ELSE {otherwise!r} END"


def sql_substring(expr: str, categories, otherwise: str) -> str:
    return sql_cases([(f"regexp_matches(lower({expr}), '{'|'.join(words)}')", name) for name, words in categories], otherwise)


#: File endings that pages take in turn, so that every kind of file occurs.
ENDINGS = [*rules.LANGUAGES, ".png", ".weird", ""]
ENDING = f"([{', '.join(repr(e) for e in ENDINGS)}])[page_id % {len(ENDINGS)} + 1]"


def _endings() -> F.Column:
    return F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))


@query(f"SELECT page_id, e AS ending, {sql_cases([(f'e = {k!r}', v) for k, v in rules.LANGUAGES.items()], 'text')} AS language, e IN ({', '.join(repr(e) for e in rules.LANGUAGES)}) AS indexable FROM (SELECT page_id, {ENDING} AS e FROM pages)")
def file_languages(t):
    path = F.concat(F.lit("a/Read.Me"), F.col("page_id").cast("string"), F.lit("x"), _endings())
    rows = t.pages.select("page_id", _endings().alias("ending"), F.when(_endings() == "", "a/plain").otherwise(path).alias("path"))
    return rows.select("page_id", "ending", rules.language_of(F.col("path")).alias("language"), rules.is_indexable(F.col("path")).alias("indexable"))


@query(f"SELECT category, count(*) AS n FROM (SELECT {sql_substring('text', rules.COMMAND_CATEGORIES, 'command')} AS category FROM conversations WHERE text IS NOT NULL UNION ALL SELECT {sql_substring('p_type', rules.COMMAND_CATEGORIES, 'command')} FROM part) GROUP BY 1")
def command_categories(t):
    both = t.conversations.filter("text IS NOT NULL").select("text").unionByName(t.part.select(F.col("p_type").alias("text")))
    return both.groupBy(rules.command_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


SHELLS = ('bash -lc "', "python3 ./", "sh run  ", "./", "  make   ")


@query(f"""WITH c AS (SELECT p_partkey, p_partkey % {len(SHELLS)} AS i, 'tool_' || p_partkey AS tool FROM part)
SELECT p_partkey, CASE i WHEN 2 THEN 'run ' || tool WHEN 4 THEN 'make ' || tool ELSE tool END AS command FROM c""")
def normalized_commands(t):
    tool = F.concat(F.lit("tool_"), F.col("p_partkey").cast("string"))
    i = F.col("p_partkey") % len(SHELLS)
    raw = F.concat(F.element_at(F.array(*map(F.lit, SHELLS)), (i + 1).cast("int")), F.when(i == 0, F.concat(F.lit("python "), tool, F.lit('"'))).otherwise(tool))
    return t.part.select("p_partkey", text.normalize_command(raw).alias("command"))


@query("SELECT c_custkey, '/x/:id/' || CASE WHEN c_custkey % 2 = 0 THEN ':id' ELSE ':n' || c_nationkey END AS route FROM customer")
def route_templates(t):
    raw = F.concat(F.lit("/x/{athleteId}/{"), F.when(F.col("c_custkey") % 2 == 0, "id").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), F.lit("}"))
    return t.customer.select("c_custkey", text.route_template(raw).alias("route"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || '|' || p_brand END AS found FROM part")
def json_arrays(t):
    good, broken = F.to_json(F.array("p_name", "p_brand")), F.concat(F.lit('["'), F.col("p_name"))
    raw = F.when(F.col("p_partkey") % 3 == 0, broken).otherwise(good)
    return t.part.select("p_partkey", F.array_join(text.json_strings(raw), "|").alias("found"))


GLOBS = ("**/casino*", "docs/**", "src/*/logger/*.html", "backend/**/*.html")
GLOB_SQL = r"regexp_matches(path, '^(.*/)?casino[^/]*$') OR regexp_matches(path, '^docs/') OR regexp_matches(path, '^src/[^/]*/logger/[^/]*\.html$') OR regexp_matches(path, '^backend/.*/[^/]*\.html$')"


@query(f"SELECT {GLOB_SQL} AS hit, count(*) AS n FROM {SQL_PATHS} GROUP BY 1")
def glob_matches(t):
    return _paths(t).groupBy(globs.matches_any(F.col("path"), list(GLOBS)).alias("hit")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(path || ' ' || n, '(?i)Widget|Card|Page|Screen|View|component') THEN 'component' WHEN regexp_matches(path || ' ' || n, '(?i)service|repository|client|provider') THEN 'service' WHEN regexp_matches(n, '^use[A-Z]') THEN 'hook' ELSE 'code_block' END AS kind
FROM (SELECT page_id, 'lib/' || page_id AS path, (['loadCard', 'userClient', 'useAuth', 'plain'])[page_id % 4 + 1] AS n FROM pages)""")
def reuse_types(t):
    name = F.element_at(F.array(*map(F.lit, ("loadCard", "userClient", "useAuth", "plain"))), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", discovery.reuse_type(F.concat(F.lit("lib/"), F.col("page_id").cast("string")), name).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.85 AND p >= 0.45 THEN 'reuse_as_is' WHEN s >= 0.65 AND p >= 0.4 THEN 'extend_existing' WHEN s >= 0.72 THEN 'extract_shared' ELSE 'create_new_allowed' END AS verdict
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS s, l_discount * 10.0::DOUBLE AS p FROM lineitem)""")
def reuse_verdicts(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", rules.reuse_verdict(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0).alias("verdict"))


@query(f"""SELECT n_regionkey, CASE WHEN count(DISTINCT plane) > 1 THEN 'mixed' WHEN min(plane) = 'docs' THEN 'docs_only' WHEN min(plane) = 'commandSources' THEN 'commands_only' WHEN min(plane) = 'evalSuites' THEN 'eval_only' WHEN min(plane) = 'workflowProfiles' THEN 'workflow_profiles_only' ELSE 'code_graph' END AS kind, count(*) AS changes
FROM (SELECT n_regionkey, (['docs', 'commandSources', 'evalSuites', 'workflowProfiles', 'codeGraph'])[CASE WHEN n_regionkey < 4 THEN n_regionkey ELSE n_nationkey % 5 END + 1] AS plane FROM nation) GROUP BY 1""")
def change_kinds(t):
    """Changes of one region are of one plane each, those of the last of all planes."""
    names = ("docs/a.md", "web/package.json", "agents-results/x", ".tessel/workflow-profiles.json", "src/a.py")
    path = F.element_at(F.array(*map(F.lit, names)), (F.when(F.col("n_regionkey") < 4, F.col("n_regionkey")).otherwise(F.col("n_nationkey") % 5) + 1).cast("int"))
    out = None
    for r in range(5):
        one = incremental.kind_of_change(incremental.planes(t.nation.filter(F.col("n_regionkey") == r).select(path.alias("path")), "path")).select(F.lit(r).cast("long").alias("n_regionkey"), "kind", "changes")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 7 = 0""")
def upserted(t):
    old = t.orders.select("o_orderkey", "o_orderstatus")
    new = t.orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")).unionByName(t.orders.filter("o_orderkey % 7 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return incremental.upsert(old, new, ["o_orderkey"])


@query("SELECT o_custkey, 'old' AS origin FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey % 2 = 1 AND o_custkey % 3 = 0")
def inserted(t):
    old = t.orders.filter("o_custkey % 2 = 0").select("o_custkey").distinct().withColumn("origin", F.lit("old"))
    new = t.orders.filter("o_custkey % 3 = 0").select("o_custkey", F.lit("new").alias("origin"))
    return incremental.insert_ignore(old, new, ["o_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN '2024-01-01' WHEN c_custkey % 10 = 0 THEN 'before' END AS deleted_at FROM customer")
def soft_deleted(t):
    catalog = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "before").alias("deleted_at"))
    return incremental.soft_delete(catalog, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "2024-01-01")


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS stale FROM lineitem")
def stale_edges(t):
    """Edges into rewritten symbols, told apart by whether their target still exists."""
    edges = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("to_symbol"))
    kept, stale = incremental.rewire(edges, t.lineitem.filter("l_suppkey % 2 = 1").select(F.col("l_suppkey").alias("symbol_key")))
    return kept.withColumn("stale", F.lit(False)).unionByName(stale.withColumn("stale", F.lit(True))).drop("to_symbol")


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def first_orders(t):
    return combinators.first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey").drop("o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def last_orders(t):
    return combinators.last_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(p, ' Also: ' ORDER BY k) AS o_orderpriority, min(k) AS o_orderkey FROM f GROUP BY 1""")
def merged_texts(t):
    return combinators.merge_text(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH p AS (SELECT doc_id, source AS family, lang AS role, 'r' || doc_id % 3 AS route, 'm' || doc_id % 2 AS mode, ['s' || doc_id % 4, 'all'] AS states FROM documents), s AS (SELECT family, unnest(states) AS state FROM p)
SELECT p.family, count(*) AS variants, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes, array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes, any_value(x.states) AS states
FROM p JOIN (SELECT family, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM s GROUP BY 1) x USING (family) GROUP BY p.family""")
def acceptance_matrix(t):
    name = lambda c, n: F.concat(F.lit(c), (F.col("doc_id") % n).cast("string"))
    pages = t.documents.select(F.col("source").alias("family"), F.col("lang").alias("role"), name("r", 3).alias("route"), name("m", 2).alias("mode"), F.array(name("s", 4), F.lit("all")).alias("states"))
    out = discovery.acceptance_matrix(pages)
    return out.select("family", "variants", *[F.array_join(c, ",").alias(c) for c in ("roles", "routes", "modes", "states")])


PHASE = "(['prepare', 'inspect', 'edit', 'guard', 'test', 'verify', 'other'])[c_nationkey % 7 + 1]"


@query(f"""WITH s AS (SELECT c_custkey AS ordinal, {PHASE} AS phase, c_nationkey % 7 AS place, c_acctbal AS score, CASE WHEN c_custkey % 50 = 0 THEN 'run ' || c_custkey END AS command FROM customer),
k AS (SELECT * FROM s QUALIFY command IS NOT NULL OR row_number() OVER (PARTITION BY phase, command IS NOT NULL ORDER BY score DESC, ordinal) <= 2), top AS (SELECT * FROM k ORDER BY place, score DESC, ordinal LIMIT 24)
SELECT (row_number() OVER (ORDER BY place, score DESC, ordinal))::INT AS ordinal, phase, score FROM top""")
def reranked_steps(t):
    phases = (*planning.PHASES, "other")
    phase = F.element_at(F.array(*map(F.lit, phases)), (F.col("c_nationkey") % 7 + 1).cast("int"))
    command = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("run "), F.col("c_custkey").cast("string")))
    return planning.rerank_steps(t.customer.select(F.col("c_custkey").alias("ordinal"), phase.alias("phase"), F.col("c_acctbal").alias("score"), command.alias("command"))).select("ordinal", "phase", "score")


@query("""WITH f AS (SELECT o_custkey % 50 AS tool, o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT min(k) AS ordinal, string_agg(s, ' Also: ' ORDER BY k) AS text FROM f GROUP BY tool""")
def deduplicated_steps(t):
    tool = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "python3 ").otherwise("./"), F.lit("tool_"), (F.col("o_custkey") % 50).cast("string"))
    steps = t.orders.select(F.col("o_orderkey").alias("ordinal"), F.lit("test").alias("phase"), tool.alias("command"), F.col("o_orderstatus").alias("text"), F.lit(1.0).alias("score"))
    return planning.dedupe_steps(steps).select("ordinal", "text")


GATE = {"name": "docs", "positive_paths": ["docs/**"], "negative_paths": ["backend/**"], "suppress_generic_markdown": True}


@query(f"""SELECT page_id, score * CASE WHEN starts_with(path, 'backend/') THEN 0.05 WHEN regexp_matches(path, '(?i)\\.(md|markdown)$') AND NOT starts_with(path, 'docs/') THEN 0.2 ELSE 1.0 END::DOUBLE AS score
FROM (SELECT page_id, path || CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '.x' END AS path, (page_id % 10) / 8.0::DOUBLE AS score FROM {SQL_PATHS}) WHERE score * CASE WHEN starts_with(path, 'backend/') THEN 0.05 WHEN regexp_matches(path, '(?i)\\.(md|markdown)$') AND NOT starts_with(path, 'docs/') THEN 0.2 ELSE 1.0 END::DOUBLE >= 0.05""")
def domain_gate(t):
    reads = _paths(t).select("page_id", F.concat("path", F.when(F.col("page_id") % 3 == 0, ".md").otherwise(".x")).alias("path"), ((F.col("page_id") % 10) / 8.0).alias("score"))
    return planning.apply_domain_gate(reads, GATE).select("page_id", "score")


@query("""WITH r AS (SELECT 'f' || l_suppkey AS path, 0 AS rank FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'f' || s_suppkey, 0 FROM supplier WHERE s_nationkey = 3 UNION SELECT 'f' || s_suppkey, 3 FROM supplier WHERE s_nationkey = 4
UNION SELECT 'f' || ps, CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END FROM (SELECT p_partkey AS ps, p_partkey % 3 AS k FROM part))
SELECT path, (['must_edit', 'may_edit', 'must_run', 'may_inspect', 'reference_only'])[min(rank) + 1] AS tier FROM r GROUP BY path""")
def file_tiers(t):
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    k = F.col("p_partkey") % 3
    targets = t.part.select(name("p_partkey").alias("target_path"), F.when(k == 0, "depends_on").when(k == 1, "sync").otherwise("validation_target").alias("kind"), F.when(k == 1, "frontmatter_sync").otherwise("inferred").alias("evidence_tier"))
    found = planning.file_tiers(t.lineitem.filter("l_returnflag = 'R'").select(name("l_suppkey").alias("file")), t.supplier.filter("s_nationkey = 3").select(name("s_suppkey").alias("path")), t.supplier.filter("s_nationkey = 4").select(name("s_suppkey").alias("path")), targets)
    return found.select("path", "tier")


@query("""WITH r AS (SELECT 'f' || s_suppkey AS path, 0.9::DOUBLE AS score, 'a' AS source FROM supplier UNION ALL SELECT 'f' || l_suppkey, l_discount * 10, 'b' FROM lineitem)
SELECT path, max(score) AS score, min_by(source, {'s': -score, 'x': source}) AS source FROM r GROUP BY path""")
def fused_reads(t):
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("path")
    return planning.fuse_reads((t.supplier.select(name("s_suppkey")), "a", 0.9), (t.lineitem.select(name("l_suppkey"), (F.col("l_discount") * 10).alias("score")), "b", None))


RULES = [{"id": "NAV-CLICK", "domain": "ui", "match": {"ruleIds": ["click"], "commandContains": ["check_ui"], "outputRegex": ["purch.se", "err"]}}, {"id": "view", "match": {"outputRegex": ["[bad", "a very long pattern|view"]}}]


@query("""WITH f AS (SELECT event_id, event_type AS e FROM events), r AS (
  SELECT event_id, 'NAV-CLICK' AS rule_id, least(0.99, CASE WHEN e = 'click' THEN 0.85 ELSE 0.0 END + 0.35 + CASE WHEN regexp_matches(e, 'purch.se') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(e, 'err') THEN 0.2 ELSE 0.0 END)::DOUBLE AS score FROM f
  UNION ALL SELECT event_id, 'view', least(0.99, CASE WHEN e = 'view' THEN 0.9 ELSE 0.0 END + CASE WHEN contains(e, 'view') THEN 0.35 ELSE 0.0 END)::DOUBLE FROM f)
SELECT event_id, rule_id, score FROM r WHERE score > 0""")
def guard_rule_scores(t):
    findings = t.events.select(F.col("event_id").alias("file"), F.col("event_type").alias("rule"), F.col("event_type").alias("message"))
    return planning.rule_scores(findings, RULES, "sh check_ui.sh", "").select(F.col("file").alias("event_id"), "rule_id", "score")


@query("SELECT 'f' || s_suppkey AS path, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) THEN 1.0 ELSE 0.97 END::DOUBLE AS score FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) OR s_nationkey IN (1, 2)")
def likely_files(t):
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    findings = t.lineitem.filter("l_quantity >= 50").select(name("l_suppkey").alias("file"))
    matched = t.nation.filter("n_nationkey IN (1, 2)").select(F.col("n_nationkey").alias("rule_id"))
    return planning.likely_files(findings, matched, t.supplier.select(F.col("s_nationkey").alias("rule_id"), name("s_suppkey").alias("path")))


@query(f"""SELECT p_partkey, least(1.0, {sql_score('fix the frontend steel', "(p_name || ' ' || p_type)")} * 0.45::DOUBLE + CASE p_size % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.45 ELSE 0.0 END::DOUBLE) AS score FROM part""")
def rule_relevance(t):
    rows = t.part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.when(F.col("p_size") % 3 == 0, "constraint").when(F.col("p_size") % 3 == 1, "frontend").otherwise("general").alias("category"))
    return planning.rule_relevance("fix the frontend steel", rows).select("p_partkey", "score")


@query("SELECT 'f' || s_suppkey AS path FROM supplier WHERE s_nationkey >= 10")
def outside_boundary(t):
    name = F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))
    outside, _ = planning.worktree_boundary(t.supplier.select(name.alias("path")), t.supplier.filter("s_nationkey < 10").select(name.alias("path")))
    return outside


@query("SELECT (SELECT count(*) FROM supplier WHERE s_nationkey > 20)::BIGINT AS errors, (SELECT count(*) FROM supplier WHERE s_nationkey BETWEEN 11 AND 20)::BIGINT + 2 AS warnings")
def task_audit(t):
    name = F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path")
    tiers = t.supplier.filter("s_nationkey <= 20").select(name, F.when(F.col("s_nationkey") > 10, "may_inspect").otherwise("must_edit").alias("tier"))
    planned = t.region.filter("r_regionkey < 3").select(F.concat(F.lit("python3 r"), F.col("r_regionkey").cast("string")).alias("command"))
    return planning.audit(t.supplier.select(name), tiers, planned, t.region.filter("r_regionkey = 0").select(F.lit("./r0").alias("command"))).select("errors", "warnings")


@query("SELECT event_type AS stage, sum(value::DECIMAL(18,4))::DOUBLE AS ms FROM events GROUP BY 1 ORDER BY ms DESC, stage LIMIT 5")
def slowest_stages(t):
    return evaluation.slowest_stages(t.events.select(F.col("user_id").alias("case"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,4)").alias("ms"))).withColumn("ms", F.col("ms").cast("double"))


@query(f"""WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, lower({PATHS}) AS path FROM pages), f AS (SELECT host, path, CASE WHEN regexp_matches(path, 'view_?model|provider|controller|notifier') THEN 'view_model' WHEN regexp_matches(path, 'widget|card|page|screen|view') THEN 'widget' WHEN regexp_matches(path, 'role|permission|auth') THEN 'role' ELSE 'other' END AS role FROM p),
g AS (SELECT role, count(DISTINCT path) AS files FROM f GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT path) FROM f) SELECT role, files, CASE WHEN files >= 8 THEN 'high' WHEN files >= 3 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def impact_roles(t):
    parts = t.pages.select(F.lit("related").alias("part"), F.lower(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)).alias("path"))
    return impact.impact_report(parts).select("role", "files", "risk")


@query("SELECT source AS path, array_to_string(list_sort(list(DISTINCT state)), ',') AS states FROM (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'modified' END AS state FROM documents UNION ALL SELECT source, 'untracked' FROM documents WHERE lang = 'de') WHERE source <> '' GROUP BY 1")
def changed_paths(t):
    a = t.documents.select(F.col("source").alias("path"), F.when(F.col("doc_id") % 2 == 0, "staged").otherwise("modified").alias("state"))
    return impact.changed_paths(a, t.documents.filter("lang = 'de'").select(F.col("source").alias("path"), F.lit("untracked").alias("state"))).select("path", F.array_join("states", ",").alias("states"))


CHAINS = {"a": [], "b": [4, 4], "c": [1, 2, 0], "d": [8] * 9}


@query("SELECT r_regionkey, ([0.0, 0.98, 0.78, 0.98, 0.0])[r_regionkey + 1]::DOUBLE AS confidence FROM region")
def chain_confidences(t):
    """Chains without steps, of two full ones, of three weak ones, and of nine; 0.35 + (0.25 + 0.5 + 0) / 3 + 0.18 = 0.78 for the third."""
    steps = F.element_at(F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<int>") for c in (*CHAINS.values(), [])]), (F.col("r_regionkey") + 1).cast("int"))
    return t.region.select("r_regionkey", text.chain_confidence(steps).alias("confidence"))


CONTROL = "('if', 'for', 'while', 'try', 'catch', 'switch', 'return')"


@query(rf"""WITH c AS (SELECT page_id, regexp_matches(h, 'Widget|Card|Column|Row|Text') AS w, list_filter(regexp_extract_all(h, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)\s*\(', 1), lambda x: x NOT IN ('String', 'Future', 'List', 'Map')) AS types,
regexp_extract_all(h, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS calls, list_filter(regexp_split_to_array(h, '[^A-Za-z0-9_]+'), lambda x: x IN {CONTROL}) AS control FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)),
k AS (SELECT page_id, CASE WHEN w THEN 'flutter_widget' WHEN len(calls) > 0 THEN 'service_logic' ELSE 'generic' END AS kind, array_to_string(CASE WHEN w THEN types ELSE list_concat(control, calls) END, '>') AS compact FROM c)
SELECT page_id, kind, sha1(kind || ':' || compact) AS shape_hash FROM k""")
def structural_shapes(t):
    shape = text.structural_shape(F.lit("html"), F.coalesce("html", F.lit("")))
    return t.pages.select("page_id", shape.alias("s")).select("page_id", "s.kind", F.col("s.hash").alias("shape_hash"))


def _plans(t):
    """Planning documents, one for each supplier, as files."""
    s = F.col("s_suppkey").cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = F.concat_ws(
        "\n", F.lit("---"), F.lit("owner_domain: area"), line("sync_targets: [src/a", s, ".py, near.py]"), F.lit("depends_on:"), line("  - docs/base", s, ".md"), F.lit("validation:"), line("  - pytest tests/test_a", s, ".py"), F.lit("---"),
        line("# Plan ", s), F.lit(""), line("Words of ", F.col("s_name"), "."), F.lit(""), F.lit("## Must update"), line("Change backend/b", s, ".py here"), line("- Run `make lint", s, "` soon"), F.lit("```bash"), F.lit("$ npm run build"), F.lit("```"), F.lit("## Notes"), F.lit("- see it"),
    )
    path = line("docs/plan", s, ".md")
    return t.supplier.select(path.alias("path"), F.lit("markdown").alias("language"), F.length(body).cast("long").alias("size"), body.alias("text"))


PLAN = "'docs/plan' || s_suppkey || '.md'"


@query(f"SELECT {PLAN} AS path, 'Plan ' || s_suppkey AS title, 'area' AS owner_domain, 'mixed' AS parse_mode, 0.85::DOUBLE AS confidence, 'Words of ' || s_name || '.' AS summary FROM supplier")
def planning_documents(t):
    return documents.source_documents(_plans(t)).select("path", "title", "owner_domain", "parse_mode", "confidence", "summary")


@query(f"""SELECT {PLAN} AS path, kind, target, confidence, tier FROM supplier, LATERAL (VALUES ('sync_target', 'src/a' || s_suppkey || '.py', 0.95::DOUBLE, 'frontmatter_sync'), ('sync_target', 'docs/near.py', 0.95::DOUBLE, 'frontmatter_sync'),
('depends_on', 'docs/base' || s_suppkey || '.md', 0.75::DOUBLE, 'frontmatter_depends'), ('validation_target', 'tests/test_a' || s_suppkey || '.py', 0.85::DOUBLE, 'frontmatter_validation'), ('sync_target', 'backend/b' || s_suppkey || '.py', 0.62::DOUBLE, 'heading_action_item')) v(kind, target, confidence, tier)""")
def document_targets(t):
    found = documents.source_documents(_plans(t)).select(F.explode("targets").alias("t"))
    return found.select("t.path", "t.kind", F.col("t.target_path").alias("target"), "t.confidence", F.col("t.evidence_tier").alias("tier"))


@query(f"""SELECT {PLAN} AS path, ordinal::INT AS ordinal, phase, command, category, title, confidence FROM supplier, LATERAL (VALUES (1, 'Must update', 'make lint' || s_suppkey, 'guard', NULL, 0.7::DOUBLE), (2, 'Must update', 'npm run build', 'step', NULL, 0.7::DOUBLE),
(3, 'Notes', NULL, 'step', 'see it', 0.7::DOUBLE), (4, 'frontmatter validation', 'pytest tests/test_a' || s_suppkey || '.py', 'test', NULL, 0.95::DOUBLE)) v(ordinal, phase, command, category, title, confidence)""")
def document_steps(t):
    found = documents.source_documents(_plans(t)).select(F.explode("steps").alias("s")).select("s.*")
    return found.select("path", "ordinal", "phase", "command", "category", "title", "confidence")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'MainPage' ELSE 'MainPage,Tile' || p_size END AS widgets FROM part")
def constructed_widgets(t):
    tile = F.concat(F.lit("Tile"), F.col("p_size").cast("string"))
    body = F.when(F.col("p_partkey") % 3 == 0, "return Column(x: HomeController(), y: DSBox(), z: call(1));").when(F.col("p_partkey") % 3 == 1, "MainPage( Text('a'), MainPage() )").otherwise(F.concat(F.lit("const MainPage(child: "), tile, F.lit(" (1))")))
    return t.part.select("p_partkey", F.array_join(widgets.constructed_widgets(body), ",").alias("widgets"))


@query("SELECT c_custkey, (c_custkey % 5)::INT AS required, CASE WHEN c_custkey % 5 > 2 THEN 'medium' ELSE 'low' END AS risk FROM customer")
def constructor_fits(t):
    params = F.array_join(F.concat(F.array(F.lit("super.key")), F.array_repeat(F.lit("required this.x"), (F.col("c_custkey") % 5).cast("int"))), ", ")
    return t.customer.select("c_custkey", discovery.constructor_fit(params).alias("f")).select("c_custkey", "f.required", "f.risk")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a/' || c_custkey || '.py,b/' || c_nationkey || ',c' || c_custkey || '.ts' END AS paths FROM customer")
def harvested_paths(t):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit('{"file": "a/'), k, F.lit('.py", "name": "no/t", "x": {"cols": ["n", "path"], "rows": [["q/r", "b/'), n, F.lit('"], ["s", "plain"]]}, "changed_files": ["c'), k, F.lit('.ts", ""]}'))
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(text, F.lit("]"))).otherwise(text).alias("answer"))
    return provenance.harvest_paths(rows, "c_custkey", "answer").select("c_custkey", F.array_join("paths", ",").alias("paths"))


@query("SELECT 'f' || s_suppkey AS path, CASE WHEN s_nationkey = 1 THEN 'deleted' WHEN s_nationkey = 2 THEN 'new' ELSE 'changed' END AS status FROM supplier WHERE s_nationkey IN (1, 2, 3)")
def worktree_changes(t):
    name = F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))
    entries = lambda rows, mark: rows.select(name.alias("path"), F.lit("M").alias("state"), F.lit("644").alias("mode"), F.lit(1).alias("size"), mark.alias("modified"), F.sha2(F.col("s_name"), 256).alias("sha256"))
    before = provenance.worktree_fingerprint(entries(t.supplier.filter("s_nationkey <> 2"), F.lit(0)))
    after = provenance.worktree_fingerprint(entries(t.supplier.filter("s_nationkey <> 1"), F.when(F.col("s_nationkey") == 3, 1).otherwise(0)))
    return provenance.worktree_changes(before, after)


@query("""SELECT CASE WHEN count(*) FILTER (c_mktsegment = 'AUTOMOBILE') > 0 THEN 'stale' ELSE 'metadata_only' END AS freshness, count(*) FILTER (c_custkey % 10 = 0)::BIGINT AS gaps, count(*) FILTER (c_mktsegment = 'AUTOMOBILE')::BIGINT AS outdated FROM customer""")
def coverage_summary(t):
    paths = t.customer.select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 10 == 0, "skipped").otherwise("no_recorded_issue").alias("status"), F.when(F.col("c_mktsegment") != "AUTOMOBILE", "metadata_match").alias("freshness"))
    return provenance.coverage_summary(paths).select("freshness", "gaps", "outdated")


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN 'stale_until_full_scan' WHEN event_type = 'view' THEN 'weak' WHEN event_type = 'error' THEN 'metadata_only' ELSE 'fresh' END AS state, event_type NOT IN ('click', 'view', 'error') AS strong, count(*) AS n FROM events GROUP BY ALL")
def evidence_states(t):
    kind = rules.first_of([(F.col("event_type") == "click", "git_co_change"), (F.col("event_type") == "view", "Weak_match"), (F.col("event_type") == "error", "metadata_only_row")], "route_match")
    state = provenance.evidence_freshness(kind)
    return t.events.groupBy("event_type", state.alias("state"), provenance.is_strong(state).alias("strong")).agg(F.count("*").alias("n"))


@query("SELECT p AS path, sha256(x) AS sha256 FROM (SELECT 'd' || doc_id AS p, coalesce(text, '') AS x FROM documents) ORDER BY p LIMIT 256")
def file_hashes(t):
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return provenance.file_hashes(files, files.select("path"))[0]


@query("""WITH m AS (SELECT DISTINCT source AS family, lang AS role FROM documents), r AS (SELECT lang AS route, min(source) AS f FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), c AS (SELECT source AS class, min(lang) AS f FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT family, role, CASE WHEN r.f IS NOT NULL AND c.f IS NOT NULL AND c.f = 'de' THEN 'verified' WHEN r.f IS NOT NULL AND c.f IS NOT NULL THEN 'implemented' WHEN r.f IS NOT NULL OR c.f IS NOT NULL THEN 'partial' ELSE 'missing' END AS status
FROM m LEFT JOIN r ON r.route = m.role LEFT JOIN c ON c.class = m.family""")
def acceptance_states(t):
    d = t.documents
    manifest = d.select(F.col("source").alias("family"), F.col("lang").alias("role"), F.col("lang").alias("route"), F.lit("m").alias("mode"), F.col("source").alias("class"), F.array().cast("array<string>").alias("states")).distinct()
    routes = d.filter("doc_id % 2 = 0").select(F.col("lang").alias("path"), F.col("source").alias("file_path"))
    classes = d.filter("doc_id % 3 = 0").select(F.col("source").alias("name"), F.col("lang").alias("path"), F.lit("class").alias("kind"))
    tests = d.select(F.lit("t").alias("test_path"), F.lit("de").alias("target_path")).distinct()
    return widgets.acceptance(manifest, routes, d.select(F.lit("none").alias("route"), F.lit("x").alias("file_path")).distinct(), classes, tests).select("family", "role", "status")


@query("""WITH n AS (SELECT n_regionkey, arg_min(n_nationkey, {'a': -(n_nationkey % 7), 'b': 'n' || n_nationkey}) AS best, max(n_nationkey % 7) AS w FROM nation GROUP BY 1),
s AS (SELECT s_nationkey, arg_min(s_suppkey, {'a': -(s_suppkey % 5), 'b': 's' || s_suppkey}) AS best, max(s_suppkey % 5) AS w FROM supplier GROUP BY 1)
SELECT 'r' || r_regionkey AS route, concat_ws(',', 'Page' || r_regionkey, 'n' || n.best, 's' || s.best) AS steps, CASE WHEN s.best IS NULL THEN 3 ELSE 4 END::INT AS depth, 'verified_chain' AS status
FROM region JOIN n ON n_regionkey = r_regionkey LEFT JOIN s ON s_nationkey = n.best""")
def widget_chains(t):
    """Regions build pages, which compose nations, which compose suppliers; of several the strongest."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pages = t.region.select(name("r", "r_regionkey").alias("route"), F.lit("f").alias("file_path"), name("Page", "r_regionkey").alias("page"), F.lit("p").alias("page_path"))
    edge = lambda df, a, b, c: df.select(a.alias("from_symbol"), b.alias("to_symbol"), F.lit("p").alias("to_path"), c.cast("double").alias("confidence"))
    composes = edge(t.nation, name("Page", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey") % 7).unionByName(edge(t.supplier, name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey") % 5))
    tests = t.region.select(F.lit("t").alias("test_path"), F.lit("q").alias("target_path")).distinct()
    return widgets.route_chains(pages, composes, tests, "").select("route", F.array_join("steps", ",").alias("steps"), "depth", "status")


@query("""WITH c AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS f FROM orders GROUP BY 1),
m AS (SELECT id, len(f) AS n, list_contains(f, '5-LOW')::INT AS bad, len(list_intersect(f, ['1-URGENT', '2-HIGH'])) AS good FROM c)
SELECT id, CASE WHEN n > 4 THEN 0.0 ELSE 1.0 - bad / n END::DOUBLE AS must_read_precision, (good / 2)::DOUBLE AS must_read_coverage, (1 - bad)::DOUBLE AS noise_suppression, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS latency FROM m""")
def scored_cases(t):
    empty, lit = F.array().cast("array<string>"), lambda *xs: F.array(*map(F.lit, xs))
    cases = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("found"))
    cases = cases.withColumns({"expected": lit("1-URGENT", "2-HIGH"), "forbidden": lit("5-LOW"), "limit": F.lit(4), "latency_ms": F.when(F.col("id") % 2 == 0, 2500).otherwise(2501)})
    cases = cases.withColumns({c: empty for w in ("chain", "reuse", "tests", "reasons") for c in (w, f"wanted_{w}")})
    return evaluation.score_cases(cases).select("id", "must_read_precision", "must_read_coverage", "noise_suppression", "latency")


@query("""WITH h AS (SELECT doc_id, source, sha1(coalesce(text, '')) AS x FROM documents), c AS (SELECT x, min(doc_id) AS representative FROM h GROUP BY 1 HAVING count(*) >= 2) SELECT DISTINCT c.x AS cluster_hash, representative FROM c JOIN h USING (x) WHERE source = 'src1'""")
def explained_clusters(t):
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "source", F.sha1(F.coalesce("text", F.lit(""))).alias("x"))
    members = duplicates.members(rows, "doc_id", F.col("x"), duplicates.clusters(rows, "doc_id", F.col("x"))).join(rows.select("doc_id", "path", F.lit(None).cast("string").alias("qualified_name")), "doc_id")
    return discovery.explain_reuse(rows.filter("source = 'src1'").select("path", F.lit("none").alias("qualified_name")), members)


PROFILES = [{"name": "low", "confidence": 0.9, "mustRead": ["f1", "f2", "gone"], "supporting": ["f3"]}, {"name": "high", "confidence": 0.97, "mustRead": ["f4"], "suppressPaths": ["f2", "f4"]}]


@query("SELECT profile, path, role, confidence FROM (VALUES ('low', 'f1', 'must_read', 0.9::DOUBLE), ('low', 'f3', 'supporting', 0.9::DOUBLE), ('high', 'f4', 'must_read', 0.97::DOUBLE)) v(profile, path, role, confidence) WHERE path IN (SELECT 'f' || s_suppkey FROM supplier)")
def profile_seeds(t):
    files = t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    return discovery.profile_seeds(t.spark, PROFILES, files)


@query("SELECT array_to_string(list_sort(list(DISTINCT 'f' || s_suppkey) FILTER (s_nationkey < 5)), ',') AS must_edit, array_to_string(list_sort(list(DISTINCT 'f' || s_suppkey) FILTER (s_nationkey >= 5)), ',') AS may_inspect FROM supplier")
def edit_boundary(t):
    tiers = t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.when(F.col("s_nationkey") < 5, "must_edit").otherwise("may_inspect").alias("tier"))
    return planning.edit_boundary(tiers).select(*[F.array_join(c, ",").alias(c) for c in ("must_edit", "may_inspect")])


@query("""WITH p AS (SELECT p_partkey // 50 AS answer, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS place, (p_partkey // 50) % 3 AS shape, p_partkey % 50 = 7 AS bad, * FROM part)
SELECT answer, place::BIGINT AS place, CASE WHEN NOT bad THEN p_name END AS name, CASE WHEN bad THEN NULL WHEN shape = 1 THEN 'shop.' || p_name ELSE 'q.' || p_partkey END AS qualified_name,
  CASE WHEN bad THEN NULL WHEN shape = 1 THEN 'shop/parts.ts' ELSE p_brand || '.ts' END AS path, CASE WHEN NOT bad THEN p_size END AS start_line,
  CASE WHEN bad THEN NULL WHEN shape = 1 THEN p_size ELSE p_size + 9 END AS end_line, CASE WHEN NOT bad AND shape = 0 THEN p_partkey / 2 END::DOUBLE AS score, CASE WHEN bad THEN 'a row has no symbol name' END AS reason
FROM p WHERE shape <> 2
UNION ALL SELECT DISTINCT answer, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'a group needs rows' FROM p WHERE shape = 2""")
def outside_symbols(t):
    key, bad = F.col("p_partkey"), F.col("p_partkey") % 50 == 7
    quoted = lambda *parts: F.concat(F.lit('"'), *[p.cast("string") for p in parts], F.lit('"'))
    name, size = F.when(bad, '""').otherwise(quoted(F.col("p_name"))), F.col("p_size")
    table = F.concat_ws(",", name, F.when(bad, '""').otherwise(quoted(F.lit("q."), key)), quoted(F.col("p_brand"), F.lit(".ts")), quoted(size, F.lit("-"), size + 9), (key / 2).cast("string"))
    shape = F.floor(key / 50) % 3
    row = F.concat(F.lit("["), F.when(shape == 0, table).otherwise(F.concat_ws(",", name, quoted(size))), F.lit("]"))
    # an answer is of 50 parts at most
    rows = t.part.groupBy(F.floor(key / 50).alias("answer")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("r")))).alias("all"))
    listed, shape = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["r"]), ","), F.lit("]")), F.col("answer") % 3
    text = F.when(shape == 0, F.concat(F.lit('{"cols":["name","qn","file","lines","rank"],"rows":'), listed, F.lit("}")))
    text = text.when(shape == 1, F.concat(F.lit('{"cols":["name","lines"],"groups":[{"qn_prefix":"shop","file":"shop/parts.ts","rows":'), listed, F.lit("}]}"))).otherwise('{"cols":["name"],"groups":[{"rows":3}]}')
    good, unread = provenance.symbol_table(rows.select("answer", text.alias("text")), "answer", "text")
    return good.drop("part", "kind").unionByName(unread.drop("part"), allowMissingColumns=True).withColumn("place", F.col("place").cast("long"))
