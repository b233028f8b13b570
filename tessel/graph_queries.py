"""Queries on a source tree that is made from the driver's tables, so that what must be found in it follows from those tables in SQL.

Supplier s of nation n has src/mod<n>/file<s>.py: an import of the next supplier's file, a class with a method, a helper and a route. Every third
has a test; every nation has a test of its module. A Makefile, a package.json and an AGENTS.md come from region and nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.rules import is_test_path, language_of, module_of, test_command
from .functions.text import call_tokens
from .operators import discovery, extract, graph, impact, resolve
from .operators.combinators import scratch
from .plans import code_graph, delta
from .queries import TASK, query, sql_bm25, sql_score
from .sources import repo


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def source_files(t, changed: int = 0, owners: DataFrame | None = None) -> DataFrame:
    """path, language, size, hash and text of the tree; files of the first so many suppliers have one more function each. owners (s_suppkey, s_nationkey) stand for suppliers."""
    s, n, k = F.col("s"), F.col("n"), F.col("k")
    base = (t.supplier if owners is None else owners).select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 10).alias("k"))
    nxt = base.select((s - 1).alias("s"), F.concat(F.lit("from src.mod"), n.cast("string"), F.lit(".file"), s.cast("string"), F.lit(" import run")).alias("imported"))
    rows = base.join(nxt, "s", "left")
    code = F.concat_ws(
        "\n", F.coalesce("imported", F.lit("import os")), F.lit(""), _text("class Box", s, ":"), _text("    def run_", k, "(self, a, b=1):"), _text("        return helper_", s + 1, "(a)"), F.lit(""),
        _text("def helper_", s, "(x: int) -> int:"), _text("    return run_", k, "(x) if x else helper_", s, "(x)"), _text('@router.get("/api/', s, '")'), _text("async def get_", s, "(id):"), _text("    return helper_", s, "(id)"),
    )
    if changed:
        code = F.when(s < changed, F.concat(code, _text("\ndef added_", s, "():\n    helper_", s, "(0)"))).otherwise(code)
    out = rows.select(_text("src/mod", n, "/file", s, ".py").alias("path"), code.alias("text"))
    out = out.unionByName(base.filter("s % 3 = 0").select(_text("tests/test_file", s, ".py").alias("path"), _text("def test_it():\n    helper_", s, "(1)\n    run_", k, "(2)").alias("text")))
    out = out.unionByName(base.select("n").distinct().select(_text("tests/test_mod", n, ".py").alias("path"), F.lit("def test_module():\n    pass").alias("text")))
    names = lambda df, c, key: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda r: r[c]))
    make = t.region.select("r_regionkey", F.concat(F.lit("test-"), F.lower(F.translate("r_name", " ", "-")), F.lit(":\n\tpytest")).alias("line"))
    out = out.unionByName(make.agg(names(make, "line", "r_regionkey").alias("text")).select(F.lit("Makefile").alias("path"), "text"))
    scripts = t.nation.select(F.lit(1).alias("one"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.when(F.col("n_regionkey") == 0, "eslint ").when(F.col("n_regionkey") == 1, "vite build ").otherwise("run "), F.lower("n_name")).alias("script"))
    package = scripts.groupBy().agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "script")))).alias("scripts"))).alias("text"))
    out = out.unionByName(package.select(F.lit("web/package.json").alias("path"), "text"))
    lines = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("# About "), F.col("r_name"), F.lit("\n- you must test "), F.col("n_name"), F.lit("\nplain "), F.col("n_name"), F.lit("\nNever touch "), F.col("n_name")).alias("line"))
    out = out.unionByName(lines.agg(names(lines, "line", "n_nationkey").alias("text")).select(F.lit("AGENTS.md").alias("path"), "text"))
    return out.select("path", language_of(F.col("path")).alias("language"), F.length("text").cast("long").alias("size"), F.sha1("text").alias("hash"), "text")


_TREES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def tree(t) -> dict[str, DataFrame]:
    """The tables of the tree; made once for a session and a folder, since what they come from is checkpointed."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _TREES:
        _TREES[key] = code_graph.build(source_files(t))
    return _TREES[key]


S = """s AS (SELECT s_suppkey AS s, s_nationkey AS n, s_suppkey % 10 AS k, 'src/mod' || s_nationkey || '/file' || s_suppkey || '.py' AS p FROM supplier),
tests AS (SELECT s, k, 'tests/test_file' || s || '.py' AS p FROM s WHERE s % 3 = 0), mods AS (SELECT DISTINCT n, 'tests/test_mod' || n || '.py' AS p FROM s),
sym(path, name, kind, qualified_name, start_line, end_line, s) AS (
  SELECT p, 'Box' || s, 'class', 'Box' || s, 3, 6, s FROM s UNION ALL SELECT p, 'run_' || k, 'method', 'Box' || s || '.run_' || k, 4, 6, s FROM s
  UNION ALL SELECT p, 'helper_' || s, 'function', 'helper_' || s, 7, 8, s FROM s UNION ALL SELECT p, 'get_' || s, 'function', 'get_' || s, 10, 11, s FROM s
  UNION ALL SELECT p, 'test_it', 'function', 'test_it', 1, 3, s FROM tests UNION ALL SELECT p, 'test_module', 'function', 'test_module', 1, 2, NULL FROM mods),
keyed AS (SELECT *, path || '::' || qualified_name || '::' || kind || '::' || start_line AS symbol_key FROM sym),
bind AS (SELECT a.p AS path, CASE WHEN b.s IS NULL THEN 'os' ELSE 'src.mod' || b.n || '.file' || b.s END AS source_text, b.p AS resolved_path, CASE WHEN b.s IS NULL THEN 0.25 ELSE 0.62 END::DOUBLE AS confidence FROM s a LEFT JOIN s b ON b.s = a.s + 1),
sources AS (SELECT p FROM s UNION ALL VALUES ('Makefile'), ('web/package.json'), ('AGENTS.md')),
covers AS (SELECT t.p AS test_path, s.p AS target_path, 'pytest ' || t.p AS command, 0.9::DOUBLE AS confidence FROM tests t JOIN s USING (s)
  UNION ALL SELECT m.p, min(x.p), 'pytest ' || m.p, 0.55::DOUBLE FROM mods m JOIN sources x ON contains(lower(x.p), 'mod' || m.n) GROUP BY m.p),
k AS (SELECT s, name, symbol_key FROM keyed),
links(from_symbol, to_symbol, confidence, how, from_path, to_path) AS (
  SELECT a.symbol_key, b.symbol_key, 0.75::DOUBLE, 'unique_name', a.path, b.path FROM keyed a JOIN keyed b ON a.kind = 'method' AND b.name = 'helper_' || (a.s + 1)
  UNION ALL SELECT a.symbol_key, b.symbol_key, 0.95::DOUBLE, 'same_file', a.path, b.path FROM keyed a JOIN keyed b ON a.name = 'helper_' || a.s AND b.kind = 'method' AND b.s = a.s
  UNION ALL SELECT a.symbol_key, b.symbol_key, 0.95::DOUBLE, 'same_file', a.path, b.path FROM keyed a JOIN keyed b ON a.name = 'get_' || a.s AND b.name = 'helper_' || a.s
  UNION ALL SELECT a.symbol_key, b.symbol_key, 0.75::DOUBLE, 'unique_name', a.path, b.path FROM keyed a JOIN keyed b ON a.name = 'test_it' AND b.name = 'helper_' || a.s
  UNION ALL SELECT a.symbol_key, b.f.k, CASE WHEN b.n = 1 THEN 0.75 ELSE 0.45 END::DOUBLE, CASE WHEN b.n = 1 THEN 'unique_name' ELSE 'ambiguous_name' END, a.path, b.f.p
    FROM keyed a JOIN tests t ON a.name = 'test_it' AND t.s = a.s JOIN (SELECT name, min({'p': path, 'k': symbol_key}) AS f, count(*) AS n FROM keyed WHERE kind = 'method' GROUP BY name) b ON b.name = 'run_' || t.k),
edges(from_key, to_key, kind, weight, confidence) AS (
  SELECT path, symbol_key, 'contains', 1.0::DOUBLE, 1.0::DOUBLE FROM keyed UNION ALL SELECT path, resolved_path, 'imports', 0.8::DOUBLE, 0.62::DOUBLE FROM bind WHERE resolved_path IS NOT NULL
  UNION ALL SELECT target_path, test_path, 'covered_by', 0.9::DOUBLE, confidence FROM covers)"""
WITH = f"WITH {S}"
RECURSIVE = f"WITH RECURSIVE {S}"


@query(f"""{WITH} SELECT p AS path, 'python' AS language, NOT starts_with(p, 'src/') AS is_test, 'pytest ' || p AS command, CASE WHEN starts_with(p, 'src/') THEN regexp_extract(p, 'src/([^/]*)', 1) END AS module FROM (SELECT p FROM s UNION ALL SELECT p FROM tests UNION ALL SELECT p FROM mods)
UNION ALL VALUES ('Makefile', 'makefile', FALSE, '', NULL), ('web/package.json', 'json', FALSE, '', NULL), ('AGENTS.md', 'markdown', FALSE, '', NULL)""")
def tree_files(t):
    path = F.col("path")
    return source_files(t).select("path", "language", is_test_path(path).alias("is_test"), test_command(path).alias("command"), module_of(path)["name"].alias("module"))


@query(f"""{WITH} SELECT symbol_key, path, name, kind, qualified_name, start_line::INT AS start_line, end_line::INT AS end_line, CASE WHEN kind = 'method' THEN 'Box' || s END AS container_name,
CASE WHEN kind = 'method' THEN 'self,a,b' WHEN starts_with(name, 'helper_') THEN 'x' WHEN starts_with(name, 'get_') THEN 'id' ELSE '' END AS parameters, CASE WHEN starts_with(name, 'helper_') THEN 'int' END AS return_type, 'public' AS visibility FROM keyed""")
def tree_symbols(t):
    return tree(t)["symbols"].select("symbol_key", "path", "name", "kind", "qualified_name", "start_line", "end_line", "container_name", F.array_join("parameters", ",").alias("parameters"), "return_type", "visibility")


@query(f"{WITH} SELECT path, source_text, element_at(string_split(source_text, '.'), -1) AS imported_name, resolved_path, confidence, CASE WHEN resolved_path IS NULL THEN 'unresolved' ELSE 'same_module' END AS evidence FROM bind".replace("element_at(string_split(source_text, '.'), -1)", "string_split(source_text, '.')[-1]"))
def import_bindings(t):
    return tree(t)["bindings"].select("path", "source_text", "imported_name", "resolved_path", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query(f"{WITH} SELECT from_symbol, to_symbol, from_path, to_path, 'calls' AS kind, confidence, how AS evidence FROM links")
def tree_symbol_edges(t):
    return tree(t)["symbol_edges"].select("from_symbol", "to_symbol", "from_path", "to_path", "kind", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query(f"{WITH} SELECT * FROM edges")
def tree_edges(t):
    return tree(t)["edges"].select("from_key", "to_key", "kind", "weight", "confidence")


@query(f"{WITH} SELECT * FROM covers")
def test_targets(t):
    return resolve.test_targets(source_files(t)).select("test_path", "target_path", "command", "confidence")


@query(f"{WITH} SELECT 'GET' AS method, '/api/' || r.s AS path, p AS file_path, 'get_' || r.s AS symbol_name, symbol_key FROM s r JOIN keyed ON keyed.path = r.p AND name = 'get_' || r.s")
def route_symbols(t):
    made = tree(t)
    return resolve.route_symbols(made["routes"], made["symbols"]).select("method", "path", "file_path", "symbol_name", "symbol_key")


@query(f"{WITH} SELECT 'mod' || n AS name, 'src/mod' || n AS root, 'source_module' AS type, count(*) AS files FROM s GROUP BY n")
def module_files(t):
    return tree(t)["modules"]


@query("""SELECT 'test-' || replace(lower(r_name), ' ', '-') AS name, 'make test-' || replace(lower(r_name), ' ', '-') AS command, 'Makefile' AS source_file, 'test' AS category FROM region
UNION ALL SELECT 'n' || n_nationkey, 'npm run n' || n_nationkey, 'web/package.json', CASE n_regionkey WHEN 0 THEN 'lint' WHEN 1 THEN 'build' ELSE 'command' END FROM nation""")
def tree_commands(t):
    return repo.commands(source_files(t))


@query("""SELECT 'AGENTS.md' AS source_file, 'About ' || r_name AS title, 'you must test ' || n_name AS body, 'test' AS category FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'AGENTS.md', 'About ' || r_name, 'Never touch ' || n_name, CASE WHEN regexp_matches(lower(n_name), 'frontend|flutter|ui') THEN 'frontend' WHEN regexp_matches(lower(n_name), 'backend|api|schema') THEN 'backend' ELSE 'constraint' END FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_rules(t):
    return repo.rules(source_files(t))


@query(f"""{WITH}, b AS (SELECT symbol_key, kind, s, CASE WHEN kind = 'method' THEN '    def ' || name || '(self, a, b=1):' || chr(10) || '        return helper_' || (s + 1) || '(a)' || chr(10)
 WHEN starts_with(name, 'helper_') THEN 'def ' || name || '(x: int) -> int:' || chr(10) || '    return run_' || (s % 10) || '(x) if x else ' || name || '(x)' WHEN starts_with(name, 'get_') THEN 'async def ' || name || '(id):' || chr(10) || '    return helper_' || s || '(id)'
 WHEN name = 'test_it' THEN 'def test_it():' || chr(10) || '    helper_' || s || '(1)' || chr(10) || '    run_' || (s % 10) || '(2)' END AS body FROM keyed)
SELECT symbol_key, sha1(trim(body, ' ' || chr(10))) AS body_hash, CASE WHEN kind = 'method' THEN 'helper_' || (s + 1) || ',run_' || (s % 10) WHEN contains(symbol_key, '::helper_') THEN 'helper_' || s || ',run_' || (s % 10)
 WHEN contains(symbol_key, '::get_') THEN 'get_' || s || ',helper_' || s ELSE 'helper_' || s || ',run_' || (s % 10) || ',test_it' END AS calls FROM b WHERE body IS NOT NULL""")
def code_bodies(t):
    """Bodies of symbols by their lines, with the names that they call."""
    blocks = tree(t)["code_blocks"].filter("kind <> 'class' AND name <> 'test_module'")
    return blocks.select("symbol_key", "body_hash", F.array_join(F.array_sort(call_tokens("body")), ",").alias("calls"))


def _calls(made) -> DataFrame:
    return made["symbol_edges"].withColumnsRenamed({"from_symbol": "from_key", "to_symbol": "to_key"})


@query(f"{WITH} SELECT to_symbol AS node, from_symbol AS neighbour, confidence FROM links JOIN keyed ON symbol_key = to_symbol WHERE kind = 'method' QUALIFY row_number() OVER (PARTITION BY to_symbol ORDER BY confidence DESC, from_symbol) <= 2")
def symbol_callers(t):
    made = tree(t)
    return graph.neighbours(_calls(made), made["symbols"].filter("kind = 'method'").select(F.col("symbol_key").alias("node")), "callers", 2).select("node", "neighbour", "confidence")


@query(f"""{RECURSIVE}, r(node, hop) AS (SELECT symbol_key, 0 FROM keyed WHERE name = 'test_it' UNION SELECT l.to_symbol, hop + 1 FROM r JOIN links l ON r.node = l.from_symbol WHERE hop < 3)
SELECT node, min(hop)::INT AS hop FROM r GROUP BY node HAVING min(hop) > 0""")
def symbol_trace(t):
    made = tree(t)
    return impact.trace(made["symbol_edges"], made["symbols"].filter("name = 'test_it'").select(F.col("symbol_key").alias("node")), "callees", 3).select("node", "hop")


@query(f"""{WITH}, changed AS (SELECT p FROM s WHERE s IN (2, 3, 30)), e AS (SELECT path AS p, confidence, 'imports' AS how FROM bind WHERE resolved_path IN (FROM changed) UNION ALL SELECT from_path, confidence, 'calls' FROM links WHERE to_path IN (FROM changed)
UNION ALL SELECT test_path, confidence, 'covered_by' FROM covers WHERE target_path IN (FROM changed))
SELECT p AS path, max(confidence) AS confidence FROM e WHERE p NOT IN (FROM changed) GROUP BY p""")
def change_impact(t):
    made = tree(t)
    changed = source_files(t).filter(F.col("path").rlike(r"/file(2|3|30)\.py$")).filter("path LIKE 'src/%'").select("path")
    return impact.change_impact(changed, made["bindings"], made["symbol_edges"], made["tests"]).select("path", "confidence")


@query(f"{WITH}, changed AS (SELECT p FROM s WHERE s BETWEEN 10 AND 19), e AS (SELECT path AS p FROM bind WHERE resolved_path IN (FROM changed) UNION SELECT from_path FROM links WHERE to_path IN (FROM changed)) SELECT p AS path FROM e WHERE p NOT IN (FROM changed)")
def affected_callers(t):
    made = tree(t)
    changed = source_files(t).filter(F.col("path").rlike(r"^src/.*/file1[0-9]\.py$")).select("path")
    return code_graph.affected_callers(changed, made, 10_000)


@query(f"""{WITH} SELECT from_symbol, to_symbol, confidence FROM links UNION ALL
SELECT p || '::added_' || s.s || '::function::12', symbol_key, 0.95::DOUBLE FROM s JOIN keyed ON keyed.name = 'helper_' || s.s WHERE s.s <= 5""")
def partial_update(t):
    """Edges after six files changed, by the partial plan; they must be those of a full build of the changed tree."""
    tables, plan = code_graph.update(tree(t), source_files(t, 6))
    if plan != "partial":
        raise ValueError(f"six changed files take the plan {plan}")
    return tables["symbol_edges"].select("from_symbol", "to_symbol", "confidence")


def _without_two(t) -> DataFrame:
    """The tree without file 3, with file 4 in another place and file 7 with its helper under another name and one line further down."""
    files, path, text = source_files(t), F.col("path"), F.col("text")
    moved = F.when(path.rlike(r"^src/.*/file4\.py$"), F.replace(path, F.lit("/file4.py"), F.lit("/moved4.py"))).otherwise(path)
    edited = F.when(path.rlike(r"^src/.*/file7\.py$"), F.concat(F.lit("\n"), F.replace(text, F.lit("helper_7("), F.lit("aid_7(")))).otherwise(text)
    out = files.filter(~path.rlike(r"^src/.*/file3\.py$")).select(moved.alias("path"), "language", edited.alias("text"))
    return out.select("path", "language", F.length("text").cast("long").alias("size"), F.sha1("text").alias("hash"), "text")


def _advanced(t) -> dict[str, DataFrame]:
    """The stored graph after it was published and advanced to _without_two()."""
    store = delta.GraphStore(t.spark, scratch(t.spark, "graph"))
    store.publish(tree(t))
    found, plan = delta.changes(store.tables(), _without_two(t))
    if plan != "partial":
        raise ValueError(f"four changed files take the plan {plan}")
    store.advance(found)
    return store.tables()


@query(f"""{WITH}, t AS (SELECT replace(p, '/file4.py', '/moved4.py') AS p, s, k FROM s WHERE s <> 3), x AS (SELECT a.p AS path, b.s AS next, b.p AS to_path FROM t a LEFT JOIN s b ON b.s = a.s + 1)
SELECT path, CASE WHEN next IS NULL OR next IN (3, 4) THEN NULL ELSE to_path END AS resolved_path FROM x""")
def advanced_imports(t):
    """Imports in the stored graph after a file went, one moved and one changed; only touched buckets were written."""
    return _advanced(t)["bindings"].select("path", "resolved_path")


@query(f"""{WITH}, now AS (SELECT CASE WHEN s = 4 THEN replace(path, '/file4.py', '/moved4.py') ELSE path END AS path, CASE WHEN s = 7 AND starts_with(path, 'src/') THEN replace(name, 'helper_7', 'aid_7') ELSE name END AS name, kind, s,
  CASE WHEN s = 7 AND starts_with(path, 'src/') THEN replace(qualified_name, 'helper_7', 'aid_7') ELSE qualified_name END AS qualified_name, start_line + CASE WHEN s = 7 AND starts_with(path, 'src/') THEN 1 ELSE 0 END AS start_line FROM sym WHERE s IS DISTINCT FROM 3 OR starts_with(path, 'tests/')),
nk AS (SELECT *, path || '::' || qualified_name || '::' || kind || '::' || start_line AS key FROM now),
calls AS (SELECT key, path, 'helper_' || (s + 1) AS name FROM nk WHERE kind = 'method' UNION ALL SELECT key, path, 'run_' || (s % 10) FROM nk WHERE name IN ('helper_' || s, 'aid_7') AND kind = 'function' AND starts_with(path, 'src/')
  UNION ALL SELECT key, path, CASE WHEN s = 7 THEN 'aid_7' ELSE 'helper_' || s END FROM nk WHERE name = 'get_' || s UNION ALL SELECT key, path, 'helper_' || s FROM nk WHERE name = 'test_it' UNION ALL SELECT key, path, 'run_' || (s % 10) FROM nk WHERE name = 'test_it'),
own AS (SELECT name, path, min(key) AS key FROM nk GROUP BY ALL), every AS (SELECT name, min({{'p': path, 'k': key}}) AS f, count(*) AS n FROM nk GROUP BY name)
SELECT c.key AS from_symbol, coalesce(o.key, e.f.k) AS to_symbol, CASE WHEN o.key IS NOT NULL THEN 0.95 WHEN e.n = 1 THEN 0.75 ELSE 0.45 END::DOUBLE AS confidence
FROM calls c LEFT JOIN own o ON o.name = c.name AND o.path = c.path LEFT JOIN every e ON e.name = c.name WHERE coalesce(o.key, e.f.k) <> c.key""")
def advanced_edges(t):
    """Calls in the stored graph after a file went, one moved and one changed: callers elsewhere that resolve differently follow."""
    return _advanced(t)["symbol_edges"].select("from_symbol", "to_symbol", "confidence")


@query(f"""{WITH}, hits AS ({sql_bm25('(SELECT symbol_key, name || chr(32) || kind AS text FROM keyed)', 'symbol_key', 'text', ['helper', '12', 'method'], 20).replace('WITH b AS', 'SELECT * FROM (WITH b AS')}))
SELECT h.symbol_key, path, name, 1.0::DOUBLE - (row_number() OVER (ORDER BY score DESC, h.symbol_key) - 1) / (count(*) OVER ())::DOUBLE AS score FROM hits h JOIN keyed USING (symbol_key)""")
def find_symbol_indexed(t):
    """find_symbol by the stored inverted index: only the buckets of the question's terms are read."""
    store = delta.GraphStore(t.spark, scratch(t.spark, "graph"))
    store.publish(tree(t))
    return code_graph.find_symbol(store.tables(), "helper 12 method").select("symbol_key", "path", "name", "score")


@query(f"""{WITH}, changed AS (SELECT p, n FROM s WHERE s IN (3, 8)), names AS (SELECT DISTINCT name FROM keyed WHERE path IN (SELECT p FROM changed) AND length(name) >= 3 ORDER BY name LIMIT 4),
calls AS (SELECT path, 'helper_' || (s + 1) AS name FROM keyed WHERE kind = 'method' UNION SELECT path, 'run_' || (s % 10) FROM keyed WHERE name = 'helper_' || s OR name = 'test_it' UNION SELECT path, 'helper_' || s FROM keyed WHERE name IN ('helper_' || s, 'get_' || s, 'test_it')
  UNION SELECT path, name FROM keyed WHERE kind IN ('method', 'function') AND s IS NOT NULL AND name <> 'test_it' UNION SELECT path, name FROM keyed WHERE name IN ('test_it', 'test_module')),
token AS (SELECT name, path FROM calls WHERE name IN (FROM names) AND path NOT IN (SELECT p FROM changed) QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) <= 2),
near AS (SELECT s.p, s.n FROM s WHERE n IN (SELECT n FROM changed) AND p NOT IN (SELECT p FROM changed) QUALIFY row_number() OVER (PARTITION BY n ORDER BY p) <= 3),
every AS (SELECT path, 'import' AS reason FROM bind WHERE resolved_path IN (SELECT p FROM changed) UNION SELECT from_path, 'call' FROM links WHERE to_path IN (SELECT p FROM changed) UNION SELECT path, 'token' FROM token UNION SELECT p, 'module' FROM near)
SELECT path, string_agg(reason, ',' ORDER BY reason) AS reasons FROM every WHERE path NOT IN (SELECT p FROM changed) GROUP BY path ORDER BY path LIMIT 6""")
def expanded_callers(t):
    """Who two changed files may touch, with caps low enough to bind: 4 names, 2 files a name, 3 a module, 6 in all."""
    changed = source_files(t).filter(F.col("path").rlike(r"^src/.*/file[38]\.py$")).select("path")
    return code_graph.expanded_callers(changed, tree(t), 4, 2, 3, 6)[0].withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{WITH}, m AS (SELECT path, 'src/' || regexp_extract(path, 'src/([^/]*)', 1) AS root, resolved_path AS to_path, 'src/' || regexp_extract(resolved_path, 'src/([^/]*)', 1) AS to_root FROM bind WHERE resolved_path IS NOT NULL),
ranked AS (SELECT root, 'depends_on' AS what, to_path AS x FROM m WHERE root <> to_root UNION SELECT to_root, 'used_by', path FROM m WHERE root <> to_root UNION SELECT 'src/mod' || n, 'core_files', p FROM s
  UNION SELECT 'src/' || regexp_extract(target_path, 'src/([^/]*)', 1), 'tests', test_path FROM covers),
few AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY root, what ORDER BY x) <= CASE what WHEN 'core_files' THEN 12 WHEN 'tests' THEN 12 ELSE 20 END),
lists AS (SELECT root, string_agg(x, ',' ORDER BY x) FILTER (what = 'core_files') AS core_files, string_agg(x, ',' ORDER BY x) FILTER (what = 'depends_on') AS depends_on, string_agg(x, ',' ORDER BY x) FILTER (what = 'used_by') AS used_by, string_agg(x, ',' ORDER BY x) FILTER (what = 'tests') AS tests FROM few GROUP BY root)
SELECT regexp_extract(root, '[^/]*$') AS name, root, core_files, depends_on, used_by, tests FROM lists ORDER BY name, root LIMIT 30""")
def module_map(t):
    made = tree(t)
    lists = [F.array_join(c, ",").alias(c) for c in ("core_files", "depends_on", "used_by", "tests")]
    return discovery.module_map(made["modules"], made["files"], made["edges"], made["tests"]).select("name", "root", *lists)


@query(f"""{WITH}, hits AS ({sql_bm25('(SELECT symbol_key, name || chr(32) || kind AS text FROM keyed)', 'symbol_key', 'text', ['helper', '12', 'method'], 20).replace('WITH b AS', 'SELECT * FROM (WITH b AS')}))
SELECT h.symbol_key, path, name, 1.0::DOUBLE - (row_number() OVER (ORDER BY score DESC, h.symbol_key) - 1) / (count(*) OVER ())::DOUBLE AS score FROM hits h JOIN keyed USING (symbol_key)""")
def find_symbol(t):
    return code_graph.find_symbol(tree(t), "helper 12 method").select("symbol_key", "path", "name", "score")


@query(f"""{WITH}, r AS (SELECT '/api/' || s AS path, 'get_' || s AS name, p AS file_path FROM s)
SELECT path, file_path, greatest({sql_score('api file12 get 7', 'path')}, {sql_score('api file12 get 7', 'name')}, {sql_score('api file12 get 7', 'file_path')}) AS score FROM r ORDER BY score DESC, path, file_path LIMIT 20""")
def route_search(t):
    return discovery.trace_route(tree(t)["routes"], "api file12 get 7").select("path", "file_path", "score")


@query(f"""{WITH}, targets AS (SELECT p FROM s WHERE s % 7 = 0),
e AS (SELECT p AS target, 'path_token' AS type, p AS detail, {sql_score('helper file7', 'p')} AS score FROM targets UNION ALL
  SELECT path, 'symbol_token', qualified_name, {sql_score('helper file7', "(name || chr(32) || qualified_name)")} FROM keyed WHERE path IN (FROM targets)
  UNION ALL SELECT p, 'entrypoint', 'get_' || s, 0.8::DOUBLE FROM s WHERE p IN (FROM targets) UNION ALL SELECT resolved_path, 'graph_proximity', count(*)::VARCHAR, 0.5::DOUBLE FROM bind WHERE resolved_path IN (FROM targets) GROUP BY resolved_path),
g AS (SELECT target, sum(score) AS total, string_agg(type || ':' || detail, ',' ORDER BY type, detail) AS evidence FROM e WHERE score > 0 GROUP BY target)
SELECT p AS target, round(least(1.0, coalesce(total, 0) / 2), 2)::DOUBLE AS score, evidence FROM targets LEFT JOIN g ON p = target""")
def why_related_files(t):
    made = tree(t)
    targets = source_files(t).filter("path LIKE 'src/%'").filter(F.regexp_extract("path", r"file(\d+)", 1).try_cast("int") % 7 == 0).select(F.col("path").alias("target"))
    out = discovery.why_related(targets, "helper file7", made["symbols"], made["routes"], made["edges"])
    return out.select("target", "score", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["type"], e["detail"])), ",").alias("evidence"))


@query(f"""{RECURSIVE}, e AS (SELECT to_key AS u, from_key AS v, CASE kind WHEN 'covered_by' THEN 1.0 WHEN 'imports' THEN 0.86 ELSE 0.72 END::DOUBLE * least(2.0, weight) AS w, confidence AS c FROM edges),
start AS (SELECT p FROM s WHERE s = 20), r(node, d, score, c) AS (SELECT p, 0, 1.0::DOUBLE, 1.0::DOUBLE FROM start UNION ALL SELECT e.v, d + 1, score * e.w, r.c * e.c FROM r JOIN e ON r.node = e.u WHERE d < 2)
SELECT node AS path, d::INT AS distance, score, c AS confidence FROM r WHERE d > 0""")
def file_impact(t):
    start = t.supplier.filter("s_suppkey = 20").select(_text("src/mod", F.col("s_nationkey"), "/file20.py").alias("node"))
    return graph.traverse(tree(t)["edges"], start, "upstream", 2, 60).select(F.col("node").alias("path"), "distance", "score", "confidence")


@query(f"""{WITH}, q(name, place) AS (VALUES ('helper_3', 0), ('run_4', 1)) SELECT q.name AS asked, first(symbol_key ORDER BY path, start_line) AS symbol_key FROM q JOIN keyed ON keyed.name = q.name GROUP BY ALL""")
def resolved_symbols(t):
    symbols = tree(t)["symbols"]
    one = lambda name: resolve.resolve_symbol(symbols, name).select(F.lit(name).alias("asked"), "symbol_key")
    return one("helper_3").unionByName(one("run_4"))


@query(f"""{WITH} SELECT p AS path, CASE WHEN b.resolved_path IS NULL THEN NULL ELSE b.resolved_path END AS imports, t.p2 AS test_path, CASE WHEN b.resolved_path IS NOT NULL OR t.p2 IS NOT NULL THEN 'verified_chain' ELSE 'candidate_chain' END AS chain_type
FROM s JOIN bind b ON b.path = s.p LEFT JOIN (SELECT target_path, min(test_path) AS p2 FROM covers GROUP BY 1) t ON t.target_path = s.p""")
def feature_traces(t):
    made = tree(t)
    entries = made["routes"].select(F.lit("fastapi_route").alias("type"), F.col("name").alias("symbol"), F.col("file_path").alias("path"), F.lit(1.0).alias("score"))
    return discovery.trace_feature(entries, made["bindings"], made["tests"]).select("path", F.array_join("imports", ",").alias("imports"), "test_path", "chain_type")


@query(f"{WITH} SELECT 'symbols' AS tbl, count(*) AS rows FROM keyed UNION ALL SELECT 'bindings', count(*) FROM bind UNION ALL SELECT 'symbol_edges', count(*) FROM links UNION ALL SELECT 'tests', count(*) FROM covers UNION ALL SELECT 'routes', count(*) FROM s")
def tree_counts(t):
    made = tree(t)
    return discovery.repo_map(made["files"], {k: made[k] for k in ("symbols", "bindings", "symbol_edges", "tests", "routes")})[1].withColumnRenamed("table", "tbl")


@query(f"{WITH} SELECT language, count(*) AS files FROM (SELECT 'python' AS language FROM s UNION ALL SELECT 'python' FROM tests UNION ALL SELECT 'python' FROM mods UNION ALL VALUES ('makefile'), ('json'), ('markdown')) GROUP BY 1")
def tree_languages(t):
    files = source_files(t)
    return discovery.repo_map(files, {"files": files})[0]


@query(f"{WITH} SELECT path, name, kind FROM sym")
def extracted_symbols(t):
    return extract.symbols(extract.extract_files(source_files(t))).select("path", "name", "kind")


CASES = [{"id": "callers", "kind": "callers", "of": "helper_4"}, {"id": "callees", "kind": "callees", "of": "get_5"}, {"id": "trace", "kind": "trace", "of": "get_6"}]


@query(f"""{RECURSIVE}, r(node, hop) AS (SELECT symbol_key, 0 FROM keyed WHERE name = 'get_6' UNION SELECT l.to_symbol, hop + 1 FROM r JOIN links l ON r.node = l.from_symbol WHERE hop < 3)
SELECT 'callers' AS "case", from_symbol AS key FROM links JOIN keyed ON symbol_key = to_symbol WHERE name = 'helper_4' UNION ALL SELECT 'callees', to_symbol FROM links JOIN keyed ON symbol_key = from_symbol WHERE name = 'get_5'
UNION ALL SELECT 'trace', min(hop) || ' ' || node FROM r GROUP BY node HAVING min(hop) > 0""")
def query_answers(t):
    return code_graph.query_answers(tree(t), CASES)


@query(f"""{WITH} SELECT 'tests' AS section, '{{"test_path":"' || test_path || '","target_path":"' || target_path || '"}}' AS row FROM covers UNION ALL
SELECT 'bindings', '{{"path":"' || path || '","source_text":"' || source_text || '","resolved_path":' || CASE WHEN resolved_path IS NULL THEN 'null' ELSE '"' || resolved_path || '"' END || '}}' FROM bind""")
def graph_snapshot(t):
    return code_graph.snapshot(tree(t)).filter("section IN ('tests', 'bindings')")


@query(f"{WITH} SELECT from_symbol, to_symbol FROM links WHERE to_path IN (SELECT p FROM s WHERE s <= 3)")
def stale_after_deletion(t):
    """Edges into symbols of four files that a later graph no longer has."""
    made = tree(t)
    gone = F.regexp_extract("path", r"^src/.*/file([0-9]+)\.py$", 1)
    return code_graph.stale_edges(made, {"symbols": made["symbols"].filter(~gone.isin("0", "1", "2", "3"))}).select("from_symbol", "to_symbol")


@query(f"{WITH} SELECT test_path AS path, confidence AS score FROM covers WHERE target_path IN (SELECT p FROM s WHERE s IN (3, 6, 9))")
def changed_tests(t):
    made = tree(t)
    changed = [r["path"] for r in source_files(t).filter(F.col("path").rlike(r"^src/.*/file[369]\.py$")).select("path").collect()]
    related = made["files"].limit(0).select("path", F.lit(0.0).alias("score"))
    return discovery.related_tests(made["tests"], made["commands"], related, changed, "none")[0].select("path", "score")


__all__ = ["TASK", "source_files", "tree"]
