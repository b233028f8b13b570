"""Queries on the driver's tables, one for each family of operators, with the same in DuckDB SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import Intent, change_plane, entrypoint_score, first_of, freshness, suppression
from .functions.text import clamp, confidence_bucket, plain_normal, score_text
from .operators import combinators, discovery, duplicates, graph, incremental, planning, search
from .operators.evaluation import latency_score, ratio
from .plans import code_graph, suite
from .sources.documents import guard_findings
from .streaming.feed import windowed_counts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL for what plain_normal(), words_of() and tokenize() give.
NORMAL = "trim(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0]+', ' ', 'g'))"
WORDS = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9\\x{{4E00}}-\\x{{9FFF}}]+'), lambda x: length(x) > 1)"


def sql_score(query_text: str, expr: str) -> str:
    """SQL of score_text() for ASCII queries."""
    from .functions.text import query_tokens

    tokens = query_tokens(query_text)
    parts = [f"CASE WHEN list_contains({TOKENS.format(expr)}, '{t}') THEN 1.0 WHEN contains(lower(coalesce({expr}, '')), '{t}') THEN {0.5 if len(t) >= 5 else 0.0} ELSE 0.0 END" for t in tokens]
    return f"CAST(({' + '.join(parts)}) AS DOUBLE) / {float(len(tokens))}"


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS n FROM {n}" for n in TABLES))
def catalog_counts(t):
    out = None
    for n in TABLES:
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT sha1(coalesce(text, '')) AS cluster_hash, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_dup_clusters(t):
    return duplicates.clusters(t.documents, "doc_id", F.sha1(F.coalesce("text", F.lit(""))))


@query(f"SELECT sha1({NORMAL.format('text')}) AS cluster_hash, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) >= 2")
def normalized_dup_clusters(t):
    return duplicates.clusters(t.documents, "doc_id", F.sha1(plain_normal("text")))


@query(f"WITH h AS (SELECT doc_id, sha1({NORMAL.format('text')}) AS cluster_hash FROM documents), c AS (SELECT cluster_hash, min(doc_id) AS representative FROM h GROUP BY 1 HAVING count(*) >= 2) SELECT cluster_hash, representative, doc_id, 1.0::DOUBLE AS similarity FROM h JOIN c USING (cluster_hash)")
def cluster_members(t):
    rows = t.documents.select("doc_id", F.sha1(plain_normal("text")).alias("h"))
    return duplicates.members(rows, "doc_id", F.col("h"), duplicates.clusters(rows, "doc_id", F.col("h")))


@query(f"""WITH w AS (SELECT doc_id, unnest(CASE WHEN len({WORDS.format('text')}) = 0 THEN [NULL] ELSE {WORDS.format('text')} END) AS tok FROM documents),
v AS (SELECT doc_id, CAST('0x' || substr(sha1(tok), 7, 2) || substr(sha1(tok), 5, 2) || substr(sha1(tok), 3, 2) || substr(sha1(tok), 1, 2) AS BIGINT) AS b FROM w),
s AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL THEN 0 WHEN (b >> i) & 1 = 1 THEN 1 ELSE -1 END) AS x FROM v, range(32) r(i) GROUP BY ALL)
SELECT doc_id, lpad(lower(to_hex(CAST(sum(CASE WHEN x > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT))), 8, '0') AS simhash FROM s GROUP BY doc_id""")
def simhash32(t):
    return duplicates.simhash_rows(t.documents, "doc_id", search.words_of(F.col("text")))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5)
SELECT a, b, i / (p.n + q.n - i) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL)
JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE i / (p.n + q.n - i) >= 0.8""")
def token_jaccard_pairs(t):
    return duplicates.token_pairs(t.documents.select("doc_id", search.words_of(F.col("text")).alias("w")), "doc_id", "w", 0.8, 5)


@query(f"""WITH r AS (SELECT doc_id, list_sort(list_distinct({WORDS.format('text')})) AS w FROM documents), c AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS class_size FROM r WHERE len(w) >= 5),
s AS (SELECT doc_id, unnest(w) AS w FROM c), n AS (SELECT doc_id, len(w) AS n FROM c),
p AS (SELECT a, count(*) AS links FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE i / (p.n + q.n - i) >= 0.8 GROUP BY a)
SELECT doc_id, class_id, class_size, coalesce(links, 0) AS links FROM c LEFT JOIN p ON a = doc_id UNION ALL SELECT doc_id, doc_id, 1, 0 FROM r WHERE len(w) < 5""")
def token_links(t):
    """Classes of equal word sets and how many other documents are alike, without a pair of copies."""
    return duplicates.token_links(t.documents.select("doc_id", search.words_of(F.col("text")).alias("w")), "doc_id", "w", 0.8, 5)


@query(f"""WITH s AS (SELECT doc_id, list_distinct({WORDS.format('text')}) AS w, sha1({NORMAL.format('text')}) AS h FROM documents), t AS (SELECT * FROM s ORDER BY doc_id LIMIT 1),
r AS (SELECT s.doc_id, CASE WHEN s.h = t.h THEN 1.0 WHEN len(s.w) = 0 OR len(t.w) = 0 THEN 0.0 ELSE len(list_intersect(s.w, t.w)) / len(list_distinct(list_concat(s.w, t.w))) END::DOUBLE AS similarity FROM s, t WHERE s.doc_id <> t.doc_id)
SELECT * FROM r WHERE similarity >= 0.05""")
def similar_to_target(t):
    rows = t.documents.select("doc_id", F.array_distinct(search.words_of(F.col("text"))).alias("w"), F.sha1(plain_normal("text")).alias("h"))
    return duplicates.similar_to(rows, "doc_id", "w", "h", rows.orderBy("doc_id").limit(1), 0.05)


@query(r"SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(html, ''), '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>{}]*>)?\s*\(', 1)), lambda x: NOT list_contains(['if', 'for', 'while', 'switch', 'return', 'print', 'debugPrint', 'super', 'setState', 'build'], x))), ',') AS calls FROM pages")
def call_tokens(t):
    from .functions.text import call_tokens as calls

    return t.pages.select("page_id", F.array_join(F.array_sort(calls("html")), ",").alias("calls"))


@query(f"SELECT page_id, url, {sql_score('blog casino html', 'url')} AS score FROM pages WHERE {sql_score('blog casino html', 'url')} > 0 ORDER BY score DESC, page_id LIMIT 50")
def route_trace(t):
    return combinators.top_k(t.pages.select("page_id", "url", score_text("blog casino html", "url").alias("score")).filter("score > 0"), 50, F.desc("score"), F.col("page_id"))


@query("""WITH calls AS (SELECT DISTINCT 'o' || l_orderkey AS from_key, l_suppkey::VARCHAR AS file, l_partkey::VARCHAR AS name FROM lineitem),
sym AS (SELECT DISTINCT 's' || l_suppkey || ':' || l_partkey AS key, l_suppkey::VARCHAR AS file, l_partkey::VARCHAR AS name FROM lineitem WHERE l_linenumber = 1),
loc AS (SELECT name, file, min(key) AS k FROM sym GROUP BY ALL), whole AS (SELECT name, min({'file': file, 'key': key}).key AS k, count(*) AS n FROM sym GROUP BY 1)
SELECT from_key, name, coalesce(loc.k, whole.k) AS to_key, CASE WHEN loc.k IS NOT NULL THEN 0.95 WHEN n = 1 THEN 0.75 ELSE 0.45 END::DOUBLE AS confidence, CASE WHEN loc.k IS NOT NULL THEN 'same_file' WHEN n = 1 THEN 'unique_name' ELSE 'ambiguous_name' END AS how
FROM calls LEFT JOIN loc USING (name, file) LEFT JOIN whole USING (name) WHERE coalesce(loc.k, whole.k) IS NOT NULL""")
def name_resolution(t):
    text = lambda c: F.col(c).cast("string")
    calls = t.lineitem.select(F.concat(F.lit("o"), text("l_orderkey")).alias("from_key"), text("l_suppkey").alias("file"), text("l_partkey").alias("name"))
    known = t.lineitem.filter("l_linenumber = 1").select(F.concat(F.lit("s"), text("l_suppkey"), F.lit(":"), text("l_partkey")).alias("key"), text("l_suppkey").alias("file"), text("l_partkey").alias("name")).distinct()
    return graph.name_resolution(calls, known)


def _supply(t) -> DataFrame:
    rows = combinators.dealt(t.lineitem.select("l_suppkey", "l_partkey"), combinators.ROWS_A_TASK, "l_suppkey", "l_partkey")
    pairs = rows.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return pairs.select(F.col("l_suppkey").alias("from_key"), F.col("l_partkey").alias("to_key"), F.lit("calls").alias("kind"), F.least(F.lit(1.0), F.col("n") / 4).alias("confidence"))


SUPPLY = "WITH e AS (SELECT l_suppkey AS f, l_partkey AS t, least(1.0, count(*) / 4)::DOUBLE AS confidence FROM lineitem GROUP BY ALL)"


@query(f"{SUPPLY} SELECT node, neighbour, kind, confidence FROM (SELECT t AS node, f AS neighbour, 'calls' AS kind, confidence, row_number() OVER (PARTITION BY t ORDER BY confidence DESC, f) AS n FROM e) WHERE n <= 3")
def callers_of(t):
    return graph.neighbours(_supply(t), t.part.select(F.col("p_partkey").alias("node")), "callers", 3)


@query(f"{SUPPLY} SELECT node, neighbour, kind, confidence FROM (SELECT f AS node, t AS neighbour, 'calls' AS kind, confidence, row_number() OVER (PARTITION BY f ORDER BY confidence DESC, t) AS n FROM e) WHERE n <= 3")
def callees_of(t):
    return graph.neighbours(_supply(t), t.supplier.select(F.col("s_suppkey").alias("node")), "callees", 3)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i FROM lineitem), k AS (SELECT c FROM s GROUP BY c HAVING count(*) BETWEEN 2 AND 30)
SELECT x.i AS a, y.i AS b, count(*) AS weight FROM s x JOIN s y ON x.c = y.c AND x.i < y.i WHERE x.c IN (SELECT c FROM k) GROUP BY ALL""")
def co_change_pairs(t):
    return graph.co_changes(t.lineitem, "l_orderkey", "l_suppkey")


@query("""WITH s AS (SELECT DISTINCT user_id || ':' || CAST(ts AS DATE) AS c, event_type AS i FROM events), k AS (SELECT c FROM s GROUP BY c HAVING count(*) BETWEEN 2 AND 30)
SELECT x.i AS a, y.i AS b, count(*) AS weight FROM s x JOIN s y ON x.c = y.c AND x.i < y.i WHERE x.c IN (SELECT c FROM k) GROUP BY ALL""")
def co_change_events(t):
    rows = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("c"), "event_type")
    return graph.co_changes(rows, "c", "event_type")


def _geo(t) -> DataFrame:
    row = lambda df, f, to, kind, w, c: df.select(f.alias("from_key"), to.alias("to_key"), F.lit(kind).alias("kind"), F.lit(w).alias("weight"), F.lit(c).alias("confidence"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = row(t.nation, key("r", "n_regionkey"), key("n", "n_nationkey"), "contains", 1.0, 1.0)
    out = out.unionByName(row(t.customer, key("n", "c_nationkey"), key("c", "c_custkey"), "imports", 0.8, 0.9))
    return out.unionByName(row(t.orders, key("c", "o_custkey"), key("o", "o_orderkey"), "co_changes", 2.0, 0.65))


GEO = "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS f, 'n' || n_nationkey AS t, 0.72::DOUBLE * 1.0 AS w, 1.0::DOUBLE AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 0.86::DOUBLE * 0.8::DOUBLE, 0.9::DOUBLE FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 0.62::DOUBLE * 2.0, 0.65::DOUBLE FROM orders)"


@query(f"{GEO}, r(node, d) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT e.t, d + 1 FROM r JOIN e ON r.node = e.f WHERE d < 3) SELECT node, min(d)::INT AS distance FROM r WHERE d > 0 GROUP BY node")
def bfs_reach(t):
    return graph.traverse(_geo(t), t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")), "downstream", 3).select("node", "distance")


@query(f"{GEO}, r(node, d, s, c) AS (SELECT 'o' || o_orderkey, 0, 1.0::DOUBLE, 1.0::DOUBLE FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT e.f, d + 1, s * e.w::DOUBLE, r.c * e.c::DOUBLE FROM r JOIN e ON r.node = e.t WHERE d < 3) SELECT node, distance, score, confidence FROM (SELECT node, d::INT AS distance, max(s) AS score, max(c) AS confidence FROM r WHERE d > 0 GROUP BY ALL)")
def impact_scored(t):
    seeds = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.traverse(_geo(t), seeds, "upstream", 3).select("node", "distance", "score", "confidence")


def _old_new(t) -> tuple[DataFrame, DataFrame]:
    """documents before and after: texts of one source change, those of another go, those of a third come."""
    old = t.documents.filter("source <> 'src7'").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("hash"))
    text = F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = t.documents.filter("source <> 'src5'").select("doc_id", F.sha1(F.coalesce(text, F.lit(""))).alias("hash"))
    return old, new


@query("SELECT doc_id, CASE source WHEN 'src7' THEN 'new' WHEN 'src5' THEN 'deleted' ELSE 'changed' END AS status FROM documents WHERE source IN ('src3', 'src5', 'src7')")
def hash_diff(t):
    return incremental.hash_diff(*_old_new(t), "doc_id", "hash")


@query("SELECT doc_id, sha1(coalesce(CASE WHEN source = 'src3' THEN text || '!' ELSE text END, '')) AS hash FROM documents WHERE source <> 'src5'")
def apply_partial(t):
    old, new = _old_new(t)
    diff = incremental.hash_diff(old, new, "doc_id", "hash")
    return incremental.apply_partial(old, diff, new.join(diff.select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query("SELECT o_orderkey, side, 'orders' AS section, o_orderstatus FROM (SELECT o_orderkey, 'missing' AS side, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'X' UNION ALL SELECT o_orderkey, 'extra', 'X' FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'X')")
def snapshot_equivalence(t):
    left = t.orders.select("o_orderkey", "o_orderstatus")
    right = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return graph.equivalence(left, right, ["o_orderkey", "o_orderstatus"], "orders")


PATHS = "regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)"


def _paths(t) -> DataFrame:
    """Paths of pages, with some that stand for other kinds of files."""
    path = F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    kind = F.when(F.col("url").startswith("https://m."), F.concat(F.lit("docs/"), path)).when(F.col("url").startswith("https://blog."), F.concat(F.lit("src/auth/logger/"), path)).when(F.col("url").startswith("http://m."), F.concat(F.lit("backend/app/api/"), path)).otherwise(F.concat(F.lit("frontend/lib/modules/dashboard/"), path))
    return t.pages.select("page_id", "url", kind.alias("path"))


SQL_PATHS = f"(SELECT page_id, url, CASE WHEN starts_with(url, 'https://m.') THEN 'docs/' WHEN starts_with(url, 'https://blog.') THEN 'src/auth/logger/' WHEN starts_with(url, 'http://m.') THEN 'backend/app/api/' ELSE 'frontend/lib/modules/dashboard/' END || {PATHS} AS path FROM pages)"


@query(f"SELECT CASE WHEN regexp_matches(path, '(^|/)(AGENTS|CLAUDE|README)\\.md$|^docs/') THEN 'docs' ELSE 'codeGraph' END AS plane, count(*) AS n FROM {SQL_PATHS} GROUP BY 1")
def change_planes(t):
    return _paths(t).groupBy(change_plane(F.col("path")).alias("plane")).agg(F.count("*").alias("n"))


def sql_bm25(table: str, key: str, text: str, terms: list[str], k: int) -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    cols = ", ".join(f"{x} AS t{i}" for i, x in enumerate(tf))
    stats = ", ".join(f"sum((t{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    one = " + ".join(f"CASE WHEN t{i} > 0 THEN greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) ELSE 0 END" for i in range(len(terms)))
    return f"""WITH b AS (SELECT {key}, len(w) AS l, {cols} FROM (SELECT {key}, {WORDS.format(text)} AS w FROM {table})), s AS (SELECT count(*) AS n, avg(l) AS a, {stats} FROM b)
SELECT {key}, {one} AS score FROM b, s WHERE {' + '.join(f't{i}' for i in range(len(terms)))} > 0 ORDER BY score DESC, {key} LIMIT {k}"""


@query(sql_bm25("documents", "doc_id", "text", ["disgusting", "attention", "pathetic"], 50))
def bm25_search(t):
    return search.bm25(t.documents, "doc_id", F.col("text"), "disgusting attention pathetic", 50)


@query("""WITH w AS (SELECT DISTINCT p_name || ' ECONO' AS "case", list_filter(string_split_regex(lower(p_name || ' ECONO'), '[^a-z0-9]+'), lambda x: length(x) > 1) AS t FROM part), x AS (SELECT DISTINCT p_name || ' ' || p_type AS text FROM part),
s AS (SELECT "case", text, list_sum(list_transform(t, lambda v: CASE WHEN list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), v) THEN 1.0::DOUBLE WHEN contains(lower(text), v) AND length(v) >= 5 THEN 0.5::DOUBLE ELSE 0::DOUBLE END)) / len(t) AS score FROM w, x)
SELECT "case", text, score FROM s WHERE score > 0""")
def suite_text_scores(t):
    """Lexical scores of all tasks (a part's name and the start of a word) against all texts, by words."""
    tasks = t.part.select(F.concat("p_name", F.lit(" ECONO")).alias("case")).distinct()
    words = suite.task_words(tasks.withColumn("task", F.col("case")))
    texts = t.part.select(F.lit("part").alias("kind"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return suite.text_scores(words, suite.words_inside(words, texts)).select("case", "text", "score")


@query("""WITH m AS (SELECT n_regionkey AS r, n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'change' WHEN 2 THEN 'rename' ELSE 'add' END AS kind FROM nation),
f AS (SELECT DISTINCT s_nationkey AS n FROM supplier), s AS (SELECT DISTINCT r FROM m),
o AS (SELECT s.r, f.n, m.kind FROM f CROSS JOIN s LEFT JOIN m ON m.r = s.r AND m.n = f.n AND m.kind <> 'add'),
rows AS (SELECT r, CASE WHEN kind = 'rename' THEN 'new' ELSE 'src' END || n || '.py' AS path, CASE WHEN kind = 'change' THEN 'y = 2' ELSE 'x = ' || n END AS text FROM o WHERE kind IS DISTINCT FROM 'delete'
  UNION ALL SELECT r, 'more' || n || '.py', 'z = 3' FROM m WHERE kind = 'add')
SELECT 'r' || r AS suite, path, sha1(text) AS hash, octet_length(encode(text))::BIGINT AS size FROM rows""")
def mutated_trees(t):
    """A suite of mutations for each region: its nations' files are deleted, changed, renamed or added to."""
    n, kinds = F.col("n_nationkey"), F.array(*map(F.lit, ("delete", "change", "rename", "add")))
    name = lambda start: F.concat(F.lit(start), n.cast("string"), F.lit(".py"))
    kind = F.element_at(kinds, (n % 4 + 1).cast("int"))
    rows = t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("suite"), n.cast("int").alias("place"), kind.alias("kind"), F.when(kind == "add", name("more")).otherwise(name("src")).alias("path"), F.when(kind == "add", "z = 3").otherwise("y = 2").alias("text"), name("new").alias("to"))
    files = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().select(name("src").alias("path"), F.concat(F.lit("x = "), n.cast("string")).alias("text"))
    return code_graph.mutated(files, rows).select("suite", "path", "hash", "size")


def _index(t) -> incremental.BucketStore:
    """A stored inverted index of all documents."""
    store = incremental.BucketStore(t.spark, combinators.scratch(t.spark, "index"))
    store.KEYS = {"postings": "term", "lengths": "doc_id"}
    text = F.col("text")
    store.publish({"postings": search.postings(t.documents, "doc_id", text, "doc_id"), "lengths": search.lengths(t.documents, text, "doc_id")})
    return store


def _asked(store: incremental.BucketStore) -> DataFrame:
    found = store.tables()
    return search.Index(found["postings"], found["lengths"], "doc_id").bm25("disgusting attention pathetic", 50)


@query(sql_bm25("documents", "doc_id", "text", ["disgusting", "attention", "pathetic"], 50))
def indexed_search(t):
    """bm25_search by the index; only the buckets of the question's terms are read."""
    return _asked(_index(t))


@query(sql_bm25("(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat(text, ' pathetic Attention span') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4)", "doc_id", "text", ["disgusting", "attention", "pathetic"], 50))
def index_update(t):
    """The index after a tenth of the documents went and a tenth changed, by a layer of postings; it must answer as one made anew."""
    store, text = _index(t), F.col("text")
    was = t.documents.filter("doc_id % 10 IN (3, 4)")
    now = was.filter("doc_id % 10 = 3").withColumn("text", F.concat_ws("", "text", F.lit(" pathetic Attention span")))
    gone = was.select("doc_id")
    store.advance(incremental.Delta(gone={"postings": gone, "lengths": gone}, rows={"postings": search.postings(now, "doc_id", text, "doc_id"), "lengths": search.lengths(now, text, "doc_id")}))
    return _asked(store)


@query(sql_bm25("(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)", "turn_id", "text", ["that", "with", "ble"], 50))
def memory_search(t):
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return search.bm25(turns, "turn_id", F.col("text"), "that with ble", 50)


@query(f"SELECT doc_id, {sql_score('theBlest attention reading', 'text')} AS score FROM documents")
def lexical_score(t):
    return t.documents.select("doc_id", score_text("theBlest attention reading", "text").alias("score"))


@query(f"""WITH a AS (SELECT path AS k, least(1.0, {sql_score('dashboard logger html', 'path')} * 0.65::DOUBLE) AS score FROM {SQL_PATHS} UNION ALL SELECT path, {sql_score('dashboard logger html', 'url')} * 0.75::DOUBLE FROM {SQL_PATHS} UNION ALL SELECT path, 0.35::DOUBLE FROM {SQL_PATHS} WHERE regexp_matches(lower(path), 'dashboard|logger|html'))
SELECT k AS path, max(score) AS score FROM a WHERE score > 0 GROUP BY 1 ORDER BY score DESC, path LIMIT 100""")
def related_fusion(t):
    files = _paths(t).select("path", F.lit("html").alias("language")).distinct()
    names = _paths(t).select("path", F.col("url").alias("name"))
    return discovery.related_files(files, names, "dashboard logger html", k=100).select("path", "score")


TASK = "add a dashboard card"


@query(f"""WITH p AS (SELECT page_id, path, {sql_score(TASK, 'path')} AS q, lower(path) AS low FROM {SQL_PATHS}),
s AS (SELECT page_id, path, q * 0.28::DOUBLE + 0.26::DOUBLE + least(1.0, CASE WHEN starts_with(low, 'frontend/lib/') THEN 0.35 ELSE 0.0 END + CASE WHEN contains(low, 'dashboard') THEN 0.28 ELSE 0.0 END)::DOUBLE * 0.24::DOUBLE + 0.12::DOUBLE
 - CASE WHEN regexp_matches(low, '^(backend|database|infra)/') THEN 0.45 ELSE 0.0 END::DOUBLE - CASE WHEN regexp_matches(low, '(maestro|patrol|screenshot|golden|ocr|qa)') THEN 0.25 ELSE 0.0 END::DOUBLE
 - least(0.24, {' + '.join(f"CASE WHEN contains(low, '{w}') THEN 0.09 ELSE 0.0 END" for w in ('lookup', 'level', 'management', 'platform', 'plan', 'admin', 'pr'))})::DOUBLE AS x FROM p)
SELECT page_id, path, greatest(0.0, least(0.99, x))::DOUBLE AS score FROM s ORDER BY score DESC, page_id LIMIT 100""")
def entrypoint_rank(t):
    intent, none = Intent.of(TASK), F.lit("")
    rows = _paths(t)
    scored = rows.select("page_id", "path", entrypoint_score(intent, F.lit("flutter_route"), none, F.col("path"), score_text(TASK, "path")).alias("score"))
    return combinators.top_k(scored, 100, F.desc("score"), F.col("page_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_per_key(t):
    return combinators.best_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", -F.col("o_totalprice"), F.col("o_orderkey"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def topk_per_group(t):
    return combinators.top_k_per_group(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), "l_suppkey", 3, F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"))


@query("SELECT o_custkey, max(o_totalprice) AS score, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS evidence, min(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS tier_rank FROM orders GROUP BY 1")
def merge_per_key(t):
    rank = first_of([(F.col("o_orderstatus") == "O", 0), (F.col("o_orderstatus") == "P", 1)], 2)
    rows = t.orders.select("o_custkey", F.col("o_totalprice").alias("score"), F.array("o_orderpriority").alias("evidence"), rank.alias("tier_rank"))
    return combinators.merge_per_key(rows, "o_custkey").withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH m AS (SELECT 'src/' || source || '/' || doc_id AS path, quality * 0.5::DOUBLE + 0.45::DOUBLE - toxic * 0.3::DOUBLE AS score, quality, toxic FROM documents JOIN labels USING (doc_id)),
f AS (SELECT *, quality = 1 AND toxic = 0 AS ok FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, path) AS n FROM f)
SELECT path, score, ok AND n <= 5 AS selected, CASE WHEN ok AND n <= 5 THEN NULL WHEN quality = 0 THEN 'insufficient_strong_evidence' ELSE 'below_must_read_threshold' END AS reason FROM r""")
def must_read_gate(t):
    rows = t.documents.join(t.labels, "doc_id").select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), (F.col("quality") * 0.5 + 0.45 - F.col("toxic") * 0.3).alias("score"), F.when(F.col("quality") == 1, F.array(F.lit("label"), F.lit("catalog"))).otherwise(F.array(F.lit("catalog"))).alias("evidence"))
    return discovery.must_read("check src quality", rows).select("path", "score", "selected", "reason")


@query(f"""WITH h AS (SELECT page_id, path, greatest(0.0, least(0.99, 0.9::DOUBLE * 0.55::DOUBLE + least(1.0, CASE WHEN starts_with(lower(path), 'frontend/lib/') THEN 0.35 ELSE 0.0 END + CASE WHEN contains(lower(path), 'dashboard') THEN 0.28 ELSE 0.0 END)::DOUBLE * 0.4::DOUBLE
 - CASE WHEN regexp_matches(lower(path), '^(backend|database|infra)/') THEN 0.45 ELSE 0.0 END::DOUBLE - CASE WHEN regexp_matches(lower(path), '(maestro|patrol|screenshot|golden|ocr|qa)') THEN 0.25 ELSE 0.0 END::DOUBLE))::DOUBLE AS score,
 regexp_matches(lower(path), '^(backend|database|infra)/') AS noise FROM {SQL_PATHS}),
a AS (SELECT *, score >= 0.72 AND NOT noise AS core FROM h), b AS (SELECT *, core AND row_number() OVER (PARTITION BY core ORDER BY score DESC, path, page_id) <= 5 AS m FROM a),
c AS (SELECT *, NOT m AND NOT noise AND row_number() OVER (PARTITION BY m, NOT noise ORDER BY score DESC, path, page_id) <= 15 AS s FROM b),
d AS (SELECT *, NOT m AND NOT s AND row_number() OVER (PARTITION BY m, s ORDER BY score DESC, path, page_id) <= 15 AS i FROM c)
SELECT page_id, path, score, CASE WHEN m THEN 'mustRead' WHEN s THEN 'shouldInspect' ELSE 'ignoreForNow' END AS tier FROM d WHERE m OR s OR i""")
def tier_read_order(t):
    from .functions.rules import module_proximity, noise_penalty

    intent, path = Intent.of(TASK), F.col("path")
    noise = noise_penalty(intent, path)
    rows = _paths(t).select("page_id", "path", clamp(F.lit(0.9) * 0.55 + module_proximity(intent, path) * 0.4 - noise, 0.99).alias("score"), (noise >= 0.35).alias("_noise"))
    out = combinators.budgeted_tiers(rows, "page_id", (F.col("score") >= 0.72) & ~F.col("_noise"), ~F.col("_noise"), 5, 15, F.desc("score"), path, F.col("page_id"))
    return out.filter("tier IS NOT NULL").drop("_noise")


@query(f"""SELECT page_id, CASE WHEN regexp_matches(low, '(screenshots?|golden|ocr|snapshot)') THEN 'screenshot_artifact' WHEN regexp_matches(low, '^(backend|database|infra)/') THEN 'backend_noise_for_frontend_task' WHEN regexp_matches(low, '(^|/)(l10n|locale|localizations?)(/|\\.|_)') THEN 'import_only_l10n_wrapper'
 WHEN regexp_matches(low, '(logger|logging)') THEN 'logger_utility' WHEN regexp_matches(low, '(utils?|helpers?|constants|shared|common)') THEN 'generic_helper' ELSE 'below_must_read_threshold' END AS reason FROM (SELECT page_id, lower(path) AS low FROM {SQL_PATHS})""")
def suppression_reason(t):
    return _paths(t).select("page_id", suppression(Intent.of(TASK), F.col("path"))["reason"].alias("reason"))


@query(f"SELECT m AS module, count(*) AS files FROM (SELECT CASE WHEN starts_with(path, 'frontend/lib/modules/') THEN 'frontend/lib/modules/' || array_to_string((string_split(substr(path, 22), '/'))[1:greatest(0, least(len(string_split(substr(path, 22), '/')) - 1, 2))], '/') WHEN starts_with(path, 'backend/app/') THEN 'backend/app/' || array_to_string((string_split(substr(path, 13), '/'))[1:greatest(0, least(len(string_split(substr(path, 13), '/')) - 1, 2))], '/') WHEN starts_with(path, 'src/') THEN 'src/' || split_part(substr(path, 5), '/', 1) END AS m FROM {SQL_PATHS}) WHERE m IS NOT NULL GROUP BY 1")
def module_rollup(t):
    from .functions.rules import module_of

    return _paths(t).select(module_of(F.col("path")).alias("m")).filter("m IS NOT NULL").groupBy(F.col("m.root").alias("module")).agg(F.count("*").alias("files"))


@query("""WITH g AS (SELECT source, count(*) AS n, sum(quality) AS good, sum(toxic) AS bad, avg(n_chars) AS len FROM documents JOIN labels USING (doc_id) GROUP BY 1),
m AS (SELECT source, greatest(0.0, 1.0 - bad / n)::DOUBLE AS precision, (good / n)::DOUBLE AS coverage, CASE WHEN len <= 2500 THEN 1.0 WHEN len <= 5000 THEN 0.8 ELSE 0.6 END::DOUBLE AS latency FROM g)
SELECT source, precision, coverage, latency, 0.22::DOUBLE * precision + 0.18::DOUBLE * coverage + 0.06::DOUBLE * latency AS score FROM m""")
def eval_metrics(t):
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"), F.avg("n_chars").alias("len"))
    m = g.select("source", F.greatest(F.lit(0.0), 1.0 - ratio(F.col("bad"), F.col("n"))).alias("precision"), ratio(F.col("good"), F.col("n")).alias("coverage"), latency_score(F.col("len")).alias("latency"))
    return m.withColumn("score", F.lit(0.22) * F.col("precision") + F.lit(0.18) * F.col("coverage") + F.lit(0.06) * F.col("latency"))


@query("SELECT o_custkey, e AS errors, w AS warnings, greatest(0.0, 1.0 - 0.35 * e - 0.12 * w)::DOUBLE AS score FROM (SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::BIGINT AS e, sum((o_orderstatus = 'P')::INT)::BIGINT AS w FROM orders GROUP BY 1)")
def audit_score(t):
    g = t.orders.groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("errors"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("warnings"))
    return g.withColumn("score", planning.audit_score(F.col("errors"), F.col("warnings")))


@query(f"SELECT page_id, path AS file, CAST(CASE WHEN l THEN page_id END AS INT) AS line, CASE WHEN l THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence FROM (SELECT *, starts_with(url, 'https') AS l FROM {SQL_PATHS}) WHERE NOT regexp_matches(path, '[:`''\")]')")
def guard_findings_log(t):
    line = F.concat(F.lit("FAIL at "), F.col("path"), F.when(F.col("url").startswith("https"), F.concat(F.lit(":"), F.col("page_id").cast("string"))).otherwise(""), F.lit(" not allowed"))
    found = _paths(t).filter(~F.col("path").rlike("[:`'\")]")).select("page_id", guard_findings(line).alias("f"))
    return found.filter("f IS NOT NULL").select("page_id", "f.file", "f.line", "f.confidence")


@query("SELECT p_partkey, 1.0 - (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) / 100.0::DOUBLE AS score FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100)")
def rank_position_score(t):
    top = combinators.top_k(t.part, 100, F.desc("p_retailprice"), F.col("p_partkey"))
    return combinators.rank_position_score(top.select("p_partkey", "p_retailprice"), F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", "score")


@query("""WITH m AS (SELECT DISTINCT event_type, CASE event_type WHEN 'view' THEN 'metadata_only' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'none' ELSE 'incremental' END AS mode FROM events),
p AS (SELECT unnest(['fileCatalog', 'symbolGraph', 'importGraph', 'routeGraph', 'testGraph', 'duplicateClusters', 'coChangeGraph']) AS plane)
SELECT event_type, plane, CASE WHEN mode = 'none' OR plane = 'fileCatalog' THEN 'fresh' WHEN plane = 'coChangeGraph' THEN 'stale_until_full_scan' WHEN mode = 'metadata_only' THEN 'stale' WHEN plane = 'duplicateClusters' THEN 'partial' ELSE 'fresh' END AS state FROM m, p""")
def freshness_table(t):
    mode = first_of([(F.col("event_type") == "view", "metadata_only"), (F.col("event_type") == "click", "partial"), (F.col("event_type") == "error", "none")], "incremental")
    return t.events.select("event_type").distinct().select("event_type", F.explode(freshness(mode)).alias("plane", "state"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(t):
    return windowed_counts(t.events.select(F.col("ts"), "event_type"))


@query("SELECT CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_buckets(t):
    return t.lineitem.groupBy(confidence_bucket(F.col("l_discount") * 10).alias("bucket")).agg(F.count("*").alias("n"))


__all__ = ["ORACLES", "QUERIES"]
