"""Widget trees of Flutter code: what a route builds, what a page composes, and chains from a route to its widgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TEST_DIR, first_of
from ..functions.text import score_text
from .combinators import best_per_key

# Names that stand for the framework, not for a widget of the project.
PRIMITIVES = ("String", "Text", "Column", "Row", "Container", "Padding", "SizedBox", "Scaffold", "Card", "Center", "Expanded", "Flexible", "Stack", "Positioned", "ListView", "GridView", "SingleChildScrollView", "Builder", "GestureDetector", "InkWell", "Icon", "Divider", "Spacer", "SafeArea", "Material", "Theme", "MediaQuery", "LayoutBuilder")
NOT_WIDGET = r"^DS[A-Z]|ViewModel|DesignValues|Provider|Controller|Notifier|Duration|DateTime|Future|Stream|Iterable|List|Map|Set|Function"
CONSTRUCTED = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)\s*\("
PAGE = r"(Page|Screen|View|Shell)$"
ROUTE, BLOCK = "GoRoute(", 1800


def constructed_widgets(body: Column) -> Column:
    """Distinct names of the project's widgets that a body constructs, in order of first use."""
    found = F.array_except(F.array_distinct(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(CONSTRUCTED), F.lit(1))), F.array(*map(F.lit, PRIMITIVES)))
    return F.filter(found, lambda n: ~n.rlike(NOT_WIDGET))


def route_block(text: Column, name: Column, path: Column) -> Column:
    """The part of a file that declares one route: from the `GoRoute(` before the first mention of its name, else its path, to the next one, or BLOCK
    characters; the whole text without a mention."""
    place = lambda needle: F.when(F.coalesce(needle, F.lit("")) != "", F.position(needle, text)).otherwise(0)
    at = F.when(place(name) > 0, place(name)).otherwise(place(path))
    head = F.substring(text, F.lit(1), at + F.lit(len(ROUTE) - 1))  # up to a `GoRoute(` that begins at the mention itself
    after_last = F.length(head) - F.length(F.substring_index(head, ROUTE, -1)) + 1  # 1 if head has none
    start = F.when(after_last > 1, after_last - F.lit(len(ROUTE))).otherwise(1)
    after = F.position(F.lit(ROUTE), text, at + 1)
    end = F.when(after > 0, after).otherwise(F.least(F.length(text) + 1, at + F.lit(BLOCK)))
    return F.when(at == 0, text).otherwise(F.substring(text, start, end - start))


def composition(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_symbol, to_symbol, from_path, to_path and confidence of widgets that the bodies of others construct, by name. blocks: name, path, body; symbols: name, path, kind.

    A name is one symbol: the first by path. Names resolve by one equi-join.
    """
    known = symbols.filter("kind IN ('class', 'component')").groupBy("name").agg(F.min("path").alias("to_path"))
    uses = blocks.select(F.col("name").alias("from_symbol"), F.col("path").alias("from_path"), F.explode(constructed_widgets(F.col("body"))).alias("name")).distinct()
    page = F.col("from_symbol").rlike(PAGE)
    found = uses.join(known, "name").filter("name <> from_symbol")
    return found.select("from_symbol", F.col("name").alias("to_symbol"), "from_path", "to_path", F.when(page, 0.88).otherwise(0.8).alias("confidence"))


def route_pages(routes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """route, file_path, page and page_path of every Flutter route with the first page-like widget that its block builds. routes: path, name, file_path; files: path, text."""
    texts = files.select(F.col("path").alias("_f"), "text")
    blocks = routes.filter("framework = 'flutter_go_router'").join(texts, F.col("file_path") == F.col("_f")).withColumn("_b", route_block(F.col("text"), F.col("name"), F.col("path")))
    page = F.get(F.filter(constructed_widgets(F.col("_b")), lambda n: n.rlike(PAGE)), F.lit(0))
    found = blocks.select(F.col("path").alias("route"), "file_path", page.alias("page")).filter("page IS NOT NULL")
    known = symbols.filter("kind = 'class'").groupBy(F.col("name").alias("page")).agg(F.min("path").alias("page_path"))
    return found.join(known, "page", "left").select("route", "file_path", "page", "page_path")


def route_chains(pages: DataFrame, composes: DataFrame, tests: DataFrame, task: str, hops: int = 3) -> DataFrame:
    """For every route its steps (route, page, up to `hops` widgets, each the best composed one that isn't in the chain yet), depth, status, completeness,
    confidence and coverage (strong: a test of the page or a widget; weak: a test of the route's file; none).

    A widget's rank is its name's score for the task, then its confidence. Each hop is one join and one best-per-key for all routes at once.
    """
    chains = pages.select("route", "file_path", "page", "page_path", F.col("page").alias("_at"), F.array("page").alias("steps"), F.array("page_path").alias("paths"), F.lit(0.86 + 0.92).alias("_sum"))
    edges = composes.select(F.col("from_symbol").alias("_u"), F.col("to_symbol").alias("_v"), F.col("to_path").alias("_p"), "confidence", score_text(task, F.col("to_symbol")).alias("_s"))
    for _ in range(hops):
        step = chains.join(edges, F.col("_at") == F.col("_u")).filter(~F.array_contains("steps", F.col("_v")))
        best = best_per_key(step.select("route", "file_path", "_v", "_p", "confidence", "_s"), ["route", "file_path"], -F.col("_s"), -F.col("confidence"), F.col("_v"))
        best = best.withColumnsRenamed({"route": "_r", "file_path": "_f"}).drop("_s")
        joined = chains.join(best, (F.col("route") == F.col("_r")) & (F.col("file_path") == F.col("_f")), "left")
        more = F.col("_v").isNotNull()
        chains = joined.select("route", "file_path", "page", "page_path", F.col("_v").alias("_at"), F.when(more, F.concat("steps", F.array("_v"))).otherwise(F.col("steps")).alias("steps"), F.when(more, F.concat("paths", F.array("_p"))).otherwise(F.col("paths")).alias("paths"), (F.col("_sum") + F.coalesce("confidence", F.lit(0.0))).alias("_sum"))
    covered = tests.groupBy(F.col("target_path").alias("_t")).agg(F.min("test_path").alias("_test"))
    flat = chains.select("route", "file_path", F.explode("paths").alias("_x")).join(covered, F.col("_x") == F.col("_t")).groupBy(F.col("route").alias("_r"), F.col("file_path").alias("_f")).agg(F.min("_test").alias("_strong"))
    out = chains.join(flat, (F.col("route") == F.col("_r")) & (F.col("file_path") == F.col("_f")), "left").drop("_r", "_f").join(covered, F.col("file_path") == F.col("_t"), "left")
    depth = F.size("steps") + 1
    coverage = first_of([(F.col("_strong").isNotNull(), "strong"), (F.col("_test").isNotNull(), "weak")], "none")
    complete = first_of([((depth >= 3) & (coverage == "strong"), "complete"), (depth >= 3, "untested"), (depth == 2, "route_and_page")], "route_only")
    status = F.when(depth >= 3, "verified_chain").otherwise("partial_chain")
    confidence = F.round(F.least(F.lit(0.98), F.col("_sum") / depth), 2)
    return out.select("route", "file_path", "steps", "paths", depth.alias("depth"), status.alias("status"), complete.alias("completeness"), confidence.alias("confidence"), coverage.alias("coverage"), F.coalesce("_strong", "_test").alias("test_path"))


def route_constants(files: DataFrame) -> DataFrame:
    """file_path, name and route of string constants that look like routes; `$other` inside is replaced by that constant of the same file, once.

    files: path, text.
    """
    line = F.regexp_extract_all("text", F.lit(r"(?:static\s+)?const\s+(?:String\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=\s*['\"]/?[^'\"]*['\"]"), F.lit(0))
    each = files.select(F.col("path").alias("file_path"), F.explode(line).alias("l")).select("file_path", F.regexp_extract("l", r"([A-Za-z_][A-Za-z0-9_]*)\s*=", 1).alias("name"), F.regexp_extract("l", r"['\"]([^'\"]*)['\"]", 1).alias("raw")).filter("raw LIKE '%/%' OR raw LIKE '%$%'")
    each = each.withColumn("_needs", F.regexp_extract("raw", r"\$\{?([A-Za-z_][A-Za-z0-9_]*)", 1))
    other = each.select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("raw").alias("_raw"))
    joined = each.join(other, (F.col("file_path") == F.col("_f")) & (F.col("_needs") == F.col("_n")), "left")
    filled = F.when(F.col("_raw").isNotNull(), F.regexp_replace("raw", r"\$\{?[A-Za-z_][A-Za-z0-9_]*\}?", F.regexp_replace("_raw", r"([\\$])", r"\\$1"))).otherwise(F.col("raw"))
    return joined.select("file_path", "name", filled.alias("route")).distinct()


def acceptance(manifest: DataFrame, routes: DataFrame, constants: DataFrame, classes: DataFrame, tests: DataFrame) -> DataFrame:
    """Pages of a visual manifest (family, role, route, mode, class, states) with the file of their route, the file of their class, a test of that, and a
    status: verified (route, class and test), implemented (route and class), partial (one of them) or missing."""
    declared = routes.select(F.col("path").alias("_route"), F.col("file_path").alias("_file")).unionByName(constants.select(F.col("route").alias("_route"), F.col("file_path").alias("_file"))).filter(~F.col("_file").rlike(TEST_DIR)).groupBy("_route").agg(F.min("_file").alias("route_file"))
    known = classes.filter("kind = 'class'").groupBy(F.col("name").alias("_class")).agg(F.min("path").alias("class_file"))
    covered = tests.groupBy(F.col("target_path").alias("_target")).agg(F.min("test_path").alias("test_path"))
    out = manifest.join(declared, F.col("route") == F.col("_route"), "left").join(known, F.col("class") == F.col("_class"), "left").join(covered, F.col("class_file") == F.col("_target"), "left")
    has = lambda c: F.col(c).isNotNull()
    status = first_of([(has("route_file") & has("class_file") & has("test_path"), "verified"), (has("route_file") & has("class_file"), "implemented"), (has("route_file") | has("class_file"), "partial")], "missing")
    return out.select("family", "role", "route", "mode", "class", "states", "route_file", "class_file", "test_path", status.alias("status"))
