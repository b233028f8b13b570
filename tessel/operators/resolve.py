"""Names and paths to the files and symbols they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import base_name, first_of, is_test_path, test_command
from .combinators import best_per_key

# Endings and folders that are tried, in order.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".dart", ".py")
INDEXES = ("/index.ts", "/index.tsx", "/index.js")
DOTTED = (("", ".py"), ("backend/", ".py"), ("backend/app/", ".py"), ("src/", ".ts"))
RELATIVE = r"^\.|^[^:/]+?\.(dart|ts|tsx|js|jsx|py)$"


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(kept, "/")


def import_candidates(from_path: Column, text: Column) -> Column:
    """Paths that an import may mean, best first."""
    folder = F.when(from_path.contains("/"), F.regexp_replace(from_path, "/[^/]*$", "")).otherwise("")
    base = normal_path(F.concat_ws("/", folder, text))
    relative = F.array(base, *[F.concat(base, F.lit(e)) for e in (*ENDINGS, *INDEXES)])
    package = F.array(F.concat(F.lit("frontend/lib/"), F.regexp_replace(text, "^package:[^/]+/", "")))
    slashed = F.replace(text, F.lit("."), F.lit("/"))
    dotted = F.array(*[F.concat(F.lit(a), slashed, F.lit(b)) for a, b in DOTTED])
    return F.when(text.rlike(RELATIVE), relative).when(text.startswith("package:"), package).otherwise(dotted)


def imported_name(text: Column) -> Column:
    path_like = text.startswith("package:") | text.startswith(".") | text.contains("/")
    return F.when(path_like, F.nullif(F.regexp_replace(base_name(text), r"\.[^.]+$", ""), F.lit(""))).otherwise(F.element_at(F.split(text, r"\."), -1))


def import_bindings(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, names, text, resolved_path, confidence and evidence of every import; the first candidate that is a file is taken."""
    each = imports.select("path", "import_text").distinct()
    tried = each.select("path", "import_text", F.posexplode(import_candidates(F.col("path"), F.col("import_text"))).alias("place", "candidate"))
    hits = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = hits.groupBy("path", "import_text").agg(F.min_by("candidate", "place").alias("resolved_path"))
    out = each.join(best, ["path", "import_text"], "left")
    text, done = F.col("import_text"), F.col("resolved_path").isNotNull()
    confidence = first_of([(~done, 0.25), (text.rlike(RELATIVE), 0.85), (text.startswith("package:"), 0.78)], 0.62)
    words = lambda *w: F.array(*map(F.lit, w))
    evidence = first_of([(~done, words("unresolved")), (text.rlike(RELATIVE), words("import_resolved", "relative_import")), (text.startswith("package:"), words("import_resolved", "dart_package_import"))], words("same_module"))
    return out.select("path", imported_name(text).alias("imported_name"), imported_name(text).alias("local_name"), text.alias("source_text"), "resolved_path", confidence.alias("confidence"), evidence.alias("evidence"))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def test_targets(files: DataFrame) -> DataFrame:
    """test_path, target_path, command and confidence: the source file of the same stem (0.9), else the first whose path holds it (0.55).

    Exact stems are an equi-join. Only tests without one are matched by substring: a test meets the sources whose path has the rarest of its name's runs
    of three characters (fewer for shorter names), which is an equi-join too.
    """
    tests = files.filter(is_test_path(F.col("path"))).select(F.col("path").alias("test_path"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(base_name(F.col("test_path")), r"(_test|\.test|\.spec)\.[^.]+$", ""), r"\.[^.]+$", ""), "^test_", "")
    tests = tests.withColumn("_name", name)
    sources = files.filter(~is_test_path(F.col("path"))).select("path", stem(F.col("path")).alias("_stem"))
    exact = tests.join(sources, F.col("_name") == F.col("_stem")).groupBy("test_path").agg(F.min("path").alias("target_path")).withColumn("confidence", F.lit(0.9))
    rest = tests.join(exact.select("test_path"), "test_path", "left_anti").filter(F.length("_name") > 0)
    runs = lambda text, n: F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    low = F.lower("path")
    grams = sources.select("path", F.explode(F.concat(runs(low, 1), runs(low, 2), runs(low, 3))).alias("_gram"))
    name = F.lower("_name")
    own = F.when(F.length(name) < 3, F.array(name)).otherwise(runs(name, 3))
    asked = rest.select("test_path", name.alias("_low"), F.explode(own).alias("_gram")).join(grams.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram", "left")
    rarest = asked.groupBy("test_path", "_low").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    loose = rarest.join(grams, "_gram").filter(F.lower("path").contains(F.col("_low"))).groupBy("test_path").agg(F.min("path").alias("target_path")).withColumn("confidence", F.lit(0.55))
    out = exact.unionByName(loose)
    return out.select("test_path", "target_path", test_command(F.col("test_path")).alias("command"), "confidence")


def resolve_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """The one symbol that a name means: by qualified name, then name, then the first in a path."""
    place = F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name, 1).when(F.col("path") == name, 2)
    return symbols.withColumn("_p", place).filter("_p IS NOT NULL").orderBy("_p", "path", "start_line").limit(1).drop("_p")


def route_symbols(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """routes with the key of the symbol of that name in their file, if there is one."""
    own = symbols.groupBy(F.col("path").alias("file_path"), F.col("name").alias("symbol_name")).agg(F.max_by("symbol_key", "start_line").alias("symbol_key"))
    return routes.join(own, ["file_path", "symbol_name"], "left")


__all__ = ["best_per_key", "import_bindings", "import_candidates", "resolve_symbol", "route_symbols", "stem", "test_targets"]
