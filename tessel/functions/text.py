"""Tokens, lexical scores, code normalisation, fingerprints and shapes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
STOP_WORDS = ("if", "else", "for", "while", "return", "const", "final", "var", "let", "new", "class", "function", "async", "await", "import", "export", "from", "true", "false", "null", "none")
IGNORED_CALLS = ("if", "for", "while", "switch", "return", "print", "debugPrint", "super", "setState", "build")
FRAMEWORK_TYPES = ("String", "Future", "List", "Map")
NOT_WORD = r"[^a-z0-9\x{4E00}-\x{9FFF}]+"
CODE_TOKEN = r"[a-z_][a-z0-9_]*|[{}()\[\].,;:+\-*/=<>]"
CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>{}]*>)?\s*\("
TYPE_CALL = r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)\s*\("
METHOD_CALL = r"\.([A-Za-z_][A-Za-z0-9_]*)\s*\("
CONTROL = r"(?<![A-Za-z0-9_])(if|for|while|try|catch|switch|return)(?![A-Za-z0-9_])"
WIDGET = r"Widget|Card|Column|Row|Text"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Words of a name or sentence: camelCase split, lower-cased, of two characters or more; null gives none."""
    spaced = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), NOT_WORD), lambda t: F.length(t) > 1)


def score_text(query: str, candidate: Column | str) -> Column:
    """Mean over the query's tokens (known when the plan is made) of: 1 for a token of the candidate, else 0.8 for a Chinese and 0.5 for a
    long token inside its text, else 0."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(0.0)
    own, text = tokenize(candidate), F.lower(F.coalesce(_col(candidate), F.lit("")))

    def one(t: str) -> Column:
        inside = 0.8 if any("一" <= ch <= "鿿" for ch in t) else 0.5 if len(t) >= 5 else 0.0
        return F.when(F.array_contains(own, t), 1.0).when(text.contains(t), inside).otherwise(0.0)

    return reduce(lambda a, b: a + b, map(one, tokens)) / float(len(tokens))


def query_tokens(query: str) -> list[str]:
    """tokenize() for a string at hand."""
    import re

    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", query or "").lower()
    return [t for t in re.split(r"[^a-z0-9一-鿿]+", spaced) if len(t) > 1]


def clamp(x: Column, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), x))


def normalize_code(body: Column | str) -> Column:
    """Code with comments dropped, then strings, numbers and names replaced by marks; stop words stay, lower-cased.

    Comments go first, so `//` and `#` inside strings cut a line. The marks for strings and numbers are names themselves and end as ID.
    """
    x = F.coalesce(_col(body), F.lit(""))
    for pattern, mark in ((r"/\*[\s\S]*?\*/", " "), (r"//[^\n\r]*", " "), (r"#[^\n\r]*", " "), (r"\x27(?:\\.|[^\x27\\\n])*\x27|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\\n])*`", " STR "), (r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])", " NUM ")):
        x = F.regexp_replace(x, pattern, mark)
    kept = "|".join(STOP_WORDS)
    x = F.regexp_replace(x, rf"(?<![A-Za-z0-9_])(?!(?i:{kept})(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*", "ID")
    for word in STOP_WORDS:
        x = F.regexp_replace(x, rf"(?<![A-Za-z0-9_])(?i:{word})(?![A-Za-z0-9_])", word)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def plain_normal(text: Column | str) -> Column:
    """The same for prose: ASCII letters lower-cased, digits to 0, anything else to single spaces. Used where both engines must agree."""
    x = F.translate(F.coalesce(_col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(x, r"[^a-z0]+", " "))


def tokenize_code(body: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(body), F.lit(""))), F.lit(CODE_TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def simhash(tokens: Column) -> Column:
    """32 bits as 8 hex digits: bit b is set if more tokens have it set than not in their SHA-1 (byte b / 8, bit b % 8). No tokens give zeros."""
    words = F.transform(tokens, lambda t: F.sha1(t))

    def digit(k: int) -> Column:
        # hex digit k, most significant first, is half of byte 3 - k / 2
        byte, low = 3 - k // 2, k % 2

        def vote(bit: int) -> Column:
            place = F.lit(2 * byte + 1 + (0 if bit >= 4 else 1))
            value = lambda w: F.conv(F.substring(w, place, F.lit(1)), 16, 10).cast("int")
            total = F.aggregate(words, F.lit(0), lambda a, w: a + F.when(F.shiftright(value(w), bit % 4).bitwiseAND(1) == 1, 1).otherwise(-1))
            return (total > 0).cast("int")

        bits = range(4, 8) if low == 0 else range(4)
        return F.hex(sum((vote(b) * (1 << (b % 4)) for b in bits), F.lit(0)))

    return F.lower(F.concat(*[digit(k) for k in range(8)]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / all_).otherwise(0.0)


def call_tokens(body: Column | str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit(CALL), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, IGNORED_CALLS)))


def structural_shape(language: Column, body: Column) -> Column:
    """A struct of kind, tokens, shape and hash: constructors in order for widget code, else control words, then method calls."""
    widgets = F.filter(F.regexp_extract_all(body, F.lit(TYPE_CALL), F.lit(1)), lambda t: ~t.isin(*FRAMEWORK_TYPES))
    calls, control = F.regexp_extract_all(body, F.lit(METHOD_CALL), F.lit(1)), F.regexp_extract_all(body, F.lit(CONTROL), F.lit(1))
    is_widget = (language == "dart") | body.rlike(WIDGET)
    kind = F.when(is_widget, "flutter_widget").when(F.size(calls) > 0, "service_logic").otherwise("generic")
    tokens = F.when(is_widget, widgets).otherwise(F.concat(control, calls))
    compact = F.array_join(tokens, ">")
    return F.struct(kind.alias("kind"), tokens.alias("tokens"), F.concat(kind, F.lit("("), compact, F.lit(")")).alias("shape"), F.sha1(F.concat(kind, F.lit(":"), compact)).alias("hash"))


def fingerprint(body: Column | str, tokens_source: str = "raw") -> Column:
    """A struct of body_hash, normalized_hash, tokens and simhash. Tokens come from the raw body; from the normalised one, with every name gone, on request."""
    raw = F.coalesce(_col(body), F.lit(""))
    normal = normalize_code(raw)
    tokens = tokenize_code(raw if tokens_source == "raw" else normal)
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.struct(F.sha1(trimmed).alias("body_hash"), F.sha1(normal).alias("normalized_hash"), F.array_distinct(tokens).alias("tokens"), simhash(tokens).alias("simhash"))


def split_words(name: str) -> list[str]:
    return query_tokens(name)


def extract_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(text, r"\r?\n"), first, F.greatest(end, start) - first + 1), "\n")


def normalize_command(command: Column) -> Column:
    """A command without its shell wrapper, interpreter and `./`."""
    x = F.regexp_replace(F.trim(command), r"""^bash\s+-lc\s+["'](.+)["']$""", "$1")
    for prefix in (r"^python3?\s+", r"^bash\s+", r"^sh\s+", r"^\./"):
        x = F.regexp_replace(x, prefix, "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def route_template(path: Column) -> Column:
    """`{athleteId}` and `{id}` become `:id`, other `{x}` become `:x`."""
    return F.regexp_replace(F.regexp_replace(path, r"\{(?:athleteId|id)\}", ":id"), r"\{([A-Za-z_][A-Za-z0-9_]*)\}", ":$1")


def json_strings(text: Column) -> Column:
    """The strings of a JSON array; bad JSON gives none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def confidence_bucket(x: Column) -> Column:
    return F.when(x >= 0.9, "high").when(x >= 0.7, "medium").otherwise("low")


def chain_confidence(evidence_counts: Column) -> Column:
    """Of a chain, from the number of pieces of evidence of each step; 0 without steps."""
    n = F.size(evidence_counts)
    total = F.aggregate(evidence_counts, F.lit(0.0), lambda a, e: a + F.least(F.lit(1.0), e * F.lit(0.25)))
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(0.98), 0.35 + total / n + F.least(F.lit(0.3), n * F.lit(0.06))), 2))
