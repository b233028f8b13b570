"""Removal of byte strings that repeat anywhere, by prefix doubling over sampled positions.

A window is a run of THRESHOLD bytes of a text; it is repeated if the same bytes start anywhere else. Prefix doubling ranks positions by prefixes of
growing length until a position's rank is its own (it can't repeat) or the length is past the threshold (it does). All byte positions are far too
many to sort in each round, so a round sorts samples that stand for runs of windows:

1. In every window the string of `length` bytes with the smallest fingerprint (the first of them) is its anchor. Anchors depend on a window's bytes only,
   so equal windows have equal anchors at equal places. Windows in a row with one anchor are a run: one position with a rank, the fingerprint of
   the anchor's string, and a second rank, the fingerprint of all bytes of the run and of the anchor's place in it.
2. Spark groups positions by the pair of ranks. A first rank that only one position has: its windows are unique and leave. Both ranks shared: all windows
   of the run are repeated, the run is settled. The rest, and one run of each settled class that shares a first rank with them, go on.
3. The next round takes longer strings, so runs are shorter, in the texts and runs that are left only. At the threshold a run is one window and
   nothing is left over.

Fingerprints have 64 bits and two independent byte tables, so a pair of ranks has 128. Matches are decided on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

THRESHOLD = 400
#: Shares of the threshold that strings of the rounds are long.
GROWTH = (0.25, 0.5, 0.75, 0.875, 1.0)
#: Windows of a text that are looked at together; a longer text is taken in blocks of so many. A place in a block has PLACE bits.
BLOCK, PLACE = 1 << 19, 20
BROADCAST = 8 << 20
KEY = ["k1", "k2"]
RUNS = "array<struct<start:long,m:int,g:long,u:long>>"


class Prints:
    """Fingerprints of substrings from prefix sums of random 64-bit numbers for bytes, weighted by powers of an odd number, modulo 2**64."""

    _POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        table, base = rng.integers(0, 1 << 64, 256, np.uint64), int(rng.integers(0, 1 << 63)) * 2 + 1
        n = len(data)
        if seed not in self._POWERS or len(self._POWERS[seed][0]) <= n:
            size = max(2 * n, 1 << 14)
            up = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
            self._POWERS[seed] = (up[0], up[1])
        powers, self.inverse = self._POWERS[seed]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.inverse[start])


def scramble(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` values in a row, in time that doesn't depend on width."""
    if width == 1:
        return x
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def runs_of(data: np.ndarray, length: int, threshold: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """start, m (windows), g and u (ranks) of the runs of one block. wanted: for each window, a number above 0 if it is looked at; runs end where it changes."""
    n = len(data) - threshold + 1
    first, second = Prints(data, 1), Prints(data, 2)
    at = np.arange(len(data) - length + 1)
    prints = first.of(at, at + length)
    key = (prints >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    anchor = (sliding_min(key, threshold - length + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    if wanted is not None:
        new[1:] |= wanted[1:] != wanted[:-1]
    start = np.flatnonzero(new)
    m = np.diff(np.append(start, n))
    if wanted is not None:
        start, m = start[wanted[start] > 0], m[wanted[start] > 0]
    place = ((anchor[start] - start) << 32 | m).astype(np.uint64)
    return start, m, prints[anchor[start]], second.of(start, start + m - 1 + threshold) ^ scramble(place)


def _blocks(data: np.ndarray, threshold: int, block: int, wanted: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """place, bytes and wanted windows of each block of a text's windows; blocks without wanted windows are left out."""
    for at in range(0, len(data) - threshold + 1, block):
        own = None if wanted is None else wanted[at : at + block]
        if own is None or own.any():
            yield at, data[at : min(at + block, len(data) - threshold + 1) + threshold - 1], own


def _columns(found: list[list[tuple[np.ndarray, ...]]]) -> pa.Array:
    """A list of runs for each text."""
    sizes = [sum(len(x[0]) for x in own) for own in found]
    flat = [np.concatenate([x[i] for own in found for x in own] or [np.zeros(0, np.int64)]) for i in range(4)]
    fields = [pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].view(np.int64)), pa.array(flat[3].view(np.int64))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "m", "g", "u"]))


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer() or b"", np.uint8)


def _first(length: int, threshold: int, block: int):
    """Runs of whole texts: all columns but the text (the first) are kept."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                data = _bytes(text)
                found.append([(r[0] + at, *r[1:]) for at, part, _ in _blocks(data, threshold, block, None) for r in [runs_of(part, length, threshold)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _columns(found)], [*batch.schema.names[1:], "runs"])

    return go


def _next(length: int, threshold: int, block: int):
    """id and runs of the wanted runs of a text (k1, k2, text, wanted: id, start, m). Copies of a text in one task are taken once."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids, found = [], []
            for k1, k2, text, wanted in zip(*batch.columns, strict=True):
                if (key := (k1.as_py(), k2.as_py())) in seen:
                    continue
                seen.add(key)
                data, asked = _bytes(text), wanted.as_py()
                number = np.zeros(max(0, len(data) - threshold + 1), np.int32)
                for i, w in enumerate(asked):
                    number[w["start"] : w["start"] + w["m"]] = i + 1
                for at, part, own in _blocks(data, threshold, block, number):
                    start, *rest = runs_of(part, length, threshold, own)
                    of = own[start] - 1
                    for i in np.unique([asked[j]["id"] for j in of]):
                        mine = np.array([asked[j]["id"] == i for j in of])
                        ids.append(int(i))
                        found.append([(start[mine] + at, *[r[mine] for r in rest])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _columns(found)], ["id", "runs"])

    return go


def _keyed(docs: DataFrame) -> DataFrame:
    """text with its key, two hashes: equal texts have one key."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _round(runs: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of runs (id, start, m, g, u), stored: those settled as repeated, and those that go on (none after the last round)."""
    ranks = stored(runs.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "ranks")
    left = stored(runs.join(ranks, "g", "left_semi"), "shared")
    classes = left.groupBy("g", "u").agg(F.count("*").alias("n"), F.min(F.struct("id", "start", "m")).alias("one"))
    classes = stored(classes, "classes")
    settled = left.join(classes.filter("n > 1").select("g", "u"), ["g", "u"], "left_semi").select("id", "start", "m")
    if last:
        return stored(settled, "settled"), None
    alone = classes.filter("n = 1")
    partners = classes.filter("n > 1").join(stored(alone.select("g").distinct(), "open"), "g", "left_semi")
    return stored(settled, "settled"), stored(alone.select("one.*").unionByName(partners.select("one.*")), "wanted")


def _spans(settled: DataFrame, threshold: int) -> DataFrame:
    """id, start and end of maximal runs of bytes that settled windows cover."""
    rows = settled.distinct().select("id", "start", (F.col("start") + F.col("m") - 1 + threshold).alias("end"))
    order = Window.partitionBy("id").orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_n", F.sum("_new").over(order))
    return rows.groupBy("id", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_n")


def _cut():
    """id and the SHA-256 of what spans leave of a text, and that text as UTF-8 without broken characters."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, texts = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, at, kept = text.as_buffer().to_pybytes(), 0, []
                for s in sorted(spans.as_py(), key=lambda s: s["start"]):
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                rest = b"".join([*kept, raw[at:]])
                sums.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["id", "sha", "kept"])

    return go


def _lengths(threshold: int) -> list[int]:
    return sorted({max(1, int(threshold * share)) for share in GROWTH})


def _searched(docs: DataFrame, id_col: str, text_col: str, threshold: int, block: int, broadcast: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (doc_id, text, k1, k2), one row for each document (id, doc_id, k1, k2, n_bytes, sha) and the spans (id, start, end) that repeat; the latter two stored."""
    if threshold < 1:
        raise ValueError("a window has one byte at least")
    texts = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")))
    whole = texts.select("text", F.monotonically_increasing_id().alias("id"), "doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    form = ", ".join(f"`{c}` {t}" for c, t in whole.dtypes[1:])
    first, *more = _lengths(threshold)
    scanned = stored(whole.mapInArrow(_first(first, threshold, block), f"{form}, runs {RUNS}"), "runs")
    rows, settled, wanted = scanned.drop("runs"), *_round(scanned.select("id", F.inline("runs")), not more)
    for length in more:
        asked = wanted.join(rows.select("id", *KEY), "id").groupBy(*KEY).agg(F.collect_list(F.struct("id", "start", "m")).alias("wanted"))
        part = texts.select("text", *KEY).join(small(stored(asked, "asked"), broadcast), KEY).select(*KEY, "text", "wanted")
        runs = stored(part.mapInArrow(_next(length, threshold, block), f"id long, runs {RUNS}"), "runs").select("id", F.inline("runs"))
        also, wanted = _round(runs, length == more[-1])
        settled = settled.unionByName(also)
    return texts, rows, stored(_spans(settled, threshold), "spans")


def _kept(texts: DataFrame, rows: DataFrame, spans: DataFrame, broadcast: int) -> DataFrame:
    """id, n_removed, n_spans, sha and kept (text) of documents with spans; a text that goes whole is not read again."""
    sums = spans.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("n_removed"), F.count("*").alias("n_spans"))
    sums = stored(sums.join(rows.select("id", *KEY, "n_bytes"), "id"), "covered")
    gone = sums.filter("n_removed = n_bytes").select("id", "n_removed", "n_spans", F.sha2(F.lit(b""), 256).alias("sha"), F.lit("").alias("kept"))
    # one document of each text stands for its copies, whose spans are the same
    some = sums.filter("n_removed < n_bytes").groupBy(*KEY).agg(F.min("id").alias("id"))
    cuts = spans.join(some, "id").groupBy("id", *KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    part = texts.select("text", *KEY).join(small(stored(cuts, "cuts"), broadcast), KEY).select("id", "text", "spans")
    done = part.mapInArrow(_cut(), "id long, sha string, kept string").withColumnRenamed("id", "_one")
    same = sums.filter("n_removed < n_bytes").join(some.withColumnRenamed("id", "_one"), KEY)
    return gone.unionByName(same.join(done, "_one").select("id", "n_removed", "n_spans", "sha", "kept"))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, start and end (bytes from 0, end left out) of the maximal runs of bytes that repeated windows cover, for every row that has any."""
    _, rows, spans = _searched(docs, id_col, text_col, threshold, block, broadcast)
    return spans.join(rows.select("id", "doc_id"), "id").select("doc_id", "start", "end")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    All bytes that a repeated window covers go, each occurrence's, overlaps included; windows never cross rows. Null counts as empty; texts shorter than the
    threshold lose nothing; repeated rows and equal texts of at least the threshold go whole; a text may repeat in itself. Null ids stay null. Other
    columns are ignored; no rows give no rows. A very long text is searched in blocks of BLOCK windows. Groups of copies share classes, which are counted by
    task before they meet, and one of each goes on to the next round.
    """
    texts, rows, spans = _searched(docs, id_col, text_col, threshold, block, broadcast)
    found = _kept(texts, rows, spans, broadcast).select("id", "n_removed", "n_spans", F.col("sha").alias("_sha"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(found, "id", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """docs, every row, with the bytes of repeated windows cut out of the text; a character that loses some of its bytes goes too. docs' own columns."""
    texts, rows, spans = _searched(docs, id_col, text_col, threshold, block, broadcast)
    kept = _kept(texts, rows, spans, broadcast).join(rows.select("id", *KEY), "id").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("kept").alias("_kept")).dropDuplicates(["_k1", "_k2"])
    raw = F.coalesce(F.col(f"_row.{text_col}"), F.lit("")).cast("binary")
    whole = docs.select(F.struct("*").alias("_row")).withColumns({"k1": F.xxhash64(raw), "k2": F.xxhash64(F.lit(1), raw)})
    joined = whole.join(small(stored(kept, "kept"), broadcast), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    cut = F.coalesce("_kept", F.col(f"_row.{text_col}"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


#: Windows are cut from pieces of twice the threshold, as hex digits.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, c, substr(h, 800 * c + 1, 1600) AS p FROM (SELECT r, h, unnest(range(len(h) // 800 + 1)) AS c FROM d WHERE len(h) >= 800)),
windows AS (SELECT r, 400 * c + o AS i, md5(substr(p, 2 * o + 1, 800)) AS w FROM (SELECT r, c, p, unnest(range(least(400, len(p) // 2 - 399))) AS o FROM pieces WHERE len(p) >= 800)),
hits AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS s FROM marked) GROUP BY r, s),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, max(b), len(any_value(h)) // 2 FROM spans JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
