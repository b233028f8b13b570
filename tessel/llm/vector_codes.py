"""Vector compression by product codes, with annular norm pruning in the search for the nearest entry.

1. A vector's components become integers and its parts are coded one by one against a codebook of at most 64 entries for each part.
2. Entries are sorted by norm. A part is first measured against the entry whose norm is next to its own; that distance d bounds the annulus of norms
   from |part| - d to |part| + d, found by binary search, and only entries in it, ends included, are measured exactly. By the triangle inequality no
   other entry is as near. All distances are integers.
3. A round adds up each entry's parts inside the tasks (at most entries x parts sums each, whatever the rows), then over tasks, and replaces entries by means.

Codebooks are bounded by entries x components, so the driver holds them and hands them to tasks. Rows never meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers from which on squares of differences might not fit into 64 bits.
LARGEST = 1 << 25
#: Vectors measured at once.
ROWS = 4096
BROADCAST = 8 << 20


@dataclass
class Codebooks:
    """entries: an integer array for each part, one row for each entry. width: components of a vector, padding included."""

    entries: list[np.ndarray]
    width: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimals with commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """True for a vector without null and non-finite components; null for null."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, label and v (integers) of the kept rows, padded with zeros to the returned width."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(F.coalesce(finite(F.col("v")), F.lit(False)))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    v = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.withColumn("v", F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.int64).reshape(len(column), width)
    if x.size and max(x.max(), -x.min()) >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}, where distances don't fit into 64 bits")
    return x


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties to the lower index) and the squared distance, by annular norm pruning."""
    norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms, by_norm = norms[order], entries[order]
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), ROWS):
        x = parts[at : at + ROWS]
        r = np.sqrt((x * x).sum(1).astype(np.float64))
        start = np.minimum(np.searchsorted(norms, r), len(norms) - 1)
        d = np.sqrt(((x - by_norm[start]) ** 2).sum(1).astype(np.float64))
        room = d + 1e-9 * (r + d + 1)  # what roots may be off; a wider annulus loses nothing
        low, high = np.searchsorted(norms, r - room, "left"), np.searchsorted(norms, r + room, "right")
        n = high - low
        begin = np.cumsum(n) - n
        entry = np.arange(n.sum()) + np.repeat(low - begin, n)
        exact = ((np.repeat(x, n, 0) - by_norm[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(exact, begin)
        index[at : at + ROWS] = np.minimum.reduceat(np.where(exact == np.repeat(best, n), order[entry], len(norms)), begin)
        distance[at : at + ROWS] = best
    return index, distance


def _cut(x: np.ndarray, books: Codebooks) -> list[np.ndarray]:
    return np.split(x, len(books.entries), 1)


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(e) for e in books.entries], [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            for p, x in enumerate(_cut(_matrix(batch.column(0), books.width), books)):
                index, _ = nearest(x, books.entries[p])
                np.add.at(sums[p], index, x)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist()]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _fit(rows: DataFrame, width: int, entries: int, rounds: int) -> Codebooks:
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    books = Codebooks(np.split(start, PARTS, 1), width)
    for _ in range(rounds if first else 0):
        each = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        total = each.select("part", "entry", "n", F.posexplode_outer("sums").alias("j", "s")).groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = [e.copy() for e in books.entries]
        for r in total.collect():  # entries x components rows at most
            if r["j"] is not None:
                moved[r["part"]][r["entry"], r["j"]] = r["s"] // r["n"]
        books = Codebooks(moved, width)
    return books


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after so many rounds over all kept vectors, started from the smallest ids."""
    return _fit(*_integers(vectors, id_col, vector_col, label_col), entries, rounds)


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), books.width)
            index, error = np.zeros((len(x), len(books.entries)), np.uint8), np.zeros(len(x), np.int64)
            for p, part in enumerate(_cut(x, books)):
                index[:, p], distance = nearest(part, books.entries[p])
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in index], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row.

    Rows whose vector is null or has a null or non-finite component are dropped, and no others: null ids count as largest, null labels share a sum,
    repeated rows are coded each, ids that tie are ordered by their integers. Vectors of fewer components are padded with zeros to the longest, and
    that to a multiple of 16; vectors without components have code 00.. and error 0. Fewer rows than entries give fewer entries. Components beyond
    131,072 raise an error. Other columns are ignored; no rows give no rows. Labels are summed by task first, so a label with a third of the rows is no hot key.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows, width = _integers(vectors, id_col, vector_col, label_col)
    books = _fit(rows, width, entries, rounds)
    kinds = dict(rows.dtypes)
    if not len(books.entries[0]):
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = rows.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = stored(coded, "codes")
    sums = stored(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(small(sums, BROADCAST), F.col("label").eqNullSafe(F.col("_l")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for (padding included); null codes give null. Entries are bounded and travel in the plan."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in part.tolist()]) for part in books.entries])
    at = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out_col, F.concat(*[table[p][at(p)] for p in range(len(books.entries))]))


ORACLE = """
WITH RECURSIVE kept AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS (SELECT r, p, v[1 + p * len(v) // 16 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) t(p)),
books AS (
  SELECT 0 AS round, p, r - 1 AS e, x FROM parts WHERE r <= 64
  UNION ALL
  (WITH near AS (SELECT p, r, x, arg_min(e, {'d': d, 'e': e}) AS e FROM (
     SELECT a.p, a.r, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN books b USING (p)) GROUP BY p, r, x),
   places AS (SELECT p, e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM near, range(1, len(x) + 1) t(j) GROUP BY p, e, j),
   moved AS (SELECT p, e, list(m ORDER BY j) AS x FROM places GROUP BY p, e)
   SELECT b.round + 1, b.p, b.e, coalesce(m.x, b.x) FROM books b LEFT JOIN moved m USING (p, e) WHERE b.round < 2)),
final AS (SELECT p, e, x FROM books WHERE round = 2),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM final),
near AS (SELECT r, p, min({'d': d, 'e': e}) AS best FROM (
  SELECT a.r, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN final b USING (p)) GROUP BY r, p),
coded AS (SELECT r, string_agg(lower(printf('%02x', best.e::INT)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""
