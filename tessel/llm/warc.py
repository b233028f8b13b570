"""WARC archives, and an external merge of their capture index.

1. Digests: SHA-1 of every payload; of equal payloads the smallest page_id is stored as a response, the others as revisits of it. Only narrow
   rows are grouped; the table of revisits is stored and, if small, broadcast, so that payloads are not shuffled.
2. Archives: Spark's text writer puts the records, each ended by CR LF CR LF, into uncompressed .warc files in the shared folder. A payload's size
   decides how many records its file may hold, so files are bounded (CLASSES).
3. Reading: archives come back as whole files (bounded by step 2) and are cut by Content-Length into captures with file, offset and length.
4. Index: each task sorts its captures by URL key, timestamp, id, file and offset into runs. Spark deals the runs into ranges of that key, whose number
   grows with the captures, so no range does. What a range gets of a run is in order; a loser tree merges these parts of all runs. File and
   offset are part of the key, so one URL with very many captures, or one id, is cut too.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, stored

#: Most payload bytes of a class, and records in a file of it. Larger payloads have a file each.
CLASSES = ((256 << 10, 1000), (8 << 20, 16))
#: Payloads of fewer bytes are always stored as responses.
LEAST_BYTES = 0
BROADCAST = 8 << 20
#: Captures of an index range (expected).
RANGE_ROWS = 50_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
CAPTURE = pa.schema([("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DDL = "key string, ts string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 given in hex: eight groups of 20 bits, four letters each."""
    groups = [F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, digest and n (bytes) of every row; stored."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return stored(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")), "digests")


def revisits(digests: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest and refers_to of payloads() that repeat the payload of a smaller page_id, distinct. Null ids and repeated rows of the smallest id are responses."""
    digests = digests.filter(F.col("n") >= least_bytes)
    groups = stored(digests.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1").select(F.col("digest").alias("_g"), F.col("n").alias("_n"), "refers_to"), "groups")
    joined = digests.join(small(groups, BROADCAST), (F.col("digest") == F.col("_g")) & (F.col("n") == F.col("_n")))
    return joined.filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def size_class(n: Column) -> Column:
    """The place of n bytes in CLASSES, or the place after them."""
    out = F.lit(len(CLASSES))
    for i, (most, _) in reversed(list(enumerate(CLASSES))):
        out = F.when(n <= most, i).otherwise(out)
    return out


def records(pages: DataFrame, digests: DataFrame, when: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """value (a WARC record without its final CR LF CR LF) and n (payload bytes) of every row of page_id, url and html. digests: payloads() of them. when: capture time, as text `2024-01-01T00:00:00Z`.

    Control characters and spaces of a URL are percent-encoded, so that they can't break the header; a null URL is `urn:null`, a null id `null`.
    """
    again = stored(revisits(digests, least_bytes), "revisits").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"), when.alias("when"))
    rows = rows.join(small(again, BROADCAST), (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    unsafe = F.col("url").rlike(r"[\x00-\x20\x7f]")
    url = F.regexp_replace(F.col("url"), "%", "%25")
    for c in [*range(33), 127]:
        url = F.regexp_replace(url, rf"\x{c:02x}", f"%{c:02X}")
    url = F.coalesce(F.when(unsafe, url).otherwise(F.col("url")), F.lit("urn:null"))
    page, is_revisit = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    body = F.when(is_revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), page, F.lit(f">{CRLF}WARC-Date: "), F.col("when"), F.lit(f"{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32(F.col("digest")), F.lit(f"{CRLF}X-Payload-Length: "), F.col("n").cast("string"),
        F.when(is_revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return rows.select(F.concat(head, body).alias("value"), "n")


def write_archives(found: DataFrame, classes: list[int], path: str) -> list[str]:
    """The folders that hold the archives of records(), one for each of these size classes; they must be all there are."""
    folders = []
    for i in classes:
        folders.append(f"{path}/class-{i}")
        most = CLASSES[i][1] if i < len(CLASSES) else 1
        found.filter(size_class(F.col("n")) == i).select("value").write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(folders[-1])
    return folders


def url_key(url: str) -> str:
    """A sort key: the host's labels reversed, then port, path and query, lower-cased; scheme, `www.` and fragment are left out."""
    m = re.match(r"(?s)[a-z][a-z0-9+.\-]*://([^/?#:]*)([^#]*)", url, re.I)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def parse_archive(data: bytes, file: str) -> Iterator[tuple]:
    """A row as in CAPTURE for each record; the digest and length of a response are made anew from its payload. ValueError for a broken archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 8] != b"WARC/1.1":
            raise ValueError(f"no WARC record at {at} of {file}")
        head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split(CRLF))
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at {at} of {file} has the wrong length")
        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = memoryview(data)[data.index(b"\r\n\r\n", start) + 4 : stop]
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if (own, len(payload)) != (digest, n):
                raise ValueError(f"the payload at {at} of {file} isn't the one of its header")
        page = head["WARC-Record-ID"][10:-1]
        refers = head.get("WARC-Refers-To")
        uri = head["WARC-Target-URI"]
        ts = re.sub(r"\D", "", head["WARC-Date"])[:14]
        yield url_key(uri), ts, None if page == "null" else int(page), uri, head["WARC-Type"], digest, n, int(refers[10:-1]) if refers else None, file, at, stop + 4 - at
        at = stop + 4


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # one archive is held at a time
            yield _batch(list(parse_archive(batch.column(1)[i].as_py(), batch.column(0)[i].as_py().rpartition("/")[2])), CAPTURE)


def read_archives(spark, folders: list[str]) -> DataFrame:
    """Captures of all archives in these folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders).select("path", "content")
    return files.mapInArrow(_parse, DDL)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterator], key=lambda x: x):
        self.key, self.runs, self.k = key, runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Ended runs lose; equal keys keep the order of the runs."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def sort_key(row: tuple) -> tuple:
    """Of a capture: URL key, timestamp, page_id (null first), file, offset."""
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2], row[8], row[9]


_KEYED = CAPTURE.append(pa.field("run", pa.int64()))
_PLACED = CAPTURE.append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))


def _runs(held: int):
    """Sorts each block of so many captures, in their task's number and order, into a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def run_of_rows() -> Iterator[pa.RecordBatch]:
            rows.sort(key=sort_key)
            for i in range(0, len(rows), 5000):
                yield _batch([(*r, number) for r in rows[i : i + 5000]], _KEYED)
            rows.clear()

        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(rows) >= held:
                yield from run_of_rows()
                number += 1
        yield from run_of_rows()

    return run


def sorted_parts(rows: list[tuple]) -> list[list[tuple]]:
    """Rows of one run, as they came, in as few parts as are in order. A shuffle keeps a run's order; where it doesn't, there are more parts."""
    parts: list[list[tuple]] = []
    last = None
    for row in rows:
        if last is None or sort_key(row) < last:
            parts.append([])
        parts[-1].append(row)
        last = sort_key(row)
    return parts


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: a task's rows, which are at most a few times RANGE_ROWS."""
    from pyspark import TaskContext

    part, of_run = TaskContext.get().partitionId(), {}
    for batch in batches:
        for *row, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of_run.setdefault(run, []).append(tuple(row))
    out: list = []
    for place, row in enumerate(LoserTree([iter(p) for run in sorted(of_run) for p in sorted_parts(of_run[run])], sort_key)):
        out.append((*row, part, place))
        if len(out) == 10_000:
            yield _batch(out, _PLACED)
            out = []
    yield _batch(out, _PLACED)


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures (stored) with range and place: ranges are in order of their numbers and captures of a range in order of place, by key, ts, page_id, file and offset."""
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(captures.count() / range_rows))
    runs = captures.mapInArrow(_runs(range_rows), f"{DDL}, run long")
    return runs.repartitionByRange(ranges, "key", "ts", F.col("page_id").asc_nulls_first(), "file", "offset").mapInArrow(_merge, f"{DDL}, range int, place long")


def capture_history(pages: DataFrame, when: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for every row of page_id, url and html, reads the archives back, and returns the merged index: a row for each record.

    A record is held whole by one task, a very long page's too; no rows give no rows.
    """
    spark = pages.sparkSession
    digests = payloads(pages)
    classes = sorted(r[0] for r in digests.select(size_class(F.col("n"))).distinct().collect())  # at most one more than CLASSES
    folders = write_archives(records(pages, digests, when, least_bytes), classes, scratch(spark, "warc"))
    captures = read_archives(spark, folders) if folders else spark.createDataFrame([], DDL)
    return merge_index(stored(captures, "captures"))


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, from the archives' merged index.

    pages has no capture time: page n counts as captured n seconds after the start of 2024, modulo a year. Null html is an empty payload. Rows
    with a null page_id, and all rows that repeat both the smallest id and its payload, are responses. Other columns are ignored; no rows give no rows.
    """
    when = F.expr("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0), 31536000)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    return capture_history(pages.select("page_id", "url", "html"), when).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS smallest FROM p),
letters AS (SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * i + 1, 5) AS INT) >> s) & 31) + 1, 1), '' ORDER BY i, s DESC) AS digest
  FROM d, range(8) a(i), (VALUES (15), (10), (5), (0)) b(s) GROUP BY r)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > smallest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > smallest THEN smallest END AS refers_to
FROM d JOIN letters USING (r)
"""
