"""Hash differences, plan choice, keyed recompute and versioned tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rules import change_kind, change_plane
from .graph import equivalence

#: Changed code files up to which a partial and a batch partial update is made.
PARTIAL, BATCH = 20, 100


def hash_diff(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """key and status (new, changed, deleted) of what differs; one full outer join."""
    a, b = (df.select(F.col(key), F.col(hash_col).alias(n)) for df, n in ((old, "_old"), (new, "_new")))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status IS NOT NULL")


def planes(diff: DataFrame, path: str) -> DataFrame:
    """diff with the plane that each path belongs to."""
    return diff.withColumn("plane", change_plane(F.col(path)))


def kind_of_change(diff: DataFrame) -> DataFrame:
    """One row: kind and the number of changes."""
    return diff.agg(F.collect_set("plane").alias("_p"), F.count("*").alias("changes")).select(change_kind(F.col("_p")).alias("kind"), "changes")


def choose_plan(diff: DataFrame, empty_before: bool = False) -> str:
    """none, metadata_only, lightweight, partial, batch_partial or full, from aggregated counts. An empty index is built in full."""
    r = diff.agg(F.count("*").alias("n"), F.sum((F.col("plane") == "codeGraph").cast("int")).alias("code"), F.sum(F.col("plane").isin("workflowProfiles", "evalSuites").cast("int")).alias("meta")).first()
    if empty_before:
        return "full"
    code = r["code"] or 0
    if not r["n"]:
        return "none"
    if not code:
        return "metadata_only" if r["meta"] == r["n"] else "lightweight"
    return "partial" if code <= PARTIAL else "batch_partial" if code <= BATCH else "full"


def apply_partial(old: DataFrame, invalid: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """old without the invalid keys, plus their recomputed rows."""
    return old.join(invalid.select(key).distinct(), key, "left_anti").unionByName(recomputed)


def soft_delete(catalog: DataFrame, deleted: DataFrame, key: str, at: str) -> DataFrame:
    """catalog with deleted_at set for deleted keys."""
    gone = deleted.select(F.col(key).alias("_k")).distinct()
    joined = catalog.join(gone, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("deleted_at", F.when(F.col("_k").isNotNull(), F.lit(at)).otherwise(F.col("deleted_at"))).drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def rewire(incoming: DataFrame, symbols: DataFrame, key: str = "to_symbol") -> tuple[DataFrame, DataFrame]:
    """Incoming edges whose target still exists, and those that have become stale."""
    kept = symbols.select(F.col("symbol_key").alias(key)).distinct()
    return incoming.join(kept, key, "left_semi"), incoming.join(kept, key, "left_anti")


def verify(full: Callable[[], dict[str, DataFrame]], partial: Callable[[], dict[str, DataFrame]], keys: dict[str, list[str]], soft: tuple[str, ...] = ("code_blocks",)) -> DataFrame:
    """Differences between a full and a partial build, by section; hard is false for sections that may differ."""
    a, b = full(), partial()
    out = None
    for section, columns in keys.items():
        rows = equivalence(a[section], b[section], columns, section).select("section", "side", F.to_json(F.struct(*columns)).alias("key"), F.lit(section not in soft).alias("hard"))
        out = rows if out is None else out.unionByName(rows)
    return out


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """df without the rows whose values in gone's columns are in gone."""
    return df.join(gone, gone.columns, "left_anti")


@dataclass
class Delta:
    """What changes in tables. gone: for a table, values of some of its columns whose rows go; with the bucket's key among them, touched buckets are written anew,
    without it the table gets a layer (BucketStore). rows: what comes, with keys that gone has. whole: tables that are replaced."""

    gone: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, DataFrame] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)

    def put(self, name: str, gone: DataFrame, rows: DataFrame) -> None:
        self.gone[name], self.rows[name] = gone, rows

    def apply(self, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """old after the change, unwritten."""
        return old | {name: without(old[name].select(rows.columns), self.gone[name]).unionByName(rows) for name, rows in self.rows.items()} | self.whole


class VersionedStore:
    """Tables of a graph, published together: every version has a folder, and one small file names the current one.

    The pointer is written by Spark as a new folder with the next number, so a failed build leaves the last version in place, on any store.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _pointers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/published") if "_SUCCESS" in self._names(f"{self.root}/published/{n}"))

    def publish(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        at = (self._pointers() or [0])[-1] + 1
        self.spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").coalesce(1).write.json(f"{self.root}/published/{at}")
        return version

    def tables(self) -> dict[str, DataFrame]:
        found = self._pointers()
        if not found:
            return {}
        row = self.spark.read.schema("version string, tables array<string>").json(f"{self.root}/published/{found[-1]}").first()
        return {t: self.spark.read.parquet(f"{self.root}/versions/{row['version']}/{t}") for t in row["tables"]}

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a log; one folder for each call, seen only when it is whole."""
        at = time.time_ns()
        rows.withColumn("_logged", F.lit(at)).write.parquet(f"{self.root}/logs/{name}/a-{at}-{uuid.uuid4().hex}")

    def log(self, name: str) -> DataFrame:
        """All rows of a log, in no order."""
        return self._log(name).drop("_logged")

    def latest(self, name: str, key: str) -> DataFrame:
        """The row of each key that was appended last. Partial results combine before the shuffle."""
        rows = self._log(name)
        rest = F.struct(*[c for c in rows.columns if c != key])
        last = rows.groupBy(key).agg(F.max_by(rest, F.struct("_logged", F.xxhash64(rest))).alias("_row"))
        return last.select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns if c != "_logged"])

    def compact(self, name: str, key: str | None = None) -> int:
        """Writes a log's rows, or the last of each key, into one folder and deletes those it stands for; returns how many. Appends may go on meanwhile.

        The list of what the new folder replaces is written after it; until that list is whole, readers see the old folders and not the new one.
        """
        old, mark = self._parts(name), uuid.uuid4().hex
        if len(old) < 2:
            return 0
        rows = self._log(name, old)
        if key:
            rest = F.struct(*[c for c in rows.columns if c != key])
            rows = rows.groupBy(key).agg(F.max_by(rest, F.struct("_logged", F.xxhash64(rest))).alias("_row")).select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns])
        rows.coalesce(1).write.parquet(f"{self.root}/logs/{name}/b-{mark}")
        self.spark.createDataFrame([(o,) for o in old], "folder string").coalesce(1).write.json(f"{self.root}/logs/{name}/r-{mark}")
        for folder in old:
            fs, at = self._at(f"{self.root}/logs/{name}/{folder}")
            fs.delete(at, True)
        return len(old)

    def _parts(self, name: str) -> list[str]:
        """The folders of a log that count."""
        top = f"{self.root}/logs/{name}"
        whole = {n for n in self._names(top) if "_SUCCESS" in self._names(f"{top}/{n}")}
        lists = [f"{top}/{n}" for n in whole if n.startswith("r-")]
        gone = {r["folder"] for r in self.spark.read.schema("folder string").json(lists).collect()} if lists else set()
        return sorted(n for n in whole - gone if n.startswith("a-") or n.startswith("b-") and f"r-{n[2:]}" in whole)

    def _log(self, name: str, parts: list[str] | None = None) -> DataFrame:
        found = parts if parts is not None else self._parts(name)
        if not found:
            raise ValueError(f"nothing was logged under {name}")
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/logs/{name}/{n}" for n in found])


class BucketStore(VersionedStore):
    """A VersionedStore whose large tables are kept in buckets of a key's hash. A version is a list of folders, one for each bucket of each table, so an
    update writes the buckets that it touches and names the folders of the last version for all others.

    Rows that go by other columns than the key may be in any bucket. Such an update writes a layer instead: the buckets of the rows that come, and a list of what
    goes, which a reader leaves out of the layers below. It costs what changes, not what the table holds. The update after MOST_LAYERS of them writes the table as one layer.

    KEYS: the key column of each table that has buckets; others are written whole. SHOWN: tables read with their bucket as a column, which filters can prune;
    the number of buckets is in that column's metadata.
    """

    KEYS: dict[str, str] = {}
    SHOWN: tuple[str, ...] = ("postings",)
    #: Tables written at the same time: each is a few short jobs.
    AT_ONCE = 8
    MOST_LAYERS = 8
    #: Parts that the buckets of a table are written in, about; the planner joins small ones.
    PARTS = 256
    #: What stands for a bucket in the entry of a layer's list.
    GONE = -1
    _LIST = "name string, bucket int, folder string, form string, buckets int, layer int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        super().__init__(spark, root)
        self.buckets = buckets

    def publish(self, tables: dict[str, DataFrame]) -> str:
        version = f"v{uuid.uuid4().hex}"
        with ThreadPoolExecutor(self.AT_ONCE) as pool:
            found = list(pool.map(lambda t: self._write(version, t[0], t[1], self.buckets), tables.items()))
        return self._point(version, [r for rows in found for r in rows])

    def advance(self, delta: Delta) -> str:
        """The next version: rows that go (delta.gone) and come (delta.rows) in touched buckets or a layer, whole tables (delta.whole), and everything else as it is."""
        version, now = f"v{uuid.uuid4().hex}", self._folders()

        asked: dict[int, object] = {}  # tables that lose the same keys share the list of their buckets

        def touched(name: str, n: int, pool: ThreadPoolExecutor):
            df = delta.gone[name].select(bucket_of(F.col(self.KEYS[name]), n).alias("b")).distinct()
            if (same := df.semanticHash()) not in asked:
                asked[same] = pool.submit(lambda: {r[0] for r in df.collect()})  # buckets at most
            return asked[same]

        def one(name: str, own: list, hit) -> list[tuple]:
            n, hit, top = own[0]["buckets"], hit.result(), max(r["layer"] for r in own)
            lists = [r for r in own if r["bucket"] == self.GONE]
            rows = without(self._whole(name, [r for r in own if r["bucket"] in hit] + lists, own), delta.gone[name]).unionByName(delta.rows[name])
            return [tuple(r) for r in own if r["bucket"] not in hit and r["folder"]] + self._write(version, name, rows, n, top)

        def layer(name: str, own: list) -> list[tuple]:
            n, at, gone, rows = own[0]["buckets"], max(r["layer"] for r in own) + 1, delta.gone[name].distinct(), delta.rows[name]
            if at > self.MOST_LAYERS:
                return self._write(version, name, without(self._whole(name, own, own), gone).unionByName(rows), n)
            folder = f"data/{name}.gone/version={version}"
            gone.write.parquet(f"{self.root}/{folder}")
            return [tuple(r) for r in own] + [(name, self.GONE, folder, gone.schema.json(), n, at)] + self._write(version, name, rows, n, at)

        with ThreadPoolExecutor(self.AT_ONCE) as first, ThreadPoolExecutor(self.AT_ONCE) as pool:
            of = {name: [r for r in now if r["name"] == name] for name in delta.rows}
            hits = {name: touched(name, own[0]["buckets"], first) for name, own in of.items() if self.KEYS.get(name) in delta.gone[name].columns}
            jobs = [pool.submit(one, name, own, hits[name]) if name in hits else pool.submit(layer, name, own) for name, own in of.items()] + [pool.submit(self._write, version, name, df, 0) for name, df in delta.whole.items()]
            found = [job.result() for job in jobs]
        rest = [tuple(r) for r in now if r["name"] not in delta.rows and r["name"] not in delta.whole]
        return self._point(version, rest + [r for rows in found for r in rows])

    def tables(self) -> dict[str, DataFrame]:
        by: dict[str, list] = {}
        for r in self._folders():
            by.setdefault(r["name"], []).append(r)
        with ThreadPoolExecutor(self.AT_ONCE) as pool:  # each lists its folders
            return dict(pool.map(lambda t: (t[0], self._whole(t[0], t[1], t[1], t[0] in self.SHOWN)), by.items()))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names, and older pointers; returns how many folders went. Not while something is written."""
        pointers = self._pointers()
        used = {r["folder"] for at in pointers[-keep:] for r in self._folders(at)}
        gone = 0
        for table in self._names(f"{self.root}/data"):
            for version in self._names(f"{self.root}/data/{table}"):
                top = f"data/{table}/{version}"
                for folder in [f"{top}/{n}" for n in self._names(f"{self.root}/{top}") if n.startswith("bucket=")] or [top]:
                    if folder not in used:
                        fs, at = self._at(f"{self.root}/{folder}")
                        gone += bool(fs.delete(at, True))
        for at in pointers[:-keep]:
            fs, path = self._at(f"{self.root}/published/{at}")
            fs.delete(path, True)
        return gone

    def _folders(self, at: int | None = None) -> list:
        found = self._pointers()
        if not found:
            return []
        rows = self.spark.read.schema(self._LIST).json(f"{self.root}/published/{at or found[-1]}")
        return rows.fillna(0, ["layer"]).collect()  # layers x buckets x tables rows

    def _point(self, version: str, folders: list[tuple]) -> str:
        at = (self._pointers() or [0])[-1] + 1
        self.spark.createDataFrame(folders, self._LIST).coalesce(1).write.json(f"{self.root}/published/{at}")
        return version

    def _write(self, version: str, name: str, df: DataFrame, buckets: int, layer: int = 0) -> list[tuple]:
        top, form = f"data/{name}/version={version}", df.schema.json()
        if name not in self.KEYS:
            df.write.parquet(f"{self.root}/{top}")
            return [(name, None, top, form, 0, 0)]
        key = self.KEYS[name]
        # rows of a large bucket, or of one key, are dealt into parts; a sort by a hash compares no rows and leaves those of one key together
        part = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, self.PARTS // buckets)))
        dealt = df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket", part).sortWithinPartitions(F.xxhash64(key))
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{top}")
        made = [n for n in self._names(f"{self.root}/{top}") if n.startswith("bucket=")]
        return [(name, int(n.removeprefix("bucket=")), f"{top}/{n}", form, buckets, layer) for n in made] or [(name, None, None, form, buckets, layer)]

    def _whole(self, name: str, folders: list, own: list, shown: bool = False) -> DataFrame:
        """A table, or the buckets of it that folders has: the rows of each layer, without what later layers list. own: all entries of the table."""
        form = next(r["form"] for r in own if r["bucket"] != self.GONE)
        df = None
        for layer in sorted({r["layer"] for r in folders}):
            for r in folders:
                if df is not None and r["bucket"] == self.GONE and r["layer"] == layer:
                    df = without(df, self.spark.read.schema(StructType.fromJson(json.loads(r["form"]))).parquet(f"{self.root}/{r['folder']}"))
            mine = [r for r in folders if r["layer"] == layer and r["bucket"] != self.GONE and r["folder"]]
            if mine:
                rows = self._read(name, mine, form, shown)
                df = rows if df is None else df.unionByName(rows)
        return self._read(name, [], form) if df is None else df

    def _read(self, name: str, folders: list, form: str, shown: bool = False) -> DataFrame:
        schema = StructType.fromJson(json.loads(form))
        paths = [f"{self.root}/{r['folder']}" for r in folders if r["folder"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{name}").parquet(*paths)
        buckets = [F.col("bucket").alias("bucket", metadata={"buckets": folders[0]["buckets"]})] if shown else []
        return df.select(*[F.col(f"`{c}`") for c in schema.names], *buckets)


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key, 0 to buckets - 1."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
