"""Grouped prefix join on word shingles, and the components of its links.

Two texts link when 100 * intersection >= 80 * union of their sets of distinct five-word shingles. A shingle is a 64-bit hash of its words.

1. Equal sets (by a 128-bit digest of the sorted set) collapse to their smallest id.
2. Shingles are put in one order for all texts: frequent ones last, by an estimate of their frequency, then by hash. Any fixed order is
   right; this one keeps passages that many texts share out of prefixes. The table of frequent shingles has at most FREQUENT rows.
3. A text's prefix is its first n - ceil(0.8 n) + 1 shingles; texts that link share a shingle of their prefixes. Texts with identical prefixes and
   size form a group, and the index has a row for each prefix shingle of a group's head, with the number of its members.
4. Runs (the groups of one shingle) of up to RUN members give all pairs of groups, and each group of several members with itself; a pair of groups stays if
   sizes, the places of its first common shingle and the number of its common prefix shingles allow a link, which are the same for all members.
   Pairs of groups that stay expand to pairs of members, which are verified on the whole sets.
5. Longer runs (large groups of near copies) don't list their pairs: they expand to members, which are first tried against the run's most central member, then against
   their neighbour by size, and linked ones become one component. What is still in different components is then tried pair by pair, so no link
   between different components is missed and a large group of near copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .components import components

SHINGLE, PERCENT = 5, 80
#: Bounds: rows in the table of frequent shingles; shingles counted at a time; least count within those that is reported.
FREQUENT, BLOCK, REPORTED = 1 << 17, 1 << 20, 3
BROADCAST = 8 << 20
#: Members of a run that is listed pair by pair.
RUN = 64
#: Rows of a run that one task sorts, and that meet the whole run in one task.
SORTED, JOINED = 100_000, 2000
#: Word hashes that a worker remembers.
REMEMBERED = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, hashes: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _batch(columns: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of doc_id, text key, n and digest for each text; rows of hash and seen for shingles that are frequent within a block of texts."""
    hashes, block, digests, held = _WordHashes(), [], set(), 0
    names, types = ["doc_id", "key", "n", "digest", "hash", "seen"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def frequent() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([*block, np.empty(0, np.uint64)]), return_counts=True)
        h, n = h[n >= REPORTED].view(np.int64), n[n >= REPORTED]
        block.clear()
        digests.clear()
        none = [None] * len(h)
        return _batch([none, none, none, none, h, n], names, types)

    for batch in batches:
        ids, sizes, keys = batch.column(0), [], []
        for text in batch.column(2):
            s = shingles(text.as_py(), hashes)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            if keys[-1] not in digests:
                digests.add(keys[-1])
                block.append(s)
                held += len(s)
            if held >= BLOCK:
                yield frequent()
                held = 0
        none = [None] * len(sizes)
        yield _batch([ids, batch.column(1), sizes, keys, none, none], names, types)
    yield frequent()


def _prefixes(shared):
    """A row of doc_id, n, two halves of a digest of the prefix, and the prefix, for each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (common, rank) = _WordHashes(), shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), hashes)
                if not len(s):
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, rank[at], 0), kind="stable")]
                p = np.ascontiguousarray(s[: prefix_length(len(s))]).view(np.int64)
                d = xxhash.xxh3_128_intdigest(p.tobytes())
                out.append((doc, len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), p))
            yield _batch(list(zip(*out)) if out else [[]] * 5, ["doc_id", "n", "p1", "p2", "prefix"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        yield _batch([batch.column(0), [shingles(t.as_py(), hashes).tobytes() for t in batch.column(1)]], ["doc_id", "set"], [pa.int64(), pa.binary()])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            ok.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield _batch([batch.column(0), batch.column(1), ok], ["a", "b", "linked"], [pa.int64(), pa.int64(), pa.bool_()])


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("pos_a", pa.int32()), ("pos_b", pa.int32())])
_FOUND_DDL = "a long, b long, token long, n_a int, n_b int, pos_a int, pos_b int"


def _runs(most: int):
    """From token, head, n, pos and m (members) of groups in order of token: the pairs of groups of short runs (at most `most` members) with sizes that allow a link (token null; a
    group of several members with itself too), and the rows of long runs (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64)]
        long_token: int | None = None

        def out(a, b, token, n_a, n_b, p_a, p_b) -> pa.RecordBatch:
            none = lambda x, t: pa.nulls(len(a), t) if x is None else pa.array(x, t)
            return pa.RecordBatch.from_arrays([none(x, f.type) for x, f in zip((a, b, token, n_a, n_b, p_a, p_b), _FOUND, strict=True)], schema=_FOUND)

        def rows(token, doc, n, pos) -> pa.RecordBatch:
            return out(doc, None, token, n, None, pos, None)

        def pairs(doc, n, pos, m, i, j) -> pa.RecordBatch:
            ok = ((doc[i] != doc[j]) | (m[i] > 1) | (m[j] > 1)) & (100 * np.minimum(n[i], n[j]).astype(np.int64) >= PERCENT * np.maximum(n[i], n[j]).astype(np.int64))
            i, j = i[ok], j[ok]
            swap = doc[i] > doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            return out(doc[i], doc[j], None, n[i], n[j], pos[i], pos[j])

        def closed(token, doc, n, pos, m) -> Iterator[pa.RecordBatch]:
            """Of whole runs."""
            cuts = np.flatnonzero(np.diff(token)) + 1
            starts, ends = np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(token)]]).astype(np.int64)
            size, members = ends - starts, np.add.reduceat(m, starts)
            short = members <= most
            own = np.flatnonzero((m > 1) & np.repeat(short, size))  # groups of several members, with themselves
            first, second = [own], [own]
            for rows_of in np.unique(size[(size > 1) & short]):
                i, j = np.triu_indices(rows_of, 1)
                at = starts[(size == rows_of) & short]
                first.append((at[:, None] + i).ravel())
                second.append((at[:, None] + j).ravel())
            i, j = np.concatenate(first), np.concatenate(second)
            for k in range(0, len(i), 200_000):
                yield pairs(doc, n, pos, m, i[k : k + 200_000], j[k : k + 200_000])
            for x, y in zip(starts[~short], ends[~short], strict=True):
                yield rows(token[x:y], doc[x:y], n[x:y], pos[x:y])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(new[0]):
                continue
            if long_token is not None:  # goes on with a run that is already known to be long
                k = int(np.searchsorted(new[0], long_token, side="right"))
                yield rows(*(c[:k] for c in new[:4]))
                new = [c[k:] for c in new]
                if not len(new[0]):
                    continue
                long_token = None
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last:
                yield from closed(*(c[:last] for c in held))
                held = [c[last:] for c in held]
            if held[4].sum() > most:
                long_token = int(held[0][-1])
                yield rows(*held[:4])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from closed(*held)

    return run


def _need(a: str, b: str) -> str:
    """SQL for the least overlap of sets of these sizes that link."""
    return f"ceil({PERCENT} * ({a} + {b}) / {100 + PERCENT}.0D - 1e-9)"


def _rest(n: str) -> str:
    """SQL for the shingles after the prefix."""
    return f"(ceil({PERCENT} * {n} / 100.0D - 1e-9) - 1)"


def _room() -> str:
    """Room for the overlap after a pair's first common shingle of a short run. Rows of long runs stay."""
    return f"b IS NULL OR least(n_a - pos_a, n_b - pos_b) >= {_need('n_a', 'n_b')}"


def _frequent_order(seen: DataFrame, bound: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most bound shingles, sorted, with their rank: the more often seen, the higher."""
    counts = stored(seen.groupBy("hash").agg(F.sum("seen").alias("n")), "frequent")
    held, cut = 0, 1 << 62
    for r in counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("level")).agg(F.count("*").alias("m"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        if (held := held + r["m"]) > bound:
            break
        cut = r["n"]
    rows = counts.filter(F.col("n") >= cut).collect()
    h, n = np.array([r["hash"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _grouped(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From doc_id, n, p1, p2 and prefix: head, n, m and prefix of each group of equal size and prefix (m: its rows), and member, head, n and m of groups of several rows (stored)."""
    key = ["n", "p1", "p2"]
    groups = stored(prefixes.groupBy(*key).agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).filter("m > 1"), "groups")
    members = stored(prefixes.select("doc_id", *key).join(small(groups, BROADCAST), key).select(F.col("doc_id").alias("member"), "head", "m", *key).distinct(), "members")
    marked = prefixes.join(small(members.withColumnRenamed("member", "doc_id"), BROADCAST), ["doc_id", *key], "left")
    heads = marked.filter("head IS NULL OR head = doc_id").select(F.col("doc_id").alias("head"), "n", F.coalesce("m", F.lit(1)).cast("long").alias("m"), "prefix")
    return heads, members.select("member", "head", "n", "m")


def _group_pairs(index: DataFrame) -> DataFrame:
    """From token, head, n, pos and m: pairs of groups of short runs whose sizes and first places allow a link, with their common shingles, and the rows of long runs."""
    found = index.select("token", "head", "n", "pos", "m").repartition("token").sortWithinPartitions("token").mapInArrow(_runs(RUN), _FOUND_DDL)
    return found.groupBy("a", "b", "token", "n_a", "n_b").agg(F.count("*").alias("common"), F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b")).filter(_room())


def _likely(pairs: DataFrame, share: DataFrame) -> DataFrame:
    """a, b, n_a and n_b of pairs of groups with enough common shingles: those of short runs, and at most as many of long ones as either has."""
    for c in "ab":
        long = share.select(F.col("_s").alias(f"_{c}"), F.col("long").alias(f"long_{c}"))
        pairs = pairs.join(small(long, BROADCAST), F.col(c) == F.col(f"_{c}"), "left")
    most = f"common + least(coalesce(long_a, 0), coalesce(long_b, 0)) + greatest({_rest('n_a')}, {_rest('n_b')})"
    return pairs.filter(f"{most} >= {_need('n_a', 'n_b')}").select("a", "b", "n_a", "n_b")


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """a and b of the distinct pairs of members of pairs of groups, which have RUN members together at most."""
    few = members.filter(f"m <= {RUN}")
    for c in "ab":
        side = few.select(F.col("member").alias(f"member_{c}"), F.col("head").alias(f"_{c}"), F.col("n").alias(f"_n_{c}"))
        pairs = pairs.join(small(side, BROADCAST), (F.col(c) == F.col(f"_{c}")) & (F.col(f"n_{c}") == F.col(f"_n_{c}")), "left").withColumn(c, F.coalesce(f"member_{c}", c))
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of long runs for each member (doc_id) of their groups. A large group's members are dealt into parts, each of which meets its head's rows in a task of its own."""
    parts = F.ceil(F.col("m") / SORTED)
    sizes = members.groupBy(F.col("head").alias("_h"), F.col("n").alias("_n")).agg(F.max(parts).alias("_parts"))
    last = F.coalesce("_parts", F.lit(1).cast("long")) - 1
    rows = runs.join(sizes, (F.col("head") == F.col("_h")) & (F.col("n") == F.col("_n")), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_h", "_n", "_parts")
    dealt = members.select("member", F.col("head").alias("_h"), F.col("n").alias("_n"), F.pmod(F.xxhash64("member"), parts).alias("_part"))
    rows = rows.join(dealt, (F.col("head") == F.col("_h")) & (F.col("n") == F.col("_n")) & (F.col("part") == F.col("_part")), "left")
    return rows.select("token", F.coalesce("member", "head").alias("doc_id"), "n", "pos", "share").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked of distinct pairs."""
    x, y = (sets.select(F.col("doc_id").alias(f"_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")
    joined = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
    return stored(joined.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long, linked boolean"), "verified")


def _merged(roots: DataFrame | None, verified: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """node and root after more links."""
    links = verified.filter("linked").select("a", "b")
    if roots is None:
        return components(links.unionByName(bridges) if bridges is not None else links)
    for c in "ab":
        links = links.join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_r", c)).drop("_n", "_r")
    more = components(links)
    moved = roots.join(more.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return stored(moved.unionByName(more.join(roots.select("node"), "node", "left_anti")), "roots")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and wordless texts have no shingles and link with nothing. Rows with the same id are one node, which has the links of all its texts; rows
    with a null id have no component (null). Repeated rows and equal sets link. Other columns are ignored; no rows give no rows. A very long text is
    one array of hashes in one task.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    pass_one = stored(docs.mapInArrow(_signatures, "doc_id long, key long, n int, digest binary, hash long, seen long"), "signatures")
    rows = pass_one.filter("n IS NOT NULL").select("doc_id", "key", "n", "digest")
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # ids of several rows; those of several texts link what is equal to any of them
    again = stored(nodes.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("m"), (F.min("key") != F.max("key")).alias("several")).filter("m > 1"), "again")
    repeats = not again.isEmpty()
    # equal sets
    same = stored(nodes.groupBy("n", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).filter("m > 1").select(F.col("n").alias("_n"), F.col("digest").alias("_d"), "first"), "same")
    copies = stored(nodes.join(small(same, BROADCAST), (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_d"))).filter("doc_id <> first").select("doc_id", "key", "first").distinct(), "copies")
    bridges = copies.join(small(again.filter("several"), BROADCAST), F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    gone = small(copies.select(F.col("doc_id").alias("_c"), F.col("key").alias("_k")), BROADCAST)
    single = docs.filter("doc_id IS NOT NULL").join(gone, (F.col("doc_id") == F.col("_c")) & (F.col("key") == F.col("_k")), "left_anti")
    single = (single.dropDuplicates(["doc_id", "key"]) if repeats else single).select("doc_id", "text")
    # prefixes and groups
    order = spark.sparkContext.broadcast(_frequent_order(pass_one.filter("hash IS NOT NULL").select("hash", "seen")))
    prefixes = stored(single.mapInArrow(_prefixes(order), "doc_id long, n int, p1 long, p2 long, prefix array<long>"), "prefixes")
    heads, members = _grouped(prefixes)
    # the index: runs of groups that share a prefix shingle
    index = heads.select(F.posexplode("prefix").alias("pos", "token"), "head", "n", "m")
    found = stored(_group_pairs(index), "found")
    runs = found.filter("b IS NULL").select("token", F.col("a").alias("head"), F.col("n_a").alias("n"), F.col("pos_a").alias("pos"))
    share = stored(runs.groupBy(F.col("head").alias("_s")).agg(F.count("*").alias("long"), (F.count("*") / F.max("n")).alias("share")), "long-runs")
    pairs = stored(_expanded(_likely(found.filter("b IS NOT NULL"), share), members), "pairs")
    runs = stored(_spread(runs.join(share.drop("long"), F.col("head") == F.col("_s")).drop("_s"), members), "long")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("_c")).unionByName(runs.select(F.col("doc_id").alias("_c"))).distinct(), "candidates")
    texts = docs.join(small(wanted, BROADCAST), F.col("doc_id") == F.col("_c"), "left_semi")
    texts = (texts.dropDuplicates(["doc_id", "key"]) if repeats else texts).select("doc_id", "text")
    sets = stored(texts.mapInArrow(_sets, "doc_id long, set binary"), "sets")
    # links
    verified = _linked(pairs, sets)
    roots = _merged(None, verified, bridges)
    if not runs.isEmpty():
        tried = verified
        for how in ("center", "neighbour", "all"):
            open_runs = _open_runs(runs, roots)
            pairs = _all_pairs(open_runs) if how == "all" else _proposals(open_runs, how)
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            verified = _linked(stored(pairs, f"pairs-{how}"), sets)
            tried = tried.unionByName(verified)
            roots = _merged(roots, verified)
    # equal sets join the component of the first of them
    to_root = copies.join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("first") == F.col("_n"), "left").select(F.col("doc_id").alias("node"), F.coalesce("_r", "first").alias("root"))
    final = roots.unionByName(to_root)
    final = stored(final.groupBy("node").agg(F.min("root").alias("root")), "final")
    out = rows.join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _open_runs(index: DataFrame, roots: DataFrame) -> DataFrame:
    """token, doc_id, n, pos, share, root and m (rows of the run) of runs that reach into more than one component; stored."""
    marked = stored(index.join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc_id")).drop("node"), "marked-runs")
    several = marked.groupBy(F.col("token").alias("_t")).agg(F.count("*").alias("m"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("_t", "m")
    return stored(marked.join(small(stored(several, "open-tokens"), BROADCAST), F.col("token") == F.col("_t")).drop("_t"), "open-runs")


def _proposals(runs: DataFrame, how: str) -> DataFrame:
    """At most one pair for each text: the one that most of its runs propose."""
    if how == "center":
        best = runs.groupBy(F.col("token").alias("_t")).agg(F.max(F.struct("share", (-F.col("doc_id")).alias("minus"), "n")).alias("c"))
        best = small(stored(best.select("_t", (-F.col("c.minus")).alias("other"), F.col("c.n").alias("size")), "centers"), BROADCAST)
        pairs = runs.join(best, F.col("token") == F.col("_t"))
    else:
        # a run of very many rows is dealt into parts, each with neighbours of its own
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / SORTED))
        run = Window.partitionBy("token", "part").orderBy("n", "doc_id")
        pairs = runs.withColumn("part", part).withColumn("other", F.lag("doc_id").over(run)).withColumn("size", F.lag("n").over(run))
    pairs = pairs.filter("doc_id <> other").filter(f"100 * least(n, size) >= {PERCENT} * greatest(n, size)")
    counted = pairs.groupBy("doc_id", "other").agg(F.count("*").alias("votes"))
    best = counted.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.col("other")).alias("minus"))).alias("best")).select("doc_id", (-F.col("best.minus")).alias("other"))
    return best.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def _all_pairs(runs: DataFrame) -> DataFrame:
    """Pairs of different components that share a shingle of a long run and have room for the overlap after it. If a pair's first common shingle has a
    short run, it is among the short runs' pairs; if it has a long one, it has room there. Runs are dealt into parts on one side, each of
    which meets the whole other side in a task of its own."""
    x, y = (runs.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "pos", "root", "m")]) for s in "xy")
    fits = f"100L * least(n_x, n_y) >= {PERCENT}L * greatest(n_x, n_y) AND least(n_x - pos_x, n_y - pos_y) >= {_need('n_x', 'n_y')}"
    # every row that can pair at all has room for itself, which drops most of a run before it is joined
    x, y = (df.filter(f"n_{s} - pos_{s} >= {_need(f'n_{s}', f'ceil({PERCENT} * n_{s} / 100.0D - 1e-9)')}") for df, s in ((x, "x"), (y, "y")))
    parts = lambda s: F.ceil(F.col(f"m_{s}") / JOINED)
    x = x.withColumn("part", F.pmod(F.xxhash64("doc_id_x"), parts("x")))
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts("y") - 1)))
    return x.join(y, ["token", "part"]).filter("doc_id_x < doc_id_y AND root_x <> root_y").filter(fits).select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, its smallest id; rows without shingles and with a null id stay. Repeated rows of that id all stay."""
    found = near_components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    gone = stored(found, "near-copies")
    return docs.join(small(gone, BROADCAST), docs["doc_id"] == gone["_drop"], "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
