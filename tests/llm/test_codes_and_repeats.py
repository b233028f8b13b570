"""Operators 11 to 13 against brute-force versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import importance, suffix_dedup, vector_codes

EXTRA = ("id", "k1", "k2", "g", "u", "v", "code", "bucket", "place", "_range", "start", "runs", "n")


def clashing(df, but=()):
    for c in EXTRA:
        if c not in but:
            df = df.withColumn(c, F.lit("clash"))
    return df


# ---- 11


def codes_by_force(rows):
    """rows: (vec_id, label, vector) that are kept. Returns (vec_id, label, code, error) sorted, and the digest."""
    width = -(-max(len(v) for *_, v in rows) // 16) * 16
    ints = sorted(((math.inf if i is None else i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), label) for i, label, v in rows), key=lambda r: r[:2])
    d = width // 16
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in ints[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(2):
        sums = {}
        for _, v, _ in ints:
            for p in range(16):
                sums.setdefault((p, best(v, p)[1]), []).append(cut(v, p))
        books = [[[sum(c) // len(c) for c in zip(*sums[p, i], strict=True)] if (p, i) in sums else e for i, e in enumerate(books[p])] for p in range(16)]
    out = [(i, label, "".join(f"{best(v, p)[1]:02x}" for p in range(16)), sum(best(v, p)[0] for p in range(16))) for i, v, label in ints]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_vector_codes(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 1, 2]), [rnd.choice([-1.5, -0.001, 0.0, 0.25, 0.251, 3.0]) for _ in range(32)]) for i in range(150)]
    rows += [(7, 1, rows[7][2]), (7, 1, [0.5] * 32), (None, None, [-0.25] * 32), (200, 3, [1.0] * 20), (201, 3, [])]
    bad = [(300, 1, None), (301, 1, [None] + [0.0] * 31), (302, 1, [float("nan")] * 32), (303, 1, [float("inf")] * 32), (304, None, [-float("inf")] + [0.0] * 31)]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>")).repartition(5)
    got = vector_codes.compress(df).collect()
    want, sha = codes_by_force(rows)
    labels = Counter()
    for _, label, _, error in want:
        labels[label] += error
    assert sorted((math.inf if r["vec_id"] is None else r["vec_id"], str(r["label"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted((i, str(label), code, error, labels[label]) for i, label, code, error in want)
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_vector_codes_few_and_none(spark):
    form = "vec_id long, label int, embedding array<float>"
    few = spark.createDataFrame([(1, None, [0.5] * 16), (2, 4, [0.25] * 16)], form)
    assert [(r["code"], r["error"]) for r in vector_codes.compress(few).orderBy("vec_id").collect()] == [("00" * 16, 0), ("01" * 16, 0)]
    assert vector_codes.compress(few.limit(0)).collect() == [] and vector_codes.compress(spark.createDataFrame([(1, 1, None)], form)).collect() == []
    empty = vector_codes.compress(spark.createDataFrame([(1, 1, []), (2, 1, [])], form)).collect()
    assert [(r["code"], r["error"]) for r in empty] == [("00" * 16, 0)] * 2
    books = vector_codes.fit(few)
    back = vector_codes.decode(vector_codes.compress(few), books).orderBy("vec_id").collect()
    assert [r["vector"] for r in back] == [[0.5] * 16, [0.25] * 16]
    with pytest.raises(Exception, match="131072"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [3e38] * 16)], form)).collect()


def test_annulus_is_exact_and_prunes():
    rnd = np.random.default_rng(2)
    for spread in (2, 50, 5000):
        entries, parts = rnd.integers(-spread, spread, (64, 4)), rnd.integers(-spread, spread, (9000, 4))
        index, distance = vector_codes.nearest(parts, entries)
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


# ---- 12


def features(text, n=3):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def test_importance_resampling(spark):
    rnd = random.Random(8)
    vocabulary = ["alpha", "Beta", "gam-ma", "é1", "x", "Ü", "longer", "77", "日本", "of"]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 5, 19, 20, 25, 60])))) for i in range(200)]
    docs += [(3, docs[3][1]), (400, None), (401, ""), (402, " .,"), (None, "x " * 30), (403, "of x " * 20_000)]
    target = [(1, "alpha of alpha of"), (2, None), (3, "日本 x")]
    form = "doc_id long, text string, lang string"
    df = clashing(spark.createDataFrame([(*d, "en") for d in docs], form)).repartition(6)
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(df, bench).collect()
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for _, x in target:
        t.update(features(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for i, x in docs:
        words, own = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    place = {}
    for n, r in enumerate(able[: 5 * len(able) // 100], 1):
        place.setdefault(r, []).append(n)
    want = [(*r, place[r].pop(0) if place.get(r) else None) for r in rows]
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    drawn = importance.drawn_documents(df, bench)
    assert drawn.columns == df.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[5]}
    assert importance.resample(df.limit(0), bench).collect() == []
    alone = importance.resample(df, bench.limit(0)).collect()
    assert len(alone) == len(docs)


def test_ring_equals_features():
    for text in ("", None, "One two", "a b c d e f g é"):
        n, own = importance.buckets_of(text)
        assert (n, sorted(own.tolist())) == (features(text)[0], sorted(features(text)[1]))
    assert sorted(importance.buckets_of("a b c d", 2)[1].tolist()) == sorted(features("a b c d", 2)[1])


def test_ranked_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("x"), F.col("id").alias("y")).repartition(7)
    got = importance.ranked(rows, F.desc("x"), F.asc("y")).orderBy("place").collect()
    assert [(r["x"], r["y"]) for r in got] == sorted(((i % 700, i) for i in range(5000)), key=lambda r: (-r[0], r[1])) and [r["place"] for r in got] == list(range(1, 5001))


# ---- 13


def repeats_by_force(texts, threshold):
    raw = [(x or "").encode() for x in texts]
    seen = Counter(r[i : i + threshold] for r in raw for i in range(len(r) - threshold + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - threshold + 1):
            if seen[r[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def odd_texts(rnd, threshold):
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, near = prose(2 * threshold), prose(2 * threshold)
    texts = [prose(rnd.randint(1, threshold)) for _ in range(30)]
    for _ in range(25):
        a = rnd.randrange(len(shared) - threshold)
        texts.append(prose(20) + shared[a : a + rnd.randint(threshold - 6, 2 * threshold)] + prose(20))
    for _ in range(15):  # copies with a few bytes changed
        copy = list(near)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
    own = prose(threshold)
    return texts + [None, "", own + " " + own, "x" * (threshold - 1), "x" * threshold, "ab" * threshold, "x" * 3 * threshold, shared, shared, texts[0], texts[40], texts[40]]


@pytest.mark.parametrize(("threshold", "block", "broadcast"), [(20, 1 << 19, 8 << 20), (37, 50, 0), (8, 64, 8 << 20), (1, 1 << 19, 0)])
def test_repeats(spark, threshold, block, broadcast):
    rnd = random.Random(threshold)
    texts = odd_texts(rnd, max(threshold, 8))
    df = clashing(spark.createDataFrame([(i if i % 11 else None, x) for i, x in enumerate(texts)], "doc_id long, text string")).repartition(3)
    got = suffix_dedup.remove_repeats(df, threshold, block=block, broadcast=broadcast).collect()
    want = [((-1 if i % 11 == 0 else i), *r) for i, r in enumerate(repeats_by_force(texts, threshold))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got) == sorted(want)


def test_repeated_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "0123456789ab"), (2, "..0123456789,,"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.repeated_spans(df, 10).collect())) == [(1, 0, 10), (2, 2, 12)]
    assert suffix_dedup.remove_repeats(df.limit(0), 10).collect() == []
    cut = suffix_dedup.without_repeats(clashing(df), 10)
    assert cut.columns == clashing(df).columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "ab", 2: "..,,", 3: None}


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for width in (1, 2, 7, 56, 57):
        assert suffix_dedup.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]
