"""Each operator against a brute-force version or known answers, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import decontamination, exact_dedup, hmm_lm, html_extraction, jaccard_join, language_id, mixing, sharding, url_filter, warc
from tessel.llm.components import components

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; clash on purpose.
EXTRA = ("_row", "_hash", "digest", "n", "copies", "shard", "host", "size")


def frame(spark, docs):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, DDL)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(text):
    return (text or "").encode().lower().split()


def benchmark_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (4, "A b\x0bC"), (4, "A b\x0bC"), (5, "ÉA! b"), (6, "x " * 30_000), (7, "a b c d e f g h i j k")]


# ---- 1


def test_hmm_counts(spark):
    docs = [*ODD, *[(i, " ".join(random.Random(i).choices("the of in le la de und die".split(), k=20))) for i in range(10, 60)]]
    got = {(r["doc_id"], r["n_tokens"]): r for r in hmm_lm.score(frame(spark, docs), states=2, frequent=5, rounds=1).collect()}
    assert len(hmm_lm.score(frame(spark, docs).limit(0), rounds=1).collect()) == 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    total, distinct = sum(c.values()), len(c)
    for i, t in docs:
        w = [*words(t), None]
        r = got[i, len(w)]
        assert r["held_out"] == held(i) and r["train_tokens"] == total and r["n_known"] == sum(c[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])


def small_model():
    rnd = np.random.default_rng(3)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return {"start": norm(rnd.random(2), 0), "move": norm(rnd.random((2, 2)), 1), "emit": norm(rnd.random((3, 2)), 0)}


def by_paths(m, seq):
    total = 0.0
    for path in itertools.product(range(2), repeat=len(seq)):
        p = m["start"][path[0]] * m["emit"][seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m["move"][path[t - 1], path[t]] * m["emit"][seq[t], path[t]]
        total += p
    return math.log(total)


def test_forward_is_exact():
    m, seqs = small_model(), [np.array(s, np.uint16) for s in ([0], [1, 2, 0], [2, 2, 1, 0, 1], [0, 1])]
    for places, x, lengths in hmm_lm._blocks(seqs):
        assert hmm_lm.forward(m, x, lengths) == pytest.approx([by_paths(m, seqs[i]) for i in places])


def test_baum_welch_never_loses():
    m = small_model()
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 0, 1, 2], [1, 1, 2], [0, 0, 0, 2], [2])]
    seen = []
    for _ in range(6):
        sums = hmm_lm._zero(3, 2)
        hmm_lm.expected(m, seqs, sums)
        assert sums["emit"].sum() == pytest.approx(sum(map(len, seqs))) and sums["start"].sum() == pytest.approx(len(seqs))
        seen.append(sums["loglik"])
        m = hmm_lm.next_model(sums, 1e-9)
    assert all(a <= b + 1e-9 for a, b in zip(seen, seen[1:], strict=False))


def test_baum_welch_in_runs_of_steps(monkeypatch):
    m, rnd = small_model(), random.Random(4)
    seqs = [np.array([*rnd.choices((1, 2), k=rnd.randrange(30)), 0], np.uint16) for _ in range(9)]
    found = []
    for tokens, rows in ((400_000, 512), (7, 512), (7, 2), (1, 1)):
        monkeypatch.setattr(hmm_lm, "TOKENS", tokens)
        monkeypatch.setattr(hmm_lm, "ROWS", rows)
        hmm_lm.expected(m, seqs, sums := hmm_lm._zero(3, 2))
        score = np.zeros(len(seqs))
        for places, x, lengths in hmm_lm._blocks(seqs):
            score[places] = hmm_lm.forward(m, x, lengths)
        found.append(np.concatenate([[sums["loglik"]], sums["start"], sums["move"].ravel(), sums["emit"].ravel(), score]))
    assert all(f == pytest.approx(found[0]) for f in found[1:])


def test_training_and_score_against_one_process(spark):
    rnd, frequent, states, rounds = random.Random(6), 4, 2, 3
    docs = [(i, " ".join(rnd.choices("the of in le la de und die a1 b2 c3 zz".split(), weights=range(12, 0, -1), k=rnd.randrange(7)))) for i in range(80)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in words(t))
    spread = Counter(c.values())
    cut = min((n for n in spread if sum(m for k, m in spread.items() if k >= n) <= frequent), default=10**9)
    top = sorted((w for w in c if c[w] >= cut), key=lambda w: (-c[w], w))
    rare = {w: 1 + hmm_lm.tail_class(w) for w in {w for _, t in docs for w in words(t)} - set(top)}
    of = {w: 1 + hmm_lm.TAILS + i for i, w in enumerate(top)} | rare
    seq = {i: np.array([*(of[w] for w in words(t)), 0], np.uint16) for i, t in docs}
    learned = [seq[i] for i, _ in docs if not held[i]]
    n = 1 + hmm_lm.TAILS + len(top)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(learned))), pa.array([s.tobytes() for s in learned])], ["row", "classes"])
    parts = next(hmm_lm._company(n, hmm_lm.ANCHORS)(iter([batch])))
    model = hmm_lm.first_model(np.concatenate([np.array(p) for p in parts.column(1).to_pylist()]).reshape(n, -1), states, n)
    for _ in range(rounds):
        hmm_lm.expected(model, learned, sums := hmm_lm._zero(n, states))
        model = hmm_lm.next_model(sums)
    room = {k: (sum(c[w] for w in rare if rare[w] == k), sum(c[w] > 0 for w in rare if rare[w] == k)) for k in set(rare.values())}
    got = {r["doc_id"]: r["score"] for r in hmm_lm.score(frame(spark, docs).repartition(3), states=states, frequent=frequent, rounds=rounds).collect()}
    for i, t in docs:
        share = sum(math.log10((c[w] + 0.1) / (room[rare[w]][0] + 0.1 * (room[rare[w]][1] + 1))) for w in words(t) if w in rare)
        assert got[i] == pytest.approx(by_paths(model, seq[i]) / math.log(10) + share, rel=1e-4)


# ---- 2


@pytest.mark.parametrize("k", range(7))
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.choices(range(9), k=rnd.randrange(7))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark, monkeypatch):
    tricky = "é\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a.b/ x\n%", None), (2, "HTTP://WWW.a.b", ""), (3, None, tricky), (7, "http://c.a.b/?q", tricky), (None, "x", "abc"), (9, "x", "abc"), (9, "x", "abc"), (10, "x", "abc"), (11, "y", "z" * 300_000), (12, "y", "z" * 9_000_000)]
    rows += [(None, "same", str(i % 50)) for i in range(400)]
    monkeypatch.setattr(warc, "RANGE_ROWS", 30)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.archive_report(pages).collect()
    assert len(got) == len(rows) and warc.archive_report(pages.limit(0)).collect() == []
    import base64

    for i, _, html in rows:
        data = (html or "").encode()
        smallest = min((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if i is not None and i > smallest else "response", smallest if i is not None and i > smallest else None)
        assert want in [(r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] == i]
    when = F.lit("2024-01-01T00:00:00Z")
    index = sorted(warc.capture_history(pages.select("page_id", "url", "html"), when).collect(), key=lambda r: (r["range"], r["place"]))
    keys = [(r["key"], r["ts"], -1 if r["page_id"] is None else r["page_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == len(rows)
    merged = warc.merge_index(warc.stored(spark.createDataFrame([r[:11] for r in index], warc.DDL), "t"), 30).collect()
    merged = sorted(merged, key=lambda r: (r["range"], r["place"]))
    assert [warc.sort_key(r) for r in merged] == sorted(warc.sort_key(r) for r in index)
    assert max(Counter(r["range"] for r in merged).values()) <= 90  # one URL, one time and no id, but many ranges
    assert warc.sorted_parts([]) == [] and len(warc.sorted_parts([tuple(r) for r in merged] * 2)) == 2
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_archive(b"junk", "f"))


# ---- 3


def jump(key, n):
    key, b, j = (key or 0) & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    docs = [*ODD, (2**63 - 1, "q"), (-(2**63), "r"), *[(i, "t") for i in range(100, 400)]]
    got = sharding.shard_documents(frame(spark, docs), 7).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(r["doc_id"], 7), jump(r["doc_id"], 8), "key") and r["grown_shard"] in (r["shard"], 7)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(frame(spark, docs).limit(0)).collect() == []


# ---- 4


def near(docs):
    sets, parent = {}, {}
    for i, t in docs:
        w = words(t)
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, []).append(s)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a, b in itertools.combinations(ids, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids} | {None: None}


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 8)
    monkeypatch.setattr(jaccard_join, "REPORTED", 2)
    monkeypatch.setattr(jaccard_join, "SORTED", 16)
    monkeypatch.setattr(jaccard_join, "JOINED", 4)
    rnd, vocabulary, n = random.Random(1), [f"w{i}" for i in range(200)], itertools.count(10)
    docs = list(ODD)
    for _ in range(3):
        base = rnd.choices(vocabulary, k=60)
        for _ in range(30):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(60)] = rnd.choice(vocabulary)
            docs.append((next(n), " ".join(own)))
    passage = rnd.choices(vocabulary, k=40)
    docs += [(next(n), " ".join(rnd.choices(vocabulary, k=rnd.randrange(2, 16)) + passage)) for _ in range(40)]
    docs += [(next(n), " ".join(rnd.choices(vocabulary[:4], k=rnd.randrange(1, 8)))) for _ in range(40)]
    # ids with several texts: a copy here, a link there, and a text of a group with one prefix
    one, other, third = (rnd.choices(vocabulary, k=50) for _ in range(3))
    docs += [(5003, " ".join(one)), (5005, " ".join(one)), (5005, " ".join(other)), (5007, " ".join(other[:-1])), (5005, " ".join(other)), (5009, " ".join(third)), (5007, " ".join(third[1:])), (5010, " ".join(third[:-1]))]
    got = jaccard_join.near_components(frame(spark, docs)).collect()
    want = near(docs)
    assert {want[i] for i in (5003, 5005, 5007, 5009, 5010)} == {5003}
    assert len(got) == len(docs) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == {(i, len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if (w := words(t)) else 0) for i, t in docs}


def test_groups_are_paired_before_they_expand(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 12)
    monkeypatch.setattr(jaccard_join, "SORTED", 5)
    rnd, groups, doc = random.Random(4), [], itertools.count(1)
    for g in range(60):
        prefix = [9, *rnd.sample(range(10, 40), 2), 100 + g] if g % 10 == 0 else rnd.sample(range(10, 70), 4)
        groups.append((rnd.randrange(15, 20), prefix, [next(doc) for _ in range(17 if g < 2 else rnd.choice([1, 1, 2, 3, 4]))]))
    rows = [(d, n, g, -g, p) for g, (n, p, ids) in enumerate(groups) for d in ids]
    prefixes = spark.createDataFrame(rows, "doc_id long, n int, p1 long, p2 long, prefix array<long>")
    heads, members = jaccard_join._grouped(prefixes)
    assert sorted((r["head"], r["n"], r["m"]) for r in heads.collect()) == sorted((min(ids), n, len(ids)) for n, _, ids in groups)
    found = jaccard_join._group_pairs(heads.select(F.posexplode("prefix").alias("pos", "token"), "head", "n", "m")).cache()
    listed = found.filter("b IS NOT NULL")
    load = {t: sum(len(ids) for _, p, ids in groups if t in p) for _, p, _ in groups for t in p}
    need = lambda a, b: -(-80 * (a + b) // 180)
    places = lambda g, h: [(g[1].index(t), h[1].index(t)) for t in g[1] if t in h[1] and load[t] <= 12]
    fits = lambda g, h: 5 * min(g[0], h[0]) >= 4 * max(g[0], h[0]) and (at := places(g, h)) and min(g[0] - min(x for x, _ in at), h[0] - min(y for _, y in at)) >= need(g[0], h[0])
    want = [(g, h) for i, g in enumerate(groups) for h in groups[i:] if (g is not h or len(g[2]) > 1) and fits(g, h)]
    assert {(r["a"], r["b"]) for r in listed.collect()} == {(g[2][0], h[2][0]) for g, h in want} and listed.count() == len(want)
    pairs = {tuple(r) for r in jaccard_join._expanded(listed.select("a", "b", "n_a", "n_b"), members).collect()}
    assert pairs == {(min(x, y), max(x, y)) for g, h in want for x in g[2] for y in h[2] if x != y} and len(pairs) > 2 * len(want)
    runs = found.filter("b IS NULL").select("token", F.col("a").alias("head"), F.col("n_a").alias("n"), F.col("pos_a").alias("pos"), F.lit(0.5).alias("share"))
    spread = sorted(tuple(r)[:4] for r in jaccard_join._spread(runs, members).collect())
    assert spread == sorted((t, d, n, p.index(t)) for n, p, ids in groups for t in p if load[t] > 12 for d in ids) and any(len(ids) > 12 for *_, ids in groups)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_components(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(20)] + [(rnd.randrange(30, 60), rnd.randrange(30, 60)) for _ in range(15)] + [(70, 70), (None, 1)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


# ---- 5


def test_language(spark):
    rnd = random.Random(4)
    stems = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "schön", "über"], "fr": ["le", "été", "avec", "que"]}
    make = lambda lang: " ".join(rnd.choice(stems[lang]) + rnd.choice(["", rnd.choice(stems[lang])]) for _ in range(12))
    rows = [(i, make(lang), lang, "s", 1) for i, lang in enumerate(list(stems) * 40)]
    rows += [(1000, None, "en", "s", 0), (1001, " 12 ?? ½", "en", "s", 0), (1002, "漢字", None, "s", 0), (None, "der und", None, "s", 0)]
    df = spark.createDataFrame(rows, DDL)
    got = {r["doc_id"]: r for r in language_id.predict(df.withColumn("host", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows[:-4]:
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] in stems and got[None]["lang_pred"] == "de"
    assert {r["doc_id"] for r in language_id.accepted(df).collect()} == set(got) - {1000, 1001, 1002}
    assert {r["lang_pred"] for r in language_id.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def backoff(learned, text):
    """Language and share of the likelihood, straight from the rule."""
    import re

    cut = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    pieces = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    langs = sorted({lang for lang, _ in learned})
    n_of = {(lang, k): Counter() for lang in langs for k in range(5)}
    for lang, t in learned:
        for w in cut(t):
            n_of[lang, 0][w] += 1
            for k in range(1, 5):
                n_of[lang, k].update(pieces(w if k == 1 else f" {w} ", k))
    log = lambda lang, k, g: math.log10(n_of[lang, k][g] / sum(n_of[lang, k].values())) if n_of[lang, k][g] else -7.0
    known = lambda k, g: any(n_of[lang, k][g] for lang in langs)
    total = dict.fromkeys(langs, 0.0)
    for w in cut(text):
        use = [(0, w)] if known(0, w) else next((u for k in (4, 3, 2, 1) if (u := [(k, g) for g in pieces(w if k == 1 else f" {w} ", k) if known(k, g)])), [])
        for lang in langs:
            total[lang] += sum(log(lang, k, g) for k, g in use) / max(1, len(use))
    best = max(langs, key=lambda lang: total[lang])
    return best, 1 / sum(10 ** (x - total[best]) for x in total.values())


def test_language_against_brute_force(spark):
    rnd = random.Random(5)
    parts = {"en": ["th", "ing", "er", "and", "st"], "de": ["sch", "ung", "er", "und", "st"], "fr": ["eau", "que", "er", "et", "st"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(parts[lang] if rnd.random() < 0.8 else parts["en"], k=rnd.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang := rnd.choice(list(parts)), rnd.randrange(1, 9)), lang, "s", 1) for i in range(120)]
    rows += [(7, "Schung QUE Xy", "de", "s", 1)] * 3 + [(200, text("fr", 20_000), "fr", "s", 1), (201, "", "fr", "s", 1), (202, None, "fr", "s", 1), (203, "zzz", "fr", None, 1), (203, "qqq ing", None, None, 1)]
    df = frame(spark, []).limit(0).select(*DDL.replace(",", "").split()[::2]).unionByName(spark.createDataFrame(rows, DDL)).withColumn("lang_pred", F.lit("clash")).withColumn("n", F.lit(0))
    learned = [(r[2], r[1]) for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    want = Counter((i, backoff(learned, t)[0] if t and any(map(str.isalpha, t)) else "und") for i, t, *_ in rows)
    got = language_id.predict(df).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == want
    share = {(i, backoff(learned, t)[1]) for i, t, *_ in rows if t}
    assert all(any(j == r["doc_id"] and x == pytest.approx(r["score"], abs=1e-3) for j, x in share) for r in got if r["lang_pred"] != "und")
    assert language_id.predict(df.limit(0)).collect() == []


def test_backoff_is_longest_first():
    scorer = language_id.Scorer({"langs": ["a", "b"], "first": "a", "index": [{"abc": 0}, {"x": 0}, {" q": 0}, {}, {"wxyz": 0}], "rows": [np.array([[-1, -7]]), np.array([[-7, -1]]), np.array([[-1, -7]]), np.zeros((0, 2)), np.array([[-1, -7]])]})
    assert scorer("abc")[0] == "a" and scorer("wxyzx")[0] == "a" and scorer("xx")[0] == "b" and scorer("q")[0] == "a"


# ---- 6

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">no</div><article><h1>T &amp; t<b>i</b>tle</h1><p>One&nbsp;&lt;two&gt;<br>three<p>4 < 5<div class="ad">no</div><form>no</form><section class="comments"><p>no</p></section></article><aside>no</aside><footer>no"""


def test_main_text():
    assert html_extraction.main_text(PAGE) == "T & title One <two> three 4 < 5"
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<p") == ""
    assert html_extraction.main_text("<div>plain</div><ul class='menu'><li>no</ul>") == "plain"


def test_template(spark):
    page = lambda i: f"<html><body><article><p>Read more here</p><p>text {i} of {i % 3}</p><p>shared</p>{'<p>shared</p>' * (i % 2)}</article></body></html>"
    rows = [(i, "http://big.com/x", page(i)) for i in range(12)] + [(100 + i, "http://small.com/x", page(i)) for i in range(3)] + [(None, None, None), (200, "http://big.com/y", PAGE)][:1]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in html_extraction.extract(df).collect()}
    assert len(got) == len(rows) and got[None]["text"] == "" and got[None]["n_chars"] == 0
    for i in range(12):
        assert got[i]["text"] == f"text {i} of {i % 3} shared{' shared' * (i % 2)}"
    assert got[101]["text"] == "Read more here text 1 of 1 shared shared"
    assert html_extraction.extract(df.limit(0)).collect() == []


def extracted(spark, pages, url="http://one.com/x"):
    rows = [(i, url, p) for i, p in enumerate(pages)]
    return [r["text"] for r in sorted(html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


def test_template_of_nested_classes(spark):
    box = lambda text: f"<div class='zzz'><p>{text}</p><div>Agree</div></div>"
    page = lambda i: f"<html><body>{box('We keep data') * (1 + (i % 5 == 0)) if i != 3 else ''}<div class='post'><p>own {i}</p>{'<p>said often</p>' * (i % 3)}</div></body></html>"
    want = [f"own {i}{' said often' * (i % 3)}" for i in range(20)]
    assert extracted(spark, [*map(page, range(20)), None, "", "<html><body>"]) == [*want, "", "", ""]
    # in another order each time: no template
    mixed = lambda i: f"<body><div class='zzz'><div>{'</div><div>'.join(('left', 'right')[:: 1 - 2 * (i % 2)])}</div></div><p>own {i}</p></body>"
    assert extracted(spark, map(mixed, range(20))) == [f"{('left right', 'right left')[i % 2]} own {i}" for i in range(20)]
    # an empty page leaves an article's template as it is
    article = lambda i: f"<body><article><p>Read more</p><p>a text of its own {i}</p></article></body>"
    assert extracted(spark, [*map(article, range(12)), None, "<html><body>"]) == [*[f"a text of its own {i}" for i in range(12)], "", ""]


def test_template_of_copies(spark):
    text = [f"Paragraph {i} of the one article" for i in range(6)]
    for tag in ("article", "div class='post'"):
        page = lambda own, foot: f"<body><{tag}>{''.join(f'<p>{t}</p>' for t in own)}</{tag.split()[0]}><footer>{foot}</footer></body>"  # noqa: E731, B023
        assert extracted(spark, [page(text, "") for _ in range(12)]) == [" ".join(text)] * 12
        assert extracted(spark, [page(text, i) for i in range(12)]) == [" ".join(text)] * 12
        versions = [[*text, f"changed on day {i}"] for i in range(12)]
        assert extracted(spark, [page(v, i) for i, v in enumerate(versions)]) == [" ".join(v) for v in versions]


def test_template_of_unnamed_parts(spark):
    """Pages that mark no article and whose class words are of another language."""
    rnd = random.Random(9)
    words = lambda n: " ".join(rnd.choices("der die das und von mit nicht ein zu im".split(), k=n))
    own = [[words(rnd.randrange(20, 60)) for _ in range(rnd.randrange(1, 5))] for _ in range(24)]

    def page(i, title="h1"):
        links = "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for _ in range(4))
        said = "".join(f"<div class=stimme><p>{words(3)}</p></div>" for _ in range(i % 3))
        return f"<body><div class=kopf><ul>{links}</ul></div><div class=hinweis><p>Wir nutzen Kekse</p></div><{title}>Titel {i}</{title}><div class=inhalt><div class=stück>{''.join(f'<p>{t}</p>' for t in own[i])}</div></div><div class=meinungen>{said}</div><div class=fuß>Impressum {words(2)}</div></body>"

    assert extracted(spark, [page(i) for i in range(24)], "http://eins.de/x") == [" ".join([f"Titel {i}", *own[i]]) for i in range(24)]
    # a page without that part keeps its text
    rows = extracted(spark, [*[page(i) for i in range(24)], "<body><p>ganz anders</p></body>"], "http://eins.de/x")
    assert rows[24] == "ganz anders"
    # twice each, and pages without a host beside them: as before, and a page without a host has no template
    pages = [(i, "http://eins.de/x", page(i % 24)) for i in range(48)] + [(100 + i, None, page(i)) for i in range(24)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == got[i + 24] for i in range(24)) and "Kekse" in got[100] and not any("Kekse" in got[i] or "Impressum" in got[i] for i in range(48))


def deduced(pages):
    """Text of a host's template, from occurrence vectors over its different pages, as (path, text)."""
    found = set()
    for article in (True, False):
        each = {}
        for html in pages:
            blocks, paths = html_extraction.parse(html)
            own = html_extraction.slots(blocks)
            if own and own[0].main == article:
                each.setdefault(tuple((b.path, b.text) for b in own), (own, paths))
        places, chars, parent = {}, Counter(), {}
        for page, (own, paths) in each.items():
            places["", page] = [0]
            for b in own:
                token = (b.path, b.text)
                parent[token] = b.path
                places.setdefault((token, page), []).append(b.at)
                chars.update({token: len(b.text), b.path: len(b.text), "": len(b.text)})
                path = b.path
                while path != html_extraction.ROOT:
                    parent[path] = paths[path][0]
                    places[path, page] = paths[path][1]
                    path = parent[path]
        tokens = {t for t, _ in places}
        vector = {t: tuple(len(places.get((t, p), ())) for p in each) for t in tokens}
        seen = {t: sum(map(bool, v)) for t, v in vector.items()}
        common = {t for t in tokens if max(html_extraction.LEAST_PAGES, html_extraction.SUPPORT * len(each)) <= seen[t]}
        up = lambda t: "" if t == "" or parent[t] == html_extraction.ROOT else parent[t]  # noqa: B023, E731
        anchor = {}
        for t in common - {""}:
            a = up(t)
            while a != "" and vector[a] != vector[t]:
                a = up(a)
            if vector[a] == vector[t] and (not article or vector[t] == vector[""]):
                anchor[t] = a
        for a in set(anchor.values()):
            group = [t for t in anchor if anchor[t] == a]
            orders = []
            for p in each:
                if order := [t for _, t in sorted((x, str(t)) for t in group for x in places.get((t, p), ()))]:
                    k = len(set(order))
                    orders.append(tuple(order[:k]) if order == order[:k] * (len(order) // k) else None)
            if None not in orders and len(set(orders)) == 1:
                found |= {(article, t) for t in group if isinstance(t, tuple)}
        mine = {t for kind, t in found if kind == article}
        for t in mine:
            here, whole = sum(chars[x] for x in mine if x[0] == t[0]), sum(chars[x] for x in mine)
            if not (2 * whole < chars[""] if article else 2 * here < chars[t[0]] or here == chars[t[0]]):
                found.discard((article, t))
    return {html_extraction._hash("text", *t) for _, t in found}


@pytest.mark.parametrize("seed", range(3))
def test_deduction_against_brute_force(spark, seed):
    rnd, hosts = random.Random(seed), {}
    for host in ("a.com", "b.com", "c.com"):
        tags = [rnd.choice(("div", "section", "ul")) for _ in range(4)]
        fixed = [f"fixed {k}" for k in range(6)]

        def page(i, tags=tags, fixed=fixed):
            part = lambda k: f"<{tags[k]}><p>{fixed[k]}</p><p>own {rnd.randrange(400)} words of page {i}</p>{f'<p>{fixed[5]}</p>' * (i % 3)}</{tags[k]}>"
            parts = [part(k) * (1 + (i % 4 == 0) * (k == 2)) for k in range(4) if k != 3 or i % 2]
            if seed == 2 and i % 2:
                parts[:2] = parts[1::-1]
            body = "".join(parts)
            return f"<body>{f'<article>{body}</article>' if rnd.random() < seed / 2 else body}</body>"

        pages = [page(i) for i in range(rnd.randrange(24, 40))]
        hosts[host] = pages + pages[:5] + [None, ""]
    df = spark.createDataFrame([(h, p) for h, pages in hosts.items() for p in pages], "host string, html string")
    got = {r["host"]: set(r["template_text"]) for r in html_extraction.deduce(df).collect()}
    want = {h: deduced(pages) for h, pages in hosts.items()}
    assert any(want.values()) and all(got.get(h, set()) == x for h, x in want.items())


# ---- 7


SIGMA = "a b ΟΔΟΣΑΛΛΗΣ b c d e f g h"


@pytest.mark.parametrize("broadcast", [decontamination.BROADCAST, 0])
def test_contamination(spark, broadcast):
    item = " ".join(f"k{i}" for i in range(14))
    items = [(1, item), (2, "Solo"), (3, None), (10, "!!"), (4, item), (5, "two words"), (6, SIGMA), (7, "İstanbul'da ẞ"), (8, "never seen by any text"), (9, "x x x")]
    docs = [*ODD, (20, f"x {item.upper()} y"), (21, "k0 k1 k2 k3 k4 k5 k6 k7 k8"), (22, f"{item} z {item} SOLO"), (23, "two,words two  words"), (24, "k3-k4-k5-k6-k7-k8-k9-k10-k11-k12"), (25, "solos")]
    docs += [(26, f"x {SIGMA.replace('Σ b', 'Σ.b')}"), (26, f"x {SIGMA}"), (27, SIGMA.lower()), (28, "İSTANBUL-DA ẞ, i̇stanbul da ß"), (29, "x x x x"), (30, "a " * 40_000 + item)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame(spark, docs), benchmark, broadcast=broadcast).collect()
    grams = set()
    for i, t in items:
        w = benchmark_words(t)
        n = min(10, len(w))
        grams |= {(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1)} if n else set()
    want, covered = Counter(), {}
    for i, t in docs:
        w = benchmark_words(t)
        hit, ids = set(), set()
        for item_id, g in grams:
            for k in range(len(w) - len(g) + 1):
                if w[k] == g[0] and tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(item_id)
        covered[i, t] = hit
        want[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert {r["doc_id"]: r["n_hit"] for r in got if r["n_words"] == 11}[26] == 10
    # spans cut out
    cut = decontamination.without_spans(frame(spark, docs), benchmark, broadcast=broadcast).select("doc_id", "text", "digest").collect()
    left = lambda i, t: [w for k, w in enumerate(benchmark_words(t)) if k not in covered[i, t]]
    assert Counter((r["doc_id"], *benchmark_words(r["text"])) for r in cut) == Counter((i, *left(i, t)) for i, t in docs)
    assert {(r["doc_id"], r["text"]) for r in cut} >= {(i, t) for i, t in docs if not covered[i, t]}
    assert {r["text"] for r in cut if r["doc_id"] in (22, 23)} == {" z", ""}
    # nothing to look for, nothing to look in
    assert not any(r["contaminated"] for r in decontamination.contamination(frame(spark, docs[:3]), benchmark.limit(0), broadcast=broadcast).collect())
    assert decontamination.contamination(frame(spark, docs).limit(0), benchmark, broadcast=broadcast).collect() == []


# ---- 8


def test_exact_dedup(spark):
    docs = [*ODD, *[(100 + i, "hot") for i in range(200)], *[(400 + i, f"t{i % 20}") for i in range(40)]]
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t in docs:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert [len(exact_dedup.heavy_digests(frame(spark, docs), k).collect()) for k in (0, 1, 1024)] == [0, 1, 1]  # frame() has one digest
    for k in (0, 2, 1024):  # none, some and all digests are heavy
        got = exact_dedup.exact_dedup(frame(spark, docs), k=k).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.exact_dedup(frame(spark, docs).limit(0)).collect() == []
    left = Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(frame(spark, [*docs, (5, "hot"), (9, "only")])).collect())
    hot = [*docs, (5, "hot"), (9, "only")]
    assert left == Counter((i, t) for i, t in hot if i == max((x for x, y in hot if (y or "") == (t or "") and x is not None), default=None))


@pytest.mark.parametrize("seed", range(4))
def test_misra_gries(seed):
    rnd = random.Random(seed)
    values = [rnd.choice("abcdefgh" if rnd.random() < 0.7 else "xyz" * 9 + "0123456789") for _ in range(500)]
    found = exact_dedup.misra_gries(values, {}, 4)
    true = Counter(values)
    assert len(found) <= 4 and all(v in found for v, c in true.items() if c > 500 / 5) and all(true[v] - 100 <= c <= true[v] for v, c in found.items())


# ---- 9


def filled(size, weights, total):
    target, live = dict.fromkeys(size, 0.0), set(size)
    rest = total
    while rest > 1e-9 and live:
        w = sum(weights[s] for s in live)
        add = {s: rest * weights[s] / w for s in live}
        rest = 0.0
        for s in list(live):
            target[s] += add[s]
            if target[s] >= 2 * size[s]:
                rest += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                live.discard(s)
    return target


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.randrange(1, 40)), None, rnd.choice(["a", "b", "é", None, "Z", "z"]), 0) for i in range(400)]
    rows += [(1, None, None, "nul", 0), (2, "", None, "nul", 0), (5, "a b", None, "a", 0), (5, "a b", None, "a", 0), (None, "a b", None, "a", 0)]
    df = spark.createDataFrame(rows, DDL).withColumn("rows", F.lit(1)).withColumn("copies", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = filled(size, weights, 1.5 * sum(size.values()))
    taken = Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 80 for s in size)
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(df).collect())
    assert sum(len(words(t)) * mixed[i, s] for i, t, _, s, _ in rows if i not in (5, None)) == sum(r["taken"] for r in got if r["doc_id"] not in (5, None))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_of_repeats(spark):
    rows = [(7, "a b c", None, "a", 0)] * 100 + [(i, "a b c", None, "a", 0) for i in range(100, 300)] + [(8, f"x y {i}", None, "b", 0) for i in range(60)] + [(None, "q r s", None, "b", 0)] * 30
    rows += [(i, "a b c", None, "c", 0) for i in range(1000, 1400)] + [(9, "a b c", None, "c", 0)] * 200
    df = spark.createDataFrame(rows, DDL)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken, repeats = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        repeats[r["doc_id"]] += r["taken"]
    target = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert all(abs(taken[s] - t) <= 3 for s, (t, _) in target.items())
    assert all(abs(repeats[i] - 3 * n * target[s][0] / target[s][1]) <= 3 for i, s, n in ((7, "a", 100), (8, "b", 60), (None, "b", 30), (9, "c", 200)))
    texts = [Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(d).collect()) for d in (df, df.repartition(3))]
    assert texts[0] == texts[1]
    mixed = Counter()
    for (i, _), n in texts[0].items():
        mixed[i] += 3 * n
    assert +mixed == +repeats


# ---- 10


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [(1, "http://A.Example.NET/en/x?y", None), (2, "https://example.net/de", link("bad.net")), (3, "http://x.example.com/de/", ""), (4, "http://example.com/en", link("example.com")), (5, "ftp://q.org/fr/1#z", None), (6, None, None), (7, "nothing", link("bad.net")), (8, "http://bad.net", None), (9, "http://notexample.com/de/", None), (10, "http://farm.com/a", link("bad.net", "bad.net", "example.net")), (11, "http://farm2.com/a", link("farm.com")), (12, "http://good.com?u=://v/w", link("ok.com"))]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("src", F.lit(1))).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/de", "net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4] == ("example.com", "/en", None, "allow") and got[5] == ("q.org", "/fr/1", "org/fr/", "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("bad.net", "", None, "allow") and got[9][2:] == (None, "allow") and got[12] == ("good.com", "", None, "allow")
    assert got[10][3] == "block" and got[11][3] == "block"


def test_distrust_of_long_chains(spark):
    link = lambda host: f'<a href="http://{host}/x">x</a>'
    rows = [(0, "http://bad.net/", None)] + [(i, f"http://c{i}.com/", link(f"c{i - 1}.com" if i > 1 else "bad.net")) for i in range(1, 17)]
    judged = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r["verdict"] for r in judged.collect()}
    assert {i for i in range(1, 17) if got[i] == "block"} == {i for i in range(1, 17) if 0.85**i >= 0.1}
    # a cycle: each of two hosts passes all on to the other
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    ranks = {r["host"]: r["distrust"] for r in url_filter.propagate(edges, spark.createDataFrame([("a", False, True)], "host string, trusted boolean, blocked boolean")).collect()}
    assert ranks == pytest.approx({"a": 1 / (1 - 0.85**2), "b": 0.85 / (1 - 0.85**2)}, abs=1e-4)


def page_rank(edges, seeds, hosts, damping=0.85):
    """Power iteration over a dense matrix; what hosts without links have goes back to the seeds."""
    at = {h: i for i, h in enumerate(hosts)}
    move, start = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for a, b, n in edges:
        move[at[a], at[b]] += n
    out = move.sum(axis=1)
    move[out > 0] /= out[out > 0, None]
    for h in seeds:
        start[at[h]] = 1 / len(seeds)
    rank = start.copy()
    for _ in range(400):
        rank = damping * (rank @ move + rank[out == 0].sum() * start) + (1 - damping) * start
    return dict(zip(hosts, rank, strict=True))


def test_propagation_is_page_rank(spark):
    rnd, hosts = random.Random(11), [f"h{i}" for i in range(60)]
    pairs = {(f"h{i}", f"h{(i + 1) % 9}") for i in range(9)}  # a cycle
    pairs |= {(f"h{i}", "h9") for i in range(10, 40)} | {("h9", f"h{i}") for i in range(40, 50)}  # a hub, and hosts that link to none
    pairs |= {(rnd.choice(hosts[:55]), rnd.choice(hosts)) for _ in range(80)}
    edges = sorted((a, b, rnd.randrange(1, 5)) for a, b in pairs if a != b)
    trusted, blocked = ["h0", "h12", "h13"], ["h9", "h47", "h59"]
    seeds = [(h, h in trusted, h in blocked) for h in sorted({*trusted, *blocked})]
    found = url_filter.page_rank(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, trusted boolean, blocked boolean"), tolerance=1e-5).collect()
    got = {r["host"]: r for r in found}
    for name, way, own in (("trust_rank", edges, trusted), ("distrust_rank", [(b, a, n) for a, b, n in edges], blocked)):
        want = page_rank(way, own, hosts)
        assert all((got[h][name] if h in got else 0.0) == pytest.approx(x, abs=1e-5) for h, x in want.items())
    assert url_filter.page_rank(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([], "host string, trusted boolean, blocked boolean")).collect() == []


def test_urls_of_odd_tables(spark):
    rows = [(1, "http://bad.net/", None), (1, "http://bad.net/", None), (2, "http://ok.com/", '<a href="//BAD.net/?x">' * 3), (2, "http://ok.com/", '<a href="//BAD.net/?x">' * 3), (3, "http://far.com/" + "p" * 100_000, "x" * 500_000 + "<a href=http://ok.com>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("links", F.lit(1))
    assert Counter((r["page_id"], r["verdict"]) for r in url_filter.judge(pages).collect()) == {(1, "block"): 2, (2, "block"): 2, (3, "block"): 1}
    assert url_filter.judge(pages.limit(0)).collect() == []


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("a", "en", "ou", "ts", "ir", "um")]
    text = lambda: " ".join(rnd.choices(vocabulary, k=40))
    items = [(1, text())]
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, None, "en", "s0", 0), (101, "12 34", "en", "s0", 0), (102, rows[3][1], "en", "s1", 0), (103, rows[4][1] + " end", "en", "s1", 0), (104, f"before {items[0][1]} after", "en", "s2", 0)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    got = got.collect()
    kept = [r for r in rows if r[0] not in (100, 101)]
    root = near([(i, t) for i, t, *_ in kept])
    kept = [r for r in kept if root[r[0]] == r[0] and r[0] != 104]
    assert {r["doc_id"] for r in got} <= {r[0] for r in kept} and {102, 103} & {r["doc_id"] for r in got} == set()
    assert Counter(r["doc_id"] for r in got) == mixed_by_hand(kept)
    assert all(r["shard"] == jump(r["doc_id"], 40) for r in got)


def mixed_by_hand(rows):
    """How often the mix takes each id: steps of a source in order of size band, block, size and id, from one offset."""
    size, sources = Counter(), {}
    for i, t, _, s, _ in rows:
        size[s] += len(words(t))
        sources.setdefault(s, []).append((len(words(t)), i))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    target = filled(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()))
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    taken = Counter()
    for s, docs in sources.items():
        rate, offset = target[s] / size[s] if size[s] else 0.0, int(md5(f"mix-1:{s or ''}")[:8], 16) / 2**32
        band = lambda n: f"{len(f'{n + 8:b}'):02d}{f'{n + 8:b}'[1:4]}"
        for place, (_, i) in enumerate(sorted(docs, key=lambda d: (band(d[0]), md5(d[1])[0], *d)), 1):
            taken[i] += min(2, math.floor(place * rate + offset) - math.floor((place - 1) * rate + offset))
    return +taken


def test_pipeline_of_odd_tables(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices([f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], k=30))
    rows = [(i, text(), "en", None if i % 3 else "s", 1) for i in range(24)] + [(30, text() * 300, "en", None, 1), (31, "", "en", "s", 0), (32, None, None, None, None)]
    frame = spark.createDataFrame(rows, DDL).withColumn("_row", F.lit("clash")).withColumn("digest", F.lit(0))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == mixed_by_hand([r for r in rows if r[1]]) and {(r["_row"], r["digest"]) for r in got} == {("clash", 0)}
    frame.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
