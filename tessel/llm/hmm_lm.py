"""A hidden Markov language model, trained by Baum-Welch over the whole training part and scored by the scaled forward recursion.

Tokens are words and an end. Every word belongs to one class. The FREQUENT commonest words are a class each, so is the end; every other word's
class is a hash of its last letters into TAILS classes. States emit classes, and a class emits its words by their corpus counts:
P(word | state) = P(class | state) * (c + 0.1) / (C + 0.1 * (V + 1)), with the class's tokens C and distinct words V; its last share is for unseen words.
Log10 likelihood is then that of the class sequence (exact, by the forward recursion) plus a sum over words that only needs their counts.

1. Words are counted over all training texts and stored. Counts of rare words meet the texts' words in an ordinary shuffle join, so the vocabulary
   may be of any size; only the FREQUENT commonest words and the classes' sums are broadcast.
2. Texts become sequences of class numbers, stored.
3. States start from the words' company: counts of the first PLACED classes beside the ANCHORS commonest words, over all training texts, are
   clustered; classes beyond those start evenly in all states.
4. Baum-Welch: every task runs forward and backward over its training sequences and sums expected counts in one small array; the arrays are added
   in Spark and the driver makes the next model. ROUNDS rounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .language_id import is_held_out

STATES, FREQUENT, TAILS, ANCHORS, ROUNDS = 8, 60_000, 1024, 32, 3
#: Classes whose company is counted for the first model: the end, tails and as many of the commonest words.
PLACED = 5000
#: Added to each count.
SMOOTH = 0.1
#: Distinct words counted before a task passes them on; sequences and tokens of a batch of the recursion.
HELD, ROWS, TOKENS = 200_000, 1024, 400_000
END = 0


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased, without the end."""
    return text.encode().lower().split() if text else []


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COUNT = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
            if len(held) > HELD:
                yield _rows([list(held), list(held.values())], _COUNT)
                held.clear()
    yield _rows([list(held), list(held.values())], _COUNT)


def tail_class(word: bytes) -> int:
    """The class, from 0, of a word that isn't frequent."""
    return xxhash.xxh32_intdigest(word[-3:]) % TAILS


class Classes:
    """Numbers classes: 0 the end, then tails, then frequent words. Remembers rare words."""

    def __init__(self, frequent: list[bytes]):
        self.n = 1 + TAILS + len(frequent)
        if self.n > 1 << 16:
            raise ValueError("class numbers have 16 bits: take fewer frequent words")
        self.of = {w: 1 + TAILS + i for i, w in enumerate(frequent)}

    def sequence(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Class numbers with the end, and the words that aren't frequent."""
        found = list(map(self.of.get, words))
        rare = [w for w, c in zip(words, found, strict=True) if c is None]
        tails = iter([1 + xxhash.xxh32_intdigest(w[-3:]) % TAILS for w in rare])
        return np.array([next(tails) if c is None else c for c in found] + [END], np.uint16), rare


_ENCODED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("room", pa.float64())])


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, room = shared.value
        classes = Classes(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                seqs, rare, times, rooms = [], [], [], []
                for text in part.column(3):
                    seq, words = classes.sequence(tokens(text.as_py()))
                    own = Counter(words)
                    seqs.append(seq.tobytes())
                    rare.append(list(own))
                    times.append(list(own.values()))
                    rooms.append(float(room[seq[(seq > END) & (seq <= TAILS)] - 1].sum()))
                yield _rows([part.column(0), part.column(1), part.column(2), seqs, rare, times, rooms], _ENCODED)

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Blocks of row keys and sequences, by length, of bounded size."""
    keys, held, size = [], [], 0
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            held.append(np.frombuffer(blob, np.uint16))
            size += len(held[-1])
            if size > 4 * TOKENS:
                yield keys, held
                keys, held, size = [], [], 0
    if held:
        yield keys, held


def _blocks(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places, padded classes (time, row) and lengths; the longest first, so that the rows still running are the first ones."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        n = max(1, min(ROWS, TOKENS // len(seqs[order[at]])))
        part = order[at : at + n]
        at += n
        x = np.zeros((len(seqs[part[0]]), len(part)), np.int64)
        for j, i in enumerate(part):
            x[: len(seqs[i]), j] = seqs[i]
        yield part, x, np.array([len(seqs[i]) for i in part])


def _ahead(model: dict, x: np.ndarray, running: np.ndarray, first: int, last: int, alpha: np.ndarray | None, total: np.ndarray | None):
    """The scaled forward recursion (states first, rows last) from step first up to last, from the values of the step before. Adds logs of
    the scales to total. Returns the emissions, values and scales of these steps.

    A step may hold a class that no state emits only if the model was not smoothed; smoothed models give every class some probability.
    """
    emitted = np.ascontiguousarray(model["emit"][x[first:last]].transpose(0, 2, 1))
    move, alphas, scales = np.ascontiguousarray(model["move"].T), [], []
    for t in range(first, last):
        r = running[t]
        now = emitted[t - first, :, :r]
        alpha = model["start"][:, None] * now if alpha is None else (move @ alpha[:, :r]) * now
        c = alpha.sum(axis=0)
        alpha /= c
        alphas.append(alpha)
        scales.append(c)
    if total is not None:
        for t, c in zip(range(first, last), scales, strict=True):
            total[: running[t]] += np.log(c)
    return emitted, alphas, scales


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of steps that hold about TOKENS tokens, so that a very long text is never held with all its values."""
    step = max(1, TOKENS // x.shape[1])
    return [(t, min(len(x), t + step)) for t in range(0, len(x), step)]


def _running(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows that are longer than each step."""
    return np.searchsorted(-lengths, -np.arange(len(x)), side="left")


def forward(model: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each column."""
    running, total, alpha = _running(x, lengths), np.zeros(x.shape[1]), None
    for first, last in _cuts(x):
        alpha = _ahead(model, x, running, first, last, alpha, total)[1][-1]
    return total


def expected(model: dict, seqs: list[np.ndarray], sums: dict) -> None:
    """Adds the expected counts of starts, moves and emissions over these sequences to sums.

    Texts of more than one run of steps are gone through twice: first the values at the ends of runs are kept, then, from the last run on,
    each run's values are made again for its backward pass.
    """
    move, k = model["move"], len(model["start"])
    for _, x, lengths in _blocks(seqs):
        running, total, cuts = _running(x, lengths), np.zeros(x.shape[1]), _cuts(x)
        ends = [None]
        for first, last in cuts[:-1]:
            ends.append(_ahead(model, x, running, first, last, ends[-1], total)[1][-1])
        beta, moves = np.ones((k, x.shape[1])), np.zeros((k, k))
        for (first, last), before in zip(reversed(cuts), reversed(ends), strict=True):
            emitted, alphas, scales = _ahead(model, x, running, first, last, before, total if last == len(x) else None)
            gammas = []
            for t in range(last - 1, first - 1, -1):
                r, i = running[t], t - first
                gammas.append(alphas[i] * beta[:, :r])
                if t:
                    back = emitted[i, :, :r] * beta[:, :r]
                    back /= scales[i]
                    moves += (alphas[i - 1] if i else before)[:, :r] @ back.T
                    beta[:, :r] = move @ back
            if not first:
                sums["start"] += gammas[-1].sum(axis=1)
            at = np.concatenate([x[t, : running[t]] for t in range(last - 1, first - 1, -1)])
            weight = np.concatenate(gammas, axis=1)
            for s in range(k):
                sums["emit"][:, s] += np.bincount(at, weight[s], len(model["emit"]))
        sums["loglik"] += total.sum()
        sums["move"] += moves * move


def _zero(n: int, k: int) -> dict:
    return {"loglik": 0.0, "start": np.zeros(k), "move": np.zeros((k, k)), "emit": np.zeros((n, k))}


_SUMS = pa.schema([("part", pa.int32()), ("sums", pa.list_(pa.float32()))])
#: Classes in a row of expected counts.
CHUNK = 512


def _packed(sums: dict) -> pa.RecordBatch:
    """Part 0 has the log likelihood, starts and moves; part i the emissions of a run of classes."""
    parts = [np.concatenate([[sums["loglik"]], sums["start"], sums["move"].ravel()])]
    parts += [sums["emit"][i : i + CHUNK].ravel() for i in range(0, len(sums["emit"]), CHUNK)]
    return _rows([list(range(len(parts))), parts], _SUMS)


def _em_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = _zero(len(model["emit"]), len(model["start"]))
        for _, seqs in _sequences(batches):
            expected(model, seqs, sums)
        yield _packed(sums)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = np.asarray(values.values, np.float64)
            held[part] = held[part] + v if part in held else v.copy()
    yield _rows([list(held), list(held.values())], _SUMS)


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """Adds rows of part and sums by part: in each of a few shuffled groups first, then by part. What reaches the driver has the model's size."""
    form = "part int, sums array<float>"
    once = df.repartition(16 * 4, "part", F.spark_partition_id() % 4).mapInArrow(_add, form)
    return {r["part"]: np.array(r["sums"]) for r in once.repartition(16, "part").mapInArrow(_add, form).collect()}


def next_model(sums: dict, smooth: float = 0.01) -> dict:
    """The model of these expected counts; a little is added to each, so that nothing becomes impossible."""
    start, move, emit = sums["start"] + smooth, sums["move"] + smooth, sums["emit"] + smooth
    return {"start": start / start.sum(), "move": move / move.sum(axis=1, keepdims=True), "emit": emit / emit.sum(axis=0)}


def _company(n: int, anchors: int):
    """Counts of each class beside each of the commonest words in the same text; in parts of CHUNK classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((n, anchors + 1))
        first = 1 + TAILS
        for _, seqs in _sequences(batches):
            for s in seqs:
                c, m = np.unique(s, return_counts=True)
                m = m[c < n]
                c = c[c < n]
                near = np.zeros(anchors + 1)
                of = (c >= first) & (c < first + anchors)
                near[c[of] - first] = m[of]
                near[anchors] = 1.0
                table[c] += m[:, None] * (near / near.sum())
        yield _rows([list(range(0, n, CHUNK)), [table[i : i + CHUNK].ravel() for i in range(0, n, CHUNK)]], _SUMS)

    return run


def first_model(table: np.ndarray, states: int, n_classes: int) -> dict:
    """States from clusters of classes with the same company; centres are chosen farthest first from the most frequent class on."""
    mass = table.sum(axis=1)
    rows = np.sqrt(table / np.maximum(mass, 1e-9)[:, None])
    common = np.argsort(-mass, kind="stable")[: max(states, 2000)]
    centres = [rows[common[0]]]
    near = ((rows[common] - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, states):
        best = int(np.argmax(near * np.log1p(mass[common])))
        centres.append(rows[common[best]])
        near = np.minimum(near, ((rows[common] - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(10):
        own = ((rows**2).sum(axis=1)[:, None] - 2 * rows @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
        for s in range(states):
            if (w := np.where(own == s, mass, 0.0)).sum() > 0:
                c[s] = (w @ rows) / w.sum()
    emit = np.full((max(n_classes, len(table)), states), float(np.median(mass)) * 0.1 + SMOOTH)
    emit[: len(table)] = (mass[:, None] + SMOOTH) * 0.1
    emit[np.arange(len(table)), own] += mass
    return {"start": np.full(states, 1 / states), "move": np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), "emit": emit / emit.sum(axis=0)}


def train(encoded: DataFrame, n_classes: int, states: int = STATES, rounds: int = ROUNDS, anchors: int = ANCHORS) -> tuple[dict, list[float]]:
    """The model and each round's log likelihood, from row and classes of the training sequences."""
    spark = encoded.sparkSession
    seqs = encoded.select("row", "classes")
    placed = min(n_classes, PLACED)
    parts = _summed(seqs.mapInArrow(_company(placed, anchors), "part int, sums array<float>"))
    table = np.concatenate([parts[i] for i in sorted(parts)]).reshape(placed, anchors + 1) if parts else np.zeros((placed, anchors + 1))
    model, seen = first_model(table, states, n_classes), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        parts = _summed(seqs.mapInArrow(_em_task(shared), "part int, sums array<float>"))
        shared.unpersist()
        head = parts.pop(0, np.zeros(1 + states + states * states))
        emit = np.concatenate([parts[i] for i in sorted(parts)]).reshape(n_classes, states) if parts else np.zeros((n_classes, states))
        seen.append(float(head[0]))
        model = next_model({"start": head[1 : 1 + states], "move": head[1 + states :].reshape(states, states), "emit": emit})
    return model, seen


def _score(shared):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("hmm", pa.float64()), ("known", pa.int64()), ("base", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_base, below = shared.value
        first = 1 + TAILS
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                seqs = [np.frombuffer(b, np.uint16) for b in part.column(3).to_pylist()]
                hmm = np.zeros(len(seqs))
                for places, x, lengths in _blocks(seqs):
                    hmm[places] = forward(model, x, lengths)
                # the end and frequent words; rare ones are added by the join
                known = [int((s >= first).sum()) + 1 for s in seqs]
                base = [float(log_base[s].sum()) - below * (len(s) - k) for s, k in zip(seqs, known, strict=True)]
                inside = hmm / math.log(10) - np.array(part.column(4).to_pylist())
                yield _rows([part.column(0), part.column(1), part.column(2), [len(s) for s in seqs], inside, known, base], schema)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the rows that are not held out.

    Null texts are empty: they have the end only. Ids count only for the fold (a null id as the empty text); repeated rows are scored and learned
    each. The end counts as known if any text was learned. Without training rows every token has the base probability of an unseen one and
    the model is uniform. Other columns are ignored; no rows give no rows. A very long text is one sequence in one task, whose values are held a run
    of steps at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", is_held_out("doc_id", 10, 0))
    learned = docs.filter("not held_out")
    vocabulary = stored(learned.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    n_docs = learned.count()
    spread = sorted(vocabulary.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"])
    held, cut = 0, 1 << 62
    for r in spread:  # a row for each count, about the root of the number of words
        if (held := held + r["m"]) > frequent:
            break
        cut = r["n"]
    top = sorted(((-r["n"], bytes(r["word"])) for r in vocabulary.filter(F.col("n") >= cut).collect()))
    words, counts = [w for _, w in top], np.array([-n for n, _ in top], np.float64)
    total = sum(r["n"] * r["m"] for r in spread) + n_docs
    distinct = sum(r["m"] for r in spread) + (n_docs > 0)
    below = total + SMOOTH * (distinct + 1)
    # what the class of a rare word holds
    tail = F.pandas_udf(_tails, "int")
    rare = vocabulary.filter(F.col("n") < cut)
    room = np.full(TAILS, math.log10(SMOOTH))
    for r in rare.select(tail("word").alias("class"), "n").groupBy("class").agg(F.sum("n").alias("c"), F.count("*").alias("v")).collect():  # at most TAILS rows
        room[r["class"]] = math.log10(r["c"] + SMOOTH * (r["v"] + 1))
    classes = spark.sparkContext.broadcast((words, room))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "held_out", "text")
    encoded = stored(rows.mapInArrow(_encode(classes), "doc_id long, row long, held_out boolean, classes binary, rare array<binary>, times array<int>, room double"), "encoded")
    n_classes = 1 + TAILS + len(words)
    model, _ = train(encoded.filter("not held_out"), n_classes, states, rounds)
    log_base = np.zeros(n_classes)
    log_base[END] = math.log10((n_docs + SMOOTH) / below)
    log_base[1 + TAILS :] = np.log10((counts + SMOOTH) / below)
    shared = spark.sparkContext.broadcast((model, log_base, math.log10(below)))
    common = encoded.select("row", "doc_id", "held_out", "classes", "room").mapInArrow(_score(shared), "row long, doc_id long, held_out boolean, n_tokens long, hmm double, known long, base double")
    uses = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("u")).select("row", F.col("u.rare").alias("word"), F.col("u.times").alias("times"))
    uses = uses.join(rare, "word", "left")
    log_c = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    uses = uses.groupBy("row").agg(known.alias("rare_known"), F.sum(F.col("times") * log_c).alias("rare_log"))
    out = common.join(uses, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    n_known = F.col("known") - F.lit(0 if n_docs else 1) + F.coalesce("rare_known", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + rare_log).alias("base_score"), (F.col("hmm") + rare_log).alias("score"))


def _tails(words):
    return words.map(lambda w: tail_class(bytes(w)))
