"""Language identification: words first, then progressively shorter character n-grams.

A word that the model knows adds its log10 frequency in each language, with a fixed penalty where a language has not seen it. An unseen word is
cut into n-grams, longest first; the first length of which any n-gram is known gives the mean over its known n-grams. A text's language
has the highest sum. The model is fitted on at most about DOCS_PER_LANGUAGE labelled documents of each language, chosen by a hash of their id; it
has all their words and n-grams, and is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Bound of the fit: labelled documents of a language (expected number).
DOCS_PER_LANGUAGE = 1000
LONGEST = 4
#: log10 frequency of what a language has not seen.
PENALTY = -7.0
#: Unseen words whose scores a worker remembers.
REMEMBERED = 100_000
UND = "und"
#: Bytes of the stored table of languages up to which it is broadcast.
BROADCAST = 8 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word with a space at both ends; single letters without the spaces."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, kind (0: word, else n), gram and count; flushed when many are held."""
    held: dict = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, kind, g, c) for (lang, kind), counts in held.items() for g, c in counts.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault((lang, 0), Counter()).update(_LETTERS.findall(text.lower()))
        if sum(map(len, held.values())) > 200_000:
            yield flush()
    yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, gram (a word), n: its n-grams, counted as often as the word, summed within a block."""
    for batch in batches:
        held: Counter = Counter()
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    held[lang, k, g] += n
        rows = [(*key, n) for key, n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "gram", "n"])


def is_held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id as text, modulo folds, is fold. Null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """The model from rows of doc_id, text and lang; rows without text or lang are ignored. {} if nothing is left.

    A language's sample is its documents whose id and text hash below a bound, and those with its smallest hash at least; equal rows are chosen together.
    """
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("_hash"))
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("docs"), F.min("_hash").alias("least")), "languages")  # a row for each language
    langs = {r["lang"]: r["docs"] for r in sizes.collect()}
    bound = small(sizes.select(F.col("lang").alias("_l"), F.greatest(F.lit(float(docs_per_language)) / F.col("docs") * (1 << 20), F.col("least") + 1.0).alias("_bound")), BROADCAST)
    chosen = labelled.join(bound, F.col("lang") == F.col("_l")).filter(F.col("_hash") < F.col("_bound")).select("lang", "text")
    form = "lang string, kind int, gram string, n long"
    vocabulary = stored(chosen.mapInArrow(_count, form).groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")), "words")
    pieces = vocabulary.select("lang", "gram", "n").mapInArrow(_cut, form).groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    counts = stored(vocabulary.unionByName(pieces), "grams")
    total = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    names = sorted(langs)
    place = {lang: i for i, lang in enumerate(names)}
    index: list[dict] = [{} for _ in range(LONGEST + 1)]
    cells: list[tuple[list, list, list]] = [([], [], []) for _ in range(LONGEST + 1)]
    for r in counts.toLocalIterator():  # the words and n-grams of the sample
        row, column, value = cells[r["kind"]]
        row.append(index[r["kind"]].setdefault(r["gram"], len(index[r["kind"]])))
        column.append(place[r["lang"]])
        value.append(r["n"] / total[r["lang"], r["kind"]])
    rows = []
    for own, (row, column, value) in zip(index, cells, strict=True):
        rows.append(np.full((len(own), len(names)), PENALTY, np.float32))
        rows[-1][row, column] = np.log10(value)
    model = {"langs": names, "first": max(langs, key=lambda k: (langs[k], k)) if langs else None, "index": index, "rows": rows}
    return model if names else {}


class Scorer:
    """Scores texts with a model; remembers the rows of unseen words."""

    def __init__(self, model: dict):
        self.model = model
        if model:
            self.known, self.base = model["index"][0], model["rows"][0]
            self._forget()

    def _forget(self) -> None:
        self.unseen: dict = {}
        self.extra = np.zeros((1024, len(self.model["langs"])), np.float32)

    def _unseen(self, word: str) -> int:
        """The row in extra that has an unseen word's scores; -1 if none of its letters is known."""
        at = self.unseen.get(word)
        if at is None:
            row = None
            for n in range(LONGEST, 0, -1):
                index = self.model["index"][n]
                if found := [i for g in grams(word, n) if (i := index.get(g)) is not None]:
                    row = self.model["rows"][n][found].mean(axis=0)
                    break
            at = -1 if row is None else len(self.unseen)
            if at >= len(self.extra):
                self.extra = np.vstack([self.extra, np.zeros_like(self.extra)])
            if row is not None:
                self.extra[at] = row
            self.unseen[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model or not any(map(str.isalpha, text)):
            return UND, 0.0
        counts = Counter(_LETTERS.findall(text.lower()))
        if len(self.unseen) > REMEMBERED:
            self._forget()
        get, a, an, b, bn = self.known.get, [], [], [], []
        for word, n in counts.items():
            i = get(word)
            if i is not None:
                a.append(i)
                an.append(n)
            elif (i := self._unseen(word)) >= 0:
                b.append(i)
                bn.append(n)
        langs = self.model["langs"]
        if not a and not b:
            return self.model["first"], 1.0 / len(langs)
        total = np.array(an, np.float64) @ self.base[a] if a else 0.0
        total = total + (np.array(bn, np.float64) @ self.extra[b] if b else 0.0)
        likely = np.exp((total - total.max()) * np.log(10))
        best = int(total.argmax())
        return langs[best], float(likely[best] / likely.sum())


def language(text: Column, model: dict, spark) -> Column:
    """A struct of lang and score (0 to 1: its share of the likelihood). `und` and 0 for null texts and texts without letters, or if the model is empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["lang", "score"])

    return identify(text)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out.

    Ids count only for the fold. Repeated rows are learned as often as they are there. Without labelled rows all predictions are `und`; no rows give
    no rows. Whole texts count; a very long one is held by one task.
    """
    model = fit(docs.filter(~is_held_out("doc_id")))
    found = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), language(F.col("text"), model, docs.sparkSession).alias("_l"))
    return found.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without rows whose language can't be told: no text, no letters, or a score under least. docs' own columns."""
    model = fit(docs.filter(~is_held_out("doc_id")))
    rows = docs.select(F.struct("*").alias("_row"))  # no column can clash
    found = rows.withColumn("_l", language(F.col("_row.text"), model, docs.sparkSession))
    return found.filter((F.col("_l.lang") != UND) & (F.col("_l.score") >= least)).select("_row.*")
