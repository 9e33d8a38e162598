"""Operator 1: language identification by words, backing off to shorter character n-grams.

A known word scores its log relative frequency in each language. An unseen word takes
the longest n at which the model knows any of its n-grams (the word padded by one space
on both sides) and scores the mean over those known. A document's score is the mean over
its words.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``); Spark counts all
their words and n-grams, and all of them are the model (each n-gram of a word counts as
often as the word). Prediction reads every whole text.

A word is a run of letters (Unicode L); digits, other number characters and marks end it.

Defined cases: null text and text without a letter give ``und`` with score 0; without
any labelled row everything is ``und``; a tie goes to the language first in order; a null
doc_id isn't held out; texts of any length are taken whole; repeated rows each get a row and
count again in fitting; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_ROWS = 12_000
LONGEST = 5
SMOOTHING = 0.5
CACHE_WORDS = 300_000

def _number_characters() -> str:
    r"""A class of the characters that \w takes and that are neither letters nor decimal digits."""
    found = [k for k in range(sys.maxunicode + 1) if (c := chr(k)).isalnum() and not c.isalpha() and not c.isdecimal()]
    first = [k for at, k in enumerate(found) if not at or found[at - 1] != k - 1]
    last = [k for at, k in enumerate(found) if at + 1 == len(found) or found[at + 1] != k + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


_LETTERS = re.compile(rf"[^\W\d_{_number_characters()}]+")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(df: DataFrame, rows: int, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """A repeatable sample of about ``rows`` rows at most, by a hash of the id."""
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < share)


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[at : at + size] for at in range(len(padded) - size + 1)]


class Model:
    """Log relative frequencies by language of words and of n-grams: a row of a table for each."""

    def __init__(self, words: pa.Table, grams: pa.Table):
        """Tables of lang, key, n."""
        self.langs = sorted(set(words["lang"].to_pylist()))
        # a word seen once says little by itself and goes by its n-grams
        self.words, self.word_logs = self._logs(words, 2)
        size = pc.utf8_length(grams["key"])
        by_size = [self._logs(grams.filter(pc.equal(size, k)), 1) for k in range(LONGEST + 1)]
        self.grams, self.gram_logs = [b[0] for b in by_size], [b[1] for b in by_size]

    def _logs(self, rows: pa.Table, least: int) -> tuple[dict[str, int], np.ndarray]:
        """Keys counted ``least`` times or more, with their places in the table of logs."""
        keys = rows["key"].combine_chunks().dictionary_encode()
        lang = pc.index_in(rows["lang"], pa.array(self.langs, pa.string())).to_numpy()
        table = np.zeros((len(keys.dictionary), len(self.langs)))
        np.add.at(table, (keys.indices.to_numpy(), lang), rows["n"].to_numpy())
        kept = np.flatnonzero(table.sum(1) >= least)
        table = table[kept] + SMOOTHING
        logs = np.log(table / table.sum(0).clip(1)).astype(np.float32)
        return {key: at for at, key in enumerate(keys.dictionary.take(pa.array(kept)).to_pylist())}, logs

    def score(self, word: str) -> np.ndarray:
        if (own := self.words.get(word)) is not None:
            return self.word_logs[own]
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [at for g in grams_of(word, size) if (at := self.grams[size].get(g)) is not None]
            if known:
                return self.gram_logs[size][known].mean(0)
        return np.zeros(len(self.langs))


_COUNTED = "lang string, key string, n long"


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["lang", "key", "n"])


def _count(make):
    """Counts of the (lang, key) that ``make(row)`` gives with numbers, by task, in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for lang, key, n in make(row):
                    seen[lang, key] += n
                if len(seen) > 500_000:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    return run


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From text and lang of a bounded sample of the labelled rows that aren't held out."""
    rows = bounded(docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text"), sample_rows)
    words = rows.select("lang", "text").mapInArrow(_count(lambda r: ((r[0], w, 1) for w in _LETTERS.findall(r[1].lower()))), _COUNTED)
    with C.released(docs.sparkSession):
        words = C.written(words.groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
        return Model(words.toArrow(), _grams(words).toArrow())


def _grams(words: DataFrame) -> DataFrame:
    grams = words.mapInArrow(_count(lambda r: ((r[0], g, r[2]) for size in range(1, LONGEST + 1) for g in grams_of(r[1], size) if g != " ")), _COUNTED)
    return grams.groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Predictor:
    """Scores texts with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.table = np.zeros((4096, max(1, len(model.langs))))

    def _learn(self, fresh: dict[str, None]) -> None:
        for word in fresh:
            k = len(self.place)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.score(word)
            self.place[word] = k

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.place) > CACHE_WORDS:
            self.place = {}
        self._learn(dict.fromkeys(w for s in split for w in s if w not in self.place))
        n = np.array([len(s) for s in split])
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not n.sum():
            return names, score
        get = self.place.__getitem__
        where = np.fromiter((get(w) for s in split for w in s), np.int64, int(n.sum()))
        some = np.flatnonzero(n)
        sums = np.add.reduceat(self.table[where], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
        best = sums.argmax(1)
        odds = np.exp((sums - sums.max(1, keepdims=True)) / np.sqrt(n[some])[:, None])
        score[some] = 1 / odds.sum(1)
        for k, b in zip(some.tolist(), best.tolist()):
            names[k] = langs[b]
        return names, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for batch in C.chunks(batches, "t"):
            names, score = predictor(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
