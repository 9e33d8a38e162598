"""Operator 3: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any training text is unlabelled. A linear model
over the presence of words and of word beginnings (``STEMS`` bytes) is trained in numpy on the class-prior-corrected risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),   l(z) = sigmoid(-z),

following the reversed gradient of the second part whenever it is negative. The bounded
loss keeps a prior that is too high from turning clean texts positive. The prior is the
toxic share of labelled training rows unless given.

Fitting takes bounded samples (``POSITIVES``, ``UNLABELLED`` rows, by a hash of the id)
of rows that aren't held out. Spark counts in how many sampled texts of each side a word
stands, and keeps those that positives have more or less often than unlabelled texts (a z
score of ``MIN_Z``, and of ``LEAST_SHARE`` of the strongest word's at least, which leaves
out words that only groups of copies share). The driver gets these words and, of each
sampled text, which of them it has: never texts or their vocabularies. Scoring reads every
whole text.

Defined cases: null or empty text scores by the bias alone; texts of any length are taken
whole; without a positive row every score is 0; several labels of one document count as
their maximum; rows without a label are unlabelled; a null doc_id isn't held out and has no
label; repeated rows score alike, and sampled texts of equal words count once; an empty
table gives an empty result. Other columns pass through; where one is named toxic_score or
rejected, the result's name gets an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .langid import bounded, held_out

POSITIVES = 3_000
UNLABELLED = 9_000
MIN_Z = 4.5
LEAST_SHARE = 0.2
STEMS = (4, 5, 6)


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Scores from 0 to 1."""
        n = len(column)
        f = np.full(n, self.bias)
        if len(self.words):
            hits = []
            for row, h in _terms(column):
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                own = self.words[at] == h
                hits.append(np.unique(row[own] * len(self.words) + at[own]))
            hits = np.unique(np.concatenate(hits))
            f += np.bincount(hits // len(self.words), self.weights[hits % len(self.words)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word of each text, then of its beginnings of each length."""
    raw, off = C.text_bytes(column)
    raw = C.LOWER[raw]
    s, e, first = C.words(raw, off, C.NOT_ALNUM)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    yield row, C.word_hashes(raw, s, e)
    for size in STEMS:
        longer = e - s > size
        yield row[longer], C.mix(C.word_hashes(raw, s[longer], s[longer] + size) + C.U64(size))


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct word and word beginning of each text."""
    row, h = (np.concatenate(x) for x in zip(*_terms(column)))
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _features(rows: DataFrame, positive: bool) -> DataFrame:
    """(positive, same, h): the distinct word hashes of each sampled text; texts of the same words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            row, h = presence(batch.column("text"))
            own = [x.astype("<i8") for x in np.split(h, np.searchsorted(row, np.arange(1, batch.num_rows)))]
            same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["same", "h"])

    return rows.select("text").mapInArrow(run, "same binary, h array<long>").dropDuplicates(["same"]).select(F.lit(positive).alias("positive"), "same", "h")


def choose_words(features: DataFrame, n_p: int, n_u: int, min_z: float = MIN_Z) -> np.ndarray:
    """Words whose document frequency differs between positives and unlabelled texts."""
    side = F.col("positive")
    seen = features.select("positive", F.explode("h").alias("word")).groupBy("word").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    a, b, n_u = F.col("a"), F.col("b"), max(1, n_u)
    both = (a + b) / (n_p + n_u)
    z = F.abs(a / n_p - b / n_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    strong = C.written(seen.filter(a >= 3).select("word", z.alias("z")).filter(F.col("z") >= min_z), "strong-words")
    most = strong.agg(F.max("z")).first()[0] or 0.0
    return np.sort(strong.filter(F.col("z") >= LEAST_SHARE * most).select("word").toArrow()["word"].to_numpy().view(C.U64))


def _matrices(features: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` each positive and each unlabelled text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.isin(words, np.array(h, np.int64).view(C.U64))).tobytes() for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("same"), pa.array(bits, pa.binary())], names=["positive", "same", "bits"])

    found = features.mapInArrow(run, "positive boolean, same binary, bits binary").toArrow().sort_by("same")
    bits = np.array([np.frombuffer(x, np.uint8) for x in found["bits"].to_pylist()], np.uint8).reshape(found.num_rows, -1)
    table, positive = np.unpackbits(bits, axis=1)[:, : len(words)].astype(np.float32), np.array(found["positive"].to_pylist(), bool)
    return table[positive], table[~positive]


def train(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-6, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model, by Adam on the non-negative risk."""
    w, m, v = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    p, u = (np.concatenate([x, np.ones((len(x), 1), np.float32)], 1) for x in (p, u))
    for t in range(1, steps + 1):
        fa, fb = p @ w, u @ w
        sa, sb = (1 / (1 + np.exp(-np.clip(f, -60, 60))) for f in (fa, fb))  # l(-f) is sigmoid(f)
        rest = sb.mean() - prior * sa.mean()
        slope_a, slope_b = (sa * (1 - sa)) @ p / len(p), (sb * (1 - sb)) @ u / len(u)
        grad_rest = slope_b - prior * slope_a
        grad = grad_rest - prior * slope_a if rest >= 0 else -gamma * grad_rest
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(np.float64), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    with C.released(docs.sparkSession):
        return _fit(docs, labels, prior, positives, unlabelled)


def _fit(docs: DataFrame, labels: DataFrame, prior: float | None, positives: int, unlabelled: int) -> Model:
    rows = docs.filter(~held_out()).select("doc_id", "text")
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = bounded(known.filter("toxic = 1"), positives)
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    texts = _features(rows.join(toxic.select("doc_id"), "doc_id", "left_semi"), True)
    texts = C.written(texts.unionByName(_features(bounded(rows, unlabelled, seed=29), False)), "sampled-words")
    n_p, n_u = (texts.filter(F.col("positive") == side).count() for side in (True, False))
    if not n_p or prior <= 0:
        return Model(np.zeros(0, C.U64), np.zeros(0), -500.0)
    words = choose_words(texts, n_p, n_u)
    return Model(words, *train(*_matrices(texts, words), float(prior)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds toxic_score and rejected to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(result_names(docs.columns), (T.DoubleType(), T.BooleanType())))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            s = sent.value(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= 0.5)], names=names)

    return docs.mapInArrow(run, schema)


def result_names(columns: list[str]) -> list[str]:
    return [C.free_name(n, columns) for n in ("toxic_score", "rejected")]


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("rejected").cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those judged toxic."""
    _, rejected = result_names(docs.columns)
    return score(docs, fit(docs, labels)).filter(~F.col(rejected)).select(*[f"`{c}`" for c in docs.columns])
