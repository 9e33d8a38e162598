"""Operator 6: token counts by trie-shared dynamic programming.

Pre-tokens are white-space words with a leading word mark. Texts are read in runs; a run sends each of its distinct
words once to the bucket of the word's beginning, where equal words of all runs meet. A bucket puts its distinct
words in order, which walks their trie depth first: a word keeps the forward scores of the prefix it
shares with the word before and computes only the rest. The forward score of a prefix is the best sum of
piece scores over its segmentations; each word's end stores its count of pieces and score. They go back by (run, number)
of the word, and a document sums those of its words. So every distinct word of all texts is computed once.

Scores are a parameter: those of a unigram file, or of any table given as ``scores``. The files at hand are byte-pair
vocabularies, ordered by frequency and without unigram probabilities, and tokenizers aren't
trained here; for them piece scores are log probabilities by Zipf's law over the file's order,
log(1 / (rank + 1)), normalised. A character that no piece covers costs one byte piece for each of its bytes. Ties
go to fewer pieces.

Defined cases: null and empty texts count 0 tokens with score 0; texts and words of any length
are taken whole; repeated rows each get a row, null doc_ids too; other columns don't matter;
an empty table gives an empty result. The input is read twice: it must give the same rows in the same
order each time, as a scan of files does, else an error is raised.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

MARK = "▁"
#: Words that begin with the same so many characters meet in one bucket.
BEGINNING = 4


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """Scores of the pieces of a sentencepiece file, and the score of a byte piece: the file's own
    if they are logs of probabilities, else by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    pieces, own = [model.id_to_piece(k) for k in ids], [model.get_score(k) for k in ids]
    if math.isclose(sum(math.exp(x) for x in own), 1.0, rel_tol=0.05):
        return dict(zip(pieces, own)), min(own)
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces) + 1)))
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}, -math.log(len(pieces) + 1) - total


class Counter:
    """Counts of pieces and forward scores of words."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        sizes: dict[str, set[int]] = {}
        for piece in scores:
            sizes.setdefault(piece[-1], set()).add(len(piece))
        self.sizes = {c: sorted(s) for c, s in sizes.items()}

    def __call__(self, words: list[str]) -> tuple[dict[str, tuple[int, float]], int]:
        """Terminal counts of distinct words, and the number of trie nodes that were computed."""
        best, count, before, nodes = [0.0], [0], "", 0
        get, sizes_of, ends = self.scores.get, self.sizes, {}
        for word in sorted(words):
            text = MARK + word
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                char = text[end - 1]
                n_bytes = len(char.encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + n_bytes * self.byte_score, count[end - 1] + n_bytes
                for size in sizes_of.get(char, ()):
                    if size > end:
                        break
                    own = get(text[end - size : end])
                    if own is not None:
                        own += best[end - size]
                        if own > top or (own == top and count[end - size] + 1 < n):
                            top, n = own, count[end - size] + 1
                best.append(top)
                count.append(n)
            nodes += len(text) - same
            before = text
            ends[word] = (count[-1], best[-1])
        return ends, nodes


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each worker process."""
    return Counter(*piece_scores(path))


def _split(text: str | None) -> list[str]:
    return text.split() if text else []


def _answered(count: Counter, sent: pa.Table) -> pa.Table:
    words, numbers = P.met_words(sent)
    ends, _ = count(words)
    table = np.array([ends[w] for w in words], np.float64).reshape(-1, 2)
    rows = [(C.squeeze_small(table[own, 0].astype(np.int64)), pa.compress(table[own, 1].tobytes(), codec="zstd", asbytes=True)) for own in numbers]
    return pa.table([sent["run"], sent["n"], sent["ks"], *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["run", "n", "ks", "counts", "scores"])


def _summed(run: dict, replies: pa.Table, names: list[str]) -> pa.RecordBatch:
    rows, found = C.unpack_rows(run["body"]).combine_chunks(), replies.to_pylist()
    tokens, score = np.zeros(run["n_distinct"], np.int64), np.zeros(run["n_distinct"])
    for k, r in zip(P.reply_numbers(found, run["n_distinct"]), found):
        tokens[k] = C.unsqueeze_small(r["counts"], r["n"])
        score[k] = np.frombuffer(pa.decompress(r["scores"], decompressed_size=8 * r["n"], codec="zstd", asbytes=True))
    n = rows["n"].to_numpy()
    at = C.unsqueeze_small(run["at"], int(n.sum())).astype(np.int32)
    ends = np.append(0, np.cumsum(n))
    total = np.append(0, np.cumsum(tokens[at], dtype=np.int64))[ends]
    sums = [round(math.fsum(score[at[a:b]].tolist()), 6) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.RecordBatch.from_arrays([rows["i"].combine_chunks(), pa.array(n), pa.array(np.diff(total)), pa.array(sums, pa.float64())], names=names)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", scores: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and the forward score of every row. ``scores`` are those of the pieces and of a
    byte piece; without them the file's at ``path``."""
    path = path or vocabulary_path()
    counts = (lambda: counter(path)) if scores is None else (lambda: Counter(*scores))
    texts = docs.select(F.col(text_col).alias("t"))
    buckets = C.ranges(texts, "t", 1.0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch in P.runs(batches, "t"):
            if words := list(P.numbered(_split, batch.column("t"))[0]):
                yield P.sent_words(key, words, buckets, BEGINNING)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, batch in P.runs(batches, "t"):
            words, at, sizes = P.numbered(_split, batch.column("t"))
            rows = pa.RecordBatch.from_arrays([batch.column("i"), pa.array(sizes)], names=["i", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key, pa.string()), (C.pack_rows(rows), pa.binary()), (C.squeeze_small(at), pa.binary()), (len(words), pa.int64()))], names=["run", "body", "at", "n_distinct"])

    def place(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        if not bodies.num_rows:
            raise RuntimeError("the input gave other rows in the second pass; write it to a table first")
        return pa.Table.from_batches([_summed(bodies.to_pylist()[0], replies, [id_col, "n_words", "n_tokens", "score"])])

    sent = texts.mapInArrow(send, P.SENT).repartition(buckets, "bucket")
    replies = sent.groupBy("bucket").applyInArrow(lambda sent: _answered(counts(), sent), "run string, n int, ks binary, counts binary, scores binary")
    bodies = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i")).mapInArrow(wrap, "run string, body binary, at binary, n_distinct long")
    kind = docs.schema[id_col].dataType.simpleString()
    return bodies.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(place, f"`{id_col}` {kind}, n_words long, n_tokens long, score double")


def brute_force(word: str, scores: dict[str, float], byte_score: float) -> tuple[int, float]:
    """The best segmentation of one word without sharing; for tests."""
    text = MARK + word
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + n * byte_score, -(best[end - 1][1] + n))]
        options += [(best[s][0] + scores[text[s:end]], -(best[s][1] + 1)) for s in range(end) if text[s:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1], best[-1][0]
