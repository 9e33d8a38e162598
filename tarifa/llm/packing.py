"""Operator 4: packing token sequences by minimum bin slack.

Documents become token ids; each is cut into full windows and one rest shorter than a
window. The rests form a multiset of at most ``WINDOW`` lengths, whatever the number of
documents. A bitset subset-sum over that multiset, with the longest rest always in,
finds the fill closest to the window's capacity; backtracking gives how many rests of
each length it takes, and the pattern is repeated as often as the counts allow. Rests
are ranked within their length from per-partition counts, and rank decides the window.

Only histogram rows and the plan (a few entries per length) are small data; documents
are tokenised once, and no group is collected.

Defined cases: null text is an empty document (its end id alone); texts of any length are
taken whole; repeated rows and rows that share a doc_id, or have none, are packed
separately; other columns don't matter; an empty table gives no piece. Special tokens
spelled out in a text are read as the tokenizer reads them by default.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WINDOW = 4096
END_ID = 2
CACHE_WORDS = 300_000
ENCODE_BYTES = 1 << 20
#: Words of ASCII and Latin letters that have one small form and no composition, and the runs that ``SPLITS`` cuts them into in lower case.
PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ]*")
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
#: Normaliser and splitting under which runs stand for themselves: white space is never in a token.
SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    return WordEncoder(path)


class Places(dict):
    """A number for each word, given when it's first asked for."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k


class Known:
    """Token ids of the words that were met, as flat arrays by their number; ``gap`` is number 0 and has none."""

    def __init__(self, gap: str = " "):
        self.place = Places({gap: 0})
        self.size = np.zeros(1024, np.int64)
        self.first = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Their numbers, and those that are met for the first time."""
        known = len(self.place)
        where = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return where, list(islice(self.place, known, None)) if len(self.place) > known else []

    def keep(self, first: int, ids: np.ndarray, off: np.ndarray) -> None:
        """Ids of the words whose numbers begin with ``first``."""
        while len(self.size) < first + len(off) - 1:
            self.size, self.first = np.resize(self.size, 2 * len(self.size)), np.resize(self.first, 2 * len(self.first))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        here = slice(first, first + len(off) - 1)
        self.size[here], self.first[here] = np.diff(off), self.used + off[:-1]
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after another, and the n+1 offsets."""
        return taken(self.flat, self.first[numbers], self.size[numbers])


def taken(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of an array one after another, and their n+1 offsets."""
    off = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(off[-1]) + np.repeat(first - off[:-1], size)], off


class WordEncoder:
    """Token ids of texts, word by word. The tokenizer drops white space and never joins
    across it, so ids of white-space separated words are computed once and shared. Plain words, of Latin letters,
    are cut into the runs that the tokenizer cuts them into, and a run, in lower case, is encoded once for all words that
    have it: runs go to it by many in one text, and the last token of each is one that ends a word. Other words go with a
    mark that is a token of its own between them."""

    MARK = "\x01"

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.limit = limit
        mark, probe = self._ids([self.MARK, f"a {self.MARK} b {self.MARK} "])
        self.mark = int(mark[0]) if len(mark) == 1 and probe.tolist() == [*self._ids(["a"])[0], mark[0], *self._ids(["b"])[0], mark[0]] else None
        given = json.loads(self.tokenizer.to_str())
        suffix = given["model"].get("end_of_word_suffix")
        self.lowers = (given["normalizer"], given["pre_tokenizer"]) == SPLITS and bool(suffix)
        self.special = [t["content"].lower() for t in given["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[k for t, k in vocab.items() if suffix and t.endswith(suffix)]] = True
        self._reset()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _reset(self) -> None:
        self.runs, self.others = Known(), Known()

    def _plain(self, words: list[str]) -> np.ndarray:
        """Which words may be cut into runs."""
        joined = " ".join(words)
        if not self.lowers:
            return np.zeros(len(words), bool)
        if PLAIN.fullmatch(joined) and not any(t in joined.lower() for t in self.special):
            return np.ones(len(words), bool)
        return np.fromiter((PLAIN.fullmatch(w) is not None and not any(t in w.lower() for t in self.special) for w in words), bool, len(words))

    def _by_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and n+1 offsets of plain words; a space, which has no ids, parts them."""
        where, fresh = self.runs.numbers(RUNS.findall(" ".join(words).lower()))
        if fresh:
            self._ask_runs(len(self.runs.place) - len(fresh), fresh)
        ids, off = self.runs.ids(where)
        return ids, off[np.concatenate([[0], np.flatnonzero(where == 0), [len(where)]])]

    def _ask_runs(self, first: int, runs: list[str]) -> None:
        """Without the normaliser: composition, white space and small letters change nothing in runs."""
        normalizer = self.tokenizer.normalizer
        self.tokenizer.normalizer = None
        for k in range(0, len(runs), 8192):
            some = runs[k : k + 8192]
            ids = np.concatenate(self._ids([" ".join(some[a : a + 32]) for a in range(0, len(some), 32)]))
            off = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
            if len(off) != len(some) + 1 or off[-1] != len(ids):
                each = self._ids(some)
                ids, off = np.concatenate(each), np.cumsum([0, *map(len, each)])
            self.runs.keep(first + k, ids, off)
        self.tokenizer.normalizer = normalizer

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and n+1 offsets of words of any kind."""
        where, fresh = self.others.numbers(words)
        first = len(self.others.place) - len(fresh)
        for k in range(0, len(fresh), 8192):
            some = fresh[k : k + 8192]
            run = [w for w in some if self.mark is not None and self.MARK not in w]
            ids = np.concatenate(self._ids([f" {self.MARK} ".join([*run[a : a + 128], ""]) for a in range(0, len(run), 128)]) or [np.zeros(0, np.uint32)])
            marks = np.flatnonzero(ids == self.mark) if run else np.zeros(0, np.int64)
            if len(marks) == len(run) == len(some):
                self.others.keep(first + k, ids[ids != self.mark], np.concatenate([[0], marks - np.arange(len(marks))]))
            else:  # a word that has the mark, or makes one
                each = self._ids(some)
                self.others.keep(first + k, np.concatenate(each), np.cumsum([0, *map(len, each)]))
        return self.others.ids(where)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n+1 offsets of the texts."""
        if len(self.runs.place) + len(self.others.place) > self.limit:
            self._reset()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()  # equal words of these texts are one
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        plain, size, first = self._plain(words), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, used = [], 0
        for rows, read in ((np.flatnonzero(plain), self._by_runs), (np.flatnonzero(~plain), self._whole)):
            if len(rows):
                ids, off = read(words if len(rows) == len(words) else [words[k] for k in rows.tolist()])
                size[rows], first[rows] = np.diff(off), used + off[:-1]
                flat.append(ids)
                used += len(ids)
        of = np.asarray(coded.indices)
        ids, base = taken(np.concatenate(flat) if flat else np.zeros(0, np.uint32), first[of], size[of])
        off = np.asarray(split.offsets)
        return ids, base[off - off[0]]


PIECES = "part long, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every document's full windows and rest, in a shared table; ``nth`` counts the pieces of a
    length within their part; ``keep_ids`` adds the ids."""
    schema = PIECES + (", ids array<long>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, place, ranks = encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in C.chunks(batches, "t", ENCODE_BYTES):
            ids, off = own_encoder.encode(batch.column("t"))
            out = []
            for k, doc in enumerate(batch.column("i").to_pylist()):
                own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), window):
                    piece = own[at : at + window]
                    out.append((place, int(ranks[len(piece)]), doc, at, len(piece), zlib.crc32(piece.tobytes()), len(own)) + ((piece.tolist(),) if keep_ids else ()))
                    ranks[len(piece)] += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * keep_ids
            names = ["part", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(cut, schema)
    return C.written(rows, "pieces")


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum closest to ``capacity`` from below.

    Bit s of a bitset says that s is reachable. Lengths are taken from long to short, a
    length's count in binary parts; the bitset before each part is kept, so that the
    best sum is traced back to its parts. Stops at an exact fill.
    """
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, rests per window, first window, offset in the window) by pattern.

    One pattern fills one window from the longest rest left; it's repeated while counts
    last, so the number of patterns follows the number of lengths, not of documents.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    out, at = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = closest_fill(left, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.append((length, rank[length], n * times, n, at, offset))
            rank[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        at += times
    return out


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with the sequence it lies in and its offset there."""
    spark = docs.sparkSession
    cut = pieces(docs, path or tokenizer_path(), id_col, text_col, end_id, window, keep_ids)
    by_part = C.written(cut.groupBy("part", "length").agg(F.count("*").alias("count")), "piece-counts")
    total = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}
    full = total.pop(window, 0)
    rows = [(window, 0, full, 1, 0, 0)] if full else []
    rows += [(a, b, c, d, e + full, f) for a, b, c, d, e, f in plan(total, window)]
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, steps = sent.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            step = steps[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            nth = rank - step[:, 1]
            sequence = step[:, 4] + nth // step[:, 3]
            offset = step[:, 5] + nth % step[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)
