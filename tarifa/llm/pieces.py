"""Operator 12: SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space mark behind another character (this is checked, and a
vocabulary that has one keeps each text in one chunk), so no merge crosses from a word into the mark
that follows it. A marked word, its marks and the characters up to the next mark, is segmented on
its own, wherever it stands.

Texts are read in runs. A run numbers its distinct marked words and sends each once, by the word, to
the table, where equal words of all runs meet in order and the library segments each distinct word
once. The ids go back by (run, number), many of a run packed in a row, and there, joined by position,
replace the numbers that the run's second pass has written for its words. A word that every row has is one row for each run; no group
grows with the number of its occurrences, and nothing is collected on the driver.

Decoding is the library's, of each row's ids.

Defined cases: null text is empty, and has begin and end ids only; white space, marks spelled out
(read as spaces by the library) and other odd characters come out as in the library; texts and words of
any length are taken whole (a longer text is a run of its own); repeated rows each get a row, null
ids too; an empty table gives an empty result. Other columns pass through, and where one has the
name of a result (``ids``, ``decoded``) the result's name gets an underscore. The input is read twice: it must give the
same rows in the same order each time, as a scan of files does, else an error is raised.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MARK = "▁"
RUN_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Words of a run that are placed at once.
PLACED = 500_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """A SentencePiece model and how its texts fall into chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # a text begins with a mark of its own, and the library treats a mark in it as a space
        kept = self.sp.encode(" a  b ") == self.sp.encode(f"{MARK}a{MARK}{MARK}b{MARK}") and self.sp.decode(self.sp.encode(" a  b ")) == " a  b "
        self.find = re.compile(f"{MARK}+[^{MARK}]*").findall if apart and kept else lambda text: [text]
        self.lone = [self.sp.piece_to_id(MARK)]
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.ends = ([self.sp.bos_id()], [self.sp.eos_id()])

    def chunks(self, text: str | None) -> list[str]:
        """The marked words of a text; all of them together are the text with its marks."""
        return self.find(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of marked words: the library puts the first mark itself."""
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else self.lone for ids, c in zip(found, chunks)]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Numbers(dict):
    """A number for each key, given when it's first asked for."""

    def __missing__(self, key):
        k = self[key] = len(self)
        return k


def numbered(split: Callable[[str | None], list[str]], texts: pa.Array) -> tuple[Numbers, np.ndarray, np.ndarray]:
    """Numbers of the distinct words, the number of each word in turn, and how many each text has."""
    place, at, sizes = Numbers(), [], []
    for part in C.chunks(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", SLICE_BYTES):
        for text in part.column("t").to_pylist():
            found = split(text)
            sizes.append(len(found))
            at.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
    return place, np.concatenate(at) if at else np.zeros(0, np.int32), np.array(sizes, np.int64)


def runs(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows, named by place and by content, so that a second pass finds what the first has sent."""
    place = TaskContext.get().partitionId()
    for k, batch in enumerate(C.chunks(batches, text_col, RUN_BYTES)):
        yield C.chunk_key(place, k, np.zeros(0), batch.column(text_col)), batch


SENT = "bucket int, run string, n int, ks binary, sizes binary, words binary"


def sent_words(run: str, words: list[str], buckets: int, beginning: int | None = None) -> pa.RecordBatch:
    """A row for each bucket that has words of a run: their numbers in order, and the words. The bucket is
    that of the whole word or, for words that should meet those that begin alike, of so many characters."""
    raw = [w.encode() for w in words]
    keys = raw if beginning is None else [w[:beginning].encode() for w in words]
    bucket = np.fromiter(map(zlib.crc32, keys), np.int64, len(raw)) % buckets
    by = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[by])) + 1, len(by))
    rows = []
    for ks in np.split(by, ends[:-1]):
        some = [raw[k] for k in ks.tolist()]
        rows.append((int(bucket[ks[0]]), run, len(ks), C.squeeze_small(np.diff(ks, prepend=0)), C.squeeze_small(np.array([len(w) for w in some])), zlib.compress(b"".join(some), 6)))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "run", "n", "ks", "sizes", "words"])


def met_words(sent: pa.Table) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of a bucket, and for each of its rows the places of the row's words among them."""
    place, numbers = Numbers(), []
    for n, sizes, words in zip(*(sent[c].to_pylist() for c in ("n", "sizes", "words"))):
        raw, off = zlib.decompress(words), np.append(0, np.cumsum(C.unsqueeze_small(sizes, n), dtype=np.int64)).tolist()
        numbers.append(np.fromiter((place[raw[a:b]] for a, b in zip(off[:-1], off[1:])), np.int64, n))
    return [w.decode() for w in place], numbers


def _answered(m: Model, sent: pa.Table) -> pa.Table:
    """The ids of a bucket's words, row by row: each distinct word is segmented once."""
    words, numbers = met_words(sent)
    ids = m.encode(words)
    size = np.array([len(x) for x in ids], np.int64)
    flat, off = np.array([i for x in ids for i in x], m.kind), np.append(0, np.cumsum(size))
    rows = []
    for own in numbers:
        n = size[own]
        mine = flat[np.arange(n.sum()) + np.repeat(off[own] - (np.cumsum(n) - n), n)]
        rows.append((C.squeeze_small(n), C.squeeze_small(mine)))
    return pa.table([sent["run"], sent["n"], sent["ks"], *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["run", "n", "ks", "sizes", "ids"])


def segmented(texts: DataFrame, path: str) -> DataFrame:
    """(run, n, ks, sizes, ids): numbers of every run's distinct words and their ids; ``texts`` has one column, t."""
    buckets = C.ranges(texts, "t", 1.0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for key, batch in runs(batches, "t"):
            if words := list(numbered(m.chunks, batch.column("t"))[0]):
                yield sent_words(key, words, buckets)

    sent = texts.mapInArrow(send, SENT)
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda sent: _answered(model(path), sent), "run string, n int, ks binary, sizes binary, ids binary")


def reply_numbers(rows: list[dict], n_distinct: int) -> list[np.ndarray]:
    """The numbers of a run's words that each reply is for; there must be one for every word."""
    ks = [np.cumsum(C.unsqueeze_small(r["ks"], r["n"]), dtype=np.int64) for r in rows]
    k = np.concatenate(ks) if ks else np.zeros(0, np.int64)
    if len(k) != n_distinct or (np.bincount(k, minlength=n_distinct) != 1).any():
        raise RuntimeError("the input gave other rows in the second pass; write it to a table first")
    return ks


def _replies(replies: pa.Table, n_distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of a run one after another, and the offsets of each word's, by number."""
    rows = replies.to_pylist()
    ks = reply_numbers(rows, n_distinct)
    sizes = [C.unsqueeze_small(r["sizes"], r["n"]).astype(np.int64) for r in rows]
    size = np.zeros(n_distinct, np.int64)
    for own, n in zip(ks, sizes):
        size[own] = n
    off = np.append(0, np.cumsum(size))
    flat = np.empty(off[-1], np.int32)
    for own, n, r in zip(ks, sizes, rows):
        base = np.cumsum(n) - n
        flat[np.arange(n.sum()) + np.repeat(off[own] - base, n)] = C.unsqueeze_small(r["ids"], int(n.sum()))
    return flat, off


def _joined(m: Model, run: dict, replies: pa.Table) -> pa.RecordBatch:
    """The rows of a run with the ids of their words in place, between begin and end."""
    rows = C.unpack_rows(run["body"]).combine_chunks()
    n = rows["n"].to_numpy()
    at = C.unsqueeze_small(run["at"], int(n.sum())).astype(np.int32)
    flat, off = _replies(replies, run["n_distinct"])
    size = np.diff(off)
    before = np.append(0, np.cumsum(size[at], dtype=np.int64))  # ids before each word
    word_ends = np.append(0, np.cumsum(n))
    row_off = np.append(0, np.cumsum(before[word_ends[1:]] - before[word_ends[:-1]] + 2))
    out = np.empty(row_off[-1], np.int32)
    for a in range(0, len(at), PLACED):
        words = at[a : a + PLACED]
        each = size[words]
        row = np.searchsorted(word_ends, np.arange(a, a + len(words)), side="right") - 1
        first = before[a : a + len(words)]
        number = np.arange(first[0], first[-1] + each[-1])
        out[number + np.repeat(2 * row + 1, each)] = flat[number + np.repeat(off[words] - first, each)]
    out[row_off[:-1]], out[row_off[1:] - 1] = m.ends[0][0], m.ends[1][0]
    ids = pa.ListArray.from_arrays(pa.array(row_off.astype(np.int32)), pa.array(out))
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns[:-1]), ids], names=[*rows.schema.names[:-1], "ids"])


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if none are named) and ``ids``, array<int>: what the library's encode
    gives with begin and end ids, without sampling."""
    path = path or model_path()
    keep = tuple(df.columns) if keep is None else keep
    name = C.free_name("ids", keep)
    replies = segmented(df.select(F.col(text_col).alias("t")), path)
    n_keep = len(keep)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for key, batch in runs(batches, "t"):
            words, at, sizes = numbered(m.chunks, batch.column("t"))
            rows = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes)], names=[*(f"c{k}" for k in range(n_keep)), "n"])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key, pa.string()), (C.pack_rows(rows), pa.binary()), (C.squeeze_small(at), pa.binary()), (len(words), pa.int64()))], names=["run", "body", "at", "n_distinct"])

    bodies = df.select(F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]).mapInArrow(wrap, "run string, body binary, at binary, n_distinct long")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.IntegerType()))])

    def place(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        if not bodies.num_rows:
            raise RuntimeError("the input gave other rows in the second pass; write it to a table first")
        m = model(path)
        return pa.Table.from_batches([_joined(m, bodies.to_pylist()[0], replies).rename_columns(schema.names)])

    return bodies.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(place, schema)


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the library's text for each row's ids; null ids give null."""
    path = path or model_path()
    name = C.free_name("decoded", df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path).sp
        for batch in batches:
            texts = [None if ids is None else sp.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, and hashes of the ids (little-endian, 32 bits each) and of the text decoded from them."""
    path = path or model_path()
    encoded = encode(df.select(id_col, text_col), path, text_col, keep=(id_col,))
    kind = df.schema[id_col].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path).sp
        for batch in batches:
            column = batch.column("ids")
            off, flat = np.asarray(column.offsets), np.asarray(column.values).astype("<u4")
            each = [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            hashes = [[hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), sp.decode(ids.tolist()).encode())] for ids in each]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(off).astype(np.int64)), *(pa.array(c, pa.string()) for c in (zip(*hashes) if hashes else ([], [])))], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(sums, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
