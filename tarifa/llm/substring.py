"""Operator 5: substring dedup over Rabin-Karp hashes of fixed-length token windows.

Rows are read in chunks. Each chunk hashes every window of ``width`` consecutive
words, keeps each distinct hash once with the smallest document that has it, and
sends those sorted runs to ranges of the hash space. A range sees all runs of its
hashes, counts them, and answers each chunk with one bit per hash: whether a smaller
document holds the window. The chunk then merges repeated windows into maximal
removal intervals. A hash that a third of all rows share is one entry per chunk, so
no range grows with the number of copies. There are as many ranges as keep each within
``common.RANGE_BYTES``.

Defined cases: null text has no words and stays null; rows that share a doc_id count
as equal (none is earlier than the other), within one row the earlier start wins; a null
doc_id is less than any other; texts of any length are taken whole; an empty table gives an
empty result. Other columns pass through, and where one has the name of a result
(n_words, n_removed, removed, kept_text) the result's name gets an underscore. Windows are
compared by 64-bit hashes: two different windows agree with probability 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WIDTH = 20


class Windows:
    """The windows of one chunk, ordered by document, then place; ``column`` is in row order."""

    def __init__(self, ids: np.ndarray, column: pa.Array, width: int):
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.raw, off = C.text_bytes(column.take(pa.array(self.order)))
        self.starts, self.ends, self.first = C.words(self.raw, off, C.ASCII_SPACE)
        n_words = np.diff(self.first)
        hashes = C.rolling(C.word_hashes(self.raw, self.starts, self.ends), width)
        row_of = np.repeat(np.arange(len(ids)), n_words)
        whole = np.flatnonzero(row_of[: len(hashes)] == row_of[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        hashes, self.row = hashes[whole], row_of[whole]
        by = np.argsort(hashes, kind="stable")
        self.at, h = whole[by], hashes[by]
        self.row = self.row[by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.distinct, self.lead = h[new], np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        doc = self.ids[self.row]
        again = ~new
        again[1:] &= self.row[1:] == self.row[:-1]
        self.covered = again | (doc > doc[self.lead][self.group]) if len(h) else np.zeros(0, bool)


def repeated_intervals(w: Windows, earlier: np.ndarray, width: int) -> np.ndarray:
    """Marks the words (in document order) that a repeated window covers."""
    edge = np.zeros(len(w.starts) + width + 1, np.int32)
    hit = w.at[w.covered | earlier[w.group]] if len(w.at) else w.at
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge)[: len(w.starts)] > 0


def result_names(columns: list[str]) -> list[str]:
    return [C.free_name(n, columns) for n in ("n_words", "n_removed", "removed", "kept_text")]


def _chunks(batches, id_col: str, text_col: str, limit: int):
    place = TaskContext.get().partitionId()
    for k, batch in enumerate(C.chunks(batches, text_col, limit)):
        ids = np.asarray(batch.column(id_col).fill_null(-(1 << 63)).cast(pa.int64()))
        yield C.chunk_key(place, k, ids, batch.column(text_col)), ids, batch


def removal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Adds n_words, n_removed, removed (word intervals [from, to)) and kept_text to every row.

    ``df`` is read twice and must give the same rows in the same order each time, as a
    scan of files does (``stage`` writes its input first); a chunk that differs in the second
    pass raises an error.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    buckets = C.ranges(ids, "t", 2.5)
    limit = C.chunk_bytes(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, batch in _chunks(batches, "i", "t", limit):
            w = Windows(doc, batch.column("t"), width)
            edges = C.bucket_edges(w.distinct, buckets)
            lead_row = w.row[w.lead]
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                rows, which = np.unique(lead_row[part], return_inverse=True)
                out.append((int(b), key, int(edges[b + 1] - edges[b]), C.squeeze(w.distinct[part]), C.squeeze_small(which), w.ids[rows].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "n", "hashes", "rows", "ids"])

    sent = ids.mapInArrow(send, "bucket int, chunk string, n long, hashes binary, rows binary, ids binary")

    def answer(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_numpy()
        hashes = np.concatenate([C.unsqueeze(b.as_py(), n) for b, n in zip(group["hashes"], sizes)])
        docs = np.concatenate([np.frombuffer(i.as_py(), "<i8")[C.unsqueeze_small(r.as_py(), n)] for i, r, n in zip(group["ids"], group["rows"], sizes)])
        by = np.argsort(hashes, kind="stable")
        h = hashes[by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        least = np.minimum.reduceat(docs[by], np.flatnonzero(new))
        earlier = np.empty(len(h), bool)
        earlier[by] = docs[by] > least[np.cumsum(new) - 1]
        masks = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "n": group["n"], "mask": pa.array(masks, pa.binary())})

    masks = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "chunk string, bucket int, n long, mask binary")
    masks = masks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "mask"))).alias("masks"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, batch in _chunks(batches, id_col, text_col, limit):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([C.pack_rows(batch)], pa.binary())], names=["chunk", "body"])

    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.StringType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(result_names(df.columns), kinds))])
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, found in zip(batch.column("body"), batch.column("masks")):
                rows = C.unpack_rows(body.as_py()).combine_chunks()
                doc = np.asarray(rows[id_col].combine_chunks().fill_null(-(1 << 63)).cast(pa.int64()))
                text = rows[text_col].combine_chunks()
                w = Windows(doc, text, width)
                bits = [np.unpackbits(np.frombuffer(m["mask"], np.uint8))[: m["n"]] for m in found.as_py() or []]
                earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
                if len(earlier) != len(w.distinct):
                    raise RuntimeError("the input gave other rows in the second pass; write it to a table first")
                gone = repeated_intervals(w, earlier, width)
                yield _results(rows, text, w, gone, names)

    joined = df.mapInArrow(wrap, "chunk string, body binary").join(masks, "chunk", "left").select("body", "masks")
    return joined.mapInArrow(apply, schema)


def _results(rows: pa.Table, text: pa.Array, w: Windows, gone: np.ndarray, names: list[str]) -> pa.RecordBatch:
    n = len(w.ids)
    n_words = np.diff(w.first)
    total = np.concatenate([[0], np.cumsum(gone)])
    n_gone = total[w.first[1:]] - total[w.first[:-1]]
    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    row_of = np.repeat(np.arange(n), n_words)
    spans: list[list[list[int]]] = [[] for _ in range(n)]
    for a, b in zip(flips[::2].tolist(), flips[1::2].tolist()):
        while a < b:  # a run of removed words may go on into the next document
            r = int(row_of[a])
            to = min(b, int(w.first[r + 1]))
            spans[r].append([a - int(w.first[r]), to - int(w.first[r])])
            a = to
    kept: list[str | None] = [None] * n
    data = w.raw.tobytes()
    place = np.empty(n, np.int64)
    place[w.order] = np.arange(n)
    for k in range(n):
        a, b = int(w.first[k]), int(w.first[k + 1])
        if not text[int(w.order[k])].is_valid:
            continue
        keep = ~gone[a:b]
        kept[k] = b" ".join([data[s:e] for s, e in zip(w.starts[a:b][keep].tolist(), w.ends[a:b][keep].tolist())]).decode()
    arrays = [c.combine_chunks() for c in rows.columns]
    arrays += [pa.array(n_words[place], pa.int64()), pa.array(n_gone[place], pa.int64()), pa.array([spans[p] for p in place], pa.list_(pa.list_(pa.int64()))), pa.array([kept[p] for p in place], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    out = removal(df.select(id_col, text_col), id_col, text_col, width)
    return out.select(id_col, "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def stage(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents with repeated passages cut; a text without any stays as it is.

    The columns are those of ``df``; n_chars, where there is one, follows a text that was cut."""
    out = removal(C.written(df, "documents"), width=width)
    _, n_removed, _, kept = result_names(df.columns)
    changed = F.col(n_removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")).alias("text")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(changed, F.length(kept)).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns])


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """The contract, word by word; for tests."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, tuple] = {}
    for k, (d, w) in enumerate(split):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), []).append((d, k, i))
    out = []
    for k, (d, w) in enumerate(split):
        gone = set()
        for i in range(len(w) - width + 1):
            if any(e < d or (r == k and s < i) for e, r, s in first[tuple(w[i : i + width])]):
                gone.update(range(i, i + width))
        keep = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(keep).hexdigest()))
    return out
