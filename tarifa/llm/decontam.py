"""Operator 2: benchmark decontamination with a positional inverted index.

The index is partitioned by document, as search engines do with segments: one row per
training document with, for each test term it contains, the sorted list of positions.
Building it moves no data between machines. Term frequencies over the whole corpus
order the terms of every test window; a window's candidates start from the postings of
its rarest term and are intersected, offset-adjusted, with the lists of its other
terms from rare to frequent.

Test items are taken in blocks of at most ``BLOCK_WORDS`` words, so what is sent to every
executor is bounded (62 bytes a window, one window a word at most: 31 MB); each further
block is another pass over the documents. Postings are intersected in steps of at most
``STEP`` at once, however common the terms of a window are.

Defined cases: null or empty texts have no words; texts of any length are taken whole; an
item of fewer words than a window is one window, an item of none has no window; equal items
each count, and one without an id counts for hits, but isn't listed; documents that share a doc_id, or have none, stay separate rows, each judged by
its own text; an empty benchmark leaves every document clean; an empty table gives an empty
result; ``stage`` returns the columns it is given. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 10
BLOCK_WORDS = 500_000
STEP = 1 << 20
_GAP = 64
_NO_ID = -(1 << 63)
INDEX = "row_id long, doc_id long, n_words long, terms array<int>, counts array<int>, positions array<int>"


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, one block of at most ``limit`` words (or one longer item) at a time."""
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for item, text in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        raw, off = C.text_bytes(pa.array([text], pa.string()))
        raw = C.LOWER[raw]
        s, e, _ = C.words(raw, off, C.NOT_ALNUM)
        if not len(s):
            continue
        if block and size + len(s) > limit:
            yield block
            block, size = [], 0
        block.append((_NO_ID if item is None else item, C.word_hashes(raw, s, e)))
        size += len(s)
    yield block


def vocabulary(block: list[tuple[int, np.ndarray]]) -> np.ndarray:
    return np.unique(np.concatenate([h for _, h in block])) if block else np.zeros(0, C.U64)


def build_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of ``terms`` (sorted word hashes), one row per document, in a shared table."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, row = sent.value, TaskContext.get().partitionId() << 36
        for batch in C.chunks(batches, "t"):
            raw, off = C.text_bytes(batch.column("t"))
            raw = C.LOWER[raw]
            s, e, first = C.words(raw, off, C.NOT_ALNUM)
            n_words = np.diff(first)
            h = C.word_hashes(raw, s, e)
            term = np.searchsorted(vocab, h)
            known = np.flatnonzero(vocab[np.minimum(term, len(vocab) - 1)] == h) if len(vocab) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), n_words)[known]
            key = doc * (len(vocab) + 1) + term[known]
            by = np.argsort(key, kind="stable")
            key, doc = key[by], doc[by]
            place = (known - first[:-1][np.repeat(np.arange(batch.num_rows), n_words)[known]])[by]
            lead = np.flatnonzero(np.diff(key, prepend=-1))
            counts = np.diff(np.append(lead, len(key)))
            rows = np.arange(batch.num_rows + 1)
            term_off = pa.array(np.searchsorted(doc[lead], rows), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(batch.num_rows), pa.int64()),
                    batch.column("i").cast(pa.int64()),
                    pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(term_off, pa.array(key[lead] % (len(vocab) + 1), pa.int32())),
                    pa.ListArray.from_arrays(term_off, pa.array(counts, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, rows), pa.int32()), pa.array(place, pa.int32())),
                ],
                names=["row_id", "doc_id", "n_words", "terms", "counts", "positions"],
            )
            row += batch.num_rows

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(build, INDEX)
    return C.written(rows, "postings")


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences in the whole corpus of each of ``size`` terms."""
    pair = F.explode(F.arrays_zip("terms", "counts")).alias("x")
    rows = index.select(pair).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()  # at most BLOCK_WORDS rows
    out = np.zeros(size, np.int64)
    out[rows["terms"].to_numpy()] = rows["n"].to_numpy()
    return out


class Windows:
    """Test windows with their terms from rare to frequent: term, offset in the window."""

    def __init__(self, block: list[tuple[int, np.ndarray]], vocab: np.ndarray, counts: np.ndarray, width: int):
        terms, offs, size, item = [], [], [], []
        for name, h in block:
            t = np.searchsorted(vocab, h)
            n = min(width, len(t))
            w = np.lib.stride_tricks.sliding_window_view(t, n)
            by = np.argsort(counts[w], axis=1, kind="stable")
            pad = ((0, 0), (0, width - n))
            terms.append(np.pad(np.take_along_axis(w, by, 1), pad, constant_values=-1).astype(np.int32))
            offs.append(np.pad(by, pad).astype(np.int8 if width < 128 else np.int64))
            size.append(np.full(len(w), n, np.int32))
            item.append(np.full(len(w), name, np.int64))
        self.terms, self.offs, self.size, self.item = (np.concatenate(x) for x in (terms, offs, size, item))
        possible = np.all((self.terms < 0) | (counts[self.terms] > 0), axis=1)
        by = np.flatnonzero(possible)[np.argsort(self.terms[possible, 0], kind="stable")]
        self.terms, self.offs, self.size, self.item = (x[by] for x in (self.terms, self.offs, self.size, self.item))


def intersect(w: Windows, term: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, start) at which every term of the window stands; postings by (term, place)."""
    span = int(place.max()) + 2 * _GAP if len(place) else 1
    lists = np.sort(term.astype(np.int64) * span + place)
    anchor = w.terms[:, 0].astype(np.int64)
    lo, hi = np.searchsorted(lists, anchor * span), np.searchsorted(lists, (anchor + 1) * span)
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    found = [_intersect(w, lists, span, anchor, lo, total, at, min(at + STEP, total[-1])) for at in range(0, int(total[-1]), STEP)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _intersect(w: Windows, lists: np.ndarray, span: int, anchor: np.ndarray, lo: np.ndarray, total: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of ``intersect`` that starts from the postings [first, last) of the rarest terms."""
    nth = np.arange(first, last)
    win = np.searchsorted(total, nth, side="right") - 1
    start = lists[nth - total[win] + lo[win]] - anchor[win] * span - w.offs[win, 0]
    ok = start >= 0
    win, start = win[ok], start[ok]
    for k in range(1, w.terms.shape[1]):
        if not len(win):
            break
        t = w.terms[win, k].astype(np.int64)
        need = t * span + start + w.offs[win, k]
        found = np.searchsorted(lists, need)
        ok = (t < 0) | (lists[np.minimum(found, len(lists) - 1)] == need)
        win, start = win[ok], start[ok]
    return win, start


def phrase_matches(index: DataFrame, block: list[tuple[int, np.ndarray]], width: int = WIDTH) -> DataFrame:
    """Per indexed row: n_words, the hit words as intervals [from, to) and the items that occur."""
    vocab = vocabulary(block)
    spark = index.sparkSession
    schema = "row_id long, doc_id long, n_words long, hits array<int>, items array<long>"
    if not len(vocab):
        return index.select("row_id", "doc_id", "n_words", F.array().cast("array<int>").alias("hits"), F.array().cast("array<long>").alias("items"))
    sent = spark.sparkContext.broadcast(Windows(block, vocab, term_counts(index, len(vocab)), width))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for whole in batches:
            total = np.cumsum(np.asarray(whole.column("n_words")))
            at = 0
            while at < whole.num_rows:  # up to STEP words, or one longer document, at a time
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
                batch, at = whole.slice(at, to - at), to
                n = batch.num_rows
                n_words = np.asarray(batch.column("n_words"))
                base = np.concatenate([[0], np.cumsum(n_words + _GAP)])
                lists = [batch.column(c) for c in ("terms", "counts", "positions")]
                flat = [np.asarray(x.flatten()) for x in lists]
                doc = np.repeat(np.arange(n), np.diff(np.asarray(lists[2].offsets)))
                win, start = intersect(w, np.repeat(flat[0], flat[1]), flat[2] + base[doc])
                edge = np.zeros(base[-1] + w.terms.shape[1] + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.size[win], -1)
                flips = np.flatnonzero(np.diff((np.cumsum(edge) > 0).view(np.int8), prepend=0))
                at_doc = np.searchsorted(base, flips[::2], side="right") - 1
                bounds = np.stack([flips[::2] - base[at_doc], flips[1::2] - base[at_doc]], 1).ravel()
                pairs = np.unique(np.stack([np.searchsorted(base, start, side="right") - 1, w.item[win]], 1), axis=0)
                pairs = pairs[pairs[:, 1] != _NO_ID]
                rows = np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id"),
                        batch.column("doc_id"),
                        batch.column("n_words"),
                        pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(at_doc, rows), pa.int32()), pa.array(bounds, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], rows), pa.int32()), pa.array(pairs[:, 1], pa.int64())),
                    ],
                    names=["row_id", "doc_id", "n_words", "hits", "items"],
                )

    return index.mapInArrow(find, schema)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, start, end): the shortest spans, of at most window + ``slop`` words,
    that hold all terms of a window in any order and with their multiplicity."""
    out = None
    for block in item_blocks(items, item_col, text_col):
        vocab = vocabulary(block)
        index = build_index(docs, vocab, id_col, text_col)
        if not len(vocab):
            return index.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
        sent = docs.sparkSession.sparkContext.broadcast(Windows(block, vocab, term_counts(index, len(vocab)), width))

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for batch in batches:
                for row in batch.select(["doc_id", "terms", "counts", "positions"]).to_pylist():
                    cuts = np.cumsum([0, *row["counts"]])
                    post = {t: np.array(row["positions"][a:b]) for t, a, b in zip(row["terms"], cuts, cuts[1:])}
                    found = [(None if k == _NO_ID else k, a, b) for k, a, b in _near(w, post, slop)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(found), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32())))], names=["doc_id", "item_id", "start", "end"])

        part = index.mapInArrow(near, "doc_id long, item_id long, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _near(w: Windows, post: dict[int, np.ndarray], slop: int) -> list[tuple[int, int, int]]:
    found = set()
    for k in np.flatnonzero(np.isin(w.terms[:, 0], list(post))):
        n = int(w.size[k])
        terms, need = np.unique(w.terms[k, :n], return_counts=True)
        if any(t not in post or len(post[t]) < c for t, c in zip(terms.tolist(), need)):
            continue
        place = np.concatenate([post[t] for t in terms.tolist()])
        kind = np.repeat(np.arange(len(terms)), [len(post[t]) for t in terms.tolist()])
        by = np.argsort(place)
        place, kind = place[by], kind[by]
        have, lack, a = np.zeros(len(terms), int), len(terms), 0
        for b, t in enumerate(kind):
            have[t] += 1
            lack -= have[t] == need[t]
            while lack == 0 and have[kind[a]] > need[kind[a]]:
                have[kind[a]] -= 1
                a += 1
            if lack == 0 and place[b] - place[a] < n + slop:
                found.add((int(w.item[k]), int(place[a]), int(place[b]) + 1))
    return sorted(found)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id, n_words, n_hit, items (ids of occurring items)."""
    blocks = item_blocks(items, item_col, text_col, block_words)
    parts = [phrase_matches(build_index(docs, vocabulary(b), id_col, text_col), b, width) for b in blocks]
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    if len(parts) == 1:
        return parts[0].select("row_id", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), "items", "hits")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("words", F.when(F.size("hits") > 0, F.flatten(F.transform(F.sequence(F.lit(1), (F.size("hits") / 2).cast("int")), lambda k: F.sequence(F.element_at("hits", 2 * k - 1), F.element_at("hits", 2 * k) - 1)))).otherwise(F.array().cast("array<int>")))
    merged = rows.groupBy("row_id", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("w"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.select("row_id", "doc_id", "n_words", F.size("w").cast("long").alias("n_hit"), "items")


def digest(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    m = matches(docs, items, width=width)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark window."""
    rows, row = C.with_row_ids(docs)
    with C.released(docs.sparkSession, "gone"):
        bad = C.written(matches(rows, items, id_col=row).filter("n_hit > 0").select(F.col("doc_id").alias(row)), "gone")
    return rows.join(bad, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    split = [(i, _WORD.findall((t or "").encode().lower())) for i, t in items]
    windows: dict[tuple, set] = {}
    for i, w in split:
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = _WORD.findall((t or "").encode().lower())
        hit, seen = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    seen |= got
        names = ",".join(sorted(map(str, seen)))
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out
