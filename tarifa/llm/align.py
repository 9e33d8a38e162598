"""Operator 13: alignment of two tokenizers by elementary intervals.

Both tokenizations of a text cover the same bytes, so each is an array of the bytes at which its tokens
end. The union of both arrays cuts the bytes into elementary intervals; a binary search in each array
gives the interval's owners, and the interval is the overlap of just those two tokens. An
interval whose end is an end of both closes a group. Three relations of token occurrences follow:
``end`` (the two that close a group), ``overlap`` (an interval each) and ``group`` (the group's
products, expanded, so as many as its tokens multiply to). A whole run of texts is one pair of arrays, as texts end together too.

Corpus-wide counts of linked id pairs: a run counts its own links first, sums are taken in Spark by pair, the
highest of each B id over those sums, and counts go back by (run, number) to the run's links, which
were written with the first pass. A pair that all texts have is one row for each run. The only broadcast
table has one row for each B id, as many as the vocabulary.

Tokenizer A is a byte-level BPE from its JSON file, its merges done by tiktoken with the same ranks
(strings of special tokens are plain text to it); B a SentencePiece model, whose marked words are segmented
once in a run. A text whose joined token bytes aren't a space and the text has no tokens.

Defined cases: texts that are null, empty or not restored by either tokenizer (a spelled-out
white-space mark, for one) give zeros and empty groups; texts of any length are taken whole (a longer text
is a run of its own); repeated rows each get a row and each count, null ids too; other columns don't matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

#: Of the texts whose links are counted together, and of those that are tokenized and aligned at once.
RUN_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
RELATIONS = ("end", "overlap", "group")
#: Marked words of B whose ids a worker keeps from one run to the next.
KNOWN_WORDS = 150_000


def path_a(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands
    for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteTokens:
    """Byte-level BPE: ids and bytes of tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        of, added = byte_alphabet(), {t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if k not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or spec.get("normalizer") or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: ranks don't follow the ids, or texts are changed before they are split")
        self.encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = token
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(" " + t), np.int32) for t in texts]


class PieceTokens:
    """SentencePiece: ids and bytes of tokens."""

    def __init__(self, path: str):
        self.model = P.model(path)
        sp = self.model.sp
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(P.MARK, " ").encode() for k, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.model.chunks(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        fresh = list({w for s in split for w in s if w not in self.known})
        self.known.update((w, np.array(ids, self.model.kind).tobytes()) for w, ids in zip(fresh, self.model.encode(fresh)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), self.model.kind).astype(np.int32) for s in split]


@functools.lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


@dataclass
class Alignment:
    """Of two arrays of ends over the same bytes: ``interval`` ends, their owners, and the group of each."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    interval: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    closes: np.ndarray  # whether a group ends with the interval
    group_a: np.ndarray  # of each token
    group_b: np.ndarray

    def links(self, relation: str = "end") -> tuple[np.ndarray, np.ndarray]:
        """Token numbers (a, b) of all linked occurrences, in the order of the bytes."""
        if relation == "end":
            return self.owner_a[self.closes], self.owner_b[self.closes]
        if relation == "overlap":
            return self.owner_a, self.owner_b
        if relation != "group":
            raise ValueError(f"relation is one of {RELATIONS}")
        n_b = np.bincount(self.group_b)
        each = n_b[self.group_a]  # of every A token
        before = np.append(0, np.cumsum(each))
        first_b = np.append(0, np.cumsum(n_b))[self.group_a]
        a = np.repeat(np.arange(len(self.ends_a)), each)
        return a, np.arange(before[-1]) + np.repeat(first_b - before[:-1], each)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    interval = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, interval), np.searchsorted(ends_b, interval)
    closes = (ends_a[owner_a] == interval) & (ends_b[owner_b] == interval)
    shared = interval[closes]
    return Alignment(ends_a, ends_b, interval, owner_a, owner_b, closes, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b))


def _written_groups(al: Alignment, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, names: list[bytes]) -> list[str]:
    """Hashes of each text's groups as ``a1,a2|b1;a3|b2,b3``. ``names`` has each number with ',', '|' and ';' behind."""
    n_a, n_b = np.bincount(al.group_a), np.bincount(al.group_b)
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a = np.append(al.group_a[1:] != al.group_a[:-1], True)
    last_b = np.append(al.group_b[1:] != al.group_b[:-1], True)
    code[np.arange(len(ids_a)) + np.append(0, np.cumsum(n_b))[al.group_a]] = 3 * ids_a + last_a
    code[np.arange(len(ids_b)) + np.append(0, np.cumsum(n_a))[al.group_b + 1]] = 3 * ids_b + 2 * last_b
    off = (first_a + first_b).tolist()
    name = names.__getitem__
    # the last group has no mark behind
    return [hashlib.sha256(b"".join(map(name, code[x:y].tolist()))[:-1]).hexdigest() for x, y in zip(off[:-1], off[1:])]


@functools.lru_cache(maxsize=1)
def _names(n: int) -> list[bytes]:
    return [b"%d%c" % (k, c) for k in range(n) for c in b",|;"]


def aligned_slice(texts: list[str | None], a: ByteTokens, b: PieceTokens, relation: str) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray]:
    """Of some texts: columns of each text, and each link's id pair (A id in the upper 32 bits) and text."""
    n = len(texts)
    have = [k for k, t in enumerate(texts) if t]
    whole, toks_a, toks_b = [], [], []
    for k, x, y in zip(have, a.ids([texts[k] for k in have]), b.ids([texts[k] for k in have])):
        source = b" " + texts[k].encode()
        if b"".join(map(a.bytes.__getitem__, x.tolist())) == source == b"".join(map(b.bytes.__getitem__, y.tolist())):
            whole.append(k)
            toks_a.append(x)
            toks_b.append(y)
    columns: dict[str, np.ndarray | list] = {name: np.zeros(n, np.int64) for name in NUMBERS}
    hashes = columns["groups_sha256"] = [""] * n
    if not whole:
        return columns, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.array(whole, np.int64)
    first_a, first_b = (np.append(0, np.cumsum([len(x) for x in toks])) for toks in (toks_a, toks_b))
    ids_a, ids_b = (np.concatenate(toks).astype(np.int64) for toks in (toks_a, toks_b))
    al = align(np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b]))
    text_of = np.repeat(np.arange(len(rows)), np.diff(first_a))  # of each A token
    link_a, link_b = al.links(relation)
    columns["n_a"][rows], columns["n_b"][rows] = np.diff(first_a), np.diff(first_b)
    for name, owner in (("n_groups", al.owner_a[al.closes]), ("n_links", link_a), ("n_overlaps", al.owner_a)):
        columns[name][rows] = np.bincount(text_of[owner], minlength=len(rows))
    products = np.bincount(al.group_a) * np.bincount(al.group_b)
    np.add.at(columns["n_products"], rows[text_of[al.owner_a[al.closes]]], products)
    for k, h in zip(whole, _written_groups(al, ids_a, ids_b, first_a, first_b, _names(max(len(a.bytes), len(b.bytes))))):
        hashes[k] = h
    return columns, ids_a[link_a] << 32 | ids_b[link_b], rows[text_of[link_a]]


def aligned_run(batch: pa.RecordBatch, a: ByteTokens, b: PieceTokens, relation: str) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray]:
    """The same of a run of rows, taken in slices so that only ids of few texts are held at once."""
    made, at = [], 0
    for part in C.chunks(iter([batch]), "t", SLICE_BYTES):
        columns, pairs, text = aligned_slice(part.column("t").to_pylist(), a, b, relation)
        made.append((columns, pairs, (text + at).astype(np.int32)))
        at += part.num_rows
    columns = {name: np.concatenate([m[0][name] for m in made]) for name in NUMBERS}
    return columns | {"groups_sha256": [h for m in made for h in m[0]["groups_sha256"]]}, np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_products")


def _first_pass(df: DataFrame, path_a: str, path_b: str, relation: str) -> DataFrame:
    """A row for each run: its rows, the pair of each link as a number, the distinct pairs and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(path_a, path_b)
        place = TaskContext.get().partitionId()
        for k, batch in enumerate(C.chunks(batches, "t", RUN_BYTES)):
            columns, pairs, text = aligned_run(batch, a, b, relation)
            distinct, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            del pairs
            which = which.astype(np.int32)
            which = which[np.lexsort((which, text))]  # in a text the order of links doesn't matter
            rows = pa.RecordBatch.from_arrays([batch.column("i"), *[pa.array(columns[c]) for c in NUMBERS], pa.array(columns["groups_sha256"])], names=["i", *NUMBERS, "groups_sha256"])
            step = np.diff(which, prepend=0).astype(np.int32)  # rises within a text, so it is small
            cells = [f"{place}-{k}", C.pack_rows(rows), C.squeeze_small(step.view(np.uint32)), distinct, counts]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=["run", "body", "links", "pairs", "counts"])

    schema = "run string, body binary, links binary, pairs array<long>, counts array<long>"
    return df.mapInArrow(run, schema)


def pair_counts(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, k, pair, n) of every run, and (pair, total, best): links corpus-wide, and whether no pair of the B id has more."""
    sent = first.select("run", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "x")).select("run", "k", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = C.written(sent.groupBy("pair").agg(F.sum("n").alias("total")), "pairs").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = totals.groupBy("b").agg(F.max("total").alias("most"))  # as many rows as B has ids
    return sent, totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _answered(run: dict, replies: pa.Table, names: list[str]) -> pa.RecordBatch:
    rows = C.unpack_rows(run["body"]).combine_chunks()
    n_links = rows["n_links"].to_numpy()
    step = C.unsqueeze_small(run["links"], int(n_links.sum())).view(np.int32)
    which = np.cumsum(step.astype(np.int64))
    k = replies["k"].to_numpy()
    total, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    total[k], best[k] = replies["total"].to_numpy(), replies["best"].to_numpy()
    ends = np.append(0, np.cumsum(n_links))
    sums = [np.diff(np.append(0, np.cumsum(x[which]))[ends]) if len(which) else np.zeros(len(n_links), np.int64) for x in (best, total)]
    columns = {c: rows[c].combine_chunks() for c in rows.column_names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.RecordBatch.from_arrays([columns[c] for c in ("i", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products")], names=names)


def alignment(df: DataFrame, a: str | None = None, b: str | None = None, relation: str = "end", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: tokens of both sides, groups, links of the relation, links whose count is their
    B id's highest, the sum of the links' counts, the groups' hash, and numbers of overlaps and products."""
    if relation not in RELATIONS:
        raise ValueError(f"relation is one of {RELATIONS}")
    a, b = a or path_a(), b or P.model_path()
    first = C.written(_first_pass(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), a, b, relation), "aligned")
    sent, counts = pair_counts(first)
    replies = sent.select("run", "k", "pair").join(counts, "pair").select("run", "k", "total", "best")
    kind = df.schema[id_col].dataType.simpleString()
    fields = [f"`{id_col}` {kind}", *(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256 string", "n_overlaps long", "n_products long"]
    names = [id_col, *(f.split(" ")[0] for f in fields[1:])]

    def place(runs: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_answered(runs.to_pylist()[0], replies, names)])

    bodies = first.select(F.col("run").alias("own"), "body", "links")
    return bodies.groupBy("own").cogroup(replies.groupBy("run")).applyInArrow(place, ", ".join(fields))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return alignment(df, id_col=id_col, text_col=text_col)


def brute_force(rows: list[tuple[int, str | None]], encode_a, encode_b, bytes_a, bytes_b) -> list[tuple]:
    """The contract token by token, with plain sets of ends; for tests."""
    found, counts = [], {}
    for key, text in rows:
        x, y = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        source = b" " + (text or "").encode()
        if b"".join(map(bytes_a, x)) != source or b"".join(map(bytes_b, y)) != source:
            x, y = [], []
        ends = []
        for tokens, of in ((x, bytes_a), (y, bytes_b)):
            at, own = 0, []
            for t in tokens:
                at += len(of(t))
                own.append(at)
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(x[ends[0].index(e)], y[ends[1].index(e)]) for e in both]
        groups, before = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for t, end in zip(tokens, own) if before < end <= e) for tokens, own in zip((x, y), ends)))
            before = e
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        found.append((key, x, y, links, groups))
    most: dict[int, int] = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(key, len(x), len(y), len(groups), len(links), sum(counts[link] == most[link[1]] for link in links), sum(counts[link] for link in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "") for key, x, y, links, groups in found]
