"""Operator 8: n-gram Jaccard join over a prefix tree.

1. Every document becomes the set of hashes of its distinct word n-grams. Chunks of
   documents exchange sorted hashes with ranges of the hash space and learn, for each
   n-gram, the rough logarithm of its document frequency. (frequency class, hash) is the
   global order, rare first.
2. A linked document shares an n-gram within its first n - ceil(threshold * n) + 1 ones.
   N-grams that no other document has come first and can't be shared, so a document with
   as many of them as that has no link and leaves: what stays are copies and near copies.
3. Documents of equal sets are one class, represented by the smallest doc_id. Each shared
   prefix n-gram has a centre, the smallest representative that holds it; a linked pair
   meets in the group of a common centre. Large groups are split into blocks by count and
   bytes.
4. A task walks its sets as a trie in the global order: overlaps with all members are
   kept for the current path, so that sets with a common beginning share them, and a
   subtree ends where the remaining lengths can't reach the threshold for any member that
   isn't in its part yet. It returns links that join different parts, at most one fewer
   than its members.
5. Every block is compared with itself and with a few leaders of its group. What that leaves
   outside the largest part of the group is compared with leaders of the other parts, for as
   long as parts merge, and what is then still apart with all blocks. A group of near copies
   thus sends each set once and leaders once a block; only sets apart from most meet all.
6. Parts are joined by hooking each root to its least neighbour, with pointer jumping, until
   no edge is left.

Defined cases: a text of fewer words than n is one n-gram, without words (or null) the
set is empty and links to nothing; texts of any length are taken whole; rows that share a
doc_id are one document for links in ``classes``; a row without doc_id is a document of its
own, null where its group has no other id; ``stage`` judges each row by itself, and of a
group keeps the row of the smallest doc_id (null last), the first of equal ones; other
columns don't matter and come back from ``stage``; an empty table gives an empty result.
Frequency classes only order the n-grams: cells of ``CELL_BITS`` bits may meet by chance,
which costs time and never a link. N-grams are compared by 58-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

NGRAM = 3
PERCENT = 90
BLOCK = 512
BLOCK_BYTES = 16 << 20
LEADERS = 16
CELL_BITS = 44
_NO_ID = 1 << 62


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of all rows, and the n+1 offsets of the rows."""
    raw, off = C.text_bytes(column)
    raw = C.LOWER[raw]
    starts, ends, first = C.words(raw, off, C.ASCII_SPACE)
    n_words = np.diff(first)
    h = C.word_hashes(raw, starts, ends)
    row_of = np.repeat(np.arange(len(column)), n_words)
    grams = C.rolling(h, width)
    whole = row_of[: len(grams)] == row_of[width - 1 :] if len(grams) else np.zeros(0, bool)
    row, grams = row_of[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        own = [C.mix(np.bitwise_xor.reduce(C.mix(h[first[r] : first[r + 1]] + np.arange(1, n_words[r] + 1).astype(C.U64) * C.U64(0x9E3779B97F4A7C15)), keepdims=True)) for r in short]
        row, grams = np.concatenate([row, short]), np.concatenate([grams, *own])
    by = np.lexsort((grams, row))
    row, grams = row[by], grams[by]
    new = np.ones(len(row), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    row, grams = row[new], grams[new]
    return grams, np.searchsorted(row, np.arange(len(column) + 1))


def _chunks(batches, limit: int, width: int):
    place = TaskContext.get().partitionId()
    for k, batch in enumerate(C.chunks(batches, "t", limit)):
        ids = np.asarray(batch.column("i"))
        yield C.chunk_key(place, k, ids, batch.column("t")), batch, *shingle_sets(batch.column("t"), width)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set linked to it."""
    return (percent * n + 99) // 100


def shingles(docs: DataFrame, width: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, and for documents that may have a link: set id (a, b), the first ``pre`` of
    ``tokens`` in the global order being its prefix. Written to a shared table."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id() + _NO_ID).alias("i"), F.col(text_col).alias("t"))
    buckets = C.ranges(rows, "t", 2.0)
    limit = C.chunk_bytes(buckets)
    shift = C.U64(64 - CELL_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, grams, _ in _chunks(batches, limit, width):
            cells, counts = np.unique(grams >> shift, return_counts=True)
            edges = C.bucket_edges(cells << shift, buckets)
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                out.append((int(b), key, int(edges[b + 1] - edges[b]), C.squeeze(cells[part]), C.squeeze_small(counts[part])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "n", "cells", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_numpy()
        cells = np.concatenate([C.unsqueeze(b.as_py(), n) for b, n in zip(group["cells"], sizes)])
        counts = np.concatenate([C.unsqueeze_small(b.as_py(), n) for b, n in zip(group["counts"], sizes)])
        by = np.argsort(cells, kind="stable")
        new = np.ones(len(cells), bool)
        new[1:] = cells[by][1:] != cells[by][:-1]
        total = np.add.reduceat(counts[by].astype(np.int64), np.flatnonzero(new))
        level = np.empty(len(cells), np.uint8)
        level[by] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(new) - 1]
        replies = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(level, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "n": group["n"], "levels": pa.array(replies, pa.binary())})

    sent = rows.mapInArrow(send, "bucket int, chunk string, n long, cells binary, counts binary")
    levels = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "chunk string, bucket int, n long, levels binary")
    levels = levels.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "levels"))).alias("levels"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for k, batch in enumerate(C.chunks(batches, "t", limit)):
            key = C.chunk_key(place, k, np.asarray(batch.column("i")), batch.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([C.pack_rows(batch)], pa.binary())], names=["chunk", "body"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, found in zip(batch.column("body"), batch.column("levels")):
                own = C.unpack_rows(body.as_py()).combine_chunks()
                grams, off = shingle_sets(own["t"].combine_chunks(), width)
                got = [np.frombuffer(pa.decompress(x["levels"], decompressed_size=x["n"], codec="zstd", asbytes=True), np.uint8) for x in found.as_py() or []]
                got = np.concatenate(got) if got else np.zeros(0, np.uint8)
                cells = np.unique(grams >> shift)
                if len(cells) != len(got):
                    raise RuntimeError("the input gave other rows in the second pass; write it to a table first")
                level = got[np.searchsorted(cells, grams >> shift)].astype(C.U64)
                yield _ordered(own["i"].combine_chunks(), grams, off, level, percent)

    schema = "doc_id long, n long, a long, b long, pre int, tokens binary"
    joined = rows.mapInArrow(wrap, "chunk string, body binary").join(levels, "chunk", "left").select("body", "levels")
    return C.written(joined.mapInArrow(order, schema), "shingles")


def _ordered(ids: pa.Array, grams: np.ndarray, off: np.ndarray, level: np.ndarray, percent: int) -> pa.RecordBatch:
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    alone = np.bincount(row[level == 0], minlength=len(n))
    pre = n - needed(n, percent) + 1 - alone
    stay = np.flatnonzero((pre > 0) & (n > 0))
    token = level << C.U64(58) | grams >> C.U64(6)
    a, b, blobs = [None] * len(n), [None] * len(n), [None] * len(n)
    for r in stay.tolist():
        part = slice(off[r], off[r + 1])
        own = np.sort(token[part][level[part] > 0])
        blobs[r] = own.astype("<u8").tobytes()
        g = grams[part]
        a[r], b[r] = int(np.add.reduce(g).astype(np.int64)), int(np.bitwise_xor.reduce(C.mix(g)).astype(np.int64))
    first = [int(p) if blob is not None else None for p, blob in zip(pre.tolist(), blobs)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "a", "b", "pre", "tokens"])


# --------------------------------------------------------------- the trie walk


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that join different parts of the members. ``sets``: shared tokens in
    global order; ``sizes``: whole set sizes; ``side``: members of side 0 make the trie and are
    compared with those of side 1, or all with all if they have one side; ``label``: parts
    that are known already."""
    m = len(sets)
    everyone = bool((side == side[0]).all())
    flat = np.concatenate(sets)
    tokens, rank = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    common = np.bincount(rank, minlength=len(tokens)) > 1
    keep = common[rank]
    rank, owner = (np.cumsum(common) - 1)[rank[keep]], owner[keep]
    by = np.argsort(rank, kind="stable")
    holders, base = owner[by], np.searchsorted(rank[by], np.arange(int(common.sum()) + 1))
    cut = np.searchsorted(owner, np.arange(m + 1))
    paths = [rank[cut[k] : cut[k + 1]] for k in range(m)]
    length = np.diff(cut)

    def held(path: np.ndarray) -> np.ndarray:
        """How many tokens of ``path`` each member has."""
        n = base[path + 1] - base[path]
        at = np.arange(int(n.sum())) + np.repeat(base[path] - (np.cumsum(n) - n), n)
        return np.bincount(holders[at], minlength=m)

    part = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    walkers = np.arange(m) if everyone else np.flatnonzero(side == 0)
    # in the order of their paths, the sets below a node are a run [lo, hi)
    order = np.array(sorted(walkers.tolist(), key=lambda k: paths[k].astype(">u4").tobytes()), np.int64)
    nodes = [(0, len(order), 0, np.zeros(m, np.int64), np.ones(m, bool) if everyone else side == 1)]
    while nodes:
        lo, hi, depth, overlap, active = nodes.pop()
        own = order[lo:hi]
        if (part[own] == part[own[0]]).all():
            active = active & (part != part[own[0]])
        path, least, longest = paths[own[0]], sizes[own].min(), length[own].max()
        end = common_length(path, paths[own[-1]])
        # first the tokens within which a linked set must show itself, then the rest
        shown = int((sizes[own] - needed(sizes[own], percent)).max()) + 1
        for to in (min(end, max(depth, shown)), end):
            if not active.any():
                break
            if to > depth:
                overlap, depth = overlap + held(path[depth:to]), to
            # no set below this node can overlap with a member by more than this
            best = overlap + np.minimum(longest - depth, length - overlap)
            active = active & (100 * best >= percent * (least + sizes - best))
        if not active.any():
            continue
        k = lo
        while k < hi and length[order[k]] == depth:
            s = order[k]
            for o in np.flatnonzero(active & (part != part[s]) & (100 * overlap >= percent * (sizes[s] + sizes - overlap))).tolist():
                if part[o] != part[s]:
                    links.append((int(s), o))
                    part[part == part[o]] = part[s]
            k += 1
        if links and (part == part[0]).all():
            break
        if k < hi:
            following = np.array([paths[s][depth] for s in order[k:hi]])
            cuts = [k, *(k + 1 + np.flatnonzero(np.diff(following))).tolist(), hi]
            nodes += [(a, b, depth, overlap, active) for a, b in zip(cuts[:-1], cuts[1:])][::-1]
    return links


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _group_links(group: pa.Table, percent: int) -> pa.Table:
    by = np.argsort(group["rep"].to_numpy(), kind="stable")
    rep, n, side, label = (group[c].to_numpy()[by] for c in ("rep", "n", "side", "label"))
    blobs = group["tokens"].take(pa.array(by))
    links = trie_links([np.frombuffer(b.as_py(), "<u8") for b in blobs], n, side, percent, label) if len(rep) > 1 else []
    return pa.table({"u": pa.array([int(rep[a]) for a, _ in links], pa.int64()), "v": pa.array([int(rep[b]) for _, b in links], pa.int64())})


def _groups(reps: DataFrame) -> DataFrame:
    """(c, rep, bytes): the representatives that may be linked meet in a group c."""
    tokens = reps.select("rep", F.length("tokens").cast("long").alias("bytes"), F.expr("transform(sequence(0, least(pre, length(tokens) div 8) - 1), k -> substring(tokens, 8 * k + 1, 8))").alias("t")).select("rep", "bytes", F.explode("t").alias("t"))
    tokens = C.written(tokens, "prefixes")
    centre = tokens.groupBy("t").agg(F.min("rep").alias("c"), F.count("*").alias("k")).filter("k > 1").select("t", "c")
    member = C.written(tokens.join(centre, "t").select("c", "rep", "bytes").distinct(), "members")
    # whole groups move to the smallest centre whose group holds their own centre
    better = member.groupBy("rep").agg(F.min("c").alias("f")).select(F.col("rep").alias("c"), "f")
    return C.written(member.join(better, "c").select(F.col("f").alias("c"), "rep", "bytes").distinct(), "groups")


def links_between(reps: DataFrame, percent: int = PERCENT, block: int = BLOCK, sent: list[int] | None = None) -> DataFrame:
    """(u, v): links among class representatives that connect all that are connected.

    ``sent`` gets the number of sets that each round sends to tasks."""
    with C.released(reps.sparkSession, "links"):
        return _links_between(reps, percent, block, sent)


def _links_between(reps: DataFrame, percent: int, block: int, sent: list[int] | None) -> DataFrame:
    sets = reps.select("rep", "n", "tokens")
    member = _groups(reps)
    blocks = member.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    member = C.written(member.join(blocks, "c").select("c", "rep", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("b")), "blocks")

    def found(task: DataFrame, keys: list[str]) -> DataFrame:
        """Links within tasks (keys, rep, side, label)."""
        full = task.join(sets, "rep").select(*keys, "rep", "side", "label", "n", "tokens")
        if sent is not None:
            full = C.written(full, "sent")
            sent.append(full.count())
        return C.written(full.groupBy(*keys).applyInArrow(lambda g: _group_links(g, percent), "u long, v long"), "links")

    many = member.filter("blocks > 1")
    leader = many.filter(F.col("b") < LEADERS).groupBy("c", "b").agg(F.first("blocks").alias("blocks"), F.min_by("rep", F.xxhash64("rep", F.lit(1))).alias("rep"))
    everywhere = lambda df: df.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = member.select("c", "b", "rep").union(everywhere(leader.drop("b")).select("c", "b", "rep")).distinct()
    links = found(task.withColumns({"side": F.lit(0), "label": F.col("rep")}), ["c", "b"])
    if many.isEmpty():
        return links
    before = None
    while True:
        label = components(links).select(F.col("id").alias("rep"), F.col("component").alias("label"))
        named = C.written(many.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
        part = named.groupBy("c", "label").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("rep"))
        group = part.groupBy("c").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", -F.col("label"))).alias("most")).filter("parts > 1")
        group = C.written(group, "open-groups")
        parts = group.agg(F.sum("parts") - F.count("*")).first()[0]
        if not parts:
            return links
        apart = C.written(named.join(group, "c").filter("label <> most").select("c", "rep", "label", "blocks", "b"), "apart")
        if before is not None and parts > 0.75 * before:
            break
        before = parts
        nth = F.row_number().over(W.partitionBy("c").orderBy(F.desc("n"), "label"))
        leader = part.join(group.select("c"), "c").withColumn("nth", nth).filter(F.col("nth") <= LEADERS).select("c", "rep", "label")
        leader = leader.join(apart.select("c", "b").distinct(), "c").select("c", "b", "rep", "label", F.lit(1).alias("side"))
        links = links.union(found(apart.select("c", "b", "rep", "label", F.lit(0).alias("side")).union(leader), ["c", "b"]))
    # leaders join no more parts: what is apart meets every block
    count = apart.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("rows"))
    theirs = named.join(count, "c").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select("c", "i", F.col("b").alias("j"), "rep", F.lit(1).alias("side"), "label")
    mine = everywhere(apart.join(count, "c").withColumn("i", F.pmod(F.xxhash64("rep"), "rows").cast("int"))).select("c", "i", F.col("b").alias("j"), "rep", F.lit(0).alias("side"), "label")
    return links.union(found(mine.union(theirs), ["c", "i", "j"]))


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(id, component): the smallest id connected to each end of the edges (u, v).

    Every round hooks each root to its smallest neighbouring root m, or to that one's own,
    whichever is less: following m twice never climbs, so the parents go down to the smallest
    root of the tree, and every root with an edge is in a tree with another one. Trees are
    flattened by pointer jumping and edges contracted to roots, so that each round leaves at
    most half of the roots. It ends when no edge is left; ``most`` rounds can't be reached by
    64-bit ids, and reaching them raises.
    """
    with C.released(edges.sparkSession, "components"):
        return C.written(_components(edges, most), "components")


def _components(edges: DataFrame, most: int) -> DataFrame:
    both = C.written(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    label = both.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    live = both.filter("u <> v")
    for _ in range(most):
        if not live.limit(1).count():
            return label
        least = C.written(live.groupBy("u").agg(F.min("v").alias("m")), "least")
        # a neighbour of a root with an edge has an edge itself
        root = C.written(least.join(least.select(F.col("u").alias("m"), F.col("m").alias("far")), "m").select("u", F.least("m", "far").alias("to")), "roots")
        for _ in range(most):
            jumped = root.join(root.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select("u", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved"))
            jumped = C.written(jumped, "roots")
            root = jumped.select("u", "to")
            if not jumped.filter("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"trees aren't flat after {most} jumps")
        label = C.written(label.join(root.withColumnRenamed("u", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        live = live.join(root, "u").select(F.col("to").alias("u"), "v").distinct()
        live = C.written(live.join(root.select(F.col("u").alias("v"), "to"), "v").select("u", F.col("to").alias("v")).filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"components aren't settled after {most} rounds")


def linked(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, class_id (smallest doc_id of an equal set) and component_id (of all reachable by
    links) of the documents of ``shingles`` that may have a link."""
    some = sets.filter("tokens is not null")
    # a table of one row per set: a large group of copies is then split where it's joined to it
    named = C.written(some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")), "sets")
    member = C.written(some.select("doc_id", "a", "b", "n").join(named, ["a", "b", "n"]).select("doc_id", "rep"), "classes")
    reps = some.join(named.select(F.col("rep").alias("doc_id"), "a", "b", "n"), ["doc_id", "a", "b", "n"]).dropDuplicates(["doc_id", "a", "b", "n"])
    reps = C.written(reps.select(F.col("doc_id").alias("rep"), "n", "pre", "tokens"), "representatives")
    edges = links_between(reps, percent)
    # a doc_id on rows of different sets joins their classes
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.count("*").alias("k")).filter("k > 1").select("doc_id", "u")
    edges = edges.union(member.join(twice, "doc_id").select("u", F.col("rep").alias("v")).filter("u <> v"))
    label = components(edges).select(F.col("id").alias("rep"), "component")
    return member.join(label, "rep", "left").groupBy("doc_id").agg(F.min("rep").alias("class_id"), F.min(F.coalesce("component", "rep")).alias("component_id"))


def classes(docs: DataFrame, width: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of an equal set), component_id per row."""
    with C.released(docs.sparkSession, "shingles", "linked"):
        sets = shingles(docs, width, percent, id_col, text_col)
        found = C.written(linked(sets, percent).filter("class_id <> doc_id or component_id <> doc_id"), "linked")
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    own = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return out.select(own("doc_id").alias("doc_id"), "n_shingles", *[F.coalesce(own(c), own("doc_id")).alias(c) for c in ("class_id", "component_id")])


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "n_shingles", "component_id", "class_id")


def stage(docs: DataFrame, width: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """documents with one of each group of linked ones, that of the smallest doc_id."""
    rows, row = C.with_row_ids(docs)
    with C.released(docs.sparkSession, "gone"):
        group = linked(shingles(rows, width, percent, row), percent).select(F.col("doc_id").alias(row), "component_id")
        group = C.written(group.join(rows.select(row, F.col("doc_id").cast("long").alias("own")), row), "linked")
        kept = group.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
        gone = C.written(group.select(row).join(kept, row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def brute_force(rows: list[tuple[int, str | None]], width: int = NGRAM, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), by comparing all pairs that share an n-gram; for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    part = {d: d for d, _ in rows}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                    part[b] = a
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets)}
