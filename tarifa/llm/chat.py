"""Operator 10: reply trees to formatted conversations.

Nodes (tree, node, parent) are joined with themselves: round k gives every node its
2**k-th ancestor and every leaf the ancestors up to that distance, so a thread of n turns
takes log2(n) joins. Each leaf is one root-to-leaf path; paths of a tree are ranked by
their mean score, then length, then leaf, and the best ``keep`` are formatted.

The template marks turns as [INST] .. [/INST] (user), [ANS] .. </s> (assistant),
<<SYS>> .. <</SYS>> (system) and [ROLE:name] .. [/ROLE] (others). Inside texts and role
names a backslash goes before every backslash, "[", "]" and "<", so no text can form a
mark, and removing it gives the text back. The loss mask covers assistant texts.

Defined cases: null text and null role are empty; texts of any length are taken whole; a
parent that doesn't exist makes its child a root; nodes on or above a cycle give no path.
Rows without a tree are one tree, that of null; a row without a node is one of its own,
below its parent. Rows that are equal in all these columns are one node; of different rows
of one node the first by role and text has its children, the others are leaves beside it.
Of ``threads``, equal turns are ordered by role and text and all kept. Other columns don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_OPEN = re.compile(r"\[INST\] |\[ANS\] |<<SYS>> |\[ROLE:((?:[^\\\[\]<]|\\.)*)\] ", re.S)
_BODY = re.compile(r"(?:[^\\\[\]<]|\\.)*", re.S)
_SPECIAL = re.compile(r"[\\\[\]<]")


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        start, end = MARKS.get(role) or (f"[ROLE:{escape(role)}] ", " [/ROLE]")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(start), at + len(start) + len(body)))
        parts += [start, body, end, "\n"]
        at += len(start) + len(body) + len(end) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    names = {start: role for role, (start, _) in MARKS.items()}
    turns, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        role = unescape(m[1]) if m[1] is not None else names[m[0]]
        end = MARKS[role][1] if m[1] is None else " [/ROLE]"
        stop = _BODY.match(formatted, m.end()).end() - 1  # the space before the closing mark
        if formatted[stop : stop + len(end) + 1] != end + "\n":
            raise ValueError(f"the turn at {at} isn't closed")
        turns.append((role, unescape(formatted[m.end() : stop])))
        at = stop + len(end) + 1
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every leaf and each node on its way to the root, ``up`` turns
    above. ``nodes``: tree, node, parent (null for a root); tree and node name a row."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = C.written(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")), "ancestors")
    leaves = nodes.select("tree", "node").join(up.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    total, k = nodes.count(), 0
    while not up.isEmpty():
        if 1 << k > total:  # still an ancestor that far up: a cycle
            endless = found.join(up, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
            return found.join(endless, ["tree", "leaf"], "left_anti")
        step = found.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = C.written(found.unionByName(step), "paths")
        far = up.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        up = C.written(up.join(far, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), "ancestors")
        k += 1
    return found


def conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, branch, formatted, loss_spans): the best ``keep`` paths of each tree, formatted.

    ``nodes``: tree, node, parent, role, text and optionally score (0 where missing)."""
    kind = nodes.schema["tree"].dataType
    if "score" not in nodes.columns:
        nodes = nodes.withColumn("score", F.lit(0.0))
    named = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    nodes = nodes.select(F.coalesce(named("tree"), F.lit("")).alias("tree"), named("node").alias("node"), named("parent").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.filter("node is not null").distinct().unionByName(nodes.filter("node is null"))
    again = F.row_number().over(W.partitionBy("tree", "node").orderBy("role", "text", "parent", "score"))
    own = F.when(F.col("node").isNull(), F.concat(F.lit("?"), F.monotonically_increasing_id())).when(F.col("again") == 1, F.col("node")).otherwise(F.concat_ws("?", "node", "again"))
    nodes = C.written(nodes.withColumn("again", again).withColumn("node", own).drop("again"), "nodes")
    way = C.written(paths(nodes), "paths")
    scored = way.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("turns"))
    order = W.partitionBy("tree").orderBy(F.desc("mean"), F.desc("turns"), F.length("leaf"), "leaf")
    best = scored.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= keep).select("tree", "leaf", "branch")
    turn = way.join(best, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turn.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("branch"), pa.array([d[0] for d in done], pa.string()), pa.array([[list(x) for x in d[1]] for d in done], pa.list_(pa.list_(pa.int64())))], names=["tree", "branch", "formatted", "loss_spans"])

    made = whole.mapInArrow(run, "tree string, branch int, formatted string, loss_spans array<array<bigint>>")
    return made.withColumn("tree", F.when(F.col("tree") != "", F.expr("substring(tree, 2)").cast(kind)))


def threads(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before."""
    tree = F.col("conv_id")
    node = F.row_number().over(W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def digest(rows: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    spark = rows.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    made = conversations(threads(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text, spans in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_spans"))):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
