"""The judge of the grey zone: described pairs become prompts, its answers become verdicts.

A judge is a function (instructions, prompt, answer schema) -> answer, where the answer is JSON
text or what it parses to. It's named in the configuration as ``module:function`` and called on
executors, so it should make its client there. Any service can stand behind it.
"""

from __future__ import annotations

import importlib
import json
import logging
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as C
from ..functions import spec as S
from ..sources import files
from .tables import cut, scratch_dir

log = logging.getLogger(__name__)
Judge = Callable[[str, str, dict], "str | dict"]

INSTRUCTIONS = "你核对电商商品。每一条给出我方商品和竞品商品，请判断两者能否直接比较价格：品牌、产品线、口味等变体必须相同，包装数量可以不同。只依据给出的文字；拿不准时降低 confidence（0 到 1）。reason 用一句话说明。"
ANSWER = {
    "type": "object",
    "properties": {"results": {"type": "array", "items": {"type": "object", "properties": {"index": {"type": "integer"}, "is_match": {"type": "boolean"}, "confidence": {"type": "number"}, "reason": {"type": "string"}}, "required": ["index", "is_match", "confidence", "reason"]}}},
    "required": ["results"],
}
#: What a judge may raise without stopping the job; the pairs of its batch go to review.
SOFT = (OSError, TimeoutError, ValueError, KeyError, TypeError, AttributeError)


def describe(title: Column, brand: Column, spec: Column, spec_text: Column, price: Column) -> Column:
    """One product in the words of a prompt; what is unknown is left out."""
    size = F.when(S.is_parsed(spec), S.spec_display(spec)).otherwise(F.nullif(spec_text, F.lit("")))
    cost = F.concat(F.format_string("%.2f", price), F.lit("元"))
    parts = {"标题": title, "品牌": F.nullif(brand, F.lit("")), "规格": size, "售价": F.when(price.isNotNull(), cost)}
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}："), value) for name, value in parts.items()])


def prompt(pairs: list[tuple[str, str]]) -> str:
    """A numbered list of (own, rival) descriptions."""
    listed = "\n\n".join(f"[{k}]\n  我方商品：{own}\n  竞品商品：{rival}" for k, (own, rival) in enumerate(pairs))
    return f"以下共 {len(pairs)} 条，每一条都要有结果，index 为方括号中的序号。\n\n{listed}"


def verdicts_of(answer: str | dict, n: int) -> dict[int, dict[str, Any]]:
    """Verdicts by number; those that aren't complete or name no pair of the batch are left out."""
    data = json.loads(answer) if isinstance(answer, str) else answer
    found = {}
    for r in data.get("results") or []:
        k = int(r["index"])
        if 0 <= k < n:
            found[k] = {"is_match": bool(r["is_match"]), "confidence": float(r.get("confidence") or 0.0), "reason": str(r.get("reason") or "")}
    return found


def load(path: str | None) -> Judge | None:
    """The function named ``module:function``; None, with a warning, where there is none."""
    module, _, name = (path or "").partition(":")
    if not name:
        return None
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        log.warning("the judge %s isn't available: %s", path, e)
        return None


#: Calls of one task before its answers are kept, and calls that a task makes at once at most.
CALLS, THREADS = 16, 4
_KEPT = "pair string, is_match boolean, confidence double, reason string"


def _asking(judge: Judge, batch_size: int, threads: int):
    def call(part: pd.DataFrame) -> pd.DataFrame | None:
        try:
            found = verdicts_of(judge(INSTRUCTIONS, prompt(list(zip(part["a"], part["b"]))), ANSWER), len(part))
        except SOFT as e:
            log.warning("a batch of %d pairs goes to review: %s", len(part), e)
            return None
        some = part.iloc[sorted(found)][["pair"]].reset_index(drop=True)
        return pd.concat([some, pd.DataFrame([found[k] for k in sorted(found)], columns=["is_match", "confidence", "reason"])], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in batches:
                for found in pool.map(call, [frame.iloc[at : at + batch_size] for at in range(0, len(frame), batch_size)]):
                    if found is not None:
                        yield found

    return run


def ask(new: DataFrame, judge: Judge, store: str, batch_size: int = 20, concurrency: int = 4) -> None:
    """Asks for (pair, a, b) and appends the answers to ``store``. At most ``concurrency`` calls are under way, in
    waves of a few calls a task; the answers of a task are kept as soon as it's done, whatever becomes of the others."""
    new = cut(new, "asked")
    threads = min(THREADS, concurrency)
    tasks = -(-concurrency // threads)
    waves = -(-new.count() // (batch_size * CALLS * tasks))
    for wave in range(waves):
        some = new.filter(F.pmod(F.xxhash64("pair"), F.lit(waves)) == wave).repartition(tasks, F.xxhash64("pair", F.lit("task")))
        kept = some.mapInPandas(_asking(judge, batch_size, threads), _KEPT)
        kept.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)


def adjudicate(gray: DataFrame, own: DataFrame, rivals: DataFrame, judge: Judge, batch_size: int = 20, concurrency: int = 4, store: str | None = None) -> DataFrame:
    """Verdicts on grey pairs, ``batch_size`` pairs a call. A batch whose call fails softly has none.

    ``store`` is a folder of verdicts by a hash of what the judge is told; a pair that it has isn't asked
    again, by another run or after a failure, nor is one that another product is told in the same words. Without it
    a folder of this run is used."""
    text = describe(*(F.col(c) for c in ("title", "brand", "spec", "spec_text", "price")))
    side = lambda df, uid, name: df.select(F.col("uid").alias(uid), text.alias(name))
    rows = gray.select("self_uid", "platform", "rival_uid").join(side(own, "self_uid", "a"), "self_uid").join(side(rivals, "rival_uid", "b"), "rival_uid")
    told = cut(rows.select("self_uid", "platform", "a", "b", F.sha2(F.concat_ws("\x1f", F.lit(INSTRUCTIONS), "a", "b"), 256).alias("pair")), "described")
    spark, store = gray.sparkSession, store or f"{scratch_dir(gray.sparkSession)}/verdicts-{uuid.uuid4().hex}"
    known = lambda: spark.read.schema(_KEPT).parquet(store).dropDuplicates(["pair"])
    new = told.groupBy("pair").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    if files.exists(spark, store):
        new = new.join(known().select("pair"), "pair", "left_anti")
    ask(new, judge, store, batch_size, concurrency)
    if not files.exists(spark, store):  # there was nothing to ask
        return spark.createDataFrame([], C.VERDICT)
    return told.join(known(), "pair").select("self_uid", "platform", "is_match", "confidence", "reason")
