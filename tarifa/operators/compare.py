"""Benchmark choice, price gaps and actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as C
from ..functions import spec as S
from .tables import cut

#: Rivals with the most pairs, which are joined without dealing; pairs of a task when they are listed by product.
HOT_RIVALS, TASK_PAIRS = 1024, 200_000


@dataclass(frozen=True)
class CompareConfig:
    benchmark: str = "min"  # min, avg or the key of a platform
    critical_high: float = 0.15
    warn_high: float = 0.05
    warn_low: float = -0.10


def decide_action(rate: Column, config: CompareConfig = CompareConfig()) -> Column:
    return F.when(rate.isNull(), C.NO_DATA).when(rate >= config.critical_high, C.CUT_URGENT).when(rate >= config.warn_high, C.CUT).when(rate <= config.warn_low, C.RAISE).otherwise(C.WATCH)


def action_kind(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in C.ACTION_KINDS.items() for x in pair]), action)


def met(pairs: DataFrame, rivals: DataFrame) -> DataFrame:
    """Pairs with the ``rival`` of each. Products with equal titles share their best rival, so the rivals with the most
    pairs are sent to all tasks; pairs without a rival aren't dealt by it either. Only rivals of pairs are worded."""
    named = rivals.select(F.col("uid").alias("rival_uid"), F.struct("title", "price", "unit_price", "spec", "url").alias("rival"))
    r = lambda name: F.col(f"rival.{name}")
    told = F.struct(r("title"), r("price"), r("unit_price"), r("spec.unit").alias("unit"), S.is_parsed(r("spec")).alias("parsed"), S.spec_display(r("spec")).alias("spec"), r("url"))
    worded = lambda df: df.withColumn("rival", F.when(F.col("rival").isNotNull(), told))
    most = pairs.filter("rival_uid is not null").groupBy("rival_uid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rival_uid").limit(HOT_RIVALS).select("rival_uid")
    hot = cut(worded(cut(named.join(F.broadcast(most), "rival_uid"), "hot")), "hot")
    flagged = pairs.join(F.broadcast(hot), "rival_uid", "left")
    rest = F.col("rival_uid").isNotNull() & F.col("rival").isNull()
    return flagged.filter(~rest).unionByName(worded(flagged.filter(rest).drop("rival").join(named, "rival_uid", "left")))


def with_rivals(own: DataFrame, pairs: DataFrame, rivals: DataFrame) -> DataFrame:
    """Own products, each with the list of its pairs in platform order (one per platform). ``pairs`` is a table; it
    is dealt into so many partitions that a task holds about ``TASK_PAIRS``."""
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // TASK_PAIRS))
    dealt = met(pairs, rivals).repartition(tasks, "self_uid")
    rows = dealt.groupBy("self_uid").agg(F.sort_array(F.collect_list(F.struct("platform_ord", "platform", "rival_uid", "score", "level", "confidence", "reason", "need_review", "rival"))).alias("pairs"))
    empty = F.array().cast(rows.schema["pairs"].dataType)
    return own.join(rows, own["uid"] == rows["self_uid"], "left").drop("self_uid").withColumn("pairs", F.coalesce("pairs", empty))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values).cast("double"))


def benchmark(config: CompareConfig = CompareConfig()) -> dict[str, Column]:
    """Columns over ``with_rivals`` rows: the representative pair (``bench``), its prices."""
    valid = F.filter("pairs", lambda p: p["rival_uid"].isNotNull() & p["rival"]["price"].isNotNull())
    like = F.filter(valid, lambda p: p["rival"]["unit_price"].isNotNull() & (p["rival"]["unit"] == F.col("spec.unit")))
    unit = lambda p: p["rival"]["unit_price"]
    price = lambda p: p["rival"]["price"]

    def least(pool: Column, key) -> Column:
        return F.get(F.array_sort(F.transform(pool, lambda p: F.struct(key(p).alias("key"), p["platform_ord"].alias("ord"), p.alias("pair")))), 0)["pair"]

    if config.benchmark == "min":
        bench = F.when(F.size(like) > 0, least(like, unit)).otherwise(least(valid, price))
    elif config.benchmark == "avg":
        near = lambda pool, key: least(pool, lambda p: F.abs(key(p) - _mean(F.transform(pool, key))))
        bench = F.when(F.size(like) > 0, near(like, unit)).otherwise(near(valid, price))
    else:
        bench = F.get(F.filter(valid, lambda p: p["platform"] == config.benchmark), 0)
    if config.benchmark == "avg":
        return {"bench": bench, "benchmark_price": _mean(F.transform(valid, price)), "benchmark_unit_price": _mean(F.transform(like, unit))}
    return {"bench": bench, "benchmark_price": bench["rival"]["price"], "benchmark_unit_price": bench["rival"]["unit_price"]}


def compare_rows(own: DataFrame, pairs: DataFrame, rivals: DataFrame, config: CompareConfig = CompareConfig()) -> DataFrame:
    """Own products with benchmark, gap, action and notes; ``pairs`` stays as a list column."""
    rows = with_rivals(own, pairs, rivals).withColumns(benchmark(config))
    has = F.col("price").isNotNull() & F.col("bench").isNotNull()
    for name in ("benchmark_price", "benchmark_unit_price"):
        rows = rows.withColumn(name, F.when(has, F.col(name)))
    rows = rows.withColumn("benchmark_platform", F.when(has, F.col("bench.platform")).otherwise(""))
    units = has & F.col("unit_price").isNotNull() & F.col("benchmark_unit_price").isNotNull() & (F.col("spec.unit") == F.col("bench.rival.unit"))
    rows = rows.withColumn("comparable", F.coalesce(units, F.lit(False)))
    base = F.when(F.col("comparable"), F.col("benchmark_unit_price")).otherwise(F.col("benchmark_price"))
    own_price = F.when(F.col("comparable"), F.col("unit_price")).otherwise(F.col("price"))
    rows = rows.withColumn("diff", F.when(has, own_price - base))
    rows = rows.withColumn("diff_rate", F.when(has, F.try_divide("diff", base)))
    rows = rows.withColumn("action", decide_action(F.col("diff_rate"), config))
    why = F.when(F.col("price").isNull(), "我方缺少价格").when(F.col("bench").isNull(), "无有效竞品匹配").when(F.col("comparable"), F.lit(None)).when(~S.is_parsed(F.col("spec")), "我方规格未解析，按标价对比").when(~F.col("bench.rival.parsed"), "竞品规格未解析，按标价对比").otherwise("单位类别不同，按标价对比")
    review = F.when(has & F.exists("pairs", lambda p: p["rival_uid"].isNotNull() & p["need_review"]), "存在待复核的匹配关系")
    return rows.withColumn("notes", F.array_compact(F.array(why, review))).drop("bench")
