"""Entity resolution over all platforms in one plan.

Exact rules come first; what they leave open goes to a blocked similarity top-k join; its
grey zone to an external verdict. Every product of one's own gets one row per platform
that has data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as C
from ..functions import lanes
from ..functions import similarity as M
from ..functions import spec as S
from ..functions import text as X
from .judge import Judge, adjudicate
from .tables import cut, spread

TITLE_FLOOR = 60.0
#: Pools of so many titles at most on either side are measured together, without an index.
SMALL_POOL = 64
#: Pools that one group of them holds on average at most.
BUNDLE_POOLS = 4096
#: Pairs of titles whose bounds one partition counts, on average at least where there are more partitions than the session's.
TASK_BOUNDS = 1 << 25
#: What the candidates of a pending product depend on.
KIND = ("platform", "category", "norm_title", "spec", "variants", "line")


@dataclass(frozen=True)
class MatchConfig:
    barcode: bool = True
    brand_spec: bool = True
    top_k: int = 5
    auto_accept: float = 88.0
    reject_below: float = 55.0
    spec_penalty: float = 12.0
    judge: str = "disabled"  # disabled, unavailable or verdicts
    accept_confidence: float = 0.7
    batch_size: int = 20
    concurrency: int = 4
    part: int = 4096  # own titles, and rival titles, that meet in one task
    block: int = 65536

    @property
    def coarse(self) -> int:
        return max(4 * self.top_k, 20)


def _pair(rival: Column, score, level: str, confidence, reason: Column, review=False) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ["self_uid", "platform", "platform_ord", rival.cast("string").alias("rival_uid"), lit(score).cast("double").alias("score"), lit(level).alias("level"), lit(confidence).cast("double").alias("confidence"), reason.alias("reason"), lit(review).cast("boolean").alias("need_review")]


def platforms_of(rivals: DataFrame) -> DataFrame:
    return rivals.groupBy("platform").agg(F.min("platform_ord").alias("platform_ord"))


def with_platforms(own: DataFrame, rivals: DataFrame) -> DataFrame:
    """Own products once per platform that has data; platforms are as few as configured."""
    every = F.broadcast(platforms_of(rivals).withColumn("_all", F.lit(1)))
    rest = [c for c in own.columns if c not in ("platform", "platform_ord", "uid")]
    return own.select(F.col("uid").alias("self_uid"), *rest, F.lit(1).alias("_all")).join(every, "_all").drop("_all")


def match_barcode(pending: DataFrame, rivals: DataFrame) -> DataFrame:
    """Equal non-blank barcodes; of several rivals the first by ``ord``."""
    code = lambda: X.trimmed(F.coalesce("barcode", F.lit("")))
    first = rivals.select("platform", code().alias("code"), "uid", "ord").filter("code <> ''").groupBy("platform", "code").agg(F.min_by("uid", "ord").alias("rival"))
    mine = pending.withColumn("code", code()).filter("code <> ''")
    return mine.join(first, ["platform", "code"]).select(*_pair(F.col("rival"), 100.0, C.BARCODE, 1.0, F.concat(F.lit("条码一致 "), F.col("code"))))


def _keyed(df: DataFrame) -> DataFrame:
    known = (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "") & S.is_parsed(F.col("spec"))
    return df.filter(known).withColumns({"k_brand": F.lower("brand"), "k_unit": F.col("spec.unit"), "k_total": F.round("spec.total_base", 3)})


def match_brand_spec(pending: DataFrame, rivals: DataFrame) -> DataFrame:
    """Equal brand, category and total, where exactly one rival has them, without a conflict of
    variants or product lines and with titles alike enough."""
    keys = ["platform", "k_brand", "category", "k_unit", "k_total"]
    lone = _keyed(rivals).groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 1").drop("n")  # counts alone: a hash aggregate, nothing is sorted
    one = cut(_keyed(rivals).join(lone, keys).select(*keys, F.struct("uid", "norm_title", "variants", "line").alias("r")), "lone")
    both = spread(_keyed(pending).join(one.select(*keys), keys, "left_semi"), *keys).join(one, keys)
    fit = ~X.variant_conflict(F.col("variants"), F.col("r.variants")) & (F.col("line") == F.col("r.line"))
    alike = M.token_sort_ratio_arrow(F.col("norm_title"), F.col("r.norm_title")) >= TITLE_FLOOR
    reason = F.concat(F.lit("品牌/品类/规格一致（"), "brand", F.lit(" · "), "category", F.lit(" · "), S.spec_display(F.col("spec")), F.lit("）"))
    return both.filter(fit).filter(alike).select(*_pair(F.col("r.uid"), 96.0, C.BRAND_SPEC, 0.95, reason))


def title_pools(pending: DataFrame, rivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (platform, category, title) of both sides by the ``pool`` in which they meet, rivals with
    the ``first`` order of each title.

    Pools of a platform are its categories (the blank one is compatible with all) and, for own titles
    to which no rival's category is compatible, the whole platform."""
    mine = pending.select("platform", F.col("category").alias("s_cat"), F.col("norm_title").alias("s_title")).distinct()
    theirs = rivals.groupBy("platform", F.col("category").alias("r_cat"), F.col("norm_title").alias("r_title")).agg(F.min("ord").alias("first"))
    there = rivals.select("platform", F.col("category").alias("s_cat")).distinct()
    blank = there.filter("s_cat = ''").select("platform", F.lit(True).alias("has_blank"))
    mine = mine.join(there.withColumn("has_same", F.lit(True)), ["platform", "s_cat"], "left").join(blank, "platform", "left")
    every = (F.col("s_cat") == "") | ~(F.coalesce("has_same", F.lit(False)) | F.coalesce("has_blank", F.lit(False)))
    own_pools = F.when(every, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), "s_cat"), F.lit("=")))
    mine = cut(mine.select("platform", F.explode(own_pools).alias("pool"), "s_cat", "s_title"), "own-titles")
    theirs = theirs.filter("r_title <> ''").withColumn("pool", F.explode(F.array(F.concat(F.lit("="), "r_cat"), F.lit("*"))))
    asked = mine.select("platform", "pool").distinct()
    return mine, theirs.join(asked, ["platform", "pool"], "left_semi")


def title_pairs(pending: DataFrame, rivals: DataFrame) -> DataFrame:
    """All pairs of titles that meet in a pool: what the similarity join answers without scoring each."""
    mine, theirs = title_pools(pending, rivals)
    return mine.join(theirs, ["platform", "pool"]).select("platform", "s_cat", "s_title", "r_cat", "r_title", "first")


def nearest_titles(pending: DataFrame, rivals: DataFrame, n: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """For each own title the ``n`` rival titles of its pools with the best token set ratio (``coarse``;
    ties by ``first``), and at the first of each block ``scored``, the number of titles that were scored.

    A pool's rival titles are dealt into blocks, own titles into parts, so that a hot category is many
    tasks of bounded size. A task indexes its block and scores only titles whose bound reaches
    the n-th best so far; blocks of one title then meet with ``n`` rows each. Pools of few titles go together."""
    mine, theirs = title_pools(pending, rivals)
    theirs = cut(theirs, "rival-titles")  # counted first, then dealt
    counts = lambda df, name: df.groupBy("platform", "pool").agg(F.count("*").alias(name))
    sizes = counts(mine, "own").join(counts(theirs, "rivals"), ["platform", "pool"])
    whole = lambda count, size: F.ceil(F.col(count) / size).cast("int")
    few = (F.col("own") <= min(SMALL_POOL, config.part)) & (F.col("rivals") <= min(SMALL_POOL, config.block))
    sizes = cut(sizes, "pools")
    bundles = max(4 * int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // BUNDLE_POOLS))
    work = F.sum(F.when(~few, F.least(2 * whole("own", config.part) * whole("rivals", config.block), F.ceil(F.col("own") * F.col("rivals") / TASK_BOUNDS))))
    tasks = sizes.agg(work).first()[0] or 0
    sizes = sizes.select("platform", "pool", whole("own", config.part).alias("parts"), whole("rivals", config.block).alias("blocks"), F.when(few, F.pmod(F.xxhash64("platform", "pool"), F.lit(bundles))).alias("bundle"))
    dealt = lambda count, *cols: F.pmod(F.xxhash64(*cols), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    task = F.when(F.col("bundle").isNotNull(), F.concat(F.lit("b"), "bundle")).otherwise(F.to_json(F.struct("platform", "pool", "part", "block"))).alias("task")
    mine = mine.join(sizes, ["platform", "pool"]).withColumn("part", dealt("parts", "s_title")).withColumn("block", all_of("blocks"))
    theirs = theirs.join(sizes, ["platform", "pool"]).withColumn("block", dealt("blocks", "r_cat", "r_title")).withColumn("part", all_of("parts"))

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in out.items()})
        titles, texts, place = mine["s_title"].to_pylist(), theirs["r_title"].to_pylist(), theirs["first"].to_numpy()
        if mine["task"][0].as_py().startswith("b"):
            pools = pa.concat_tables([t.select(["platform", "pool"]) for t in (mine, theirs)]).to_pylist()
            numbers = lanes.Numbers()
            of = np.array([numbers[p["platform"], p["pool"]] for p in pools], np.int64)
            own, rival, score, scored = lanes.best_of_pools(titles, of[: len(titles)], texts, of[len(titles) :], place, n)
        else:
            found, scored = lanes.TitleIndex(texts, place).nearest(titles, n)
            own = np.repeat(np.arange(len(titles)), [len(x) for x, _ in found])
            rival, score = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        lead = np.diff(own, prepend=-1) > 0
        columns = [*(mine[c].take(pa.array(own)) for c in ("platform", "s_cat", "s_title")), *(theirs[c].take(pa.array(rival)) for c in ("r_cat", "r_title", "first"))]
        return pa.table([*columns, pa.array(score), pa.array(np.where(lead, scored[own], 0))], names=list(out))

    out = {**dict.fromkeys(("platform", "s_cat", "s_title", "r_cat", "r_title"), pa.string()), "first": pa.int64(), "coarse": pa.float64(), "scored": pa.int64()}
    left = spread(mine.select(task, "platform", "pool", "s_cat", "s_title"), "task", least=tasks).groupBy("task")
    right = spread(theirs.select(task, "platform", "pool", "r_cat", "r_title", "first"), "task", least=tasks).groupBy("task")
    met = left.cogroup(right).applyInArrow(best, "platform string, s_cat string, s_title string, r_cat string, r_title string, first long, coarse double, scored long")
    rank = F.row_number().over(W.partitionBy("platform", "s_cat", "s_title").orderBy(F.desc("coarse"), "first"))
    return met.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def candidates(pending: DataFrame, rivals: DataFrame, config: MatchConfig = MatchConfig(), most: int | None = None) -> DataFrame:
    """The best ``most`` (or ``top_k``) rivals for each kind of pending products, those equal in ``KIND``: kind, rank,
    rival_uid, score, reason. Distinct titles are searched in an index, the finer text score is only for those in the
    coarse cut. The cut of a title is one row with at most ``coarse`` candidates, so that a product meets them
    in its own row: no row for each product and candidate is sorted. Reasons are worded for the ranks that stay."""
    n = config.coarse
    nth = F.row_number().over(W.partitionBy("platform", "r_cat", "r_title").orderBy("ord"))
    detail = F.struct(F.struct("spec.raw", "spec.unit", "spec.qty_base", "spec.count", "spec.total_base").alias("spec"), "variants", "line")
    entry = rivals.filter("norm_title <> ''").select("platform", F.col("category").alias("r_cat"), F.col("norm_title").alias("r_title"), "ord", "uid", detail.alias("r")).withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")
    own = W.partitionBy("platform", "s_cat", "s_title")
    best = nearest_titles(pending, rivals, n, config).drop("first", "scored")
    best = best.withColumn("base", M.text_score(F.col("coarse"), F.col("s_title"), F.col("r_title")))
    rough = best.join(entry, ["platform", "r_cat", "r_title"]).withColumn("place", F.row_number().over(own.orderBy(F.desc("coarse"), "ord"))).filter(F.col("place") <= n)
    # tables, so that their size decides how they're joined
    rough = rough.groupBy("platform", F.col("s_cat").alias("category"), F.col("s_title").alias("norm_title")).agg(F.collect_list(F.struct("place", "base", F.col("uid").alias("rival_uid"), "r")).alias("near"))
    rough = cut(rough, "coarse")
    kinds = pending.select(*KIND).distinct()
    both = spread(kinds, *KIND[:4]).join(rough, list(KIND[:3]))

    def scored(x: Column) -> Column:
        by_spec = M.spec_penalty(F.col("spec"), x["r"]["spec"], config.spec_penalty)
        return X.let(by_spec, lambda by: _scored(x, by))

    def _scored(x: Column, by_spec: Column) -> Column:
        penalty = F.when(F.col("line") != x["r"]["line"], by_spec + M.LINE_PENALTY).otherwise(by_spec)
        return F.struct((-F.greatest(F.lit(0.0), x["base"] - penalty)).alias("key"), x["place"].alias("place"), by_spec.alias("by_spec"), x["base"].alias("base"), x["rival_uid"].alias("rival_uid"), x["r"].alias("r"))

    fit = F.filter("near", lambda x: ~X.variant_conflict(F.col("variants"), x["r"]["variants"]))
    top = F.slice(F.array_sort(F.transform(fit, scored)), 1, config.top_k if most is None else most)
    both = both.select(*KIND, F.posexplode(top).alias("nth", "c")).select(*KIND, (F.col("nth") + 1).alias("rank"), (-F.col("c.key")).alias("score"), "c.by_spec", "c.base", "c.rival_uid", "c.r")
    note, by_line = M.spec_note(F.col("spec"), F.col("r.spec")), X.line_mismatch(F.col("line"), F.col("r.line"))
    noted = X.let(note, lambda t: F.when(t != "", F.concat(F.lit("，"), t, F.lit(" 扣 "), F.format_string("%.1f", "by_spec"))).otherwise(""))
    lined = F.when(by_line != "", F.concat(F.lit("，"), by_line, F.lit(" 扣 20"))).otherwise("")
    reason = F.concat(F.lit("文本相似 "), F.format_string("%.1f", "base"), noted, lined)
    return both.select(*KIND, "rank", "rival_uid", "score", reason.alias("reason"))


def of_kind(pending: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Pending products with the candidates of their kind."""
    mine = pending.select("self_uid", "platform_ord", *KIND)
    theirs = found.withColumnsRenamed({c: f"_{c}" for c in KIND})
    alike = [mine[c] == theirs[f"_{c}"] if c in KIND[:3] else mine[c].eqNullSafe(theirs[f"_{c}"]) for c in KIND]
    return mine.join(theirs, reduce(lambda a, b: a & b, alike), how).drop(*[f"_{c}" for c in KIND], *KIND[1:])


def recall(pending: DataFrame, rivals: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The ``top_k`` rivals of each pending product: self_uid, platform, platform_ord, rank, rival_uid,
    score, reason."""
    found = of_kind(pending, cut(candidates(pending, rivals, config), "candidates"))
    return found.select("self_uid", "platform", "platform_ord", "rank", "rival_uid", "score", "reason")


def route(score: Column, config: MatchConfig = MatchConfig()) -> Column:
    return F.when(score >= config.auto_accept, "accept").when(score < config.reject_below, "reject").otherwise("gray")


def route_best(pending: DataFrame, best: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(settled pairs, grey candidates) of the best candidate of each pending product."""
    return _routed(pending.select("self_uid", "platform", "platform_ord").join(best.drop("platform_ord", "rank"), ["self_uid", "platform"], "left"), config)


def _routed(rows: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("_way", F.when(F.col("rival_uid").isNull(), "none").otherwise(route(F.col("score"), config)))
    way = F.col("_way")
    limit = f"{config.reject_below:g}"
    low = F.concat(F.lit("最高分 "), F.format_string("%.1f", "score"), F.lit(f" 低于阈值 {limit}"))
    accept = way == "accept"
    settled = rows.filter(way != "gray").select(
        *_pair(
            F.when(accept, F.col("rival_uid")),
            F.coalesce("score", F.lit(0.0)),
            F.when(accept, C.FUZZY).otherwise(C.NONE),
            F.when(accept, F.least(F.col("score") / 100.0, F.lit(0.99))).otherwise(0.0),
            F.when(accept, F.col("reason")).when(way == "none", "无候选商品").otherwise(low),
        )
    )
    return settled, rows.filter(way == "gray").drop("_way")


def judge_gray(gray: DataFrame, verdicts: DataFrame | None, config: MatchConfig) -> DataFrame:
    """Grey candidates with their verdicts; without one they stay matched and go to review."""
    if verdicts is None or config.judge != "verdicts":
        tail = {"disabled": ""}.get(config.judge, "（未启用 AI 判定）")
        return gray.select(*_pair(F.col("rival_uid"), F.col("score"), C.FUZZY, F.col("score") / 100.0, F.concat("reason", F.lit(tail)), True))
    v = verdicts.select("self_uid", "platform", F.struct("is_match", "confidence", "reason").alias("v"))
    rows = gray.join(v, ["self_uid", "platform"], "left")
    sure = F.coalesce("v.confidence", F.lit(0.0))
    missing, yes = F.col("v").isNull(), F.coalesce("v.is_match", F.lit(False))
    said = F.coalesce("v.reason", F.lit(""))
    return rows.select(
        *_pair(
            F.when(missing | yes, F.col("rival_uid")),
            F.col("score"),
            F.when(missing, C.FUZZY).when(yes, C.JUDGED).otherwise(C.NONE),
            F.when(missing, F.col("score") / 100.0).otherwise(sure),
            F.when(missing, F.concat("reason", F.lit("（AI 未给出判定）"))).when(yes, F.concat(F.lit("AI 判定匹配："), said)).otherwise(F.concat(F.lit("AI 判定不匹配："), said)),
            missing | (sure < config.accept_confidence),
        )
    )


def match_all(own: DataFrame, rivals: DataFrame, config: MatchConfig = MatchConfig(), verdicts: DataFrame | None = None, judge: Judge | None = None, store: str | None = None) -> DataFrame:
    """One pair per own product and platform with data, by the first stage that settles it.

    The grey zone is settled by ``verdicts`` or, where there are none, by asking ``judge``, whose answers ``store`` keeps.
    ``own`` and ``rivals`` are read by every stage: give tables, not plans that parse titles."""
    pending = cut(with_platforms(own.select("uid", "barcode", "brand", *KIND), rivals), "pending")
    done: DataFrame | None = None
    for on, rule in ((config.barcode, match_barcode), (config.brand_spec, match_brand_spec)):
        if on:
            found = cut(rule(pending, rivals), "matched")
            if not found.isEmpty():  # else all are pending still
                pending = cut(pending.join(found.select("self_uid", "platform"), ["self_uid", "platform"], "left_anti"), "pending")
            done = found if done is None else done.unionByName(found)
    best = cut(candidates(pending, rivals, config, 1), "candidates")
    settled, gray = _routed(cut(of_kind(pending, best, "left").drop("rank"), "recalled"), config)
    if verdicts is None and judge is not None and config.judge == "verdicts":
        # asked once: a table, not a plan that asks again when it's read again
        verdicts = cut(adjudicate(gray, own, rivals, judge, config.batch_size, config.concurrency, store), "verdicts")
    out = settled.unionByName(judge_gray(gray, verdicts, config))
    return out if done is None else done.unionByName(out)


def match_stats(pairs: DataFrame) -> DataFrame:
    """Per platform: pairs, matched by level, unmatched, for review."""
    levels = {"barcode": C.BARCODE, "brand_spec": C.BRAND_SPEC, "fuzzy": C.FUZZY, "judged": C.JUDGED}
    hit = F.col("rival_uid").isNotNull()
    return pairs.groupBy("platform").agg(F.count("*").alias("total"), *[F.count_if(hit & (F.col("level") == v)).alias(k) for k, v in levels.items()], F.count_if(~hit).alias("unmatched"), F.count_if("need_review").alias("need_review"))
