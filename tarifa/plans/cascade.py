"""Queries over offers made to meet every branch of the matching cascade: variants, product lines,
other units, sizes that can't be parsed, missing candidates, and each outcome of the grey zone.

Eight kinds of parts (by key) have one product of one's own and two offers each; a category of its
own keeps the rivals of a part together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as P
from ..operators import judge as A
from ..operators import matching as J
from ..operators import report as O
from ..operators.products import to_products
from ..operators.tables import cut
from . import catalogue as K
from .catalogue import text
from .queries import part, query, six

#: kind: own title, titles of the two offers, declared brand
KINDS = [
    ("面 500g", "面 香辣 500g", "面 红烧 500g", ""),
    ("面 香辣 500g", "面 香辣 500g", "面 红烧 500g", ""),
    ("面 红烧 1kg", "面 香辣 1kg", "面 红烧 500g", ""),
    ("特仑苏 纯牛奶 500g", "纯牛奶 500g", "洗衣液 3kg", ""),
    ("特仑苏 纯牛奶 500g", "金典 纯牛奶 1kg", "特仑苏 纯牛奶 1L", ""),
    ("抽象画", "抽象画 500g", "抽象画", ""),
    ("茶π 青柠 清爽 饮品 夏日 500ml", "尖叫 青柠 清爽 饮品 夏日 500ml", "茶π 500ml 2瓶", "b"),
    ("有机 橙 500g", "浓缩 橙 500g", "鲜榨 橙 1kg", "b"),
]
#: By hand from the contract: kind, rank, which offer, score, reason. Kind 7 has no candidate.
RANKED = """ranked(m, rank, nth, score, reason) as (values
  (0, 1, 0, 60.0, '文本相似 60.0'), (0, 2, 1, 60.0, '文本相似 60.0'),
  (1, 1, 0, 100.0, '文本相似 100.0'), (2, 1, 1, 96.0, '文本相似 100.0，规格差 2.0×（1000g vs 500g） 扣 4.0'),
  (3, 1, 0, 56.0, '文本相似 76.0，仅一方标注产品线（特仑苏） 扣 20'), (3, 2, 1, 0.0, '文本相似 0.0，规格差 6.0×（500g vs 3000g） 扣 12.0，仅一方标注产品线（特仑苏） 扣 20'),
  (4, 1, 1, 88.0, '文本相似 100.0，单位类别不同（weight vs volume） 扣 12.0'), (4, 2, 0, 27.428571, '文本相似 51.4，规格差 2.0×（500g vs 1000g） 扣 4.0，产品线不同（特仑苏 vs 金典） 扣 20'),
  (5, 1, 0, 100.0, '文本相似 100.0'), (5, 2, 1, 100.0, '文本相似 100.0'),
  (6, 1, 1, 60.444444, '文本相似 64.4，规格差 2.0×（500ml vs 500ml×2 (合计1000ml)） 扣 4.0'), (6, 2, 0, 58.254545, '文本相似 78.3，产品线不同（茶π vs 尖叫） 扣 20')),
keys as (select p_partkey as k, p_partkey % 8 as m from part)"""
_BEST = f"with {RANKED}, best as (select k, m, 'p0:' || (2 * k + nth) as rival_uid, score, reason from keys left join ranked using (m) where rank is null or rank = 1) "


def _pick(which: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(kind[which]) for kind in KINDS]), (F.col("k") % len(KINDS) + 1).cast("int"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = part(spark, sf_dir).select("k")
    same = [F.concat(F.lit("c"), F.col("k")).alias("category"), _pick(3).alias("brand"), F.when(F.col("k") % 16 < 8, "10").otherwise("-").alias("price")]
    own = k.select(F.lit(K.SELF).alias("platform"), F.lit(0).alias("platform_ord"), F.col("k").alias("ord"), F.col("k").cast("string").alias("sku_id"), _pick(0).alias("title"), *same)
    offer = lambda n: k.select(F.lit("p0").alias("platform"), F.lit(1).alias("platform_ord"), (2 * F.col("k") + n).alias("ord"), (2 * F.col("k") + n).cast("string").alias("sku_id"), _pick(1 + n).alias("title"), *same)
    made = cut(to_products(own.unionByName(offer(0)).unionByName(offer(1))), "kinds")
    return made.filter(F.col("platform") == K.SELF), made.filter(F.col("platform") != K.SELF)


@query(f"with {RANKED} select 'self:' || k as self_uid, rank::bigint as rank, 'p0:' || (2 * k + nth) as rival_uid, round(score, 6)::double as score, reason from keys join ranked using (m)")
def recall_reasons(spark, sf_dir):
    own, rivals = sides(spark, sf_dir)
    found = J.recall(J.with_platforms(own, rivals), rivals)
    return found.select("self_uid", F.col("rank").cast("long").alias("rank"), "rival_uid", six("score"), "reason")


@query("""select 'self:' || p_partkey as self_uid, p_partkey % 8 in (6, 7) as same_keys, 0::bigint as pairs from part
  union all select 'self:t' || p_partkey, true, 1 from part""")
def brand_spec_conflicts(spark, sf_dir):
    """Equal brand, category and total: no pair with another variant or product line, one for plain tea."""
    own, rivals = sides(spark, sf_dir)
    tea = part(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(n).alias("platform_ord")) for n, p in enumerate((K.SELF, "p0"))])).alias("p"), "k")
    tea = tea.select("p.platform", "p.platform_ord", F.col("k").alias("ord"), text("t", F.col("k")).alias("sku_id"), F.lit("绿茶 500g").alias("title"), text("d", F.col("k")).alias("category"), F.lit("b").alias("brand"))
    tea = cut(to_products(tea), "tea")
    own, rivals = own.unionByName(tea.filter(F.col("platform") == K.SELF)), rivals.unionByName(tea.filter(F.col("platform") != K.SELF))
    found = J.match_brand_spec(J.with_platforms(own, rivals), rivals).groupBy("self_uid").agg(F.count("*").alias("n"))
    key = lambda df: df.filter("brand <> ''").select("category", F.lower("brand").alias("b"), F.col("spec.unit").alias("u"), F.col("spec.total_base").alias("t"))
    alike = key(own).intersect(key(rivals)).select("category", F.lit(True).alias("same"))
    rows = own.select(F.col("uid").alias("self_uid"), "category").join(alike, "category", "left").join(found, "self_uid", "left")
    return rows.select("self_uid", F.coalesce("same", F.lit(False)).alias("same_keys"), F.coalesce("n", F.lit(0)).alias("pairs"))


@query("select 'self:' || s_suppkey as self_uid, 'p0:' || s_suppkey as rival_uid, 100.0::double as score from supplier")
def fallback_pool(spark, sf_dir):
    """No rival's category is compatible: all of the platform are candidates, and the equal title is found."""
    word = F.concat(F.lit("q"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"))
    s = K.table(spark, sf_dir, "supplier")
    rows = lambda platform, n, category: s.select(F.lit(platform).alias("platform"), F.lit(n).alias("platform_ord"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("sku_id"), word.alias("title"), category.alias("category"))
    made = cut(to_products(rows(K.SELF, 0, F.lit("甲类")).unionByName(rows("p0", 1, text("乙类", F.col("s_suppkey") % 3)))), "fallback")
    own, rivals = made.filter(F.col("platform") == K.SELF), made.filter(F.col("platform") != K.SELF)
    return J.recall(J.with_platforms(own, rivals), rivals).filter("rank = 1").select("self_uid", "rival_uid", six("score"))


def _outcome(spark, sf_dir, judge: str, verdicts=None, function=None) -> DataFrame:
    own, rivals = sides(spark, sf_dir)
    pairs = J.match_all(own, rivals, J.MatchConfig(judge=judge), verdicts(own) if verdicts else None, function)
    return pairs.select("self_uid", "rival_uid", six("score"), "level", six("confidence"), "reason", "need_review")


def _settled(gray: str) -> str:
    """SQL of the outcomes; ``gray``: rival, level, confidence, reason and review of grey pairs."""
    return (
        _BEST
        + f""", routed as (select *, case when m = 7 then 'none' when score >= 88 then 'accept' else 'gray' end as way from best), gray as (select k, {gray} from routed where way = 'gray')
select 'self:' || k as self_uid, case when way = 'accept' then rival_uid when way = 'gray' then g_rival end as rival_uid, coalesce(round(score, 6), 0.0)::double as score,
  case when way = 'accept' then 'L2-模糊' when way = 'gray' then g_level else '未匹配' end as level,
  round(case when way = 'accept' then least(score / 100, 0.99) when way = 'gray' then g_sure else 0.0 end, 6)::double as confidence,
  case when way = 'accept' then reason when way = 'gray' then g_reason else '无候选商品' end as reason, coalesce(way = 'gray' and g_review, false) as need_review
from routed left join gray using (k)"""
    )


@query(_settled("rival_uid as g_rival, 'L2-模糊' as g_level, score / 100 as g_sure, reason as g_reason, true as g_review"))
def gray_without_judge(spark, sf_dir):
    return _outcome(spark, sf_dir, "disabled")


@query(_settled("rival_uid as g_rival, 'L2-模糊' as g_level, score / 100 as g_sure, reason || '（未启用 AI 判定）' as g_reason, true as g_review"))
def gray_unavailable_judge(spark, sf_dir):
    return _outcome(spark, sf_dir, "unavailable")


@query(
    _settled("""case when k % 3 <> 1 then rival_uid end as g_rival, case k % 3 when 0 then 'L3-AI判定' when 1 then '未匹配' else 'L2-模糊' end as g_level,
  case when k % 3 = 2 then score / 100 when k % 2 = 0 then 0.9 else 0.6 end as g_sure, case k % 3 when 0 then 'AI 判定匹配：v' when 1 then 'AI 判定不匹配：v' else reason || '（AI 未给出判定）' end as g_reason, k % 3 = 2 or k % 2 = 1 as g_review""")
)
def gray_with_verdicts(spark, sf_dir):
    return _outcome(spark, sf_dir, "verdicts", K.verdicts)


def by_line(instructions: str, prompt: str, schema: dict) -> dict:
    """Stands for a service: a pair is a match unless one side names the product line 特仑苏."""
    found = []
    for block in prompt.split("\n\n[")[1:] if not prompt.startswith("[") else prompt.split("\n\n["):
        number, own, rival = block.split("\n")[:3]
        found.append({"index": int(number.strip("[]")), "is_match": ("特仑苏" in own) == ("特仑苏" in rival), "confidence": 0.8, "reason": own.strip()})
    return {"results": found}


_SAID = """'我方商品：标题：' || case m when 0 then '面 500g | 规格：500g' when 3 then '特仑苏 纯牛奶 500g | 品牌：特仑苏 | 规格：500g' else '茶π 青柠 清爽 饮品 夏日 500ml | 品牌：b | 规格：500ml' end || case when k % 16 < 8 then ' | 售价：10.00元' else '' end"""


@query(_settled(f"case when m <> 3 then rival_uid end as g_rival, case when m <> 3 then 'L3-AI判定' else '未匹配' end as g_level, 0.8 as g_sure, case when m <> 3 then 'AI 判定匹配：' else 'AI 判定不匹配：' end || {_SAID} as g_reason, false as g_review"))
def gray_with_judge(spark, sf_dir):
    return _outcome(spark, sf_dir, "verdicts", function=by_line)


@query(
    _BEST
    + """, own as (select k, m, case when k % 16 < 8 then 10.0 end as price, case m when 2 then 1000.0 when 5 then null when 7 then 500.0 else 500.0 end as total, case when m = 6 then 'volume' when m = 5 then 'unknown' else 'weight' end as unit from keys),
  theirs(m, r_unit, r_total) as (values (0, 'weight', 500.0), (1, 'weight', 500.0), (2, 'weight', 500.0), (3, 'weight', 500.0), (4, 'volume', 1000.0), (5, 'weight', 500.0), (6, 'volume', 1000.0)),
  gap as (select k, m, price, rival_uid, score, unit = r_unit and price is not null as alike, case when price is null or rival_uid is null then null when unit = r_unit then (price / total - price / r_total) / (price / r_total) else 0.0 end as rate from own left join theirs using (m) left join (select k, rival_uid, score from best) using (k))
select 'self:' || k as uid, round(rate, 6)::double as diff_rate, coalesce(alike, false) as comparable, case when rate is null then '数据不足' when rate >= 0.15 then '建议降价(高优)' when rate <= -0.10 then '有提价空间' else '持平/关注' end as action,
  case when rate is null then 'muted' when rate >= 0.15 then 'critical' when rate <= -0.10 then 'good' else 'neutral' end as kind,
  case when price is null then '我方缺少价格' when m = 7 then '无有效竞品匹配' else concat_ws('；', case m when 4 then '单位类别不同，按标价对比' when 5 then '我方规格未解析，按标价对比' end, case when score < 88 then '存在待复核的匹配关系' end) end as notes from gap"""
)
def compare_fallbacks(spark, sf_dir):
    """List prices where units don't compare, and rows without a price or a rival."""
    own, rivals = sides(spark, sf_dir)
    rows = P.compare_rows(own, cut(J.match_all(own, rivals), "pairs"), rivals)
    return rows.select("uid", six("diff_rate"), "comparable", "action", P.action_kind(F.col("action")).alias("kind"), F.array_join("notes", "；").alias("notes"))


@query(
    _BEST
    + """select k::varchar as sku, 'p0' as platform, case m when 0 then '面 香辣 500g' when 3 then '纯牛奶 500g' else '茶π 500ml 2瓶' end as rival, case m when 0 then '500g' when 3 then '500g' else '500ml×2 (合计1000ml)' end as rival_spec,
  case m when 0 then '面 500g' when 3 then '特仑苏 纯牛奶 500g' else '茶π 青柠 清爽 饮品 夏日 500ml' end as title, case when m = 6 then '500ml' else '500g' end as spec, 'L2-模糊' as level, round(score, 1)::double as score, round(score / 100, 2)::double as sure, reason, '' as checked from best where m in (0, 3, 6)"""
)
def review_columns(spark, sf_dir):
    """All columns of the review list."""
    own, rivals = sides(spark, sf_dir)
    rows = O.review_rows(P.compare_rows(own, cut(J.match_all(own, rivals), "pairs"), rivals))
    names = ["sku", "title", "spec", "platform", "rival", "rival_spec", "level", "score", "sure", "reason", "checked"]
    return rows.select(*[F.col(c).alias(n) for c, n in zip(O.REVIEW_COLUMNS, names)])


@query("""select p_partkey as k, '标题：' || p_name || case when p_partkey % 2 = 0 then ' | 品牌：' || p_brand else '' end || case p_partkey % 3 when 0 then ' | 规格：' || (p_size * 10) || 'g' when 1 then ' | 规格：大份' else '' end || case when p_partkey % 5 > 0 then ' | 售价：' || printf('%.2f', p_retailprice) || '元' else '' end as told from part""")
def judge_descriptions(spark, sf_dir):
    from ..functions import spec as S

    third = F.col("k") % 3
    d = part(spark, sf_dir).select("k", F.col("p_name").alias("title"), F.when(F.col("k") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), F.when(third == 0, text(K.grams(), "g")).otherwise("").alias("t"), F.when(third == 1, "大份").otherwise("").alias("spec_text"), F.when(F.col("k") % 5 > 0, F.col("p_retailprice")).alias("price"))
    d = d.withColumn("spec", S.parse_spec(F.col("t")))
    return d.select("k", A.describe(*[F.col(c) for c in ("title", "brand", "spec", "spec_text", "price")]).alias("told"))
