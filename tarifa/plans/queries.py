"""One query per operator family over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as C
from ..functions import similarity as M
from ..functions.records import at_path
from ..functions import spec as S
from ..functions import text as X
from ..operators import compare as P
from ..operators import matching as J
from ..operators import products as R
from ..operators import report as O
from . import catalogue as K
from .catalogue import grams, pieces, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def six(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


# ---------------------------------------------------------------- SQL building blocks

#: Own products with what the parsers should find in them.
OWN = """own as (
  select p_partkey as ord, 'self:' || p_partkey as uid, p_name || ' ' || (p_size * 10) || 'g*' || (p_partkey % 6 + 1) as title,
    p_retailprice as price, p_brand as brand, p_type as category,
    case when p_partkey % 7 = 0 then '69' || lpad(p_partkey::varchar, 8, '0') else '' end as barcode,
    trim(replace(lower(p_name), 'x', ' ')) as norm, (p_size * 10)::double * (p_partkey % 6 + 1) as total,
    p_retailprice / ((p_size * 10)::double * (p_partkey % 6 + 1)) * 100 as unit_price
  from part)"""
#: Offers of the rival platforms.
RIVALS = """rivals as (
  select 'p' || k as platform, k + 1 as platform_ord, p_partkey as ord, 'p' || k || ':' || p_partkey as uid,
    split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || '【自营】' || (p_size * 10 * case when k = 3 then 2 else 1 end) || '克*' || (p_partkey % 6 + 1) || '袋' as title,
    floor(p_retailprice * (85 + 5 * ((p_partkey + 3 * k) % 8))) / 100 as price, case when k = 2 then '' else p_brand end as brand,
    case when p_partkey % 11 = 0 then '' else p_type end as category,
    case when p_partkey % 14 = 0 then '69' || lpad(p_partkey::varchar, 8, '0') else '' end as barcode,
    trim(replace(lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)), 'x', ' ')) as norm,
    (p_size * 10 * case when k = 3 then 2 else 1 end)::double * (p_partkey % 6 + 1) as total,
    floor(p_retailprice * (85 + 5 * ((p_partkey + 3 * k) % 8))) / 100 / ((p_size * 10 * case when k = 3 then 2 else 1 end)::double * (p_partkey % 6 + 1)) * 100 as unit_price
  from (select distinct (l_suppkey % 4)::int as k, l_partkey from lineitem) join part on l_partkey = p_partkey)"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two SQL strings: rows of the table as lists."""
    start = f"list_transform(range(length({b}) + 1), lambda z: 0::bigint)"
    chars = f"list_transform(range(1, length({a}) + 1), lambda z: [ord(substring({a}, z::int, 1))::bigint])"
    places = f"list_transform(range(1, length({b}) + 1), lambda z: [z::bigint])"
    cell = f"list_append(acc, case when ord(substring({b}, j[1]::int, 1)) = x[1] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], acc[len(acc)]) end)"
    return f"(list_reduce({chars}, lambda prev, x: list_reduce({places}, lambda acc, j: {cell}, [0::bigint]), {start}))[length({b}) + 1]"


#: Ratios of all pairs of distinct titles (a, b).
RATIOS = f"""names as (select distinct norm as a from own), others as (select distinct norm as b from rivals),
tokens as (select a, b, list_sort(list_distinct(string_split(a, ' '))) as x, list_sort(list_distinct(string_split(b, ' '))) as y,
    array_to_string(list_sort(string_split(a, ' ')), ' ') as sa, array_to_string(list_sort(string_split(b, ' ')), ' ') as sb from names, others),
split as (select a, b, sa, sb, array_to_string(list_sort(list_intersect(x, y)), ' ') as s,
    array_to_string(list_filter(x, lambda t: not list_contains(y, t)), ' ') as l, array_to_string(list_filter(y, lambda t: not list_contains(x, t)), ' ') as r from tokens),
measured as (select *, {lcs("sa", "sb")} as n_sort, {lcs("l", "r")} as n_set, case when s = '' then 0 else 1 end as gap from split),
ratios as (select a, b, 100.0 - 100.0 * (length(sa) + length(sb) - 2 * n_sort) / (length(sa) + length(sb)) as sort_ratio,
    case when s <> '' and (l = '' or r = '') then 100.0 else greatest(
      100.0 - 100.0 * (length(l) + length(r) - 2 * coalesce(n_set, 0)) / (2 * (length(s) + gap) + length(l) + length(r)),
      case when s = '' then 0 else 100.0 - 100.0 * (gap + length(l)) / (2 * length(s) + gap + length(l)) end,
      case when s = '' then 0 else 100.0 - 100.0 * (gap + length(r)) / (2 * length(s) + gap + length(r)) end) end as set_ratio,
    list_distinct(list_transform(range(1, length(replace(a, ' ', ''))), lambda z: substring(replace(a, ' ', ''), z::int, 2))) as ga,
    list_distinct(list_transform(range(1, length(replace(b, ' ', ''))), lambda z: substring(replace(b, ' ', ''), z::int, 2))) as gb from measured),
scores as (select a, b, sort_ratio, set_ratio, len(list_intersect(ga, gb))::double / (len(ga) + len(gb) - len(list_intersect(ga, gb))) * 100 as bigrams from ratios)"""
PLATFORMS = "platforms as (select platform, min(platform_ord) as platform_ord from rivals group by platform)"
BY_BARCODE = "by_barcode as (select o.uid as self_uid, r.platform, r.platform_ord, r.uid as rival_uid from own o join rivals r on o.barcode = r.barcode and o.barcode <> '')"
BY_BRAND = """by_brand as (select o.uid as self_uid, u.platform, u.platform_ord, u.uid as rival_uid, o.norm, u.norm as other
  from own o join (select platform, min(platform_ord) as platform_ord, lower(brand) as b, category, total, count(*) as n, min(uid) as uid, min(norm) as norm
      from rivals where brand <> '' and category <> '' group by platform, lower(brand), category, total having count(*) = 1) u
    on lower(o.brand) = u.b and o.category = u.category and round(o.total, 3) = round(u.total, 3)
  join scores s on s.a = o.norm and s.b = u.norm
  where sort_ratio >= 60 and not exists (select 1 from by_barcode x where x.self_uid = o.uid and x.platform = u.platform))"""
PENDING = """pending as (select o.*, p.platform, p.platform_ord from own o, platforms p
  where not exists (select 1 from by_barcode x where x.self_uid = o.uid and x.platform = p.platform)
    and not exists (select 1 from by_brand x where x.self_uid = o.uid and x.platform = p.platform))"""
RECALL = """pools as (select distinct platform, category, norm from pending),
coarse as (select q.platform, q.category, q.norm, r.uid as rival_uid, r.total as r_total, r.norm as r_norm, set_ratio, bigrams,
    row_number() over (partition by q.platform, q.category, q.norm order by round(set_ratio, 9) desc, r.ord) as place
  from pools q join rivals r on r.platform = q.platform and (r.category = '' or r.category = q.category) join scores s on s.a = q.norm and s.b = r.norm),
cand as (select p.uid as self_uid, p.platform, p.platform_ord, c.rival_uid, c.place, 0.6 * set_ratio + 0.4 * bigrams as base, greatest(p.total, r_total) / least(p.total, r_total) as ratio
  from pending p join coarse c on c.platform = p.platform and c.category = p.category and c.norm = p.norm where place <= 20),
fine as (select *, greatest(0.0, base - case when ratio <= 1.05 then 0.0 else least(12.0, (ratio - 1.0) / 3.0 * 12.0) end) as score from cand),
ranked as (select *, row_number() over (partition by self_uid, platform order by score desc, place) as rank from fine)"""
PAIRS = """best as (select p.uid as self_uid, p.platform, p.platform_ord, p.ord, r.rival_uid, r.score from pending p left join ranked r on r.self_uid = p.uid and r.platform = p.platform and r.rank = 1),
routed as (select *, case when rival_uid is null then 'none' when score >= 88 then 'accept' when score < 55 then 'reject' else 'gray' end as way,
    ord % 3 < 2 as has_verdict, ord % 3 = 0 as yes, case when ord % 2 = 0 then 0.9 else 0.6 end as sure from best),
pairs as (
  select self_uid, platform, platform_ord, rival_uid, 100.0::double as score, 'L1-条码' as level, 1.0::double as confidence, false as need_review from by_barcode
  union all select self_uid, platform, platform_ord, rival_uid, 96.0, 'L1-品牌规格', 0.95, false from by_brand
  union all select self_uid, platform, platform_ord,
    case when way = 'accept' or way = 'gray' and (not has_verdict or yes) then rival_uid end, coalesce(score, 0.0),
    case when way = 'accept' or way = 'gray' and not has_verdict then 'L2-模糊' when way = 'gray' and yes then 'L3-AI判定' else '未匹配' end,
    case when way = 'accept' then least(score / 100, 0.99) when way <> 'gray' then 0.0 when has_verdict then sure else score / 100 end,
    way = 'gray' and (not has_verdict or sure < 0.7) from routed)"""
MATCH = ", ".join([OWN, RIVALS, RATIOS, PLATFORMS, BY_BARCODE, BY_BRAND, PENDING, RECALL, PAIRS])


def compared(mode: str) -> str:
    """Comparison rows for a way to choose the benchmark."""
    pick = {
        "min": "row_number() over (partition by p.self_uid order by r.unit_price, p.platform_ord)",
        "avg": "row_number() over (partition by p.self_uid order by abs(r.unit_price - m.mean_unit), p.platform_ord)",
    }.get(mode, f"case when p.platform = '{mode}' then 1 end")
    prices = "m.mean_price as benchmark_price, m.mean_unit as benchmark_unit_price" if mode == "avg" else "b.price as benchmark_price, b.unit_price as benchmark_unit_price"
    return f"""means as (select p.self_uid, list_reduce(list(r.price order by p.platform_ord), lambda a, x: a + x) / count(*) as mean_price, list_reduce(list(r.unit_price order by p.platform_ord), lambda a, x: a + x) / count(*) as mean_unit from pairs p join rivals r on r.uid = p.rival_uid group by p.self_uid),
chosen as (select p.self_uid, p.platform, r.price, r.unit_price, {pick} as nth from pairs p join rivals r on r.uid = p.rival_uid join means m on m.self_uid = p.self_uid),
review as (select self_uid, bool_or(need_review and rival_uid is not null) as some, bool_or(rival_uid is not null) as hit from pairs group by self_uid),
gaps as (select o.*, coalesce(b.platform, '') as benchmark_platform, {prices}, v.some as some_review, v.hit
  from own o left join (select * from chosen where nth = 1) b on b.self_uid = o.uid left join means m on m.self_uid = o.uid and b.self_uid is not null left join review v on v.self_uid = o.uid),
rows as (select *, unit_price - benchmark_unit_price as diff, (unit_price - benchmark_unit_price) / benchmark_unit_price as diff_rate from gaps),
final as (select *, case when diff_rate is null then '数据不足' when diff_rate >= 0.15 then '建议降价(高优)' when diff_rate >= 0.05 then '建议降价' when diff_rate <= -0.10 then '有提价空间' else '持平/关注' end as action,
  case when benchmark_platform = '' then '无有效竞品匹配' when some_review then '存在待复核的匹配关系' else '' end as notes from rows)"""


def over(*blocks: str) -> str:
    return "with " + ", ".join(blocks) + " "


ROWS = over(MATCH, compared("min"))

# ---------------------------------------------------------------- values and texts


@query("""select p_partkey as k, case p_partkey % 5 when 0 then '' when 1 then '' when 2 then p_name when 3 then '' else p_brand end as s from part""")
def clean_str(spark, sf_dir):
    raw = F.when(F.col("k") % 5 == 0, " N/A\t").when(F.col("k") % 5 == 1, F.lit(None)).when(F.col("k") % 5 == 2, text("　", F.col("p_name"), " \n")).when(F.col("k") % 5 == 3, "—").otherwise(text(" ", F.col("p_brand")))
    return part(spark, sf_dir).select("k", X.clean_str(raw).alias("s"))


@query("""select p_partkey as k, case p_partkey % 5 when 3 then null when 4 then null else p_retailprice end as price from part""")
def parse_price(spark, sf_dir):
    p = F.col("p_retailprice").cast("string")
    raw = F.when(F.col("k") % 5 == 0, text("¥", p)).when(F.col("k") % 5 == 1, text(" ", p, "元 ")).when(F.col("k") % 5 == 2, text("￥", F.regexp_replace(p, r"(\d)(\d{2}\.)", "$1,$2"))).when(F.col("k") % 5 == 3, "-").otherwise(text(p, "d"))
    return part(spark, sf_dir).select("k", X.parse_price(raw).alias("price"))


@query("""select p_partkey as k, replace(p_name, 'x', '*') || ' (' || p_size || '):' || p_size || '*ml kg' as s from part""")
def normalize_text(spark, sf_dir):
    raw = text("　", F.col("p_name"), "  （", F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９"), "）：", F.col("p_size"), "×ｍｌ　㎏ ")
    return part(spark, sf_dir).select("k", X.normalize_text(raw).alias("s"))


def _parsed(spark, sf_dir, title: F.Column) -> DataFrame:
    s = part(spark, sf_dir).select("k", X.normalize_text(title).alias("t")).select("k", S.parse_spec(F.col("t")).alias("s"))
    return s.select("k", F.col("s.unit").alias("unit"), F.col("s.qty_base").alias("qty_base"), F.col("s.count").cast("long").alias("n"), F.col("s.total_base").alias("total"))


_RULE = "select p_partkey as k, '{unit}' as unit, ({qty})::double as qty_base, ({n})::bigint as n, (({qty}) * ({n}))::double as total from part"


@query(_RULE.format(unit="volume", qty="p_size * 10", n="p_partkey % 6 + 1"))
def parse_spec_rule1(spark, sf_dir):
    return _parsed(spark, sf_dir, text("满100减20 ", F.col("p_brand"), " ", grams(), "ml×", pieces(), "瓶"))


@query(_RULE.format(unit="weight", qty="p_size * 500", n="p_partkey % 6 + 1"))
def parse_spec_rule2(spark, sf_dir):
    return _parsed(spark, sf_dir, text(pieces(), "袋 * ", F.col("p_size"), "斤 ", F.col("p_type")))


@query(_RULE.format(unit="volume", qty="p_size * 1000", n="case when p_partkey % 250 between 2 and 200 then p_partkey % 250 else 1 end"))
def parse_spec_rule3(spark, sf_dir):
    return _parsed(spark, sf_dir, text(F.col("p_type"), " ", F.col("p_size"), "L ", F.col("p_partkey") % 250, "盒装"))


@query("""select p_partkey as k, case when p_partkey % 700 between 1 and 500 then 'count' else 'unknown' end as unit, case when p_partkey % 700 between 1 and 500 then 1.0::double end as qty_base,
  case when p_partkey % 700 between 1 and 500 then p_partkey % 700 else 1 end as n, case when p_partkey % 700 between 1 and 500 then (p_partkey % 700)::double end as total from part""")
def parse_spec_rule4(spark, sf_dir):
    return _parsed(spark, sf_dir, text(F.col("p_type"), " ", F.col("p_partkey") % 700, "个装"))


@query("""select p_partkey as k, case when p_partkey % 3 = 0 then p_size * 10.0::double when p_size % 2 = 0 and p_partkey % 3 = 1 then p_size * 1000.0::double else p_size * 50.0::double end as total from part""")
def spec_priority(spark, sf_dir):
    field = F.when(F.col("k") % 3 == 0, text(F.col("p_size"), "cl")).when((F.col("k") % 3 == 1) & (F.col("p_size") % 2 == 0), text(F.col("p_size"), "kg")).otherwise("0g")
    s = part(spark, sf_dir).select("k", X.normalize_text(text(F.col("p_size"), "两")).alias("t"), X.normalize_text(field).alias("f"))
    return s.select("k", S.parse_spec(F.col("t"), F.col("f"))["total_base"].alias("total"))


@query("""select p_partkey as k, case when p_partkey % 6 = 0 then printf('%g', q) || 'g' else printf('%g', q) || 'g×' || (p_partkey % 6 + 1) || ' (合计' || printf('%g', q * (p_partkey % 6 + 1)) || 'g)' end as d
  from (select p_partkey, (p_size * 7)::double * 0.001::double as q from part)""")
def spec_display(spark, sf_dir):
    s = part(spark, sf_dir).select("k", X.normalize_text(text(F.col("p_size") * 7, "mg*", pieces())).alias("t"))
    return s.select("k", S.parse_spec(F.col("t")).alias("s")).select("k", S.spec_display(F.col("s")).alias("d"))


@query("""select p_partkey as k, case when p_partkey % 3 = 0 then p_retailprice / (p_size * 10.0) * 100 when p_partkey % 3 = 1 then p_retailprice / p_size end as unit_price,
  case when p_partkey % 3 = 0 then '元/100g' when p_partkey % 3 = 1 then '元/件' else '—' end as label from part""".replace("p_retailprice / (p_size * 10.0) * 100", "round(p_retailprice / (p_size * 10.0) * 100, 6)").replace("p_retailprice / p_size end", "round(p_retailprice / p_size, 6) end"))
def unit_price(spark, sf_dir):
    title = F.when(F.col("k") % 3 == 0, text(grams(), "g")).when(F.col("k") % 3 == 1, text(F.col("p_size"), "件")).otherwise("无")
    s = part(spark, sf_dir).select("k", "p_retailprice", S.parse_spec(title).alias("s"))
    return s.select("k", F.round(S.unit_price(F.col("p_retailprice"), F.col("s")), 6).alias("unit_price"), S.unit_price_label(F.col("s")).alias("label"))


@query("""select p_partkey as k, trim(regexp_replace(replace(lower(p_name), 'x', ' '), ' +', ' ', 'g')) || ' 水' as s from part""")
def clean_title(spark, sf_dir):
    title = text("【自营】", F.col("p_name"), "！ ", grams(), "G*", pieces(), "瓶 水（第", F.col("p_size"), "批）满99减9 官方 ", F.col("p_size"), "袋")
    return part(spark, sf_dir).select("k", X.clean_title(X.normalize_text(title)).alias("s"))


_BRANDS = ["农夫山泉", "三只松鼠", "金典", "President", "某牌", "可口可乐"]


@query("""select p_partkey as k, case when p_partkey % 4 = 0 then p_brand else case p_partkey % 6 when 0 then '农夫山泉' when 1 then '三只松鼠' when 2 then '金典' when 3 then 'President' when 4 then '百事可乐' else '可口可乐' end end as brand from part""")
def extract_brand(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(b) for b in _BRANDS]), (F.col("k") % 6 + 1).cast("int"))
    declared = F.when(F.col("k") % 4 == 0, text(" ", F.col("p_brand"), " ")).otherwise(" ")
    return part(spark, sf_dir).select("k", X.extract_brand(X.normalize_text(text(F.col("p_size"), word, "食品 百事可乐")), declared).alias("brand"))


@query("""select p_partkey as k, case p_partkey % 5 when 0 then '面条' when 1 then '肉类' when 2 then '牛奶' when 3 then p_type else '' end as category from part""")
def extract_category(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in ("牛肉面牛肉", "牛肉", "纯牛奶", "牛奶", "礼盒")]), (F.col("k") % 5 + 1).cast("int"))
    declared = F.when(F.col("k") % 5 == 3, F.col("p_type")).otherwise("")
    return part(spark, sf_dir).select("k", X.extract_category(X.normalize_text(text(F.col("p_name"), word)), declared).alias("category"))


@query("""select p_partkey as k, p_partkey % 4 in (1, 2) and p_size % 4 in (1, 2) and p_partkey % 4 <> p_size % 4 as conflict from part""")
def variant_conflict(spark, sf_dir):
    word = lambda c: F.when(c % 4 == 0, "").when(c % 4 == 1, "香辣 袋装").when(c % 4 == 2, "红烧 桶装").otherwise("有机 罐装")
    a, b = (X.extract_variants(X.normalize_text(text(F.col("p_name"), word(F.col(c))))) for c in ("p_partkey", "p_size"))
    return part(spark, sf_dir).select("k", a.alias("a"), b.alias("b")).select("k", X.variant_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("""select k, case when a = b then '' when a <> '' and b <> '' then '产品线不同（' || a || ' vs ' || b || '）' else '仅一方标注产品线（' || a || b || '）' end as mismatch
  from (select p_partkey as k, case p_partkey % 3 when 0 then '' when 1 then '特仑苏' else '茶π' end as a, case p_size % 3 when 0 then '' when 1 then '特仑苏' else '茶π' end as b from part)""")
def product_line_mismatch(spark, sf_dir):
    word = lambda c: F.when(c % 3 == 0, "").when(c % 3 == 1, "特仑苏").otherwise("茶π")
    a, b = (X.extract_product_line(X.normalize_text(text(F.col("p_name"), " ", word(F.col(c)), " 奶"))) for c in ("p_partkey", "p_size"))
    return part(spark, sf_dir).select("k", a.alias("a"), b.alias("b")).select("k", X.line_mismatch(F.col("a"), F.col("b")).alias("mismatch"))


# ---------------------------------------------------------------- similarity


def _titles(spark, sf_dir) -> DataFrame:
    """The distinct titles that meet in a pool of candidates."""
    own, rivals = K.sides(spark, sf_dir)
    return J.title_pairs(J.with_platforms(own, rivals), rivals).select(F.col("s_title").alias("a"), F.col("r_title").alias("b")).distinct()


#: Those titles in SQL.
MET = "met as (select distinct a, b from (select distinct norm as a, category from own) o join (select distinct norm as b, category from rivals) r on r.category = '' or r.category = o.category)"


@query(over(OWN, RIVALS, RATIOS, MET) + "select a, b, round(bigrams, 6) as s from scores join met using (a, b)")
def bigram_jaccard(spark, sf_dir):
    return _titles(spark, sf_dir).select("a", "b", F.round(M.bigram_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@query(over(OWN, RIVALS, RATIOS, MET) + "select a, b, round(sort_ratio, 6) as s from scores join met using (a, b)")
def token_sort_ratio(spark, sf_dir):
    return _titles(spark, sf_dir).select("a", "b", F.round(M.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("s"))


@query(over(OWN, RIVALS, RATIOS, MET) + "select a, b, round(set_ratio, 6) as s from scores join met using (a, b)")
def token_set_ratio(spark, sf_dir):
    return _titles(spark, sf_dir).select("a", "b", F.round(M.token_set_ratio(F.col("a"), F.col("b")), 6).alias("s"))


@query(over(OWN, RIVALS, RATIOS, MET) + "select a, b, round(set_ratio, 6) as s from scores join met using (a, b)")
def token_set_ratio_arrow(spark, sf_dir):
    return _titles(spark, sf_dir).select("a", "b", F.round(M.token_set_ratio_arrow(F.col("a"), F.col("b")), 6).alias("s"))


@query(over(OWN, RIVALS) + "select o.ord as k, r.platform, round(case when greatest(o.total, r.total) / least(o.total, r.total) <= 1.05 then 0 else least(12.0, (greatest(o.total, r.total) / least(o.total, r.total) - 1) / 3 * 12) end, 6) as penalty from own o join rivals r on r.ord = o.ord")
def spec_penalty(spark, sf_dir):
    own, rivals = K.sides(spark, sf_dir)
    both = own.select("ord", F.col("spec").alias("a")).join(rivals.select("ord", "platform", F.col("spec").alias("b")), "ord")
    return both.select(F.col("ord").alias("k"), "platform", F.round(M.spec_penalty(F.col("a"), F.col("b"), 12.0), 6).alias("penalty"))


# ---------------------------------------------------------------- rows, dedup, keys


@query("select n_nationkey::varchar as sku_id, n_name as title, r_name as brand, n_regionkey::varchar as extra_region from nation join region on n_regionkey = r_regionkey")
def alias_projection(spark, sf_dir):
    n, r = K.table(spark, sf_dir, "nation"), K.table(spark, sf_dir, "region")
    raw = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias(" 商品 ID "), F.col("n_regionkey").alias("品名"), F.col("n_name").alias("Title"), F.col("r_name").alias("品牌"), F.col("n_regionkey").alias("region"))
    return R.project_aliases(raw).select("sku_id", "title", "brand", F.element_at("extra", "region").alias("extra_region"))


@query("select p_partkey as k from part where p_partkey % 4 in (1, 2)")
def required_filter(spark, sf_dir):
    raw = part(spark, sf_dir).select("k", F.when(F.col("k") % 4 == 0, "-").otherwise(F.col("k").cast("string")).alias("sku_id"), F.when(F.col("k") % 4 == 3, " NULL ").otherwise(F.col("p_name")).alias("title"))
    return raw.filter(R.has_required()).select("k")


@query("select o_custkey as custkey, min(o_orderkey) as first_order from orders group by o_custkey")
def sku_dedup(spark, sf_dir):
    return R.first_by_order(K.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("first_order"))


@query("""select event_id, case when event_id % 3 = 0 then user_id::varchar when event_id % 3 = 1 then 'auto-' || substr(sha1('http://e/' || user_id), 1, 12) else 'auto-' || substr(sha1(event_type), 1, 12) end as sku from events""")
def derive_sku(spark, sf_dir):
    n = F.col("event_id") % 3
    sku = F.when(n == 0, F.col("user_id").cast("string")).otherwise("none")
    url = F.when(n < 2, text("http://e/", F.col("user_id"))).otherwise(" ")
    return K.table(spark, sf_dir, "events").select("event_id", R.derive_sku(sku, url, F.col("event_type")).alias("sku"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as v from events""")
def json_path(spark, sf_dir):
    return K.table(spark, sf_dir, "events").select("event_id", at_path(F.col("props"), "k").cast("long").alias("v"))


@query(over(OWN, RIVALS) + "select 'self' as platform, count(*) as products from own union all select platform, count(*) from rivals group by platform")
def platform_counts(spark, sf_dir):
    return R.platform_counts(K.products(spark, sf_dir))


@query(over(OWN, RIVALS) + "select 'self' as platform, ord, norm, round(total, 6) as total, category, round(price, 6) as price, round(unit_price, 6) as unit_price from own union all select platform, ord, norm, round(total, 6), category, round(price, 6), round(unit_price, 6) from rivals")
def products(spark, sf_dir):
    return K.products(spark, sf_dir).select("platform", "ord", F.col("norm_title").alias("norm"), F.round("spec.total_base", 6).alias("total"), "category", six("price"), six("unit_price"))


@query("select count(*) as total, count(*) as parsed, 1.0::double as parse_rate from part")
def parse_rate(spark, sf_dir):
    return R.parse_rate(K.sides(spark, sf_dir)[0])


# ---------------------------------------------------------------- matching


def _pending(spark, sf_dir):
    own, rivals = K.sides(spark, sf_dir)
    return J.with_platforms(own, rivals), rivals


@query(over(OWN, RIVALS, BY_BARCODE) + "select self_uid, platform, rival_uid from by_barcode")
def barcode_join(spark, sf_dir):
    return J.match_barcode(*_pending(spark, sf_dir)).select("self_uid", "platform", "rival_uid")


@query(over(OWN, RIVALS, RATIOS, BY_BARCODE.replace("o.barcode <> ''", "false"), BY_BRAND) + "select self_uid, platform, rival_uid from by_brand")
def brand_spec_join(spark, sf_dir):
    return J.match_brand_spec(*_pending(spark, sf_dir)).select("self_uid", "platform", "rival_uid")


@query(over(OWN, RIVALS, PLATFORMS, BY_BARCODE) + "select o.uid as self_uid, p.platform from own o, platforms p where not exists (select 1 from by_barcode x where x.self_uid = o.uid and x.platform = p.platform)")
def cascade_anti(spark, sf_dir):
    pending, rivals = _pending(spark, sf_dir)
    return pending.join(J.match_barcode(pending, rivals), ["self_uid", "platform"], "left_anti").select("self_uid", "platform")


@query(over(OWN, RIVALS, RATIOS, PLATFORMS, "pending as (select o.*, p.platform, p.platform_ord from own o, platforms p)", RECALL) + "select self_uid, platform, rank, rival_uid, round(score, 6) as score from ranked where rank <= 5")
def fuzzy_recall_topk(spark, sf_dir):
    return J.recall(*_pending(spark, sf_dir)).select("self_uid", "platform", F.col("rank").cast("long").alias("rank"), "rival_uid", six("score"))


@query("select p_partkey as k, case when p_size * 2 >= 88 then 'accept' when p_size * 2 < 55 then 'reject' else 'gray' end as way from part")
def route_thresholds(spark, sf_dir):
    return part(spark, sf_dir).select("k", J.route(F.col("p_size") * 2.0).alias("way"))


@query(over(MATCH) + "select self_uid, platform, rival_uid, round(score, 6) as score, level, round(confidence, 6) as confidence, need_review from pairs")
def verdict_join(spark, sf_dir):
    return K.pairs(spark, sf_dir).select("self_uid", "platform", "rival_uid", six("score"), "level", six("confidence"), "need_review")


@query(over(MATCH) + """select platform, count(*) as total, count(*) filter (where rival_uid is not null and level = 'L1-条码') as barcode, count(*) filter (where rival_uid is not null and level = 'L1-品牌规格') as brand_spec,
  count(*) filter (where rival_uid is not null and level = 'L2-模糊') as fuzzy, count(*) filter (where rival_uid is not null and level = 'L3-AI判定') as judged, count(*) filter (where rival_uid is null) as unmatched, count(*) filter (where need_review) as need_review from pairs group by platform""")
def match_stats(spark, sf_dir):
    return J.match_stats(K.pairs(spark, sf_dir))


# ---------------------------------------------------------------- comparison and report

_BENCH = "select uid, benchmark_platform, round(benchmark_price, 6) as benchmark_price, round(benchmark_unit_price, 6) as benchmark_unit_price, round(diff, 6) as diff, round(diff_rate, 6) as diff_rate, action from final"


def _bench(rows: DataFrame) -> DataFrame:
    return rows.select("uid", "benchmark_platform", six("benchmark_price"), six("benchmark_unit_price"), six("diff"), six("diff_rate"), "action")


@query(ROWS + _BENCH)
def benchmark_min(spark, sf_dir):
    return _bench(K.rows(spark, sf_dir))


@query(over(MATCH, compared("avg")) + _BENCH)
def benchmark_avg(spark, sf_dir):
    return _bench(K.rows(spark, sf_dir, "avg"))


@query(over(MATCH, compared("p1")) + _BENCH)
def benchmark_named(spark, sf_dir):
    return _bench(K.rows(spark, sf_dir, "p1"))


@query(ROWS + "select uid, benchmark_platform <> '' as comparable, notes from final")
def compare_rows(spark, sf_dir):
    return K.rows(spark, sf_dir).select("uid", "comparable", F.array_join("notes", "；").alias("notes"))


@query("select p_partkey as k, case when p_size = 50 then '数据不足' when (p_size - 25) / 100.0::double >= 0.15 then '建议降价(高优)' when (p_size - 25) / 100.0::double >= 0.05 then '建议降价' when (p_size - 25) / 100.0::double <= -0.10 then '有提价空间' else '持平/关注' end as action from part")
def decide_action(spark, sf_dir):
    rate = F.when(F.col("p_size") < 50, (F.col("p_size") - 25) / 100.0)
    return part(spark, sf_dir).select("k", P.decide_action(rate).alias("action"))


@query(ROWS + "select count(*) as total, count(*) filter (where hit) as matched, count(diff_rate) as priced, count(*) filter (where diff_rate > 0) as higher, count(*) filter (where diff_rate < 0) as lower, count(*) filter (where notes = '存在待复核的匹配关系') as need_review, round(avg(diff_rate), 6) as avg_diff_rate, round(count(*) filter (where hit) / count(*), 6) as match_rate from final")
def kpi_summary(spark, sf_dir):
    return O.kpi_summary(K.rows(spark, sf_dir)).select("total", "matched", "priced", "higher", "lower", "need_review", six("avg_diff_rate"), six("match_rate"))


@query(ROWS + "select action, count(*) as n from final group by action")
def action_counts(spark, sf_dir):
    return O.action_counts(K.rows(spark, sf_dir))


@query(over(MATCH) + """select k.key, k.name, coalesce(count(p.self_uid), 0) as total, count(p.rival_uid) as matched, round(avg((o.unit_price - r.unit_price) / r.unit_price), 6) as avg_diff_rate
  from (values ('p0', 'P0'), ('p1', 'P1'), ('p2', 'P2'), ('p3', 'P3'), ('p9', 'P9')) k(key, name) left join pairs p on p.platform = k.key left join own o on o.uid = p.self_uid left join rivals r on r.uid = p.rival_uid group by k.key, k.name""")
def platform_summary(spark, sf_dir):
    names = spark.createDataFrame([*K.PLATFORMS, ("p9", "P9")], "key string, name string")
    return O.platform_summary(K.rows(spark, sf_dir), names).select("key", "name", "total", "matched", six("avg_diff_rate"))


_BIN = "case when diff_rate < -0.30 then 0 when diff_rate < -0.15 then 1 when diff_rate < -0.05 then 2 when diff_rate < 0.05 then 3 when diff_rate < 0.15 then 4 when diff_rate < 0.30 then 5 else 6 end"


@query(ROWS + f"select b::int as bin, count(uid) as n from range(7) t(b) left join (select uid, {_BIN} as bin from final where diff_rate is not null) x on x.bin = b group by b")
def diff_histogram(spark, sf_dir):
    return O.diff_histogram(K.rows(spark, sf_dir)).select("bin", "n")


@query(ROWS + "select uid, round(diff_rate, 6) as diff_rate from final where diff_rate is not null order by round(diff_rate, 9) desc, ord limit 20")
def top_n(spark, sf_dir):
    return O.top_gaps(K.rows(spark, sf_dir).withColumn("diff_rate", F.round("diff_rate", 9)), 20).select("uid", six("diff_rate"))


@query(ROWS + """select o.ord::varchar as sku, o.title, p.platform, case when p.rival_uid is null then '（判定为不匹配）' else r.title end as rival, p.level, round(p.score, 1) as score, round(p.confidence, 2) as sure from pairs p join own o on o.uid = p.self_uid left join rivals r on r.uid = p.rival_uid where p.need_review""")
def review_export(spark, sf_dir):
    r = O.review_rows(K.rows(spark, sf_dir))
    return r.select(*[F.col(c).alias(n) for c, n in {"我方SKU": "sku", "我方商品": "title", "竞品平台": "platform", "竞品商品": "rival", "匹配层级": "level", "相似度": "score", "置信度": "sure"}.items()])


@query(ROWS + """select o.ord::varchar as sku_id, k.key as platform, coalesce(p.rival_uid is not null, false) as matched, round(r.price, 6) as price, p.level as level
  from own o cross join (values ('p0'), ('p1'), ('p2'), ('p3'), ('p9')) k(key) left join pairs p on p.self_uid = o.uid and p.platform = k.key left join rivals r on r.uid = p.rival_uid""".replace("p.level as level", "case when p.rival_uid is not null then p.level end as level"))
def row_payload(spark, sf_dir):
    rows = O.row_payload(K.rows(spark, sf_dir), [(k, k) for k, _ in K.PLATFORMS] + [("p9", "p9")])
    return rows.select("sku_id", F.explode("rivals").alias("r")).select("sku_id", F.col("r.name").alias("platform"), "r.matched", F.round("r.price", 6).alias("price"), "r.level")


@query(ROWS + "select uid from final where contains(lower(title || ' ' || brand), 'ring') and action = '建议降价' and category = 'SMALL'")
def report_filter(spark, sf_dir):
    return O.filter_rows(K.rows(spark, sf_dir), "RING", C.CUT, "SMALL").select("uid")


@query("select distinct p_type as category from part")
def categories(spark, sf_dir):
    return O.categories(K.sides(spark, sf_dir)[0])


@query(ROWS + """select f.uid, f.action, f.benchmark_platform, round(f.diff_rate, 6) as diff_rate, count(p.rival_uid) as matched, round(max(p.score), 6) as best_score
  from final f left join pairs p on p.self_uid = f.uid group by f.uid, f.action, f.benchmark_platform, f.diff_rate""")
def end_to_end_compare(spark, sf_dir):
    hits = F.filter("pairs", lambda p: p["rival_uid"].isNotNull())
    best = F.array_max(F.transform("pairs", lambda p: p["score"]))
    return K.rows(spark, sf_dir).select("uid", "action", "benchmark_platform", six("diff_rate"), F.size(hits).cast("long").alias("matched"), F.round(best, 6).alias("best_score"))
