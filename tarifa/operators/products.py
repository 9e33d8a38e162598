"""Raw rows to products: cleaning, required values, first-wins dedup, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spec as S
from ..functions import text as X
from ..functions.titles import read_column
from ..lexicon import DEFAULT, REQUIRED, Lexicon
from ..schemas import RAW_FIELDS
from .tables import spread

_PLACE = ("platform", "platform_name", "platform_ord", "ord")


def project_aliases(raw: DataFrame, lexicon: Lexicon = DEFAULT, keep: tuple[str, ...] = _PLACE) -> DataFrame:
    """Columns under their standard names; of several for one field the last wins; others go to ``extra``."""
    of = {c: lexicon.field_of(c) for c in raw.columns if c not in keep}
    last = {f: c for c, f in of.items() if f}
    rest = [c for c, f in of.items() if not f]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    return raw.select(*[c for c in keep if c in raw.columns], *[F.col(f"`{c}`").cast("string").alias(f) for f, c in last.items()], extra.alias("extra"))


def missing_required(columns: list[str]) -> list[str]:
    return sorted(set(REQUIRED) - set(columns))


def has_required() -> Column:
    """The filter for rows with a product id and a title."""
    return ~X.is_blank(F.col("sku_id")) & ~X.is_blank(F.col("title"))


def usable_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"), F.count_if(has_required()).alias("usable"))


def first_by_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: only the smallest order travels, not all rows of the key."""
    place = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(place)).filter("_nth = 1").drop("_nth")


def to_products(raw: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Typed products, one per platform and sku_id (the first by ``ord``), with derived columns.

    ``raw``: platform, platform_ord, ord, and any of the standard fields as text."""
    have = set(raw.columns)
    text = [f for f in RAW_FIELDS if f not in ("price", "origin_price")]
    cols = {f: X.clean_str(F.col(f)) if f in have else F.lit("") for f in text}
    prices = {f: X.parse_price(F.col(f)) if f in have else F.lit(None).cast("double") for f in ("price", "origin_price")}
    name = F.col("platform_name") if "platform_name" in have else F.col("platform")
    extra = F.col("extra") if "extra" in have else F.create_map().cast("map<string,string>")
    rows = raw.filter(has_required() if have.issuperset(("sku_id", "title")) else F.lit(False)).select("platform", name.alias("platform_name"), F.col("platform_ord").cast("int").alias("platform_ord"), F.col("ord").cast("long").alias("ord"), *[c.alias(f) for f, c in (cols | prices).items()], extra.alias("extra"))
    keys = ["platform", "sku_id"]  # rows are dealt once, for the dedup and for parsing
    return enrich(first_by_order(spread(rows, *keys), keys, ["ord"]), lexicon)


def enrich(products: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Specification, normalised title, brand, category, unit price, variants and product line."""
    out = products.withColumn("_r", read_column(F.col("title"), F.col("spec_text"), lexicon))
    of = lambda name: F.col(f"_r.{name}")
    out = out.withColumns(
        {
            "spec": of("spec"),
            "norm_title": of("norm_title"),
            "brand": X.declared_or(F.col("brand"), of("brand")),
            "category": X.declared_or(F.col("category"), of("category")),
            "variants": of("variants"),
            "line": of("line"),
        }
    )
    out = out.withColumns({"unit_price": S.unit_price(F.col("price"), F.col("spec")), "uid": F.concat_ws(":", "platform", "sku_id")})
    return out.drop("_r")


def parse_rate(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("total"), F.count_if(S.is_parsed(F.col("spec"))).alias("parsed"), F.avg(S.is_parsed(F.col("spec")).cast("double")).alias("parse_rate"))


def platform_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("platform").agg(F.count("*").alias("products"))


def derive_sku(sku: Column, url: Column, title: Column) -> Column:
    """A stable id from the link or the title where none is given."""
    own, link, name = (X.clean_str(c) for c in (sku, url, title))
    basis = F.when(link != "", link).otherwise(name)
    return F.when(own != "", own).when(basis != "", F.concat(F.lit("auto-"), F.substring(F.sha1(basis), 1, 12))).otherwise("")
