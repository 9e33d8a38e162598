"""Products made of the driver tables, and the whole comparison over them.

Own products are parts; each fourth of the suppliers is a rival platform that offers the
parts it has shipped, under other spellings of title and specification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as P
from ..operators import matching as M
from ..operators.products import to_products
from ..operators.tables import cut
from ..schemas import SELF

PLATFORMS = [("p0", "P0"), ("p1", "P1"), ("p2", "P2"), ("p3", "P3")]
CONFIG = M.MatchConfig(judge="verdicts")
_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> F.Column:
    return F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])


def pieces() -> F.Column:
    return F.col("p_partkey") % 6 + 1


def grams() -> F.Column:
    return F.col("p_size") * 10


def own_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 7 == 0, text("69", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise("")
    return p.select(F.lit(SELF).alias("platform"), F.lit(0).alias("platform_ord"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("sku_id"), text(F.col("p_name"), " ", grams(), "g*", pieces()).alias("title"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), code.alias("barcode"))


def rival_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer per platform and part it has shipped, at 85 to 120 per cent of the retail price."""
    offers = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("k"), "l_partkey").distinct()
    p = offers.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.split("p_name", " ")
    code = F.when(F.col("p_partkey") % 14 == 0, text("69", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise(" nan ")
    amount = F.when(F.col("k") == 3, grams() * 2).otherwise(grams())
    return p.select(text("p", F.col("k")).alias("platform"), (F.col("k") + 1).alias("platform_ord"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("sku_id"), text(words[1], " ", words[0], "【自营】", amount, "克*", pieces(), "袋").alias("title"), F.concat(F.lit("¥"), (F.floor(F.col("p_retailprice") * (85 + 5 * ((F.col("p_partkey") + 3 * F.col("k")) % 8))) / 100).cast("string")).alias("price"), F.when(F.col("k") == 2, "").otherwise(F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_type")).alias("category"), code.alias("barcode"))


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table made once in a session and read by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = cut(make(), name)
    return _tables[key]


def forget() -> None:
    """Lets the next query make its tables again, as a benchmark wants."""
    _tables.clear()


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of all platforms: each text is parsed once."""
    return _kept(spark, sf_dir, "products", lambda: to_products(own_raw(spark, sf_dir).unionByName(rival_raw(spark, sf_dir))))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = products(spark, sf_dir)
    return p.filter(F.col("platform") == SELF), p.filter(F.col("platform") != SELF)


def verdicts(own: DataFrame) -> DataFrame:
    """Stands for an external judge: every third product has a verdict on each platform."""
    n = F.col("ord")
    every = F.explode(F.array(*[F.lit(k) for k, _ in PLATFORMS])).alias("platform")
    return own.filter(n % 3 < 2).select(F.col("uid").alias("self_uid"), every, (n % 3 == 0).alias("is_match"), F.when(n % 2 == 0, 0.9).otherwise(0.6).alias("confidence"), F.lit("v").alias("reason"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rivals = sides(spark, sf_dir)
    return _kept(spark, sf_dir, "pairs", lambda: M.match_all(own, rivals, CONFIG, verdicts(own)))


def rows(spark: SparkSession, sf_dir: str, benchmark: str = "min") -> DataFrame:
    own, rivals = sides(spark, sf_dir)
    return P.compare_rows(own, pairs(spark, sf_dir), rivals, P.CompareConfig(benchmark=benchmark))
