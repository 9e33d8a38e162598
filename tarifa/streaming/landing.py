"""The landing directory as a stream: pushed JSON files to products, once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..lexicon import DEFAULT, Lexicon
from ..operators.products import to_products
from ..schemas import RAW_FIELDS


def stream_files(spark: SparkSession, folder: str, archive_to: str | None = None, max_files: int = 1000) -> DataFrame:
    """(path, at, record): one row per object of every new file. Read files are archived by the
    source, one batch later."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*_*.json")
    if archive_to:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_to)
    files = reader.load(folder).select("value", F.col("_metadata.file_path").alias("path"))
    array = F.when(F.ltrim("value").startswith("{"), F.get_json_object("value", "$.items")).otherwise(F.col("value"))
    return files.select("path", F.posexplode(F.from_json(array, "array<map<string,string>>")).alias("at", "record"))


def to_raw(rows: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Records under standard field names; the platform is the file name up to its last stamp parts."""
    name = F.element_at(F.split("path", "/"), -1)
    alias = lambda field: F.coalesce(*[F.element_at("record", a) for a in lexicon.aliases[field]])
    platform = F.regexp_extract(name, r"^(.+?)_(?:cloud-.*_)?\d{8}_\d{6}(?:_\d+)?\.json$", 1)
    platform = F.when(platform != "", platform).otherwise(F.regexp_extract(name, "^([^_]+)_", 1))
    return rows.select(platform.alias("platform"), F.lit(0).alias("platform_ord"), "path", "at", *[alias(f).alias(f) for f in RAW_FIELDS])


def _first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of a product that hasn't been seen; its key is the state."""
    if state.exists:
        return
    rows = pd.concat(list(frames), ignore_index=True)  # a product's rows in the files of one batch
    state.update((True,))
    yield rows.sort_values(["path", "at"], kind="stable").head(1).drop(columns="_sku")


def first_rows(raw: DataFrame) -> DataFrame:
    """The first usable row of each platform and product id, over all batches: of a batch the first in order of file
    and row, and none of a product that an earlier batch had. What has been seen is state in the checkpoint."""
    keyed = raw.withColumn("_sku", X.clean_str(F.col("sku_id")))
    usable = keyed.filter((F.col("_sku") != "") & (X.clean_str(F.col("title")) != ""))
    return usable.groupBy("platform", "_sku").applyInPandasWithState(_first, raw.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], archive_to: str | None = None, once: bool = False) -> StreamingQuery:
    """Calls ``sink`` with the products of each batch. The first of a product wins, in order of batch, file and
    row; a sink that must not see a batch twice keeps the batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        # files of a batch are few; rows keep their order within a file
        index = rows.select("path").distinct().withColumn("f", F.row_number().over(W.orderBy("path")).cast("long"))
        raw = rows.join(index, "path").withColumn("ord", F.col("f") * (1 << 40) + F.col("at")).drop("f")
        sink(to_products(raw.drop("path", "at")), number)

    firsts = first_rows(to_raw(stream_files(spark, folder, archive_to)))
    query = firsts.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
