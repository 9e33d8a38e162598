"""Intermediate results as tables in the shared folder.

A plan that reads an intermediate result several times would compute it as often, and its
tree would grow with every stage. A table cuts both, and a lost executor only re-reads.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

#: Memory that rows of a table take for a byte of its files, in which equal values are kept once: 39 and 41 were measured.
PACKED = 40
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session on one machine may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarifa-tables-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def unpacked(spark: SparkSession) -> Iterator[None]:
    """Inside, joins judge tables by the memory of their rows. By the size of files Spark would send a table of
    10 MB, which is 400 MB of rows, whole through the driver to all tasks."""
    name = "spark.sql.sources.fileCompressionFactor"
    given = spark.conf.get(name)
    spark.conf.set(name, str(max(float(given), PACKED)))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with unpacked(df.sparkSession):
        df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that were cut inside: for work whose results are written elsewhere by then."""
    before = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(before)
        for path in made:
            files.remove(spark, path)


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """The rows dealt by ``keys`` over as many partitions as the session shuffles into, or ``least``. For work that
    costs much time a byte: adaptive coalescing goes by bytes and would leave it to a few cores."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
