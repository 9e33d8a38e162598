"""Catalogue files in a landing directory: <platform>_<anything>.csv|xlsx|xls|json.

All files of all platforms are one scan: Spark lists and reads them as binary rows, wherever its
file systems reach, and tasks parse whole files, map their headers and number their rows. A file that can't be
used becomes a row that says why.
"""

from __future__ import annotations

import csv
import io
import json
import logging
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lexicon import DEFAULT, Lexicon
from ..operators.products import missing_required, to_products
from ..operators.tables import cut
from ..schemas import RAW_FIELDS
from . import files as S

log = logging.getLogger(__name__)
SUFFIXES = (".csv", ".xlsx", ".xls", ".json")
ROWS_PER_BATCH = 10_000
#: Of the files that can't be used, so many are named in the log.
NAMED = 20


# ---------------------------------------------------------------- one file


def _csv_rows(content: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), strict=True)
    header = next(rows, [])

    def values() -> Iterator[list[str | None]]:
        for row in rows:
            if len(row) > len(header):
                raise ValueError(f"row {rows.line_num} has {len(row)} values, the header {len(header)}")
            if row:
                yield [v if v != "" else None for v in row] + [None] * (len(header) - len(row))

    return header, values()


def _json_rows(content: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    """An array of objects, or an object with ``items``; numbers keep their text."""
    data = json.loads(content.decode("utf-8-sig"), parse_float=str, parse_int=str)
    items = data.get("items") if isinstance(data, dict) else data
    items = items if isinstance(items, list) else []
    header = list(dict.fromkeys(k for item in items for k in item.keys()))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return header, ([text(item.get(k)) for k in header] for item in items)


def _excel_rows(content: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    import pandas as pd

    frame = pd.read_excel(io.BytesIO(content), dtype=str)
    return [str(c) for c in frame.columns], ([None if pd.isna(v) else v for v in row] for row in frame.itertuples(index=False))


def parse(name: str, content: bytes, lexicon: Lexicon = DEFAULT) -> list[tuple[dict[str, str | None], list[tuple[str, str | None]]]]:
    """(standard fields, other columns) of every row; ValueError tells why a file can't be used. Of several
    columns for one field the last wins."""
    read = _csv_rows if name.endswith(".csv") else _json_rows if name.endswith(".json") else _excel_rows
    header, rows = read(content)
    of = [lexicon.field_of(h) for h in header]
    if lacking := missing_required([f for f in of if f]):
        raise ValueError(f"lacks {', '.join(lacking)}")
    place = {f: k for k, f in enumerate(of) if f}
    rest = [k for k, f in enumerate(of) if not f]
    return [({f: row[k] for f, k in place.items()}, list({header[k]: row[k] for k in rest}.items())) for row in rows]


# ---------------------------------------------------------------- the directory

_OWN = [("path", pa.string()), ("platform", pa.string()), ("at", pa.int64()), ("problem", pa.string())]
_ROW = pa.schema([*_OWN, *((f, pa.string()) for f in RAW_FIELDS), ("extra", pa.map_(pa.string(), pa.string()))])
_DDL = "path string, platform string, at long, problem string, " + ", ".join(f"{f} string" for f in RAW_FIELDS) + ", extra map<string,string>"


def scan(spark: SparkSession, folder: str, platforms: list[tuple[str, str]], lexicon: Lexicon = DEFAULT, pattern: str = "*_*") -> DataFrame:
    """Rows of all files: path, platform, platform_name, platform_ord, ord (by file, then row), the standard
    fields, extra; and for each file one row with ``at`` -1, whose ``problem`` tells why it can't be used.

    A platform (key, name) whose key begins another's reads that one's files too."""
    keys = [k for k, _ in platforms]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                name = path.rsplit("/", 1)[-1]
                mine = [key for key in keys if name.startswith(f"{key}_")]
                if not mine:
                    continue
                try:
                    rows, problem = parse(name, content, lexicon), None
                except Exception as e:  # noqa: BLE001  a bad file doesn't stop the others
                    rows, problem = [], f"{type(e).__name__}: {e}"
                for key in mine:
                    yield pa.RecordBatch.from_pylist([{"path": path, "platform": key, "at": -1, "problem": problem}], schema=_ROW)
                    for at in range(0, len(rows), ROWS_PER_BATCH):
                        yield pa.RecordBatch.from_pylist([{"path": path, "platform": key, "at": at + j, **fields, "extra": extra} for j, (fields, extra) in enumerate(rows[at : at + ROWS_PER_BATCH])], schema=_ROW)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).filter(F.col("path").rlike(rf"({'|'.join(map(re.escape, SUFFIXES))})$"))
    known = spark.createDataFrame([(key, name or key, k) for k, (key, name) in enumerate(platforms)] or [("", "", 0)], "platform string, platform_name string, platform_ord int")
    rows = found.select("path", "content").mapInArrow(read, _DDL).join(F.broadcast(known), "platform")  # as few as configured
    # files are ordered by path; only their names take part in it
    order = found.select("path").withColumn("nth", F.row_number().over(W.partitionBy(F.regexp_extract("path", r"([^/_]*)_[^/]*$", 1)).orderBy("path")))
    place = F.shiftleft(F.col("nth").cast("long"), 36) + F.col("at")
    return rows.join(order, "path").withColumn("ord", place).drop("nth")


def rows_of(landed: DataFrame) -> DataFrame:
    return landed.filter("at >= 0").drop("path", "at", "problem")


def files_of(landed: DataFrame) -> DataFrame:
    """(path, platform, problem) of every file."""
    return landed.filter("at < 0").select("path", "platform", "problem")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One CSV or JSON file, or a folder of CSV files, with all columns under their own names, as text."""
    if path.endswith(".json"):
        rows = spark.read.options(multiLine=True, primitivesAsString=True, mode="FAILFAST").json(path)
        return rows.select(*[(F.to_json(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`")).alias(c) if t != "string" else F.col(f"`{c}`") for c, t in rows.dtypes])
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="FAILFAST", ignoreLeadingWhiteSpace=False).csv(path)


def archive(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Moves files that have been read to ``folder`` under a time stamp; a failure only warns."""
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    for path in dict.fromkeys(paths):
        stem, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
        try:
            S.move(spark, path, f"{folder}/{stem}__{stamp}.{suffix}")
        except OSError as e:
            log.warning("%s can't be archived: %s", path, e)


def collect(spark: SparkSession, folder: str, platforms: list[tuple[str, str]], archive_to: str | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame | None:
    """Products of all platforms (key, name) as one table; files are archived after they were read. None without a usable file."""
    if not S.exists(spark, folder):
        return None
    landed = cut(scan(spark, folder, platforms, lexicon), "landed")  # parsed once, and safe when the files go
    files = files_of(landed)
    bad = files.filter("problem is not null")
    for r in bad.orderBy("path").limit(NAMED).collect():
        log.error("%s can't be used: %s", r.path, r.problem)
    used = files.filter("problem is null")
    if used.isEmpty():
        return None
    products = to_products(rows_of(landed), lexicon)
    if archive_to:
        products = cut(products, "collected")
        archive(spark, [r.path for r in used.select("path").toLocalIterator()], archive_to)
    return products
