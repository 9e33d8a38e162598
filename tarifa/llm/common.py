"""Shared pieces: scratch tables, chunked row blobs and vectorised word hashing.

Scratch tables live under ``spark.checkpoint.dir``, which the cluster names, so that every
executor sees them and a lost executor only costs a re-read. Only a session on one machine
may leave it unset. ``released`` deletes the scratch tables of work whose result is written.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import math
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 4 << 20
#: What one range of the hash space, held in memory by one task, receives at most on average.
RANGE_BYTES = 32 << 20

_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarifa-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def released(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes, at the end, the scratch tables written inside, but for those of the names in
    ``keep``: nothing that's used later may read the others."""
    outer, made = _made.get(), []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for path in made:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(texts: DataFrame, column: str, factor: float) -> int:
    """Into how many ranges to divide the hash space: at least the session's shuffle partitions,
    and so many that none receives more than RANGE_BYTES on average, if every byte of text
    sends ``factor`` bytes."""
    size = texts.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), math.ceil(size * factor / RANGE_BYTES))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with an underscore for each column of the user's that has it already."""
    own = {x.lower() for x in taken}
    while name.lower() in own:
        name += "_"
    return name


def with_row_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table with an id of each row's own, and that column's name. Null and repeated
    document ids then don't matter, and every pass reads the same rows."""
    name = free_name("row_id", df.columns)
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- words and hashes

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing: digits, a-z and every byte of a non-ASCII character are word bytes.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_BYTE_KEYS = np.random.PCG64(20240229).random_raw(256)


@functools.lru_cache(maxsize=4)
def _place_keys(size: int) -> np.ndarray:
    return np.random.PCG64(77003).random_raw(size) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = (h ^ (h >> U64(31))) * U64(0x9FB21C651E98DF25)
    h = (h ^ (h >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n+1 offsets of each row's words."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside[1:-1] & (~inside[:-2] | cut[:-1])
    last = inside[1:-1] & (~inside[2:] | cut[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of the bytes of each word, computed in bounded slices."""
    out = np.empty(len(starts), U64)
    step, at = 1 << 20, 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step)))
        s, e = starts[at:to], ends[at:to]
        size = e - s
        base = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(base[-1]) - np.repeat(base[:-1], size)
        keys = _place_keys(1 << max(8, int(size.max()).bit_length()))
        value = _BYTE_KEYS[raw[place + np.repeat(s, size)]] * keys[place]
        out[at:to] = mix(np.add.reduceat(value, base[:-1]) + size.astype(U64))
        at = to
    return out


_BASE = 0x9E3779B97F4A7C15 | 5


@functools.lru_cache(maxsize=8)
def _powers(size: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    p = np.full(size, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every run of ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    size = 1 << max(10, n.bit_length())
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * _powers(size, False)[:n])])
    return mix((total[width:] - total[:-width]) * _powers(size, True)[: n - width + 1])


# --------------------------------------------------------------- chunks of rows


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` bytes of text; a longer single text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def chunk_bytes(buckets: int) -> int:
    """Larger chunks where there are many ranges to send to, so that runs stay long: 4 to 16 MB."""
    return min(16 << 20, max(CHUNK_BYTES, buckets << 16))


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema))
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def chunk_key(partition: int, ordinal: int, ids: np.ndarray, text: pa.Array) -> str:
    """Names a chunk by place and by content, so that a second pass over the same rows finds it."""
    return f"{partition}-{ordinal}-{zlib.crc32(text_bytes(text)[0], zlib.crc32(ids.tobytes())):08x}"


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed planes of the bytes of their differences."""
    step = np.diff(values, prepend=U64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def squeeze_small(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze_small(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the hash space begins and ends in a sorted array."""
    inner = [U64((k << 64) // buckets) for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(sorted_hashes, np.array(inner, U64)), [len(sorted_hashes)]]).astype(np.int64)
