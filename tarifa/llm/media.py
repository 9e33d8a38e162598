"""Operator 7: media columns stored as content-defined chunks.

A payload (the text's bytes, zero-padded to a positive multiple of 64) becomes the samples of
an 8-bit mono WAV, and the WAV's bytes are stored. A gear hash over the last 32 bytes cuts
them into chunks wherever its masked bits are zero, so equal passages give equal chunks
wherever they stand. Documents are read in containers, one row each: distinct chunks, their digests,
and for each distinct medium the ordered list of its chunks.

Equal payloads are one medium, with the first container that has it as its home. Joined digests of
all homes tell which container owns a chunk, the first that needs it; then containers are sealed: each
keeps the bodies of the chunks it owns and no others, so the store holds every distinct chunk once, and
the unsealed containers are deleted. A chunk that other containers need is exported by its owner, joined to the
containers whose lists name it, and travels to them. Containers lie in tables bucketed by
their key, so joining lists and chunks to them moves no container. At its home each medium is put
together from its ordered list, a missing chunk is an error, and every rebuilt WAV is checked against the
digest taken before storing; all values come from its bytes. They are joined to the containers that
have the medium, then there to its documents, so a medium of very many documents is no hot key.

The containers' files lie in the shared folder; their tables leave the catalogue once their plan
is made.

Defined cases: null and empty texts are 64 zero bytes; repeated rows each get a row, null ids too; a text
of any length that a row can hold (2 GB) is one medium, within a WAV's 4 GB, and a container of its own if it is
longer than others; other columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ALIGN = 64
RATE = 8000
LEAST, MOST, MASK = 256, 8192, (1 << 10) - 1
DIGEST = 16
LEVEL = 9
_GEAR = (np.random.PCG64(424242).random_raw(256) >> np.uint64(32)).astype(np.uint32)


def payload(text: bytes) -> bytes:
    return text + b"\0" * (max(ALIGN, -(-len(text) // ALIGN) * ALIGN) - len(text))


def to_media(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[byte] << age over the last 32 bytes, by doubling."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    return h


def cuts(size: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of ``size`` bytes; ``marks``: sorted places where the hash allows a cut."""
    ends, start, k = [], 0, 0
    while size - start > LEAST:
        while k < len(marks) and marks[k] < start + LEAST:
            k += 1
        end = min(marks[k] if k < len(marks) else size, start + MOST, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunk_ends(data: bytes) -> list[int]:
    h = gear(np.frombuffer(data, np.uint8))
    return cuts(len(data), (np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1).tolist())


def describe(media: bytes) -> tuple[bytes, bytes, int, int, int, str]:
    """What a stored medium gives when read: its digest, payload digest and size, tail crc, stored size, feature."""
    samples = from_media(media)
    x = np.frombuffer(samples, np.uint8)
    loud = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    feature = f"samples={len(x)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};energy={int((x.astype(np.int64) ** 2).sum())};crossings={loud}"
    return hashlib.sha256(media).digest(), hashlib.sha256(samples).digest(), len(samples), zlib.crc32(samples[-ALIGN:]), len(media), feature


#: Digests travel as bytes and become hex at the end.
_RESULT = "media_id binary, payload_sha256 binary, payload_bytes long, tail_crc32 long, media_bytes long, feature string"
_RESULT_KINDS = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_RESULT_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


_LISTS = "cont long, blob binary, sizes array<int>, digests binary, media array<struct<id: binary, chunks: array<int>>>"


def _rebuilt(parts: list[bytes], media_id: bytes) -> tuple:
    found = describe(b"".join(parts))
    if found[0] != media_id:
        raise RuntimeError("a rebuilt medium differs from the one stored")
    return found


def _batch(rows: list[tuple], kinds, names) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Store:
    """Containers of chunked media, one row for each run of documents, in a bucketed table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        kind = docs.schema[id_col].dataType.simpleString()
        limit = C.chunk_bytes(C.shuffle_partitions(self.spark))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = TaskContext.get().partitionId()
            for k, batch in enumerate(C.chunks(batches, "t", limit)):
                yield _container(place << 18 | k, batch)

        docs_kind = f"array<struct<doc_id: {kind}, n_bytes: bigint, m: int>>"
        rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(fill, f"{_LISTS}, docs {docs_kind}")
        open_path, opened = self._stored(rows)
        # each medium's home is the least container that has it
        media = opened.select("cont", "digests", F.posexplode("media").alias("m", "x"))
        digests = F.transform("x.chunks", lambda c: F.substring("digests", c * DIGEST + 1, F.lit(DIGEST)))
        media = media.select(F.col("x.id").alias("media_id"), (F.shiftleft("cont", 20) + F.col("m")).alias("home"), digests.alias("digests"))
        home = media.groupBy("media_id").agg(F.min("home").alias("home"), F.first("digests").alias("digests"))
        self.home = C.written(home.select("home", "digests"), "media")
        used = self.home.select(F.shiftright("home", 20).alias("cont"), F.explode("digests").alias("digest")).distinct()
        # chunks that several containers need are owned by the least
        held = used.groupBy("digest").agg(F.min("cont").alias("at"), F.max("cont").alias("other")).filter("at <> other").select("digest", "at")
        self.shared = C.written(used.join(held, "digest").filter(F.col("cont") != F.col("at")), "shared-chunks")
        place = F.col("home").bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        self.local = self.home.groupBy(F.shiftright("home", 20).alias("cont")).agg(F.collect_set(place).alias("local"))
        foreign = self.shared.groupBy("cont").agg(F.collect_set("digest").alias("foreign"))

        def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _sealed(batch.slice(k, 1))

        lists = opened.join(self.local, "cont", "left").join(foreign, "cont", "left")
        columns = ["cont", "blob", "sizes", "digests", "media", "docs"]
        self.path, self.table = self._stored(lists.select(*columns, "local", "foreign").mapInArrow(seal, f"{_LISTS}, docs {docs_kind}, kept array<int>"))
        C.remove(self.spark, open_path)

    def _stored(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """A bucketed table of containers: its folder and its plan, which knows the files and their buckets."""
        name = f"media_{uuid.uuid4().hex}"
        path = f"{C.scratch_dir(self.spark)}/{name}"
        rows.write.format("parquet").option("path", path).bucketBy(C.shuffle_partitions(self.spark), "cont").saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return path, table

    def chunk_counts(self) -> DataFrame:
        """(what, n): chunks ``listed`` for all distinct media, bodies ``stored``, and their ``bytes``."""
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        sums = {"listed": self.home.agg(F.sum(F.size("digests"))), "stored": self.table.agg(F.sum(F.size("sizes"))), "bytes": self.table.agg(F.sum(size))}
        named = [df.toDF("n").select(F.lit(what).alias("what"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for what, df in sums.items()]
        return named[0].unionByName(named[1]).unionByName(named[2])

    def exported(self) -> DataFrame:
        """(digest, bytes) of every chunk that another container takes, once."""
        wanted = self.shared.groupBy(F.col("at").alias("cont")).agg(F.collect_set("digest").alias("wanted"))

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _rows(batch):
                    own = _bodies(r)
                    yield from _batch([(bytes(d), own[bytes(d)]) for d in r["wanted"]], (pa.binary(), pa.binary()), ["digest", "bytes"])

        return self.table.join(wanted, "cont").select("blob", "sizes", "digests", "kept", "wanted").mapInArrow(give, "digest binary, bytes binary")

    def read(self) -> DataFrame:
        """Every distinct medium rebuilt from its ordered chunks, verified and described."""
        taken = self.shared.select("cont", "digest").join(self.exported(), "digest").groupBy("cont").agg(F.collect_list(F.struct("digest", "bytes")).alias("taken"))

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _rows(batch):
                    bodies = _bodies(r) | {bytes(t["digest"]): t["bytes"] for t in r["taken"] or []}
                    digests = _digests_of(r["digests"])
                    if lost := {digests[c] for m in r["local"] for c in r["media"][m]["chunks"]} - bodies.keys():
                        raise RuntimeError(f"{len(lost)} chunks of stored media are missing")
                    media = [r["media"][m] for m in r["local"]]
                    yield from _batch([_rebuilt([bodies[digests[c]] for c in m["chunks"]], m["id"]) for m in media], _RESULT_KINDS, _RESULT_NAMES)

        rows = self.table.join(self.local, "cont").join(taken, "cont", "left")
        return rows.select("blob", "sizes", "digests", "media", "kept", "local", "taken").mapInArrow(rebuild, _RESULT)

    def documents(self) -> DataFrame:
        """doc_id, n_bytes and the values of the document's medium."""
        own = self.table.select("cont", F.posexplode("media.id").alias("m", "media_id"))
        values = own.join(self.read(), "media_id", "left")
        rows = self.table.select("cont", F.explode("docs").alias("d")).select("cont", "d.m", "d.doc_id", "d.n_bytes")
        return rows.join(values, ["cont", "m"]).drop("cont", "m")


def _container(key: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, off = C.text_bytes(batch.column("t"))
    data = raw.tobytes()
    chunk_of: dict[bytes, int] = {}
    bodies: list[bytes] = []
    media_of: dict[bytes, int] = {}
    media: list[dict] = []
    docs: list[dict] = []
    for k, doc in enumerate(batch.column("i").to_pylist()):
        own = to_media(payload(data[off[k] : off[k + 1]]))
        media_id = hashlib.sha256(own).digest()
        m = media_of.get(media_id)
        if m is None:
            m = media_of[media_id] = len(media)
            chunks, start = [], 0
            for end in chunk_ends(own):
                body = own[start:end]
                c = chunk_of.setdefault(hashlib.blake2b(body, digest_size=DIGEST).digest(), len(bodies))
                if c == len(bodies):
                    bodies.append(body)
                chunks.append(c)
                start = end
            media.append({"id": media_id, "chunks": chunks})
        docs.append({"doc_id": doc, "n_bytes": int(off[k + 1] - off[k]), "m": m})
    doc_kind = pa.struct([("doc_id", batch.column("i").type), ("n_bytes", pa.int64()), ("m", pa.int32())])
    media_kind = pa.struct([("id", pa.binary()), ("chunks", pa.list_(pa.int32()))])
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), pa.array([_pressed(bodies)], pa.binary()), pa.array([[len(b) for b in bodies]], pa.list_(pa.int32())), pa.array([b"".join(chunk_of)], pa.binary()), pa.array([media], pa.list_(media_kind)), pa.array([docs], pa.list_(doc_kind))],
        names=["cont", "blob", "sizes", "digests", "media", "docs"],
    )


def _sealed(row: pa.RecordBatch) -> pa.RecordBatch:
    """A container with the bodies of the chunks that it owns; ``kept`` are their places in its list of digests."""
    r = row.select(["blob", "sizes", "digests", "media", "local", "foreign"]).to_pylist()[0]
    foreign, digests = set(map(bytes, r["foreign"] or [])), _digests_of(r["digests"])
    needed = sorted({c for m in r["local"] or [] for c in r["media"][m]["chunks"]})
    kept = [c for c in needed if digests[c] not in foreign]
    chunks = _chunks_of(r["blob"], r["sizes"])
    blob, sizes = _pressed([chunks[c] for c in kept]), [r["sizes"][c] for c in kept]
    columns = {"blob": pa.array([blob], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "kept": pa.array([kept], pa.list_(pa.int32()))}
    names = ["cont", "blob", "sizes", "digests", "media", "docs", "kept"]
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else row.column(n) for n in names], names=names)


def _pressed(bodies: list[bytes]) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(b"".join(bodies), asbytes=True)


def _bodies(r: dict) -> dict[bytes, bytes]:
    """The chunks that a container owns, by digest."""
    digests = _digests_of(r["digests"])
    return dict(zip((digests[k] for k in r["kept"]), _chunks_of(r["blob"], r["sizes"])))


def _chunks_of(blob: bytes, sizes: list[int]) -> list[bytes]:
    data = pa.decompress(blob, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [data[e - n : e] for e, n in zip(ends, sizes)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, as each holds megabytes."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _digests_of(joined: bytes) -> list[bytes]:
    return [joined[k : k + DIGEST] for k in range(0, len(joined), DIGEST)]


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = Store(docs, id_col, text_col).documents()
    # a document whose digest no rebuilt medium has fails the query
    size = F.coalesce("payload_bytes", F.raise_error(F.lit("a rebuilt medium differs from the one stored")).cast("long")).alias("payload_bytes")
    hexed = lambda c, to: F.lower(F.hex(c)).alias(to)
    return found.select(F.col("doc_id").alias(id_col), "n_bytes", size, hexed("payload_sha256", "payload_sha256"), "tail_crc32", "media_bytes", hexed("media_id", "media_sha256"), "feature")
