"""Operator 11: fill-in-middle transformation by a table-driven byte automaton.

A text is a row of units: a run of ASCII letters, or any other single code point. One automaton
over UTF-8 bytes follows continuation bytes, unit boundaries and sentinels at once; its tables
are built from the sentinels by rule. Each transition emits what it counts: a code point, a
unit, the end of a sentinel. The automaton forgets: its state depends on the last few bytes only,
so a run of texts is cut into lanes that all step through the tables together, each begun those few
bytes early. The counts of this one scan give the number of units and the form of a text; a second pass
over the emitted unit starts locates the two cuts.

``transform`` writes prefix, suffix and middle with sentinels between, ``restore`` finds the
sentinels of such an output with the same automaton and rebuilds the text. Every row is local
work: nothing is shuffled.

Defined cases: null text is empty; an empty text, and one that has a sentinel, stays plain; a null
id hashes as the empty string, repeated ids and rows get the same cuts; texts of any length are taken
whole (a text is a row of one batch, so its size is bounded by Arrow's 2 GB); an empty table gives
an empty result. Other columns pass through, and where one has the name of a result the result's
name gets an underscore.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SENTINELS = ("<P>", "<S>", "<M>")
#: Between texts: no byte of UTF-8, brings the automaton to its start.
END = 0xFF
CODE, UNIT, HIT = 1, 2, 4
LANES = 4096
SEED, PERCENT, SPM_PERCENT = 1, 90, 20
RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


class Automaton:
    """States are (the longest end of the input that begins a sentinel, whether a letter came last)."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode("ascii") for s in sentinels]
        if not all(marks) or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("sentinels are ASCII, not empty, and none is part of another")
        begun = {m[:k] for m in marks for k in range(len(m))}
        self.memory = max(map(len, marks)) - 1
        states, known = [(b"", False)], {(b"", False): 0}
        following, emitted = [], []
        for begin, letter in states:  # a list that grows as it's walked
            to, out = np.zeros(256, np.uint16), np.zeros(256, np.uint8)
            for byte in range(256):
                if byte == END:
                    continue
                seen = begin + bytes([byte])
                is_letter = bytes([byte]).isalpha()
                rest = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in begun)
                if (rest, is_letter) not in known:
                    known[rest, is_letter] = len(states)
                    states.append((rest, is_letter))
                to[byte] = known[rest, is_letter]
                starts = byte & 0xC0 != 0x80
                out[byte] = CODE * starts | UNIT * (starts and not (letter and is_letter)) | HIT * any(seen.endswith(m) for m in marks)
            following.append(to)
            emitted.append(out)
        self.following, self.emitted = np.concatenate(following), np.concatenate(emitted)

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What the transition at each byte emits."""
        lanes = max(1, min(LANES, len(data) // 64))
        step = -(-len(data) // lanes) if len(data) else 0
        before = np.full(self.memory + lanes * step, END, np.uint8)
        before[self.memory : self.memory + len(data)] = data
        columns = np.ascontiguousarray(before[self.memory :].reshape(lanes, step).T)
        state, at = np.zeros(lanes, np.int64), np.arange(lanes) * step
        for k in range(self.memory):
            state = self.following[state * 256 + before[at + k]].astype(np.int64)
        out = np.empty((step, lanes), np.uint8)
        for k in range(step):
            edge = state * 256 + columns[k]
            self.emitted.take(edge, out=out[k], mode="clip")  # no copy, as edges are within the table
            state = self.following[edge].astype(np.int64)
        return out.T.reshape(-1)[: len(data)]


@functools.lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    return Automaton(sentinels)


class Scanned:
    """The texts of a run, one after another with END behind each, and what the scan emitted."""

    def __init__(self, column: pa.Array, sentinels: tuple[str, ...]):
        raw, off = C.text_bytes(column)
        n, size = len(off) - 1, np.diff(off)
        self.data = np.full(len(raw) + n, END, np.uint8)
        self.data[np.arange(len(raw)) + np.repeat(np.arange(n), size)] = raw
        self.start = off[:-1] + np.arange(n)
        self.end = off[1:] + np.arange(n)
        self.emitted = automaton(sentinels).scan(self.data)

    def places(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Where transitions of a kind are, and the n+1 offsets of each text's."""
        at = np.flatnonzero(self.emitted & kind)
        return at, np.append(np.searchsorted(at, self.start), len(at))


def forms(n: np.ndarray, has_mark: np.ndarray, draws: np.ndarray, percent: int, spm_percent: int) -> np.ndarray:
    """0 plain, 1 psm, 2 spm."""
    plain = (n == 0) | has_mark | (draws[2] % 100 >= percent)
    return np.where(plain, 0, np.where(draws[3] % 100 < spm_percent, 2, 1))


def _transformed(column: pa.Array, draws: np.ndarray, sentinels: tuple[str, ...], percent: int, spm_percent: int) -> list[pa.Array]:
    s = Scanned(column, sentinels)
    units, first = s.places(UNIT)
    n = np.diff(first)
    hits = np.diff(s.places(HIT)[1])
    form = forms(n, hits > 0, draws, percent, spm_percent)
    a, b = draws[0] % (n + 1), draws[1] % (n + 1)
    ends = np.append(units, 0)  # the place past the last unit isn't asked for
    cuts = [np.where(k < n, ends[np.minimum(first[:-1] + k, len(units))], s.end) for k in (np.minimum(a, b), np.maximum(a, b))]
    codes = np.append(0, np.cumsum(s.emitted & CODE, dtype=np.int64))
    prefix, middle = codes[cuts[0]] - codes[s.start], codes[cuts[1]] - codes[cuts[0]]
    data = s.data.tobytes()
    p, q, m = (x.encode() for x in sentinels)
    out = []
    for kind, x, y, z, e in zip(form.tolist(), s.start.tolist(), cuts[0].tolist(), cuts[1].tolist(), s.end.tolist()):
        if kind == 0:
            out.append(data[x:e])
        elif kind == 1:
            out.append(b"".join((p, data[x:y], q, data[z:e], m, data[y:z])))
        else:
            out.append(b"".join((q, data[z:e], p, data[x:y], m, data[y:z])))
    plain = form == 0
    names = pa.array(["plain", "psm", "spm"]).take(pa.array(form))
    return [pa.array(n, pa.int64()), names, pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def _restored(column: pa.Array, form: pa.Array, sentinels: tuple[str, ...]) -> pa.Array:
    s = Scanned(column, sentinels)
    marks, first = s.places(HIT)
    data, out = s.data.tobytes(), []
    p, q, m = (x.encode() for x in sentinels)
    for kind, x, e, i, j in zip(form.to_pylist(), s.start.tolist(), s.end.tolist(), first[:-1].tolist(), first[1:].tolist()):
        if kind == "plain":
            out.append(data[x:e])
            continue
        order = (p, q, m) if kind == "psm" else (q, p, m)
        ends = (marks[i:j] + 1).tolist()
        parts = [(ends[k], (ends[k + 1] - len(order[k + 1])) if k < 2 else e) for k in range(3)] if len(ends) == 3 else []
        if not parts or any(data[a - len(mark) : a] != mark for (a, _), mark in zip(parts, order)):
            raise ValueError("this isn't an output of the transformation")
        one, two, middle = (data[a:b] for a, b in parts)
        out.append(one + middle + two if kind == "psm" else two + middle + one)
    return pa.array(out, pa.binary()).cast(pa.string())


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Adds n_units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Four draws come from the sha256 of the seed and the id: two cuts, whether the text is changed (in
    ``percent`` of a hundred texts) and its form (``spm_percent`` of those). ``sentinels`` stand before prefix, suffix, middle."""
    automaton(sentinels)  # a wrong list is an error here, not in a task
    results = [C.free_name(n, df.columns) for n in RESULTS]
    draw_names = [C.free_name(f"draw{k}", [*df.columns, *results]) for k in range(4)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(draw_names)]
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, text_col):
            drawn = np.array([np.asarray(batch.column(k)) for k in range(width, width + 4)])
            made = _transformed(batch.column(text_col), drawn, sentinels, percent, spm_percent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(results, kinds))])
    return df.select("*", *draws).mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Adds ``restored``, the text that each output was made of."""
    name = C.free_name("restored", df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, output_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, _restored(batch.column(output_col), batch.column(form_col), sentinels)], names=schema.names)

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    made = restore(transform(df.select(id_col, text_col), id_col, text_col).drop(text_col))
    return made.select(id_col, F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def brute_force(doc_id: int | None, text: str | None, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """The contract by a regular expression: (n, form, prefix_chars, middle_chars, output); for tests."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in SENTINELS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    spm = h[3] % 100 < spm_percent
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
