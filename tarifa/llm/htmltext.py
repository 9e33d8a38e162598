"""Operator 9: main text of web pages by differencing with the nearest URLs.

Each page is cut into blocks of text. Scanning leaves out elements that never hold main text
(menus, headers, footers, asides, forms, scripts, styles), hidden ones, and those whose whole
name says so (``class="ad"``, ``id="comments"``; a name among others or within another one says
nothing). Then pages of equal lines on a host become one, represented by the first in order
of path; representatives are ordered by host and path, and each is paired with the ``NEAR``
of its neighbours in that order whose paths have the longest common beginning. Its lines are
aligned with each one's by longest common subsequence, and lines that most of them share are deleted:
what a site repeats on nearby pages isn't the article. Copies lose what their
representative loses.

Markup protects the lines inside article and main elements from wrong deletion, as a few
articles may well have a sentence in common: neighbours that have half or more of the article's text are
near copies of it and have no say about its lines, and ``LEAST`` others, all that are taken, must
share a line that goes. With fewer such neighbours an article keeps all its lines.

Neighbours are found by position in a global sort and an equi-join on the position, so a
host with a third of all pages is dealt over all tasks. Only 64-bit hashes of lines are
paired; texts travel once, packed in chunks, to the chunks that have lines to delete.

Defined cases: null or empty html gives an empty text; html of any length is taken whole,
lines being aligned in bounded memory; a null or odd URL belongs to the host '' with the
whole URL as its path; pages of equal URL are ordered by page_id; repeated rows each get a
row, null page_ids too; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_INSIDE = r"(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"  # quotes count only where a value begins
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(noscript|template|svg|textarea|title|iframe)\b{_INSIDE}>.*?</\2\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")
_SPACE = re.compile(r"\s+")

# fixed values: elements that begin and end a block, elements never part of the main text, elements that may end without a tag, elements without content, and whole names of parts that aren't main text
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form menu button select dialog head".split())
IMPLIED_END = frozenset("p li dt dd tr td th option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PART_NAMES = frozenset("ad ads adv advert adverts advertisement banner banners sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments disqus replies share sharing social related recommended newsletter subscribe subscription signup login pagination pager widget widgets toolbar search contentinfo complementary".split())

#: Neighbours that a page is compared with, of those so many places before and behind; how many must share a line of an article.
NEAR, SIDE, LEAST = 4, 4, 4
#: Neighbours with this share of an article's text are near copies of it.
NEAR_COPY = 0.5
ALIGN_BITS = 1 << 26


def _is_part(attributes: str) -> bool:
    """Whether an element is hidden or named, by all of its class, id or role, as a part that isn't main text."""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _NOT_SHOWN.search(value)):
            return True
        if key in ("class", "id", "role") and (names := set(value.split())) and names <= PART_NAMES:
            return True
    return False


def _closes_later(html: str, name: str, at: int) -> bool:
    """Whether the next tag of this name from ``at`` on is a closing one."""
    m = re.compile(rf"<(/?){name}\b", re.I).search(html, at)
    return m is not None and m[1] == "/"


def page_blocks(html: str) -> tuple[list[str], list[bool]]:
    """The text blocks of a page in order, and whether each lies in an article or main element."""
    blocks: list[str] = []
    inside: list[bool] = []
    piece: list[str] = []
    drop: list[str] = []  # open elements from the outermost left-out one inwards
    article, at, title = 0, 0, False

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        if text:
            blocks.append(text)
            inside.append(article > 0)
        piece.clear()

    for m in _TAG.finditer(html):
        if not drop and not title and m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        name = m[4].lower() if m[4] else None
        if name is None:
            continue
        closing = m[3] == "/"
        title = name == "title" and not closing  # one that is never closed ends with the next tag
        if drop:
            if len(drop) == 1 and drop[0] in IMPLIED_END and (name == drop[0] or (name in BLOCKS and name not in IMPLIED_END and (closing or drop[0] == "p"))):
                drop.clear()  # ended without its tag
                if closing and name in IMPLIED_END:
                    continue
            elif closing and name in ("article", "main") and article and name not in drop:
                drop.clear()  # the left-out part wasn't closed
            elif not closing and name in ("article", "main") and drop[0] not in ("article", "main") and not _closes_later(html, drop[0], at):
                drop.clear()
            else:
                if closing and name in drop:
                    while drop.pop() != name:
                        pass
                elif not closing and name not in VOID and (name == drop[0] or name in ("div", "section", "ul", "ol", "nav", "form", "table", "article", "main")) and not m[5].endswith("/"):
                    drop.append(name)
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            piece.append("\n")
        if closing:
            if name in ("article", "main"):
                article = max(0, article - 1)
        elif name in ("article", "main"):
            if _is_part(m[5]):
                drop.append(name)
            else:
                article += 1
        elif name not in VOID and not m[5].endswith("/") and ((name in DROPPED and not (name == "header" and article)) or (name not in ("html", "body") and _is_part(m[5]))):
            drop.append(name)
    if not drop and not title:
        piece.append(html[at:])
    flush()
    return blocks, inside


def _places(b: list) -> dict:
    place: dict = {}
    for j, line in enumerate(b):
        place[line] = place.get(line, 0) | 1 << j
    return place


def _common_lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``."""
    place, full = _places(b), (1 << len(b)) - 1
    s = full
    for line in a:
        u = s & place.get(line, 0)
        s = ((s + u) | (s - u)) & full
    bits = np.unpackbits(np.frombuffer(s.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: list, b: list) -> np.ndarray:
    """Which lines of ``a`` lie in a longest common subsequence with ``b`` (bit-parallel; long
    pages are halved where the lengths of both halves add up to the whole's)."""
    if not a or not b:
        return np.zeros(len(a), bool)
    if len(a) == 1 or len(a) * len(b) <= ALIGN_BITS:
        return _shared_lines(a, b)
    half = len(a) // 2
    j = int((_common_lengths(a[:half], b) + _common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return np.concatenate([shared_lines(a[:half], b[:j]), shared_lines(a[half:], b[j:])])


def _shared_lines(a: list, b: list) -> np.ndarray:
    mark = np.zeros(len(a), bool)
    place, full = _places(b), (1 << len(b)) - 1
    rows, s = [full], full
    for line in a:
        u = s & place.get(line, 0)
        s = ((s + u) | (s - u)) & full
        rows.append(s)
    # a zero bit j in row i+1 that was one in row i is where line i is matched
    j = len(b)
    for i in range(len(a) - 1, -1, -1):
        low = (1 << j) - 1
        if (~rows[i + 1] & low).bit_count() > (~rows[i] & low).bit_count():
            mark[i] = True
            hit = place.get(a[i], 0) & low
            # go back to the last place in b at which a[i] gives this length
            want = (~rows[i] & low).bit_count()
            while hit:
                top = hit.bit_length() - 1
                if (~rows[i] & ((1 << top) - 1)).bit_count() == want:
                    j = top
                    break
                hit &= ~(1 << top)
    return mark


def site_lines(lines: list[int], inside: list[bool], sizes: list[int], near: list[list[int]]) -> list[int]:
    """Positions of the lines (given by hashes) of a page that go because most of its neighbours have them."""
    shared = np.array([shared_lines(lines, other) for other in near]).reshape(len(near), len(lines))
    own, size = np.array(inside, bool), np.array(sizes)
    most = shared.sum(0) * 2 > len(near)
    others = shared[[size[own & s].sum() < NEAR_COPY * size[own].sum() for s in shared]]
    votes = others.sum(0)
    return np.flatnonzero(np.where(own, (votes >= LEAST) & (votes * 2 > len(others)), most)).tolist()


def common_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _line_hashes(lines: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in lines]


def _cut_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages in a shared table: chunk, body (page_id, url and lines of its pages, packed)
    and keys, by page: row_id, page_id, url, host, path, same (of its lines), lines (hashes), inside, sizes."""
    parts = [F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"), F.coalesce(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.lit("")).alias("path")]
    kind = pa.struct([("row_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("same", pa.binary()), ("lines", pa.list_(pa.int64())), ("inside", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))])
    id_kind = pages.schema["page_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in C.chunks(batches, "html", 1 << 20):
            found = [page_blocks(h) for h in batch.column("html").to_pylist()]
            hashes = [_line_hashes(f[0]) for f in found]
            same = [hashlib.blake2b(np.array(h, np.int64).tobytes(), digest_size=16).digest() for h in hashes]
            values = [range(at, at + len(found)), *(batch.column(c).to_pylist() for c in ("url", "host", "path")), same, hashes, [f[1] for f in found], [[len(x) for x in f[0]] for f in found]]
            columns = [pa.array(v, k.type) for v, k in zip(values, kind)]
            keys = pa.StructArray.from_arrays([columns[0], batch.column("page_id"), *columns[1:]], names=["row_id", "page_id", *[k.name for k in kind][1:]])
            body = pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([f[0] for f in found], pa.list_(pa.string()))], names=["page_id", "url", "lines"])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([C.pack_rows(body)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), keys)], names=["chunk", "body", "keys"])
            at += len(found)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), *parts)
    return C.written(rows.mapInArrow(cut, f"chunk long, body binary, keys array<struct<row_id: long, page_id: {id_kind}, url: string, host: string, path: string, same: binary, lines: array<long>, inside: array<boolean>, sizes: array<int>>>"), "pages")


def nearest(keys: DataFrame) -> DataFrame:
    """(row_id, nth, near_id) for the rows of ``keys`` (row_id, host, path, page_id, url): of the SIDE
    before and the SIDE after on the host, in order of path, the NEAR whose paths have the
    longest common beginning."""
    spark = keys.sparkSession
    order = ["host", "path", "page_id", "url", "row_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "host", "path")), pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=["row_id", "host", "path", "part", "at"])
            at += n

    by_url = keys.repartitionByRange(C.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = C.written(by_url.mapInArrow(count, "row_id long, host string, path string, part long, at long"), "page-order")
    base, total = [], 0
    for part, n in sorted(rows.groupBy("part").count().collect()):  # one row per partition
        base.append((part, total))
        total += n
    rows = rows.join(F.broadcast(spark.createDataFrame(base or [(0, 0)], "part long, base long")), "part")
    rows = rows.select((F.col("base") + F.col("at")).alias("place"), "row_id", "host", "path")
    steps = F.explode(F.array(*[F.lit(k) for k in range(-SIDE, SIDE + 1) if k])).alias("step")
    others = rows.select((F.col("place")).alias("near_place"), F.col("row_id").alias("near_id"), F.col("host").alias("near_host"), F.col("path").alias("near_path"), steps)
    others = others.select((F.col("near_place") + F.col("step")).alias("place"), "near_host", F.struct("near_id", "near_path", F.abs("step").alias("far"), (F.col("step") < 0).alias("after")).alias("near"))
    both = rows.join(others, "place").filter("host = near_host").groupBy("row_id").agg(F.first("path").alias("path"), F.collect_list("near").alias("near"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, path, near in zip(*(batch.column(c).to_pylist() for c in ("row_id", "path", "near"))):
                best = sorted(near, key=lambda n: (-common_beginning(path, n["near_path"]), n["far"], n["after"]))
                found += [(row, k, n["near_id"]) for k, n in enumerate(best[:NEAR])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["row_id", "nth", "near_id"])

    return both.mapInArrow(choose, "row_id long, nth long, near_id long")


def representatives(keys: DataFrame) -> DataFrame:
    """The first in order of path of the pages with the same lines on a host."""
    first = keys.groupBy("host", "same").agg(F.min(F.struct("path", "page_id", "url", "row_id")).alias("f"))
    return first.select(F.col("f.row_id").alias("row_id"), "host", "f.path", "f.page_id", "f.url", "same")


def _shared(keys: DataFrame) -> DataFrame:
    """(host, same, gone): of each representative, the positions of the lines that go."""
    # as tables, so that their sizes are known before they are joined
    near = C.written(nearest(C.written(representatives(keys), "representatives")), "nearest")
    theirs = near.join(keys.select(F.col("row_id").alias("near_id"), "lines"), "near_id").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("nth", "lines"))).alias("near"))
    pairs = keys.select("row_id", "host", "same", "lines", "inside", "sizes").join(theirs.select("row_id", F.transform("near", lambda x: x["lines"]).alias("near")), "row_id")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [site_lines(r["lines"], r["inside"], r["sizes"], r["near"]) for r in batch.select(["lines", "inside", "sizes", "near"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("same"), pa.array(gone, pa.list_(pa.int32()))], names=["host", "same", "gone"])

    return pairs.mapInArrow(differ, "host string, same binary, gone array<int>").filter(F.size("gone") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    cuts = _cut_pages(pages)
    keys = cuts.select("chunk", F.explode("keys").alias("k")).select("chunk", "k.*").filter(F.size("lines") > 0)
    with C.released(pages.sparkSession, "site-lines"):
        gone = C.written(_shared(keys), "site-lines")
    cut = keys.select("chunk", "row_id", "host", "same").join(gone, ["host", "same"])
    cut = cut.groupBy("chunk").agg(F.collect_list(F.struct("row_id", "gone")).alias("gone"))  # a chunk has 1 MB of pages or one page

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, found in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "gone"))):
                own = C.unpack_rows(body).combine_chunks()
                less = {x["row_id"] - chunk: set(x["gone"]) for x in found or []}
                texts = ["\n\n".join(x for j, x in enumerate(lines) if j not in less.get(k, ())) for k, lines in enumerate(own["lines"].to_pylist())]
                yield pa.RecordBatch.from_arrays([own["page_id"].combine_chunks(), own["url"].combine_chunks(), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    id_kind = pages.schema["page_id"].dataType.simpleString()
    return cuts.select("chunk", "body").join(cut, "chunk", "left").mapInArrow(tell, f"page_id {id_kind}, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


class _Plain(HTMLParser):
    """Blocks of a page without odd markup, by the library's parser: (text, whether inside an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, bool]] = []
        self.piece, self.left_out, self.depth, self.article = "", "", 0, 0

    def flush(self) -> None:
        if text := " ".join(self.piece.split()):
            self.found.append((text, self.article > 0))
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.left_out:
            self.depth += tag == self.left_out
        elif tag in ("nav", "footer", "aside", "form", "header", "head", "script", "style") or any((a.get(k) or "-") in PART_NAMES for k in ("class", "id", "role")):
            self.flush()
            self.left_out, self.depth = tag, 1
        elif tag in BLOCKS:
            self.flush()
            self.article += tag in ("article", "main")
        elif tag == "br":
            self.piece += " "

    def handle_endtag(self, tag):
        if self.left_out:
            self.depth -= tag == self.left_out
            self.left_out = self.left_out if self.depth else ""
        elif tag in BLOCKS:
            self.flush()
            self.article -= tag in ("article", "main")

    def handle_data(self, data):
        if not self.left_out:
            self.piece += data


def _by_table(a: list, b: list) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, from the whole table; of several the last places."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    out, j = set(), len(b)
    for i in range(len(a), 0, -1):
        if n[i][j] > n[i - 1][j]:
            out.add(i - 1)
            j = max(k for k in range(j) if b[k] == a[i - 1] and n[i - 1][k] == n[i][j] - 1)
    return out


def brute_force(pages: list[tuple[int, str | None, str | None]]) -> dict[int, str]:
    """page_id: text, from (page_id, url, html) without odd markup, by another parser, plain tables and sorted lists; for tests."""
    split = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
    found = []
    for page, url, html in pages:
        m, parser = split.match(url or ""), _Plain()
        parser.feed(html or "")
        parser.close()
        parser.flush()
        found.append((m[1].lower() if m else "", (url or "")[m.end() if m else 0 :], page, [t for t, _ in parser.found], [i for _, i in parser.found]))
    hosts: dict[str, dict[tuple, tuple]] = {}
    for host, path, _, lines, inside in sorted(found, key=lambda f: f[:3]):
        if lines:
            hosts.setdefault(host, {}).setdefault(tuple(lines), (path, lines, inside))
    left = {}
    for host, pages_of in hosts.items():
        row = list(pages_of.values())
        for k, (path, lines, inside) in enumerate(row):
            others = sorted((j for j in range(len(row)) if 0 < abs(j - k) <= SIDE), key=lambda j: (-common_beginning(path, row[j][0]), abs(j - k), j < k))[:NEAR]
            marks = [_by_table(lines, row[j][1]) for j in others]
            of_article = sum(len(x) for x, i in zip(lines, inside) if i)
            apart = [m for m in marks if sum(len(lines[j]) for j in m if inside[j]) < NEAR_COPY * of_article]
            keep = []
            for j, line in enumerate(lines):
                votes, of = (sum(j in m for m in apart), len(apart)) if inside[j] else (sum(j in m for m in marks), len(marks))
                if 2 * votes <= of or (inside[j] and votes < LEAST):
                    keep.append(line)
            left[host, tuple(lines)] = "\n\n".join(keep)
    return {page: left.get((host, tuple(lines)), "") for host, _, page, lines, _ in found}
