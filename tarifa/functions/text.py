"""Cleaning values, normalising text and what titles name, as columns."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import DEFAULT, NULL_PRICES, NULL_WORDS, Lexicon
from . import titles

#: All white space of Unicode, as (?U)\s.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LONGEST_NULL = max(map(len, NULL_WORDS))
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(c: Column) -> Column:
    """Without white space at both ends. Most text has none there, which its first and last character tell; cutting looks at
    every character, and a regular expression costs many times more still."""

    def dark(edge: Column) -> Column:
        return edge.between(0x21, 0x7E) | (edge > ord(WHITE[-1]))

    return F.when(dark(F.ascii(c)) & dark(F.ascii(F.right(c, F.lit(1)))), c).otherwise(F.btrim(c, F.lit(WHITE)))


def clean_str(c: Column) -> Column:
    """Trimmed text; null and words that mean null become ''."""
    s = trimmed(F.coalesce(c.cast("string"), F.lit("")))
    return F.when((F.char_length(s) <= _LONGEST_NULL) & F.lower(s).isin(NULL_WORDS), "").otherwise(s)


def is_blank(c: Column) -> Column:
    """Whether ``clean_str`` gives ''. It names ``c`` once: filters are moved down to where ``c`` is made, and make it each time."""
    return F.lower(F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITE))).isin(NULL_WORDS)


def parse_price(c: Column) -> Column:
    """A price as double; currency marks and thousands separators are dropped, other text gives null."""
    s = F.btrim(c.cast("string"), F.lit(WHITE))  # named once, as often as it is read it would be made
    bare = F.btrim(F.translate(s, "¥￥元,", ""), F.lit(WHITE))
    plain = ~F.lower(s).isin(NULL_PRICES) & bare.rlike(_NUMBER)
    return F.when(plain, bare.try_cast("double"))


@functools.cache
def _unchanged() -> str:
    """A character class of all but the runs, of characters that normalisation leaves as they are wherever they
    stand, around some frequent ones: most text has none of it, and a class of few ranges is cheap."""

    def moves(code: int) -> bool:
        char = chr(code)
        return unicodedata.combining(char) > 0 or unicodedata.normalize("NFKC", char) != char or char in second

    pairs = (unicodedata.decomposition(chr(code)).split() for code in range(0xA0, 0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}  # joins the one before
    second |= set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # vowels and finals of Hangul
    moved = [code for code in range(0x10000) if moves(code)]
    runs = {(a + 1, b - 1) for a, b in zip([-1, *moved], [*moved, 0x10000]) for char in "a×é【中ア" if a < ord(char) < b}
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in sorted(runs)) + "]"


def nfkc(c: Column) -> Column:
    """Compatibility normalisation (NFKC); only texts that may change leave the JVM."""
    changed = titles.arrow_column(lambda t: unicodedata.normalize("NFKC", t), pa.string(), "string", F.when(c.rlike(_unchanged()), c))
    return F.when(c.rlike(_unchanged()), changed).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Half-width text with '*' for every multiplication sign and single spaces; null becomes ''.

    The functions below take text in this form, so that a plan normalises each text once."""
    s = F.translate(nfkc(F.coalesce(c, F.lit(""))), "×xX﹡（）：", "****():")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def clean_title(s: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A normalised title without brackets, promotions, specifications and marks, in lower case."""
    return titles.clean_column(s, lexicon)


def declared_or(declared: Column | None, found: Column) -> Column:
    if declared is None:
        return found
    given = trimmed(F.coalesce(declared, F.lit("")))
    return F.when(given != "", given).otherwise(found)


def extract_brand(title: Column, declared: Column | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """The declared brand, else the leftmost (of those the longest) known brand in the title."""
    return declared_or(declared, titles.words_column(title, lexicon)["brand"])


def extract_category(title: Column, declared: Column | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """The declared category, else that of the longest hint in the title."""
    return declared_or(declared, titles.words_column(title, lexicon)["category"])


def extract_variants(title: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """For each group in order, the longest word of it that the normalised title has, or null."""
    return titles.words_column(title, lexicon)["variants"]


def variant_conflict(a: Column, b: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether two lists of variants name different words of one group."""
    out = F.lit(False)
    for k, name in enumerate(lexicon.variants):
        if name not in lexicon.neutral_variants:
            out = out | F.coalesce(F.get(a, k) != F.get(b, k), F.lit(False))
    return out


def extract_product_line(title: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The leftmost (of those the longest) product line in the title."""
    return titles.words_column(title, lexicon)["line"]


def line_mismatch(a: Column, b: Column) -> Column:
    """'' for equal product lines, else what differs."""
    both = F.concat(F.lit("产品线不同（"), a, F.lit(" vs "), b, F.lit("）"))
    one = F.concat(F.lit("仅一方标注产品线（"), F.when(a != "", a).otherwise(b), F.lit("）"))
    return F.when(a == b, "").when((a != "") & (b != ""), both).otherwise(one)
