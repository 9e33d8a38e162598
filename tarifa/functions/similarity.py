"""Title similarity: bigram Jaccard and token ratios over the longest common subsequence.

Ratios exist in two forms with equal results: column expressions (no Python worker) and
an Arrow UDF that measures all pairs of a batch at once, many times faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lanes
from .text import let

# ---------------------------------------------------------------- column expressions


def char_bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters, spaces left out; a single character is itself."""
    s = F.replace(text, F.lit(" "), F.lit(""))
    n = F.length(s)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bigram_similarity(a: Column, b: Column) -> Column:
    """100 * Jaccard of bigram sets; 0 if one is empty."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both) * 100)

    return let(char_bigrams(a), lambda x: let(char_bigrams(b), lambda y: share(x, y)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table per character of ``a``."""
    m = F.length(b)
    start = F.array_repeat(F.lit(0), m + 1)

    def row(before: Column, char: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            hit = F.substring(b, j, F.lit(1)) == char
            best = F.when(hit, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(now, j - 1)))
            return F.array_append(now, best)

        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

    table = F.aggregate(F.split(a, ""), start, row)
    return F.when((F.length(a) == 0) | (m == 0), 0).otherwise(F.get(table, m))


def _ratio(distance: Column, total: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(100.0 - 100.0 * distance / total)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Subsequence ratio of the texts with their tokens in order."""
    x, y = (F.array_join(F.array_sort(_tokens(t)), " ") for t in (a, b))
    score = lambda x, y: _ratio(F.length(x) + F.length(y) - 2 * common_subsequence(x, y), F.length(x) + F.length(y))
    return let(x, lambda x: let(y, lambda y: score(x, y)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio of common tokens and rests; 100 where one token set holds the other."""
    x, y = (F.array_sort(F.array_distinct(_tokens(t))) for t in (a, b))
    return let(x, lambda x: let(y, lambda y: _token_set(x, y)))


def _token_set(x: Column, y: Column) -> Column:
    both, left, right = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
    parts = F.struct(*[F.array_join(t, " ").alias(k) for k, t in zip("slr", (both, left, right))])
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(let(parts, lambda t: _best_ratio(t["s"], t["l"], t["r"])))


def _best_ratio(s: Column, l: Column, r: Column) -> Column:
    n, p, q = F.length(s), F.length(l), F.length(r)
    gap = F.when(n > 0, 1).otherwise(0)
    first = _ratio(p + q - 2 * common_subsequence(l, r), 2 * n + 2 * gap + p + q)
    second, third = _ratio(gap + p, 2 * n + gap + p), _ratio(gap + q, 2 * n + gap + q)
    best = F.when(n == 0, first).otherwise(F.greatest(first, second, third))
    subset = (n > 0) & ((p == 0) | (q == 0))
    return F.when(subset, 100.0).otherwise(best)


# ---------------------------------------------------------------- the Arrow form


def ratios(a: pd.Series, b: pd.Series, whole: bool) -> np.ndarray:
    """Token sort (of ``whole`` titles) or token set ratios of pairs; equal pairs are measured once."""
    (x, of_a), (y, of_b) = (pd.factorize(s.fillna("")) for s in (a, b))
    distinct, back = np.unique(x.astype(np.int64) * (len(of_b) + 1) + y, return_inverse=True)
    tokens = lanes.Numbers()
    pairs = lanes.Pairs(*(lanes.Titles(list(t), tokens, distinct=not whole) for t in (of_a, of_b)))
    score = pairs.token_sort if whole else pairs.token_set
    return score(distinct // (len(of_b) + 1), distinct % (len(of_b) + 1))[back]


def _pairwise(whole: bool):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(ratios(a, b, whole) if len(a) else [], dtype="float64")

    return run


def token_set_ratio_arrow(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(False), "double")(a, b)


def token_sort_ratio_arrow(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(True), "double")(a, b)


# ---------------------------------------------------------------- one pair, for tests


def subsequence_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], left)
            left = row[j]
    return row[-1]


def ratio_of(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


def token_sort(a: str, b: str) -> float:
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return ratio_of(len(x) + len(y) - 2 * subsequence_length(x, y), len(x) + len(y))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    left, right, n = " ".join(sorted(x - y)), " ".join(sorted(y - x)), len(" ".join(sorted(both)))
    gap = 1 if n else 0
    p, q = len(left), len(right)
    best = ratio_of(p + q - 2 * subsequence_length(left, right), 2 * (n + gap) + p + q)
    if n:
        best = max(best, ratio_of(gap + p, 2 * n + gap + p), ratio_of(gap + q, 2 * n + gap + q))
    return best


# ---------------------------------------------------------------- scores of a candidate

LINE_PENALTY = 20.0
SAME_SIZE = 1.05


def text_score(token_set_score: Column, a: Column, b: Column) -> Column:
    """60 parts token set ratio, 40 parts bigrams; 0 for an empty title."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(0.6 * token_set_score + 0.4 * bigram_similarity(a, b))


def spec_penalty(a: Column, b: Column, most: float) -> Column:
    """By how many times the totals differ; all of ``most`` for units of different kinds."""
    from .spec import is_parsed

    ratio = F.try_divide(F.greatest(a["total_base"], b["total_base"]), F.least(a["total_base"], b["total_base"]))
    by_size = F.when(ratio <= SAME_SIZE, 0.0).otherwise(F.least(F.lit(float(most)), (ratio - 1.0) / 3.0 * most))
    return F.when(~(is_parsed(a) & is_parsed(b)), 0.0).when(a["unit"] != b["unit"], float(most)).otherwise(by_size)


def spec_note(a: Column, b: Column) -> Column:
    from .spec import is_parsed, spec_display

    ratio = F.try_divide(F.greatest(a["total_base"], b["total_base"]), F.least(a["total_base"], b["total_base"]))
    kinds = F.concat(F.lit("单位类别不同（"), a["unit"], F.lit(" vs "), b["unit"], F.lit("）"))
    sizes = F.concat(F.lit("规格差 "), F.format_string("%.1f", ratio), F.lit("×（"), spec_display(a), F.lit(" vs "), spec_display(b), F.lit("）"))
    return F.when(~(is_parsed(a) & is_parsed(b)), "").when(a["unit"] != b["unit"], kinds).when(ratio <= SAME_SIZE, "").otherwise(sizes)
