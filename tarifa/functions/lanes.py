"""Token ratios of many title pairs at once, and the nearest titles of a block by an inverted index.

A pair of titles is a lane of numpy arrays. The longest common subsequence runs bit-parallel over all
lanes: 64 characters of the first title are a word of bits, longer titles take several words with
carries, and each character of the second title is one step. Tokens that both titles have take no
part in it: their bits are masked, their characters match nothing.

``TitleIndex`` holds postings of the tokens and of the characters of a block of titles. Shared tokens and
shared characters give, without any subsequence, an upper bound of a pair's token set ratio; only
pairs whose bound reaches the n-th best score so far are scored.
"""

from __future__ import annotations

import numpy as np

SPACE = 32
#: Lanes of a pass, entries of its mask table, and cells of a comparison of tokens.
LANES, TABLE, CELLS = 4096, 1 << 21, 1 << 23
#: Titles that are scored at first, and at most in each further round.
FIRST, NEXT = 64, 256
#: Titles whose bounds are held at once.
SLICE = 64


class Numbers(dict):
    """A number for each key, given when it's first asked for."""

    def __missing__(self, key):
        k = self[key] = len(self)
        return k


def offsets(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(sizes, np.int64)))


class Titles:
    """Titles as flat arrays: their tokens in order, each behind a space, and which token a character is of."""

    def __init__(self, texts: list[str], tokens: Numbers, distinct: bool = True):
        split = [sorted(set(t.split()) if distinct else t.split()) for t in texts]
        flat = [w for s in split for w in s]
        self.count = np.array([len(s) for s in split], np.int64)
        self.token = np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
        self.token_size = np.fromiter(map(len, flat), np.int64, len(flat))
        self.token_off = offsets(self.count)
        self.code = np.frombuffer("".join([f" {w}" for w in flat]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.diff(offsets(self.token_size)[self.token_off])  # without spaces
        self.off = offsets(self.size + self.count)
        number = np.arange(len(flat)) - np.repeat(self.token_off[:-1], self.count)
        self.of_token = np.repeat(number, self.token_size + 1).astype(np.int32)

    def joined(self) -> np.ndarray:
        """Length of the tokens with single spaces between."""
        return self.size + np.maximum(self.count - 1, 0)


def padded(off: np.ndarray, flat: np.ndarray, rows: np.ndarray, fill: int) -> np.ndarray:
    """The rows of a ragged array, side by side."""
    size = off[rows + 1] - off[rows]
    width = max(1, int(size.max(initial=0)))
    at = np.arange(width)
    inside = at < size[:, None]
    if not len(flat):
        return np.full(inside.shape, fill, np.int64)
    out = flat.take(off[rows][:, None] + at, mode="clip")
    out[~inside] = fill
    return out


def common_tokens(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side the other side has, lane by lane."""
    if x.shape[1] * y.shape[1] > 100:
        same = x[:, :, None] == y[:, None, :]
        return same.any(2), same.any(1)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)  # few tokens: one column after another
    of_x, of_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(len(x)):
        for j in range(len(y)):
            same = x[i] == y[j]
            of_x[i] |= same
            of_y[j] |= same
    return of_x.T, of_y.T


class Pairs:
    """Scores pairs of two lists of titles that share their token numbers."""

    def __init__(self, a: Titles, b: Titles):
        self.a, self.b = a, b
        self.alphabet = np.unique(b.code)
        n = len(self.alphabet)
        self.none, self.trash = n, n + 1  # symbols that match nothing, and that aren't in any b
        self.space = int(np.searchsorted(self.alphabet, SPACE))
        self.b_symbol = np.searchsorted(self.alphabet, b.code).astype(np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, a.code), max(n - 1, 0))
        self.a_symbol = (np.where(self.alphabet[at] == a.code, at, self.trash) if n else np.full(len(a.code), self.trash)).astype(np.int32)
        self.words = np.maximum(1, -(-np.diff(a.off) // 64))
        self.tables: dict[int, np.ndarray] = {}

    def measured(self, ia: np.ndarray, ib: np.ndarray, shared: bool) -> np.ndarray:
        """Rows of (common subsequence, shared tokens, their characters) of each pair."""
        out = np.zeros((3, len(ia)), np.int64)
        by = np.lexsort((ia, (self.b.off[ib + 1] - self.b.off[ib]) // 8, self.words[ia]))
        wide = int(self.a.count.max(initial=1)) * int(self.b.count.max(initial=1))
        lanes = max(1, min(LANES, CELLS // max(1, wide)))
        at = 0
        while at < len(by):
            words = int(self.words[ia[by[at]]])
            most = max(1, TABLE // ((self.trash + 1) * words))  # rows of the mask table
            some = by[at : at + lanes]
            some = some[: int(np.searchsorted(self.words[ia[some]], words, side="right"))]
            first_seen = np.sort(np.unique(ia[some], return_index=True)[1])
            if len(first_seen) > most:
                some = some[: first_seen[most]]
            out[:, some] = self._lanes(ia[some], ib[some], words, shared)
            at += len(some)
        return out

    def _lanes(self, ia: np.ndarray, ib: np.ndarray, words: int, shared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = self.a, self.b, len(ia)
        own, row = np.unique(ia, return_inverse=True)
        symbols = padded(a.off, self.a_symbol, own, self.trash)
        if words not in self.tables:
            self.tables[words] = np.zeros((max(1, TABLE // ((self.trash + 1) * words)), self.trash + 1, words), np.uint64)
        table, rows = self.tables[words], np.arange(len(own))
        for k in range(symbols.shape[1]):
            table[rows, symbols[:, k], k // 64] |= np.uint64(1 << k % 64)
        tokens_a, tokens_b = padded(a.token_off, a.token, ia, -1), padded(b.token_off, b.token, ib, -2)
        both_a, both_b = common_tokens(tokens_a, tokens_b) if shared else (np.zeros(tokens_a.shape, bool), np.zeros(tokens_b.shape, bool))
        n_shared = both_a.sum(1)
        chars = (padded(a.token_off, a.token_size, ia, 0) * both_a).sum(1)
        free = np.full((n, words), ~np.uint64(0))
        free[:, 0] -= np.uint64(1)  # the space before the first token, where no token is shared
        if n_shared.any():
            gone_a = self._dropped(padded(a.off, a.of_token, own, both_a.shape[1])[row], a.count[ia], both_a, (symbols == self.space)[row])
            bits = np.zeros((n, 64 * words), np.uint8)
            bits[:, : gone_a.shape[1]] = gone_a
            free = ~np.packbits(bits, axis=1, bitorder="little").view("<u8")
        symbols_b = padded(b.off, self.b_symbol, ib, self.none)
        steps = np.where(self._dropped(padded(b.off, b.of_token, ib, both_b.shape[1]), b.count[ib], both_b, symbols_b == self.space), self.none, symbols_b)
        flat, base = table.reshape(-1, words), row * (self.trash + 1)
        state = np.full((n, words), ~np.uint64(0))
        for j in range(steps.shape[1]):
            hit = flat[base + steps[:, j]] & free & state
            if words == 1:
                state = (state + hit) | (state - hit)
                continue
            carry = np.zeros(n, np.uint64)
            for w in range(words):
                total = state[:, w] + hit[:, w]
                more = total < hit[:, w]
                total = total + carry
                carry = (more | (total < carry)).astype(np.uint64)
                state[:, w] = total | (state[:, w] - hit[:, w])
        for k in range(symbols.shape[1]):
            table[rows, symbols[:, k], k // 64] = 0
        return np.bitwise_count(~state).sum(1).astype(np.int64), n_shared, chars

    @staticmethod
    def _dropped(of_token: np.ndarray, count: np.ndarray, both: np.ndarray, is_space: np.ndarray) -> np.ndarray:
        """Which characters take no part: those of shared tokens, and the space before the first other token."""
        gone = np.take_along_axis(np.column_stack([both, np.ones(len(both), bool)]), of_token, 1)
        open_ = ~both & (np.arange(both.shape[1]) < count[:, None])
        first = np.where(open_.any(1), open_.argmax(1), -1)
        return gone | (is_space & (of_token == first[:, None]))

    def token_set(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        common, n_shared, chars = self.measured(ia, ib, True)
        a, b = self.a, self.b
        return set_ratio(common, n_shared, chars, a.count[ia], b.count[ib], a.size[ia], b.size[ib])

    def token_sort(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        total = self.a.joined()[ia] + self.b.joined()[ib]
        distance = total - 2 * self.measured(ia, ib, False)[0]
        return np.where(total > 0, 100.0 - 100.0 * distance / np.maximum(total, 1), 100.0)


def set_ratio(common, n_shared, chars, count_a, count_b, size_a, size_b) -> np.ndarray:
    """The token set ratio, given the (or a bound of the) common subsequence of the tokens that aren't shared."""
    gap = (n_shared > 0).astype(np.int64)
    n = chars + np.maximum(n_shared - 1, 0)
    p = size_a - chars + np.maximum(count_a - n_shared - 1, 0)
    q = size_b - chars + np.maximum(count_b - n_shared - 1, 0)
    ratio = lambda distance, total: 100.0 - 100.0 * distance / np.maximum(total, 1)
    best = ratio(p + q - 2 * common, 2 * (n + gap) + p + q)
    with_shared = np.maximum(best, np.maximum(ratio(gap + p, 2 * n + gap + p), ratio(gap + q, 2 * n + gap + q)))
    best = np.where(gap > 0, with_shared, best)
    best = np.where((gap > 0) & ((n_shared == count_a) | (n_shared == count_b)), 100.0, best)
    return np.where((count_a == 0) | (count_b == 0), 0.0, best)


class Postings:
    """For each key, the titles that have it."""

    def __init__(self, keys: np.ndarray, titles: np.ndarray):
        by = np.argsort(keys, kind="stable")
        self.titles = titles[by]
        self.keys, first = np.unique(keys[by], return_index=True)
        self.off = np.append(first, len(by))

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        found = [k for k, key in zip(at.tolist(), keys.tolist()) if k < len(self.keys) and self.keys[k] == key]
        return [self.titles[self.off[k] : self.off[k + 1]] for k in found]


def _occurrences(t: Titles) -> tuple[np.ndarray, np.ndarray]:
    """A key for each character's first, second ... occurrence in a title, and the titles."""
    title = np.repeat(np.arange(len(t.count)), np.diff(t.off))
    letter = t.code != SPACE
    code, title = t.code[letter].astype(np.int64), title[letter]
    by = np.lexsort((code, title))
    code, title = code[by], title[by]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (title[1:] != title[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    return nth << 21 | code, title


class TitleIndex:
    """The titles of a block, in the order that settles ties."""

    def __init__(self, texts: list[str], place: np.ndarray):
        self.tokens = Numbers()
        self.titles = Titles(texts, self.tokens)
        self.place = place
        self.by_token = Postings(self.titles.token, np.repeat(np.arange(len(texts)), self.titles.count))
        self.by_char = Postings(*_occurrences(self.titles))

    def bounds(self, own: Titles, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the scores of title ``k`` with all titles of the block, and which of them are the scores."""
        t, n = self.titles, len(self.titles.count)
        count, size = own.count[k], own.size[k]
        gather = lambda lists: np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        chars_both = gather(self.by_char.of(keys))
        n_shared, chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
        tokens = slice(own.token_off[k], own.token_off[k + 1])
        for token, token_size in zip(own.token[tokens], own.token_size[tokens].tolist()):
            for hit in self.by_token.of(np.array([token])):
                n_shared[hit] += 1
                chars[hit] += token_size
        spaces = np.minimum(np.maximum(count - n_shared - 1, 0), np.maximum(t.count - n_shared - 1, 0))
        common = chars_both - chars + spaces
        bound = set_ratio(common, n_shared, chars, count, t.count, size, t.size)
        known = (common == 0) | (n_shared == count) | (n_shared == t.count) | (count == 0) | (t.count == 0)
        return bound, known

    def nearest(self, texts: list[str], n: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each text the ``n`` best titles (ties by place) with their scores, and how many were scored."""
        own = Titles(texts, self.tokens)
        pairs = Pairs(own, self.titles)
        keys, title = _occurrences(own)
        off = np.searchsorted(title, np.arange(len(texts) + 1))
        out, scored = [], np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), SLICE):
            some = [Ranking(*self.bounds(own, k, keys[off[k] : off[k + 1]]), n) for k in range(at, min(at + SLICE, len(texts)))]
            most = FIRST
            while True:
                asked = [r.ask(most) for r in some]
                size = np.array([len(x) for x in asked])
                if not size.sum():
                    break
                found = pairs.token_set(np.repeat(np.arange(len(some)) + at, size), np.concatenate(asked))
                for r, x, score in zip(some, asked, np.split(found, np.cumsum(size)[:-1])):
                    r.answer(x, score)
                scored[at : at + len(some)] += size
                most = NEXT
            out += [r.best(self.place) for r in some]
        return out, scored


class Ranking:
    """The best titles for one text: those with the highest bounds first, all others only if the n-th
    best score lets them in."""

    def __init__(self, bound: np.ndarray, known: np.ndarray, n: int):
        self.bound, self.n = bound, n
        self.score = np.where(known, bound, -1.0)
        self.open = ~known
        self.wide = len(bound) <= 8 * FIRST
        self.near = np.arange(len(bound)) if self.wide else np.argpartition(-bound, 8 * FIRST)[: 8 * FIRST]
        self.edge = self.bound[self.near].min() if len(bound) else 0.0  # no title beyond these has a higher bound
        self.top = np.zeros(0)
        self._heard(bound[known])

    def least(self) -> float:
        """The n-th best score so far; -1 where so many haven't been scored."""
        return float(self.top.min()) if len(self.top) == self.n else -1.0

    def _heard(self, score: np.ndarray) -> None:
        both = np.concatenate([self.top, score])
        self.top = np.partition(both, len(both) - self.n)[len(both) - self.n :] if len(both) > self.n else both

    def ask(self, most: int) -> np.ndarray:
        least = self.least()
        self.near = self.near[self.bound[self.near] >= least]  # titles below the bar never come back
        todo = self.near[self.open[self.near]]
        if not len(todo) and not self.wide and self.edge >= least:
            self.wide, self.near = True, np.flatnonzero(self.bound >= least)
            todo = self.near[self.open[self.near]]
        return todo[np.argpartition(-self.bound[todo], most)[:most]] if len(todo) > most else todo

    def answer(self, titles: np.ndarray, score: np.ndarray) -> None:
        self.score[titles] = score
        self.open[titles] = False
        self._heard(score)

    def best(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = self.near[self.score[self.near] >= max(0.0, self.least())]
        top = top[np.lexsort((place[top], -self.score[top]))[: self.n]]
        return top, self.score[top]


def best_of_pools(own: list[str], own_pool: np.ndarray, texts: list[str], pool: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each own title the ``n`` best titles of its (small) pool, ties by place: own numbers, title numbers,
    scores, and how many titles each own one was scored with. All pairs of all pools are measured at once."""
    by = np.argsort(pool, kind="stable")
    first = np.searchsorted(pool[by], own_pool)
    size = np.searchsorted(pool[by], own_pool, side="right") - first
    ia = np.repeat(np.arange(len(own)), size)
    ib = by[np.arange(len(ia)) + np.repeat(first - (np.cumsum(size) - size), size)]
    tokens = Numbers()
    score = Pairs(Titles(own, tokens), Titles(texts, tokens)).token_set(ia, ib)
    order = np.lexsort((place[ib], -score, ia))
    rank = np.arange(len(ia)) - np.repeat(np.cumsum(size) - size, size)
    top = order[rank < n]
    return ia[top], ib[top], score[top], size
