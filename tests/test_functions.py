"""Scalar functions against expected values and against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tarifa.functions import similarity as M
from tarifa.functions import spec as S
from tarifa.functions import text as X

SPECS = [
    ("农夫山泉 饮用天然水 550ml*24瓶", "volume", 13200, 24),
    ("可口可乐 汽水 330ml×6罐", "volume", 1980, 6),
    ("金龙鱼 食用调和油 5L", "volume", 5000, 1),
    ("伊利 纯牛奶 250ml 12盒装", "volume", 3000, 12),
    ("三只松鼠 每日坚果 750g/盒", "weight", 750, 1),
    ("净含量：500g", "weight", 500, 1),
    ("五常大米 2斤", "weight", 1000, 1),
    ("雀巢咖啡 1kg", "weight", 1000, 1),
    ("24*500ml 整箱", "volume", 12000, 24),
    ("红富士苹果 5个装", "count", 5, 5),
    ("抽纸 6连包", "count", 6, 6),
    ("维生素C 1000mg*60片", "weight", 60, 60),
    ("第二件5折 康师傅红烧牛肉面 103g*5包", "weight", 515, 5),
    ("24*500ml*2", "volume", 1000, 2),
    ("500ml 300袋", "volume", 500, 1),
    ("999感冒灵颗粒", "unknown", None, 1),
    ("乐事 薯片 原味 大包装", "unknown", None, 1),
    ("500ML", "unknown", None, 1),
    ("500ml装", "unknown", None, 1),
    ("99999999999999个", "unknown", None, 1),
    ("0g 5个", "weight", None, 5),
    ("", "unknown", None, 1),
]


def N(name):
    return X.normalize_text(F.col(name))


def column(spark, values, *exprs):
    return spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], "k int, a string" + (", b string" if isinstance(values[0], tuple) else "")).orderBy("k").select(*exprs).collect()


def test_parse_spec(spark):
    rows = column(spark, [t for t, *_ in SPECS], S.parse_spec(N("a")).alias("s"))
    for (title, unit, total, count), (s,) in zip(SPECS, rows):
        if total is not None:
            assert (s.unit, s.total_base, s["count"]) == (unit, total, count), title
        else:
            assert not (s.total_base or 0) > 0, title


def test_spec_text_comes_first_and_null_is_empty(spark):
    rows = column(spark, [("某商品 促销中", "500ml*6瓶"), ("某商品 2kg", "无"), ("纸 5个", None), (None, None)], S.parse_spec(N("a"), N("b")).alias("s"))
    assert [r.s.total_base for r in rows] == [3000, 2000, 5, None]


def test_display_and_general(spark):
    rows = column(spark, ["维生素C 1000mg*60片", "550ml*24瓶", "5L", "5个装", "无规格", ""], S.spec_display(S.parse_spec(N("a"))).alias("d"))
    assert [r.d for r in rows] == ["1g×60 (合计60g)", "550ml×24 (合计13200ml)", "5000ml", "5件", "无规格", "未解析"]
    values = [0.0, 1.0, 0.1, 123456.0, 1234567.0, 999999.5, 0.00012345678, 0.00001234, 28.3495, 453.592 * 3, 1e15, 2.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(S.general(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == [f"{v:g}" for v in values]


def test_unit_price(spark):
    df = spark.createDataFrame([("a 500g", 10.0), ("a 5个", 10.0), ("a", 10.0), ("a 500g", None)], "t string, p double")
    s = S.parse_spec(N("t"))
    rows = df.select(S.unit_price(F.col("p"), s).alias("u"), S.unit_price_label(s).alias("l")).collect()
    assert [tuple(r) for r in rows] == [(2.0, "元/100g"), (2.0, "元/件"), (None, "—"), (None, "元/100g")]


def test_clean_values(spark):
    texts = [" a　", "NaN", "n/a", "—", None, "0", "\tx\n"]
    assert [r.c for r in column(spark, texts, X.clean_str(F.col("a")).alias("c"))] == ["a", "", "", "", "", "0", "x"]
    prices = ["¥12.90", "12.9元", "1,299", "￥ 5", "-", "nan", "", None, "abc", "1.5d", "0x1p3", "1e3", "-2", ".5", "5."]
    want = [12.9, 12.9, 1299.0, 5.0, None, None, None, None, None, None, None, 1000.0, -2.0, 0.5, 5.0]
    assert [r.p for r in column(spark, prices, X.parse_price(F.col("a")).alias("p"))] == want


def test_nfkc_of_every_character_and_of_sequences(spark):
    every = ["a" + chr(c) + "b" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(7)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    pairs = [p for p in (unicodedata.decomposition(chr(c)) for c in range(0x110000)) if p and p[0] != "<"]
    second = sorted({chr(int(x, 16)) for p in pairs for x in p.split()[1:]})
    letters = list("aeoAO牛か가ｶ1") + [chr(c) for c in (0x1100, 0x1161, 0x11A8, 0x1D7D8, 0x1F600, 0xFB01, 0x2F800)]
    mixed = ["".join(rng.choice(rng.choice((letters, marks, second))) for _ in range(rng.randint(1, 6))) for _ in range(10_000)]
    texts = [*every, *mixed, "ＡＢＣ１２３　ｘ", "㎏½№", "可乐 500ml", "𝟓𝟎𝟎ml*𝟐", "가", "é", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, a string").repartition(8)
    want = spark.createDataFrame([(k, unicodedata.normalize("NFKC", t)) for k, t in enumerate(texts)], "k int, n string")
    assert df.select("k", X.nfkc(F.col("a")).alias("n")).exceptAll(want).count() == 0


def test_text_beyond_the_first_plane_has_a_specification(spark):
    rows = column(spark, ["𝟓𝟎𝟎ml*𝟐", "Cafe\u0301 250g"], S.parse_spec(N("a"))["total_base"].alias("t"), X.clean_title(N("a")).alias("c"))
    assert [tuple(r) for r in rows] == [(1000.0, ""), (250.0, "café")]


def test_titles(spark):
    texts = ["【自营】农夫山泉 饮用天然水 550ml*24瓶", "第二件5折 Café 可乐(330ml×6罐) 特价!", "蒙牛 特仑苏 纯牛奶 250ml*16盒", "", None]
    assert [r.c for r in column(spark, texts, X.clean_title(N("a")).alias("c"))] == ["农夫山泉 饮用天然水", "café 可乐", "蒙牛 特仑苏 纯牛奶", "", ""]


def test_brand_category_line(spark):
    rows = column(spark, [("农夫山泉 饮用天然水", ""), ("PRESIDENT 黄油", " "), ("康师傅香辣牛肉面", "自有"), ("蒙牛特仑苏纯牛奶", None), ("猪肉", "")], X.extract_brand(N("a"), F.col("b")).alias("b"), X.extract_category(N("a")).alias("c"), X.extract_product_line(N("a")).alias("l"))
    assert [tuple(r) for r in rows] == [("农夫山泉", "饮用水", ""), ("PRESIDENT", "", ""), ("自有", "面条", ""), ("蒙牛", "牛奶", "特仑苏"), ("", "肉类", "")]


@pytest.mark.parametrize(("a", "b", "conflict"), [("康师傅 香辣牛肉面", "康师傅 红烧牛肉面", True), ("康师傅 香辣牛肉面", "康师傅香辣 牛肉面 袋装", False), ("纯牛奶", "低脂纯牛奶", False), ("老坛酸菜面 袋装", "老坛酸菜面 桶装", False), ("酸菜面", "老坛酸菜面", True)])
def test_variant_conflict(spark, a, b, conflict):
    assert column(spark, [(a, b)], X.variant_conflict(X.extract_variants(N("a")), X.extract_variants(N("b"))).alias("c"))[0].c is conflict


def test_line_mismatch(spark):
    rows = column(spark, [("", ""), ("特仑苏", ""), ("特仑苏", "金典")], X.line_mismatch(F.col("a"), F.col("b")).alias("m"))
    assert [r.m for r in rows] == ["", "仅一方标注产品线（特仑苏）", "产品线不同（特仑苏 vs 金典）"]


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_both_forms_of_the_ratios_agree(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("ab牛奶 ") for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(300)]
    rows = column(spark, pairs, "a", "b", M.common_subsequence(F.col("a"), F.col("b")).alias("n"), M.token_set_ratio(F.col("a"), F.col("b")).alias("s1"), M.token_set_ratio_arrow(F.col("a"), F.col("b")).alias("s2"), M.token_sort_ratio(F.col("a"), F.col("b")).alias("t1"), M.token_sort_ratio_arrow(F.col("a"), F.col("b")).alias("t2"), M.bigram_similarity(F.col("a"), F.col("b")).alias("g"))
    for r in rows:
        assert r.n == _subsequence(r.a, r.b) == M.subsequence_length(r.a, r.b)
        assert r.s1 == pytest.approx(r.s2, abs=1e-9) and r.t1 == pytest.approx(r.t2, abs=1e-9), (r.a, r.b)
        a, b = ({s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else ({s} if s else set()) for s in (r.a.replace(" ", ""), r.b.replace(" ", "")))
        assert r.g == pytest.approx(100 * len(a & b) / len(a | b) if a and b else 0.0)


@pytest.mark.parametrize(("letters", "most"), [("ab牛奶 ", 12), ("abcdef  牛😀", 90), ("ab cdefgh", 220)])
def test_lanes_measure_as_one_pair_does(letters, most):
    """Titles of one, two and several words of bits, with shared, repeated and no tokens."""
    import numpy as np

    from tarifa.functions import lanes

    rng = random.Random(most)
    titles = ["", " ", "ab", *("".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(120))]
    ia, ib = (np.array([rng.randrange(len(titles)) for _ in range(900)]) for _ in range(2))
    for distinct, plain in ((True, M.token_set), (False, M.token_sort)):
        numbers = lanes.Numbers()
        pairs = lanes.Pairs(lanes.Titles(titles, numbers, distinct), lanes.Titles(titles[::-1], numbers, distinct))
        got = (pairs.token_set if distinct else pairs.token_sort)(ia, ib)
        assert got.tolist() == [plain(titles[i], titles[::-1][j]) for i, j in zip(ia, ib)]


def test_index_finds_the_best_titles():
    import numpy as np

    from tarifa.functions import lanes

    rng = random.Random(8)
    titles = ["".join(rng.choice("abc牛奶 ") for _ in range(rng.randint(0, 14))) for _ in range(700)]
    place = np.array(rng.sample(range(5000), 700))
    own = ["", "zz", *titles[:40]]
    for n in (1, 20, 900):
        found, scored = lanes.TitleIndex(titles, place).nearest(own, n)
        for text, (best, score), asked in zip(own, found, scored):
            every = np.array([M.token_set(text, t) for t in titles])
            want = np.lexsort((place, -every))[:n]
            assert best.tolist() == want.tolist() and score.tolist() == every[want].tolist() and asked <= 700


def test_best_of_small_pools():
    import numpy as np

    from tarifa.functions import lanes

    rng = random.Random(10)
    title = lambda: "".join(rng.choice("abc牛奶 ") for _ in range(rng.randint(0, 9)))
    own, texts = [title() for _ in range(40)], [title() for _ in range(90)]
    own_pool, pool, place = np.array([rng.randrange(9) for _ in own]), np.array([rng.randrange(8) for _ in texts]), np.array(rng.sample(range(999), 90))
    ia, ib, score, size = lanes.best_of_pools(own, own_pool, texts, pool, place, 5)
    want = []
    for i, t in enumerate(own):
        found = sorted((j for j in range(90) if pool[j] == own_pool[i]), key=lambda j: (-M.token_set(t, texts[j]), place[j]))
        assert size[i] == len(found)
        want += [(i, j, M.token_set(t, texts[j])) for j in found[:5]]
    assert list(zip(ia.tolist(), ib.tolist(), score.tolist())) == want


def _by_patterns(s, lexicon):
    """The four specification rules as one expression each: (raw, number, unit, count) of the first that fits."""
    import re

    from tarifa.lexicon import SPEC_NOISE, longest_first

    s = re.sub(SPEC_NOISE, " ", s)
    unit, count = ("|".join(map(re.escape, longest_first(list(w)))) for w in (lexicon.measures, lexicon.count_words))
    number = r"\d+(?:\.\d+)?"
    if m := re.search(rf"({number})\s*({unit})\s*\*\s*(\d+)\s*(?:{count})?", s):
        return m[0].strip(), m[1], m[2], m[3]
    if m := re.search(rf"(\d+)\s*(?:{count})?\s*\*\s*({number})\s*({unit})", s):
        return m[0].strip(), m[2], m[3], m[1]
    if m := re.search(rf"({number})\s*({unit})(?![a-zA-Z一-鿿])", s):
        c = re.search(rf"(\d+)\s*({count})", s[: m.start()] + " " + s[m.end() :])
        if c and 1 < int(c[1]) <= 200:
            return m[0].strip() + "*" + c[0].strip(), m[1], m[2], c[1]
        return m[0].strip(), m[1], m[2], "1"
    if (m := re.search(rf"(\d+)\s*({count})", s)) and 0 < int(m[1]) <= 500:
        return m[0].strip(), "1", m[2], m[1]
    return None


def test_token_rules_find_what_patterns_find():
    from tarifa.functions.titles import Reader, normal
    from tarifa.lexicon import DEFAULT

    rng, read = random.Random(4), Reader()
    parts = ["1", "2", "10", "300", "2.5", "1.5.500", ".", "*", " ", " ", "ml", "l", "lb", "kg", "g", "克", "斤", "瓶", "包装", "包", "个", "x", "的", "b", "第二件5折", "买2送1"]
    hits = 0
    for _ in range(30_000):
        s = normal("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))))
        got, want = read.rule(s), _by_patterns(s, DEFAULT)
        assert (got is None) == (want is None), s
        if got:
            hits += 1
            times = max(1, int(want[3]))
            assert (got.raw, got.qty, got.unit_text) == (want[0], float(want[1]), want[2]) and got.count == times, (s, got, want)
    assert hits > 7_000


def _by_scan(title, lexicon):
    """Word lists one word at a time."""
    from tarifa.lexicon import longest_first

    def first(words):
        found = [(low.find(w.lower()), -len(w)) for w in words if w.lower() in low]
        return (lambda p: title[p[0] : p[0] - p[1]])(min(found)) if found else ""

    low = title.lower()
    hints = longest_first([h for hints in lexicon.category_hints.values() for h in hints])
    hint = next((h for h in hints if h in low), None)
    category = next((name for name, hints in lexicon.category_hints.items() if hint in hints), "") if hint else ""
    return first(lexicon.brands), category, [next((w for w in longest_first(g) if w in title), None) for g in lexicon.variants.values()], first(lexicon.product_lines)


def test_automaton_finds_what_a_scan_finds():
    from tarifa.functions.titles import Reader
    from tarifa.lexicon import DEFAULT

    rng, read = random.Random(6), Reader()
    words = [*DEFAULT.brands, *DEFAULT.product_lines, *(w for g in (*DEFAULT.variants.values(), *DEFAULT.category_hints.values()) for w in g)]
    for _ in range(3000):
        title = "".join(rng.choice([rng.choice(words), rng.choice(words)[: rng.randint(1, 3)], " ", "PRESIDENT", "qq星", "大"]) for _ in range(rng.randint(0, 6)))
        assert tuple(read.words(title)) == _by_scan(title, DEFAULT), title


def test_lexicon_of_many_brands(spark):
    """100,000 brands of master data; a title costs no more than with the short list."""
    import dataclasses
    import time

    from tarifa.functions.titles import Reader
    from tarifa.lexicon import DEFAULT

    rng = random.Random(9)
    letters = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥abcdefghij"
    brands = list({"".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(101_000)})[:100_000]
    large = dataclasses.replace(DEFAULT, brands=[*brands, *DEFAULT.brands])
    names = rng.sample(brands, 400)
    rows = column(spark, [f"大号 {n} 牛奶 500g" for n in names], X.extract_brand(N("a"), lexicon=large).alias("b"))
    scan = lambda t: min((t.find(b), -len(b)) for b in large.brands if b in t)
    for (got,), name in zip(rows[:25], names):
        title = f"大号 {name} 牛奶 500g"
        at, size = scan(title)
        assert got == title[at : at - size]
    titles = [f"{a} {b} 牛奶 500g*2" for a, b in zip(rng.choices(names, k=4000), rng.choices(names, k=4000))]
    took = []
    for lexicon in (DEFAULT, large):
        read, began = Reader(lexicon), time.thread_time()
        for t in titles:
            read.words(t)
        took.append(time.thread_time() - began)
    assert took[1] < 6 * took[0] + 0.05


def test_trimmed_drops_what_the_pattern_drops(spark):
    df = spark.range(0x10000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c")).select(F.concat("c", F.lit("a b"), "c", "c").alias("t"))
    assert df.filter(X.trimmed(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


def test_texts_read_before_are_rows_of_a_table():
    from tarifa.functions import titles
    from tarifa.lexicon import DEFAULT

    reader, texts = titles.Reader(DEFAULT), ["蒙牛 纯牛奶 250ml*16盒", None, "", "蒙牛 纯牛奶 250ml*16盒", "水 5个装"]
    for some in (texts, texts[::-1], []):
        got = reader.rows(some, ["", None, "x", "", ""][: len(some)])
        assert got.to_pylist() == titles.pa.array([reader.read(t, f) for t, f in zip(some, ["", None, "x", "", ""])], titles.READ_TYPE).to_pylist()
    assert len(reader.table) == len(reader.places)


def test_ranking_keeps_no_title_below_the_bar():
    """Best titles equal those of scoring all, and titles that can't be among them don't stay to be looked at again."""
    import numpy as np

    from tarifa.functions import lanes

    texts = ["q" + str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(5000)]
    index, own = lanes.TitleIndex(texts, np.arange(5000)), ["qbcde", "qah", "x"]
    titles = lanes.Titles(own, index.tokens)
    keys, title = lanes._occurrences(titles)
    pairs = lanes.Pairs(titles, index.titles)
    for k, t in enumerate(own):
        ranking = lanes.Ranking(*index.bounds(titles, k, keys[title == k]), 20)
        while len(asked := ranking.ask(256)):
            ranking.answer(asked, pairs.token_set(np.full(len(asked), k), asked))
        all_of = pairs.token_set(np.full(5000, k), np.arange(5000))
        want = np.lexsort((np.arange(5000), -all_of))[:20]
        if t != "x":  # all scores of the last are zero
            assert len(ranking.near) < 2500 and ranking.least() == all_of[want].min()
        assert ranking.best(np.arange(5000))[0].tolist() == want.tolist()


def test_spread_takes_more_partitions_for_more_work(spark):
    from tarifa.operators.tables import spread

    assert spread(spark.range(10), "id", least=9).rdd.getNumPartitions() == 9 and spread(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_trimming_cuts_only_text_with_white_ends(spark):
    """The same for every white character at either end; text with dark ends isn't walked through (its plan asks the ends first)."""
    dark = ["a", "~", "!", "\x7f", "é", "、", "水", "😀", "\x1c", "​"]
    rows = [w + a + "x y" + b + v for w in ["", *X.WHITE] for a in dark for b in dark for v in ["", *X.WHITE[:3], *X.WHITE[-2:]]] + ["", " ", "　", None, "NaN", " n/a　", "—", "nonE ", "İ"]
    got = spark.createDataFrame(list(enumerate(rows)), "k int, s string").select("k", X.trimmed(F.col("s")).alias("t"), X.clean_str(F.col("s")).alias("c")).collect()
    null = {"", "nan", "none", "null", "na", "n/a", "-", "—"}
    for r in got:
        want = rows[r.k] and rows[r.k].strip(X.WHITE)
        assert r.t == want and r.c == ("" if (want or "").lower() in null else want), repr(rows[r.k])
    assert "ascii" in str(X.trimmed(F.col("s"))).lower()
