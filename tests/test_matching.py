"""The match cascade, its outcome table, and comparison rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarifa import schemas as C
from tarifa.operators import compare as P
from tarifa.operators import judge as J
from tarifa.operators import matching as M
from tarifa.operators import products as R
from tarifa.operators import report as O
from tarifa.operators.tables import cut

RAW = "platform string, platform_ord int, ord long, sku_id string, title string, price string, barcode string, brand string, category string"


def make(spark, *rows):
    out = []
    for k, r in enumerate(rows):
        platform, sku, title = r[:3]
        more = dict(zip(("price", "barcode", "brand", "category"), r[3:]))
        out.append((platform, {"self": 0, "r": 1, "q": 2}[platform], k, sku, title, more.get("price", "10"), more.get("barcode", ""), more.get("brand", ""), more.get("category", "")))
    df = cut(R.to_products(spark.createDataFrame(out, RAW)), "products")
    return df.filter("platform = 'self'"), df.filter("platform <> 'self'")


def match(spark, *rows, verdicts=None, **config):
    own, rivals = make(spark, *rows)
    return {(r.self_uid, r.platform): r for r in M.match_all(own, rivals, M.MatchConfig(**config), verdicts).collect()}


def test_barcodes(spark):
    got = match(spark, ("self", "S1", "甲 水", "5", "6921168509256"), ("self", "S2", "乙 油", "5", "nan"), ("r", "R1", "完全不同 茶", "5", "6921168509256"), ("r", "R2", "另一 酒", "5", "6921168509256"), ("r", "R3", "丙", "5", ""))
    a, b = got["self:S1", "r"], got["self:S2", "r"]
    assert (a.rival_uid, a.score, a.level, a.confidence, a.reason, a.need_review) == ("r:R1", 100.0, C.BARCODE, 1.0, "条码一致 6921168509256", False)
    assert b.level == C.NONE and b.rival_uid is None


def test_brand_spec_needs_one_candidate_without_conflict(spark):
    got = match(spark, ("self", "S1", "康师傅 香辣牛肉面 103g*5包"), ("r", "R1", "康师傅 红烧牛肉面 103g*5包"))
    assert got["self:S1", "r"].level == C.NONE and got["self:S1", "r"].reason == "无候选商品"
    got = match(spark, ("self", "S1", "康师傅 香辣牛肉面 103g*5包"), ("r", "R1", "康师傅 香辣牛肉面 515g"))
    assert (got["self:S1", "r"].level, got["self:S1", "r"].score) == (C.BRAND_SPEC, 96.0)
    assert got["self:S1", "r"].reason == "品牌/品类/规格一致（康师傅 · 面条 · 103g×5 (合计515g)）"


def test_variants_choose_the_right_rival(spark):
    got = match(spark, ("self", "S1", "康师傅 香辣牛肉面 103g*5包"), ("r", "R1", "康师傅 红烧牛肉面 103g*5包"), ("r", "R2", "康师傅香辣牛肉面 103g×5袋"))["self:S1", "r"]
    assert (got.rival_uid, got.level) == ("r:R2", C.FUZZY)
    assert got.score == pytest.approx(0.6 * 100 * 16 / 17 + 40) and got.confidence == pytest.approx(got.score / 100)


def test_recall_order(spark):
    own, rivals = make(spark, ("self", "S1", "农夫山泉 饮用天然水 550ml*24瓶"), ("r", "R1", "农夫山泉 饮用天然水 4L*4桶"), ("r", "R2", "农夫山泉 饮用天然水 550ml*24瓶"))
    rows = M.recall(M.with_platforms(own, rivals), rivals).orderBy("rank").collect()
    assert [r.rival_uid for r in rows] == ["r:R2", "r:R1"]
    assert rows[0].score == pytest.approx(100) and rows[1].score == pytest.approx(100 - (16000 / 13200 - 1) / 3 * 12)
    assert rows[1].reason == "文本相似 100.0，规格差 1.2×（550ml×24 (合计13200ml) vs 4000ml×4 (合计16000ml)） 扣 0.8"


def test_other_category_falls_back_and_is_rejected(spark):
    got = match(spark, ("self", "S1", "农夫山泉 饮用水 550ml"), ("r", "R1", "蓝月亮 洗衣液 3kg"))["self:S1", "r"]
    assert got.rival_uid is None and got.reason.startswith("最高分 ") and got.reason.endswith(" 低于阈值 55")


GRAY = (("self", "S1", "蒙牛 纯牛奶 250ml*16盒"), ("r", "R1", "蒙牛 特仑苏 纯牛奶 250ml*16盒"))


@pytest.mark.parametrize(
    ("judge", "verdict", "want"),
    [
        ("disabled", None, ("r:R1", C.FUZZY, 0.55, True, "扣 20")),
        ("unavailable", None, ("r:R1", C.FUZZY, 0.55, True, "（未启用 AI 判定）")),
        ("verdicts", [], ("r:R1", C.FUZZY, 0.55, True, "（AI 未给出判定）")),
        ("verdicts", [True, 0.9, "同款"], ("r:R1", C.JUDGED, 0.9, False, "AI 判定匹配：同款")),
        ("verdicts", [True, 0.6, "x"], ("r:R1", C.JUDGED, 0.6, True, "AI 判定匹配：x")),
        ("verdicts", [False, 0.9, "不同"], (None, C.NONE, 0.9, False, "AI 判定不匹配：不同")),
        ("verdicts", [False, 0.5, ""], (None, C.NONE, 0.5, True, "AI 判定不匹配：")),
    ],
)
def test_gray_zone(spark, judge, verdict, want):
    rows = [("self:S1", "r", *verdict)] if verdict else []
    got = match(spark, *GRAY, verdicts=spark.createDataFrame(rows, C.VERDICT), judge=judge)["self:S1", "r"]
    assert got.score == pytest.approx(55.0) and (got.rival_uid, got.level, got.need_review) == (want[0], want[1], want[3])
    assert got.confidence == pytest.approx(want[2]) and got.reason.endswith(want[4])


def test_judge_batches_and_failures(spark):
    own, rivals = make(spark, *GRAY, ("self", "S2", "蒙牛 纯牛奶 1L", "3"))
    pending = M.with_platforms(own, rivals)
    _, gray = M.route_best(pending, M.recall(pending, rivals).filter("rank = 1"), M.MatchConfig())

    def judge(instructions, prompt, schema):
        assert instructions and schema["required"] == ["results"]
        if "1000ml" in prompt:
            raise TimeoutError
        return json.dumps({"results": [{"index": 0, "is_match": True, "confidence": 0.8, "reason": prompt}, {"index": 7, "is_match": True, "confidence": 1, "reason": ""}]})

    rows = J.adjudicate(gray, own, rivals, judge, batch_size=1).collect()
    assert [(r.self_uid, r.is_match, r.confidence) for r in rows] == [("self:S1", True, 0.8)]
    assert "[0]\n  我方商品：标题：蒙牛 纯牛奶 250ml*16盒 | 品牌：蒙牛 | 规格：250ml×16 (合计4000ml) | 售价：10.00元\n  竞品商品：标题：蒙牛 特仑苏" in rows[0].reason
    pairs = M.match_all(own, rivals, M.MatchConfig(judge="verdicts", batch_size=1), judge=judge).collect()
    got = {r.self_uid: (r.level, r.need_review) for r in pairs}
    assert got["self:S1"] == (C.JUDGED, False) and got["self:S2"][0] in (C.FUZZY, C.NONE)


def test_verdicts_are_kept_and_asked_once(spark, tmp_path):
    """Two runs, a run that failed half way, and products that are told in the same words."""
    words = "水 奶 油 面 茶 糖 盐 醋".split()
    rows = [("self", f"S{k}", f"蒙牛 {w} 250ml", "5") for k, w in enumerate(words)] + [("self", "T0", "蒙牛 水 250ml", "5"), ("r", "R", "蒙牛 特仑苏 酸", "5")]
    own, rivals = make(spark, *rows)
    gray = own.select(F.col("uid").alias("self_uid"), F.lit("r").alias("platform"), F.lit("r:R").alias("rival_uid"))
    calls, store, broken = tmp_path / "calls", str(tmp_path / "store"), tmp_path / "broken"
    broken.touch()

    def judge(instructions, prompt, schema):
        if broken.exists() and "蒙牛 糖" in prompt:
            raise RuntimeError("the service is gone")  # no soft failure: the task fails
        with calls.open("a", encoding="utf-8") as f:
            f.write(prompt.split("标题：")[1].split(" | ")[0] + "\n")
        return {"results": [{"index": 0, "is_match": "水" in prompt, "confidence": 0.8, "reason": "r"}]}

    run = lambda: {r.self_uid: r.is_match for r in J.adjudicate(gray, own, rivals, judge, batch_size=1, concurrency=8, store=store).collect()}
    asked = lambda: calls.read_text(encoding="utf-8").split("\n")[:-1]
    with pytest.raises(Exception, match="the service is gone"):
        run()
    kept = spark.read.parquet(store).count() if list((tmp_path / "store").glob("*.parquet")) else 0
    before = len(asked())
    broken.unlink()
    found = run()
    assert len(found) == 9 and found["self:S0"] and found["self:T0"] and not found["self:S3"]
    assert len(asked()) - before == 8 - kept  # all that weren't kept, each once
    assert run() == found and len(asked()) - before == 8 - kept
    spark.createDataFrame([], gray.schema).createOrReplaceTempView("none")
    assert J.adjudicate(spark.table("none"), own, rivals, judge).count() == 0


def test_answers_of_a_judge():
    r = {"index": "1", "is_match": 1, "reason": None}
    assert J.verdicts_of({"results": [r, {"index": 2, "is_match": True}]}, 2) == {1: {"is_match": True, "confidence": 0.0, "reason": ""}}
    assert J.verdicts_of("{}", 3) == {} and J.load(None) is None and J.load("no.such.module:f") is None and J.load("json:loads") is json.loads
    for bad in ("no json", '{"results": [{"index": 0}]}', "[1]"):
        with pytest.raises(J.SOFT):
            J.verdicts_of(bad, 1)


def test_compare_command_asks_the_judge(spark, tmp_path, monkeypatch, capsys):
    from tarifa import cli

    (tmp_path / "fixture_judge.py").write_text("def answer(instructions, prompt, schema):\n    return {'results': [{'index': 0, 'is_match': '特仑苏' not in prompt, 'confidence': 0.9, 'reason': '产品线不同'}]}\n", encoding="utf-8")
    spark.sparkContext.addPyFile(str(tmp_path / "fixture_judge.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "self_1.csv").write_text("sku_id,title,price\nS1,蒙牛 纯牛奶 250ml*16盒,60\nS2,农夫山泉 水 550ml,2\n", encoding="utf-8")
    (inbox / "r_1.csv").write_text("sku_id,title,price\nR1,蒙牛 特仑苏 纯牛奶 250ml*16盒,50\nR2,农夫山泉 水 550ml,1\n", encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"competitors": [{"key": "r", "name": "R"}], "ingest": {"inbox_dir": str(inbox), "archive_dir": str(tmp_path / "old")}, "matching": {"llm": {"judge": "fixture_judge:answer"}}, "report": {"output_dir": str(tmp_path / "out"), "html_name": "p.html"}}), encoding="utf-8")
    assert cli.main(["-c", str(tmp_path / "c.json"), "compare"]) == 0
    page = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out/p_rows").glob("*.js"))
    assert "AI 判定不匹配：产品线不同" in page and "比价完成：2 个商品，1 个产出有效价差" in capsys.readouterr().out
    assert not list(inbox.iterdir()) and len(list((tmp_path / "old").iterdir())) == 2
    # commands leave no tables behind
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    (inbox / "self_2.csv").write_text("sku_id,title,price\nS1,水 550ml,2\nS1,again,2\n", encoding="utf-8")
    assert cli.main(["-c", str(tmp_path / "c.json"), "collect"]) == 0 and "(self): 1" in capsys.readouterr().out and set(shared.iterdir()) == before


def _brute_recall(own, rivals, n, k):
    """Pool, coarse cut and ranking of one product in plain Python."""
    from tarifa.functions.similarity import token_set

    pool = [r for r in rivals if not (own["category"] and r["category"] and own["category"] != r["category"])] or rivals
    rough = sorted((r for r in pool if r["norm_title"]), key=lambda r: (-token_set(own["norm_title"], r["norm_title"]), r["ord"]))[:n]
    return [r["uid"] for r in rough]


def test_coarse_cut_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words, cats = ["水", "茶 红", "奶", "油 花", "面", ""], ["甲", "乙", "丙", ""]
    rows = [("self", f"S{k}", f"n{k}", "1", "", "b", rng.choice([*cats, "丁"])) for k in range(12)] + [("r", f"R{k}", f"m{k}", "1", "", "b", rng.choice(cats)) for k in range(60)]
    own, rivals = make(spark, *rows)
    titles = F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("uid"), F.lit(len(words))) + 1).cast("int"))
    own, rivals = own.withColumn("norm_title", titles), rivals.withColumn("norm_title", titles)
    config = M.MatchConfig(top_k=20, part=3, block=7)
    got = M.recall(M.with_platforms(own, rivals), rivals, M.MatchConfig(top_k=5, part=3, block=7)).groupBy("self_uid").agg(F.collect_set("rival_uid").alias("r")).collect()
    everything = [r.asDict() for r in rivals.collect()]
    for r in got:
        mine = own.filter(F.col("uid") == r.self_uid).first().asDict()
        assert set(r.r) <= set(_brute_recall(mine, everything, 20, 5)) and len(r.r) == 5 and config.coarse == 80


def random_titles(rng, n):
    """Distinct titles of a few words of a common vocabulary."""
    chars = "牛奶水油米面茶咖啡纸洗衣液可乐果汁薯片饼干巧克力糖红绿蓝大小新鲜原味香辣甜酸特级优选经典abcdefgh"
    words = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    out = set()
    while len(out) < n:
        out.add(" ".join(rng.sample(words, rng.randint(2, 5))))
    return sorted(out)


def test_similarity_join_scores_few_pairs(spark):
    """20,000 distinct titles in one category: the exact top 20, with under 5 % of the pairs scored."""
    import random

    import numpy as np

    from tarifa.functions import lanes

    titles = random_titles(random.Random(11), 20_600)
    random.Random(12).shuffle(titles)
    mine, theirs = titles[:600], titles[600:]
    schema = "platform string, category string, norm_title string, ord long"
    pending = spark.createDataFrame([("r", "甲", t, 0) for t in mine], schema)
    rivals = spark.createDataFrame([("r", "甲", t, (7919 * k) % 20_000) for k, t in enumerate(theirs)], schema)
    got = cut(M.nearest_titles(pending, rivals, 20, M.MatchConfig(block=12_000, part=100)), "nearest")
    assert got.agg(F.sum("scored")).first()[0] < 0.05 * len(mine) * len(theirs) and got.count() == 20 * len(mine)
    numbers = lanes.Numbers()
    pairs = lanes.Pairs(lanes.Titles(mine, numbers), lanes.Titles(theirs, numbers))
    place = (7919 * np.arange(20_000)) % 20_000
    found = {}
    for r in got.orderBy("s_title", F.desc("coarse"), "first").collect():
        found.setdefault(r.s_title, []).append((r.r_title, r.coarse))
    for k in range(0, 600, 15):  # every score of each fifteenth title
        score = pairs.token_set(np.full(20_000, k), np.arange(20_000))
        best = np.lexsort((place, -score))[:20]
        assert found[mine[k]] == [(theirs[j], score[j]) for j in best]


SPEC = "500g"


def compare(spark, own_price, own_title, rivals, **config):
    """rivals: (platform, title, price, need_review)"""
    own, other = make(spark, ("self", "S", own_title, own_price), *[(p, "R", t, x) for p, t, x, _ in rivals])
    pairs = spark.createDataFrame([("self:S", p, {"r": 1, "q": 2}[p], f"{p}:R", 90.0, C.FUZZY, 0.9, "", rv) for p, _, _, rv in rivals], "self_uid string, platform string, platform_ord int, rival_uid string, score double, level string, confidence double, reason string, need_review boolean")
    return P.compare_rows(own, pairs, other, P.CompareConfig(**config)).first()


@pytest.mark.parametrize(
    ("price", "title", "rivals", "config", "want"),
    [
        ("", "a 500g", [("r", "b 500g", "10", False)], {}, ("", None, None, C.NO_DATA, False, ["我方缺少价格"])),
        ("10", "a 500g", [("r", "b 500g", "", False)], {}, ("", None, None, C.NO_DATA, False, ["无有效竞品匹配"])),
        ("12", "a 500g", [("r", "b 1kg", "20", False), ("q", "b 500g", "10", True)], {}, ("r", 20.0, 0.2, C.CUT_URGENT, True, ["存在待复核的匹配关系"])),
        ("10.5", "a 500g", [("r", "b 500g", "10", False)], {}, ("r", 10.0, 0.05, C.CUT, True, [])),
        ("9", "a 500g", [("r", "b 500g", "10", False)], {}, ("r", 10.0, -0.1, C.RAISE, True, [])),
        ("10", "a", [("r", "b 500g", "10", False)], {}, ("r", 10.0, 0.0, C.WATCH, False, ["我方规格未解析，按标价对比"])),
        ("10", "a 500g", [("r", "b", "10", False)], {}, ("r", 10.0, 0.0, C.WATCH, False, ["竞品规格未解析，按标价对比"])),
        ("10", "a 500g", [("r", "b 1L", "10", False)], {}, ("r", 10.0, 0.0, C.WATCH, False, ["单位类别不同，按标价对比"])),
        ("10", "a 500g", [("r", "b 500g", "0", False)], {}, ("r", 0.0, None, C.NO_DATA, True, [])),
        ("11", "a 500g", [("r", "b 500g", "8", False), ("q", "b 1kg", "24", False)], {"benchmark": "avg"}, ("r", 16.0, 0.1, C.CUT, True, [])),
        ("10", "a 500g", [("r", "b 500g", "8", False), ("q", "b 1L", "20", False)], {"benchmark": "q"}, ("q", 20.0, -0.5, C.RAISE, False, ["单位类别不同，按标价对比"])),
        ("10", "a 500g", [("r", "b 500g", "8", False)], {"benchmark": "q"}, ("", None, None, C.NO_DATA, False, ["无有效竞品匹配"])),
    ],
)
def test_comparison_rows(spark, price, title, rivals, config, want):
    r = compare(spark, price, title, rivals, **config)
    assert (r.benchmark_platform, r.benchmark_price, r.action, r.comparable, r.notes) == (want[0], want[1], want[3], want[4], want[5])
    assert r.diff_rate is None if want[2] is None else r.diff_rate == pytest.approx(want[2])


def test_report(spark, tmp_path):
    own, rivals = make(spark, *GRAY, ("self", "S2", "a 500g", "12", "1"), ("r", "R2", "b 500g", "10", "1"), ("self", "S3", "z", "7"))
    pairs = cut(M.match_all(own, rivals), "pairs")
    rows = cut(P.compare_rows(own, pairs, rivals), "rows")
    k = O.kpi_summary(rows).first()
    assert (k.total, k.matched, k.priced, k.higher, k.lower, k.need_review) == (3, 2, 2, 1, 0, 1) and k.avg_diff_rate == pytest.approx(0.1)
    assert {r.bin: r.n for r in O.diff_histogram(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}
    names = spark.createDataFrame([("r", "甲"), ("x", "乙")], "key string, name string")
    assert {r.key: (r.total, r.matched) for r in O.platform_summary(rows, names).collect()} == {"r": (3, 2), "x": (0, 0)}
    assert [r.sku_id for r in O.top_gaps(rows, 1).collect()] == ["S2"]
    assert O.filter_rows(rows, review_only=True).count() == 1 and O.filter_rows(rows, query="A 5").count() == 1
    assert O.write_review_csv(rows, str(tmp_path / "out/review.csv")) == 1
    assert (tmp_path / "out/review.csv").read_bytes().startswith("\ufeff我方SKU,我方商品".encode()) and not (tmp_path / "out/review.csv.parts").exists()
    assert O.write_review_csv(rows, str(tmp_path / "out/review.csv")) == 1 and O.write_review_csv(rows.filter("sku_id = 'S2'"), str(tmp_path / "none.csv")) == 0 and not (tmp_path / "none.csv").exists()
    fails = rows.withColumn("title", F.when(F.col("sku_id") == "S1", F.raise_error(F.lit("a lost task"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="a lost task"):
        O.write_review_csv(fails, str(tmp_path / "failed.csv"))
    assert not (tmp_path / "failed.csv").exists() and not [f for f in (tmp_path / "failed.csv.parts").rglob("*part-*")]
    page = open(O.render_html(rows, [("r", "甲</script>"), ("x", "乙")], str(tmp_path / "page.html")), encoding="utf-8").read()
    assert "甲&lt;/script&gt;" in page and "$" not in page.split("<script>")[0].replace("${", "")
    assert '{"folder": "page_rows", "files": [["000000.js", 3]]}' in page
    shards = O.write_shards(rows, [("r", "甲</script>"), ("x", "乙")], str(tmp_path / "rows"), size=1)
    assert [n for _, n in shards] == [1, 1, 1] and [f.name for f in sorted((tmp_path / "rows").glob("*.js"))] == [name for name, _ in shards]
    read = [json.loads(r.row) for r in O.read_shards(spark, str(tmp_path / "rows")).collect()]
    assert {r["sku_id"]: [x["reason"] for x in r["rivals"]][1] for r in read} == dict.fromkeys(("S1", "S2", "S3"), "未参与匹配") and read[0]["rivals"][0]["name"] == "甲</script>"
    assert [json.loads((tmp_path / "rows" / name).read_text(encoding="utf-8").strip()[4:-1])["sku_id"] for name, _ in shards] == ["S1", "S2", "S3"]
    s = M.match_stats(pairs).first()
    assert (s.total, s.barcode, s.fuzzy, s.unmatched, s.need_review) == (3, 1, 1, 1, 1)


def test_report_of_many_categories(spark, tmp_path):
    """The page names the first category of each shard only; the shards have all, in order."""
    odd = ['a"b\\c', "</script><!--", "é\u2028x", "𠮷", "\uff5e", "c  c", "未分类"]
    own, rivals = make(spark, ("self", "S1", "a 500g", "12", "1"), ("r", "R1", "b 500g", "10", "1"))
    one = cut(P.compare_rows(own, cut(M.match_all(own, rivals), "pairs"), rivals), "rows")
    many = spark.createDataFrame([(n, c) for n, c in enumerate([*odd[:-1], "", *(f"c{n}" for n in range(4500)), "c7"])], "n long, name string")
    rows = cut(one.crossJoin(F.broadcast(many)).withColumn("category", F.col("name")).withColumn("ord", F.col("n")).drop("n", "name"), "many")
    page = open(O.render_html(rows, [("r", "R")], str(tmp_path / "many.html")), encoding="utf-8").read()
    index = json.loads(page.split('<script type="application/json" id="kinds">')[1].split("</script>")[0])
    found = {name: [json.loads(line[5:-1])["category"] for line in (tmp_path / index["folder"] / name).read_text(encoding="utf-8").split("\n")[:-1]] for name, _, _ in index["files"]}
    want = sorted([*odd, *(f"c{n}" for n in range(4500))])
    assert [c for name, _, _ in index["files"] for c in found[name]] == want and index["folder"] == "many_categories"
    assert [[name, len(found[name]), found[name][0]] for name in found] == index["files"] and max(n for _, n, _ in index["files"]) <= O.SHARD_ROWS
    assert len(want) == 4507 and sum(f">{c}<" in page or f'"{c}"' in page for c in want) <= len(index["files"])


def test_large_tables_are_not_sent_whole(spark):
    """A table of small files and many rows is dealt by a join; a small one is sent, and the setting is as before."""
    key = F.concat(F.lit("a long beginning of each key "), F.col("id")).alias("k")
    many, few = (cut(spark.range(n).select(key, F.lit("x").alias("v")), "many") for n in (500_000, 100))
    def plan(right):
        assert cut(few.select("k").join(right, "k", "left"), "joined").filter("v = 'x'").count() == 100
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        told = spark._jsparkSession.sharedState().statusStore().executionsList()
        return next(p for p in (told.apply(n).physicalPlanDescription() for n in reversed(range(told.size()))) if "LeftOuter" in p)
    assert "SortMergeJoin" in plan(many) and "BroadcastHashJoin" in plan(few)
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1


@pytest.mark.parametrize(("rate", "n"), [(-0.31, 0), (-0.30, 1), (-0.15, 2), (-0.05, 3), (0.0, 3), (0.05, 4), (0.15, 5), (0.30, 6)])
def test_histogram_edges(spark, rate, n):
    assert spark.range(1).select(O.gap_bin(F.lit(rate)).alias("b")).first().b == n


def test_candidates_are_found_once_for_equal_products(spark):
    """Fifty own products of one title and two of another are two kinds, and every product gets its kind's rivals."""
    own, rivals = make(spark, *[("self", f"S{k}", "蒙牛 纯牛奶 250ml*16盒") for k in range(50)], ("self", "T1", "伊利 酸奶 100g"), ("self", "T2", "伊利 酸奶 100g"), *[("r", f"R{k}", f"蒙牛 纯牛奶 250ml*{k + 10}盒") for k in range(9)], ("r", "Q", "伊利 酸奶 200g"))
    pending = M.with_platforms(own, rivals)
    assert M.candidates(pending, rivals, most=1).count() == 2
    got = M.recall(pending, rivals).groupBy("self_uid").agg(F.sort_array(F.collect_list(F.struct("rank", "rival_uid"))).alias("r")).collect()
    assert len(got) == 52 and len({str(r.r) for r in got if r.self_uid.startswith("self:S")}) == 1
    first = next(r.r for r in got if r.self_uid == "self:S7")
    assert [x["rank"] for x in first] == [1, 2, 3, 4, 5] and first[0]["rival_uid"] == "r:R6"


def test_rivals_of_many_pairs_are_joined_apart(spark, monkeypatch):
    own, rivals = make(spark, *[("self", f"S{k}", "甲 水 1L") for k in range(30)], ("r", "R0", "甲 水 1L"), ("r", "R1", "乙 油 2L*3瓶"))
    pairs = own.select(F.col("uid").alias("self_uid"), F.when(F.col("ord") < 20, "r:R0").when(F.col("ord") < 25, "r:R1").when(F.col("ord") < 28, "r:gone").alias("rival_uid"))
    monkeypatch.setattr(P, "HOT_RIVALS", 1)
    got = P.met(pairs, rivals).groupBy("rival_uid", "rival.title", "rival.spec", "rival.parsed").count().collect()
    assert {tuple(r) for r in got} == {("r:R0", "甲 水 1L", "1000ml", True, 20), ("r:R1", "乙 油 2L*3瓶", "2000ml×3 (合计6000ml)", True, 5), ("r:gone", None, None, None, 3), (None, None, None, None, 2)}


def test_tables_are_made_once(spark, monkeypatch):
    """Titles of both sides are one table each, whether they are counted or dealt, and a rule that finds nothing leaves the pending ones."""
    made = []
    monkeypatch.setattr(M, "cut", lambda df, name: made.append(name) or cut(df, name))
    own, rivals = make(spark, ("self", "S1", "甲 水 1L"), ("r", "R1", "甲 水 1L"), ("r", "R2", "乙 水 2L", "5", "6921168509256"))
    got = M.match_all(own, rivals).collect()
    assert [(r.self_uid, r.rival_uid, r.level) for r in got] == [("self:S1", "r:R1", C.FUZZY)]
    assert [made.count(n) for n in ("pending", "own-titles", "rival-titles")] == [1, 1, 1]


def test_products_of_a_query_are_made_once(spark, monkeypatch):
    from tarifa.plans import cascade

    made = []
    monkeypatch.setattr(cascade, "cut", lambda df, name: made.append(name) or cut(df, name))
    assert cascade.gray_with_verdicts(spark, "/root/testdata/sf0.001").count() > 0 and made == ["kinds"]
