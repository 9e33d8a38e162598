"""Landing files, paged APIs with a fake transport, the receiver, robot tasks and the stream."""

import json
import threading
import urllib.error
import urllib.request

import pytest
import requests
from pyspark.sql import functions as F

from tarifa.operators.products import to_products
from tarifa.operators.tables import cut
from tarifa.sources import config as G
from tarifa.sources import landing, paged, receiver, robots
from tarifa.streaming import landing as stream


def test_landing_files(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "self_1.csv").write_text('﻿商品编码,品名,售价,标题\nA,"水 ""大"" 550ml*24瓶",¥12.9,x\nA,again 1kg,1,y\n-,none,2,\nB,米 2斤,,z\n', encoding="utf-8")
    (inbox / "self_2.json").write_text(json.dumps({"items": [{"sku_id": 7, "title": "油 5L", "price": 65.9, "n": {"a": 1}}, {"sku_id": "A", "title": "later"}]}), encoding="utf-8")
    (inbox / "self_3.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (inbox / "r_1.json").write_text(json.dumps([{"SKU": "R", "title": "米 1kg", "barcode": 690}]), encoding="utf-8")
    got = landing.collect(spark, str(inbox), [("self", "S"), ("r", "R"), ("none", "N")], str(tmp_path / "old"))
    rows = {r.uid: r for r in got.collect()}
    assert set(rows) == {"self:A", "self:B", "self:7", "r:R"}
    assert (rows["self:A"].price, rows["self:A"].title, rows["self:A"].spec.total_base) == (12.9, '水 "大" 550ml*24瓶', 13200)
    assert rows["self:7"].price == 65.9 and rows["r:R"].barcode == "690" and rows["self:A"].extra["标题"] == "x"
    assert [p.name for p in inbox.iterdir()] == ["self_3.csv"] and len(list((tmp_path / "old").iterdir())) == 3


def test_bad_files_are_rows_and_rows_keep_their_order(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a_2.csv").write_text("sku,title\n1,later\n\n3,short\n", encoding="utf-8")
    (inbox / "a_1.csv").write_bytes("sku,title,价格,品名\n1,x,5,first\n2,\"two\nlines\",6\n".encode())
    (inbox / "a_b_1.json").write_text('{"items": [{"sku": 9, "title": "t", "price": 1.50, "more": [1, {"k": 2.0}], "ok": true, "none": null}, {"title": "no id"}]}', encoding="utf-8")
    for name, content in {"a_wide.csv": b"sku,title\n1,2,3\n", "a_bytes.csv": b"sku,title\n\xff,2\n", "a_open.csv": b'sku,title\n1,"x', "a_bad.json": b"{", "a_empty.csv": b"\n", "a_other.json": b'{"rows": []}', "a_list.json": b"[1]", "a_x.xlsx": b"no sheet", "a_1.txt": b"x", "c_1.csv": b"sku,title\n1,2\n"}.items():
        (inbox / name).write_bytes(content)
    landed = landing.scan(spark, str(inbox), [("a", "A"), ("a_b", "")]).cache()
    problems = {(r.path.rsplit("/", 1)[1], r.platform): r.problem for r in landing.files_of(landed).collect()}
    good = {("a_1.csv", "a"), ("a_2.csv", "a"), ("a_b_1.json", "a"), ("a_b_1.json", "a_b")}
    assert {k for k, v in problems.items() if v is None} == good
    assert {k[0] for k in set(problems) - good} == {"a_wide.csv", "a_bytes.csv", "a_open.csv", "a_bad.json", "a_empty.csv", "a_other.json", "a_list.json", "a_x.xlsx"}
    assert "row 2 has 3 values" in problems["a_wide.csv", "a"] and problems["a_other.json", "a"].endswith("lacks sku_id, title")
    rows = landing.rows_of(landed).orderBy("platform_ord", "ord").collect()
    assert [(r.sku_id, r.title, r.price) for r in rows if r.platform == "a"] == [("1", "first", "5"), ("2", None, "6"), ("1", "later", None), ("3", "short", None), ("9", "t", "1.50"), (None, "no id", None)]
    extra = rows[-2].extra
    assert (rows[-2].platform, rows[-2].platform_name, rows[-2].platform_ord) == ("a_b", "a_b", 1) and extra == {"more": '["1",{"k":"2.0"}]', "ok": "true", "none": None}
    landed.unpersist()
    assert landing.collect(spark, str(tmp_path / "nowhere"), [("a", "A")]) is None and landing.collect(spark, str(inbox), [("z", "Z")]) is None


def test_many_files_are_one_job(spark, tmp_path):
    for k in range(2000):
        (tmp_path / f"{'rs'[k % 2]}_{k:04}.csv").write_text(f"sku,title\n{k % 1500},t{k}\n{k},again\n", encoding="utf-8")
    context = spark.sparkContext
    context.setJobGroup("landing", "files")
    landed = cut(landing.scan(spark, str(tmp_path), [("r", "R"), ("s", "S")]), "landed")
    context.setJobGroup("rest", "rest")
    # the scan, and the names of the files
    assert len(context.statusTracker().getJobIdsForGroup("landing")) <= 4
    assert landing.rows_of(landed).count() == 4000 and landing.files_of(landed).filter("problem is null").count() == 2000
    first = to_products(landing.rows_of(landed)).filter("sku_id = '0'").first()
    assert (first.platform, first.title) == ("r", "t0")
    context.setLocalProperty("spark.jobGroup.id", None)


class Reply:
    def __init__(self, body, status=200, headers=None):
        self.body, self.status_code, self.headers, self.text = body, status, headers or {}, str(body)

    def json(self):
        if isinstance(self.body, str):
            raise ValueError("no JSON")
        return self.body


class Session:
    def __init__(self, *replies):
        self.replies, self.sent = list(replies), []

    def request(self, method, url, **more):
        self.sent.append((method, url, more))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def source(session, **settings):
    waits = []
    s = paged.PagedSource({"name": "n", "platform": "p", "url": "http://x/"} | settings, session, waits.append)
    return s, waits


ITEMS = [{"sku_id": str(k), "title": f"t{k}"} for k in range(5)]


def test_offset_pages(monkeypatch):
    monkeypatch.setenv("APIFY_TOKEN", "secret-token")
    s, _ = source(net := Session(Reply(ITEMS[:2]), Reply(ITEMS[2:4]), Reply(ITEMS[4:])), preset="apify", url="http://x/${id}", vars={"id": "d1"}, pagination={"page_size": 2})
    assert [r["sku_id"] for r in s.fetch()] == ["0", "1", "2", "3", "4"]
    assert [m["params"]["offset"] for _, _, m in net.sent] == [0, 2, 4] and net.sent[0][1] == "http://x/d1"
    assert net.sent[0][2]["headers"]["Authorization"] == "Bearer secret-token"


@pytest.mark.parametrize(
    ("pagination", "replies", "turns"),
    [
        ({"type": "cursor", "cursor_path": "next"}, [{"items": ITEMS[:1], "next": "c"}, {"items": ITEMS[1:2]}], [None, "c"]),
        ({"type": "page", "in": "body", "page_size": 1}, [{"items": ITEMS[:1]}, {"items": []}], [1, 2]),
        ({"type": "offset", "next_offset_path": "offset", "remaining_path": "left"}, [{"items": ITEMS[:2], "offset": 9, "left": 3}, {"items": ITEMS[2:], "offset": 9, "left": 0}], [0, 9]),
        ({"type": "offset", "next_offset_path": "offset", "page_size": 2}, [{"items": ITEMS[:2], "offset": 0}], [0]),
        ({}, [{"items": ITEMS[:2]}], [None]),
    ],
)
def test_page_rules(pagination, replies, turns):
    s, _ = source(net := Session(*map(Reply, replies)), items_path=["none", "items"], pagination=pagination)
    s.fetch()
    kind, where = pagination.get("type", "x"), "json" if pagination.get("in") else "params"
    assert [(m[where] or {}).get(kind) for _, _, m in net.sent] == turns


def test_limits_and_retries():
    s, waits = source(Session(Reply("", 429, {"Retry-After": "99"}), requests.ConnectionError("x"), Reply("", 503), Reply(ITEMS)), retries=3)
    assert len(s.fetch()) == 5 and waits == [60, 4, 8]
    for reply in (Reply("no", 404), Reply("text")):
        with pytest.raises(paged.SourceError):
            source(Session(reply))[0].fetch()
    s, _ = source(Session(*[Reply(ITEMS[:1])] * 3), pagination={"type": "offset", "page_size": 1}, max_pages=3)
    assert len(s.fetch()) == 3


def test_token_is_renewed_once_and_hidden(monkeypatch):
    monkeypatch.setenv("U", "user-name")
    auth = {"type": "password_grant", "token_url": "http://t/", "username": "${U}", "password": "pw", "token_path": "data.t"}
    s, _ = source(net := Session(Reply({"data": {"t": "one1"}}), Reply("", 401), Reply({"data": {"t": "two2"}}), Reply("bad two2 user-name", 400)), auth=auth)
    with pytest.raises(paged.SourceError) as e:
        s.fetch()
    assert "two2" not in str(e.value) and "user-name" not in str(e.value) and len(net.sent) == 4


def test_scrape(monkeypatch):
    monkeypatch.setenv("FIRECRAWL_API_KEY", "key-key")
    ok = {"data": {"json": {"products": [{"title": "水", "price": 1, "url": "u"}, {"title": "米", "sku_id": "9"}]}}}
    s, _ = source(Session(Reply({"success": False, "error": "e"}), Reply(ok)), preset="firecrawl", urls=["a", "b"])
    got = s.fetch()
    assert got[0]["sku_id"].startswith("auto-") and len(got[0]["sku_id"]) == 17 and got[1]["sku_id"] == "9" and got[0]["source_page"] == "b"
    with pytest.raises(paged.SourceError, match="all 1"):
        source(Session(Reply({"success": False})), preset="firecrawl", urls=["a"])[0].fetch()


def test_mapping(tmp_path):
    raw = {"id": 1, "name": "n", "商品名称": "dropped", "pricing": {"current": 1.5}, "images": [{"src": "i"}], "city": "c"}
    s, _ = source(Session(Reply([raw])), field_map={"sku_id": "id", "title": "name", "price": "pricing.current", "image_url": "images.0.src"})
    path, n = s.fetch_to(str(tmp_path))
    assert n == 1 and json.loads(open(path, encoding="utf-8").read()) == [{"id": 1, "name": "n", "city": "c", "sku_id": 1, "title": "n", "price": 1.5, "image_url": "i"}]
    with pytest.raises(paged.SourceError, match="goodsNo"):
        source(Session(Reply([{"goodsNo": 1}])))[0].fetch()
    assert source(Session(Reply([])))[0].fetch_to(str(tmp_path)) == (None, 0)
    with pytest.raises(paged.SourceError, match="columns: goodsNo"):
        source(Session(Reply([{"goodsNo": 1}])))[0].fetch_to(str(tmp_path))
    with pytest.raises(paged.SourceError):  # the second page fails: no half a file is left
        source(Session(Reply(ITEMS[:1]), Reply("", 404)), pagination={"type": "offset", "page_size": 1})[0].fetch_to(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == [path.rsplit("/", 1)[1]]


def test_settings(monkeypatch):
    for bad in ({"name": "a/b"}, {"platform": ""}, {"mode": "x"}, {"url": ""}, {"preset": "x"}):
        with pytest.raises(paged.SourceError):
            source(Session(), **bad)
    assert G.at_path({"a": [{"b": 1}]}, "a.0.b") == 1 and G.at_path({"a": 1}, "a.b") is None and G.at_path([1], "") == [1]
    assert G.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(G.ConfigError, match="NOT_THERE"):
        G.Variables({}, "x").expand({"k": ["${NOT_THERE}"]})
    monkeypatch.setenv("TARIFA_SECRET", "hush-hush")
    v = G.Variables({"A": "x", "B": " "}, "n")
    assert v.expand({"k": ["A-${A}"]}) == {"k": ["A-x"]} and v.redact("[n] " + v.expand("${TARIFA_SECRET}") + " refused") == "[n] *** refused"


def test_receiver(tmp_path):
    server = receiver.make_server(str(tmp_path), port=0, token="t")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, token="t"):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body, {"X-Auth-Token": token}), timeout=10) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/health") == (200, {"ok": True}) and call("/x")[0] == 404 and call("/x", b"[]")[0] == 404
    ok = "/api/ingest?platform=p1"
    assert call(ok, b"[]", "no")[0] == 401 and call("/api/ingest?platform=../x", b"[]")[0] == 400
    assert call(f"/api/ingest?platform={'a' * 33}", b"[]")[0] == 400 and call(f"/api/ingest?platform={'a' * 32}", b"[]")[0] == 200
    assert [call(ok, b)[0] for b in (b"", b"{", b"{}", b"3")] == [400] * 4
    status, reply = call(ok, '{"items": [{"sku_id": "1"}]}'.encode())
    assert status == 200 and reply["received"] == 1 and json.loads((tmp_path / reply["file"]).read_text()) == [{"sku_id": "1"}]
    server.shutdown()
    server.server_close()


def test_robot_tasks(monkeypatch):
    monkeypatch.delenv("YINGDAO_ACCESS_KEY_ID", raising=False)
    with pytest.raises(robots.RobotError):
        robots.Robots()
    token, start = {"code": 0, "data": {"accessToken": "t"}}, {"data": {"taskUuid": "k"}}
    ask = lambda state: {"code": "0", "data": {"status": state}}
    calm = {"sleep": lambda s: None}

    def service(*bodies):
        return robots.Robots(("a", "b"), session=Session(*[b if isinstance(b, Reply) else Reply(b) for b in bodies]))

    done = service(token, start, ask("running"), ask("Success"))
    assert robots.run(done, robots.Job("r", params={"x": 1}), **calm) == {"status": "Success"}
    sent = done.session.sent
    assert sent[1][2]["json"] == {"robotUuid": "r", "params": {"x": 1}} and sent[1][2]["headers"]["Authorization"] == "Bearer t" and len(sent) == 4
    for bodies in ((token, start, ask(3)), (token, {"data": {}}), ({"code": 5, "msg": "x"},), ({"data": {}},), (Reply("no", 500),), (Reply({}, 403),)):
        with pytest.raises(robots.RobotError):
            robots.run(service(*bodies), robots.Job("r"), **calm)
    now = iter(range(0, 10**6, 1000))
    with pytest.raises(robots.RobotError, match="isn't done"):
        service(token, ask("x"), ask("x"), ask("x")).outcome("k", clock=lambda: next(now), **calm)


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "r_20260101_000000_000001.json").write_text(json.dumps([{"sku_id": "1", "title": "水 500ml", "售价": "¥2"}, {"sku_id": "1", "title": "b"}]), encoding="utf-8")
    (inbox / "q_20260101_000000_000002.json").write_text(json.dumps({"items": [{"sku_id": "2", "title": "米 1kg"}]}), encoding="utf-8")
    seen = []
    for _ in range(2):
        stream.start(spark, str(inbox), str(tmp_path / "c"), lambda df, n: seen.extend(df.select("uid", "price", F.col("spec.total_base").alias("t")).collect()), once=True).awaitTermination()
    assert sorted(tuple(r) for r in seen) == [("q:2", None, 1000.0), ("r:1", 2.0, 500.0)]


def test_stream_keeps_the_first_of_a_product_over_batches(spark, tmp_path):
    """A product id again in a later batch, in a later run and after a batch that failed."""
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()

    def push(n, *items, platform="r"):
        (inbox / f"{platform}_20260101_000000_{n:06}.json").write_text(json.dumps([{"sku_id": k, "title": t} for k, t in items]), encoding="utf-8")

    def run(fails=False):
        def sink(df, number):
            rows = [tuple(r) for r in df.select("uid", "title").collect()]
            if fails:
                raise RuntimeError("the sink is away")
            seen.extend(rows)

        stream.start(spark, str(inbox), str(tmp_path / "c"), sink, once=True).awaitTermination()

    push(1, ("1", " - "), ("1", "first"), ("1", "second"), ("2", "two"))
    run()
    assert sorted(seen) == [("r:1", "first"), ("r:2", "two")]
    push(2, ("2", "later"), ("3", "three"))
    push(3, ("2", "other platform"), platform="q")
    with pytest.raises(Exception, match="the sink is away"):
        run(fails=True)
    run()  # from the checkpoint: the batch comes again
    push(4, (" 3 ", "again"), ("1", "again"), ("4", "four"))
    run()
    assert sorted(seen) == [("q:2", "other platform"), ("r:1", "first"), ("r:2", "two"), ("r:3", "three"), ("r:4", "four")]
