"""Queries over sources and sinks: suppliers go out as files, pushes and API pages and come back."""

from __future__ import annotations

import csv
import json
import os
import re
import threading
import urllib.request
import uuid
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import at_path
from ..operators import compare as P
from ..operators import matching as J
from ..operators import products as R
from ..operators import report as O
from ..operators.tables import cut, scratch_dir
from ..sources import config, files, landing, paged, receiver
from . import cascade
from . import catalogue as K
from . import local_api
from .queries import query


def suppliers(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, float]]:
    """The rows that the files and services of these queries hold."""
    return [tuple(r) for r in K.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey").collect()]


def folder(spark: SparkSession) -> Path:
    where = Path(urlsplit(scratch_dir(spark)).path) / f"feed-{uuid.uuid4().hex}"
    where.mkdir(parents=True)
    return where


def _csv(path: Path, rows: list[tuple], header: list[str]) -> None:
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def _inbox(spark: SparkSession, sf_dir: str) -> Path:
    """Two files of one's own, the second repeating some of the first with other names; a JSON file of
    a rival; files to leave alone: of no platform, without required columns, not readable."""
    own = [(k, f'{name}, "A" 1kg\n', f"¥{bal}", "n/a") for k, name, bal in suppliers(spark, sf_dir)]
    where = folder(spark)
    _csv(where / "self_1.csv", [r for r in own if r[0] % 3 < 2], ["商品编码", "品名", "售价", "备注"])
    _csv(where / "self_2.csv", [(k, "later", p) for k, _, p, _ in own if k % 3 > 0], ["SKU", "title", "价格"])
    items = [{"sku_id": k, "商品标题": name, "price": bal, "tags": {"n": k}} for k, name, bal in suppliers(spark, sf_dir)]
    (where / "r_1.json").write_text(json.dumps({"items": items + [{"sku_id": None, "商品标题": "no id", "price": 0, "tags": {"n": -1}}]}), encoding="utf-8")
    _csv(where / "self_3.csv", [("a", "b")], ["x", "y"])
    (where / "r_2.json").write_text("{", encoding="utf-8")
    _csv(where / "other_1.csv", own, ["sku", "title", "price", "备注"])
    return where


_OWN = "select s_suppkey as k, s_suppkey % 3 as m, s_name, s_acctbal from supplier"


@query(f"select k::varchar as sku_id, s_name || ', \"A\" 1kg' || chr(10) as title, '¥' || printf('%g', 0) as price, 'n/a' as extra from ({_OWN}) where m < 2".replace("'¥' || printf('%g', 0)", "round(s_acctbal, 6)"))
def csv_scan(spark, sf_dir):
    raw = landing.rows_of(landing.scan(spark, str(_inbox(spark, sf_dir)), [("self", "S")], pattern="self_1.csv"))
    return raw.select("sku_id", "title", F.round(F.substring("price", 2, 30).cast("double"), 6).alias("price"), F.element_at("extra", "备注").alias("extra"))


@query(f"select k::varchar as sku_id, s_name as title, round(s_acctbal, 6) as price, k as n from ({_OWN}) union all select null, 'no id', 0.0, -1")
def json_scan(spark, sf_dir):
    raw = landing.rows_of(landing.scan(spark, str(_inbox(spark, sf_dir)), [("r", "R")], pattern="r_1.json"))
    return raw.select("sku_id", "title", F.round(F.col("price").cast("double"), 6).alias("price"), at_path(F.element_at("extra", "tags"), "n").cast("long").alias("n"))


@query(f"""select 'self' as platform, k::varchar as sku_id, case when m < 2 then s_name || ', "A" 1kg' else 'later' end as title, round(s_acctbal, 6) as price, case when m < 2 then 1000.0 end as total from ({_OWN})
  union all select 'r', k::varchar, s_name, round(s_acctbal, 6), null from ({_OWN})""")
def collect_files(spark, sf_dir):
    """All platforms: files in order of their names, the first row of a product id, bad files left."""
    found = landing.collect(spark, str(_inbox(spark, sf_dir)), [("self", "S"), ("r", "R"), ("none", "N")])
    return found.select("platform", "sku_id", "title", F.round("price", 6).alias("price"), F.col("spec.total_base").alias("total"))


@query("select * from (values ('left', 'other_1.csv'), ('left', 'r_2.json'), ('left', 'self_3.csv'), ('gone', 'r_1.json'), ('gone', 'self_1.csv'), ('gone', 'self_2.csv')) v(place, file)")
def archive_files(spark, sf_dir):
    inbox, old = _inbox(spark, sf_dir), folder(spark)
    landing.collect(spark, str(inbox), [("self", "S"), ("r", "R")], str(old))
    gone = [("gone", re.sub(r"__\d{8}_\d{6}", "", p.name)) for p in old.iterdir()]
    return spark.createDataFrame([("left", p.name) for p in inbox.iterdir()] + gone, "place string, file string")


@query("select 'n_a' as lacking, 0::bigint as records, 0::bigint as usable where false union all select 'sku_id,title', (select count(*) from supplier), (select count(*) from supplier where s_suppkey % 3 < 2)")
def usable_rows(spark, sf_dir):
    """Required columns that a file lacks, and rows with all required values."""
    bad = landing.files_of(landing.scan(spark, str(_inbox(spark, sf_dir)), [("self", "S")])).filter("problem is not null")
    lacking = bad.select(F.replace(F.regexp_extract("problem", "lacks (.*)", 1), F.lit(" "), F.lit("")).alias("lacking"))
    rows = K.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sku_id"), F.when(F.col("s_suppkey") % 3 < 2, F.col("s_name")).otherwise(" - ").alias("title"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  a row each
    return one(lacking).join(one(R.usable_count(rows)), "one").select("lacking", "records", "usable")


# ---------------------------------------------------------------- APIs


def _api(spark: SparkSession, sf_dir: str, name: str, **more) -> dict:
    records = [{"id": k, "name": name, "商品名称": "not this", "pricing": {"now": [bal]}, "city": "c"} for k, name, bal in suppliers(spark, sf_dir)]
    return {"name": name, "platform": "r", "field_map": {"sku_id": "id", "title": "name", "price": "pricing.now.0"}, **more, "url": f"{local_api.serve(records)}/{more.get('url', name)}"}


def _records(spark: SparkSession, settings: dict) -> DataFrame:
    """The records as the data source gives them: one JSON object a row, pages or URLs as partitions."""
    found = paged.read_api(spark, settings)
    keys = F.array_join(F.array_sort(F.json_object_keys("record")), ",").alias("keys")
    return found.select(at_path(F.col("record"), "sku_id").alias("sku_id"), at_path(F.col("record"), "title").alias("title"), F.round(at_path(F.col("record"), "price").cast("double"), 6).alias("price"), keys)


_ALL = "select s_suppkey::varchar as sku_id, s_name as title, round(s_acctbal, 6) as price, 'city,id,name,price,sku_id,title' as keys from supplier"


@query(_ALL)
def api_offset(spark, sf_dir):
    turns = {"type": "offset", "limit_param": "limit", "page_size": 9, "next_offset_path": "data.offset", "remaining_path": "data.left"}
    return _records(spark, _api(spark, sf_dir, "offset", items_path=["data.none", "data.list"], pagination=turns, max_pages=100_000))


@query(_ALL)
def api_cursor(spark, sf_dir):
    turns = {"type": "cursor", "cursor_path": "next"}
    return _records(spark, _api(spark, sf_dir, "cursor", items_path="items", pagination=turns, max_pages=100_000))


@query(_ALL)
def api_page(spark, sf_dir):
    turns = {"type": "page", "in": "body", "limit_param": "size", "page_size": 9}
    return _records(spark, _api(spark, sf_dir, "page", method="post", pagination=turns, max_pages=100_000))


@query("select s_suppkey::varchar as sku_id, s_name as title, round(s_acctbal, 6) as price, 'city,id,name,price,sku_id,source_page,title' as keys from supplier")
def api_scrape(spark, sf_dir):
    settings = _api(spark, sf_dir, "scrape", mode="scrape", items_path="data.json.products")
    return _records(spark, settings | {"urls": [f"http://shop/{k}" for k in range(4)]})


@query("select '4' as pages_read, (select count(*) from supplier) as records, 'auto-' || substr(sha1('Supplier#000000000'), 1, 12) as first_id")
def api_failures(spark, sf_dir):
    """One page fails, the others are read; ids are derived where there are none (a landing file written and read)."""
    settings = _api(spark, sf_dir, "scrape", mode="scrape", items_path="data.json.products", field_map={"title": "name"}, derive_sku_id=True)
    source = paged.PagedSource(settings | {"urls": [f"http://shop/{k}" for k in ("broken", 0, 1, 2, 3)]})
    path, n = source.fetch_to(str(folder(spark)))
    rows = landing.read_file(spark, path)
    first = F.min_by("sku_id", "title").alias("first_id")
    return rows.agg(F.countDistinct("source_page").cast("string").alias("pages_read"), F.count("*").alias("records"), first).filter(F.col("records") == n)


@query("select n_nationkey::varchar as sku_id, n_name as title from nation union all select 'status', s from (values ('200'), ('400'), ('401'), ('404')) v(s)")
def push_items(spark, sf_dir):
    """Pushed over HTTP into the landing directory and read from there, with the refusals of bad pushes."""
    inbox = folder(spark)
    server = receiver.make_server(str(inbox), port=0, token="t")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    items = [{"sku_id": r[0], "title": r[1]} for r in K.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]

    def status(path: str, token: str) -> str:
        call = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", json.dumps({"items": items}).encode(), {"X-Auth-Token": token})
        try:
            with urllib.request.urlopen(call, timeout=30) as answer:
                return str(answer.status)
        except urllib.error.HTTPError as e:
            return str(e.code)

    told = [status(*x) for x in (("/api/ingest?platform=r", "t"), ("/api/ingest?platform=" + "x" * 33, "t"), ("/api/ingest?platform=r", "no"), ("/x", "t"))]
    server.shutdown()
    server.server_close()
    raw = landing.rows_of(landing.scan(spark, str(inbox), [("r", "R")]))
    return raw.select("sku_id", "title").union(spark.createDataFrame([("status", s) for s in told], "sku_id string, title string"))


@query("""select s_suppkey as k, case s_suppkey % 5 when 0 then 'name' when 1 then 'preset' when 2 then 'mode' when 3 then 'url' else '' end as refused,
  case when s_suppkey % 5 = 4 then 'https://api.apify.com/v2/datasets/' || s_name || '/items' end as url, case when s_suppkey % 5 = 4 then s_suppkey end as page_size,
  case when s_suppkey % 5 = 4 then 'offset,limit' end as parameters, case when s_suppkey % 5 = 4 then 'Bearer *** of ' || s_name end as told, case when s_suppkey % 5 = 4 then 'TARIFA_NOT_SET' end as missing from supplier""")
def source_settings(spark, sf_dir):
    """A source for each supplier: refusals, presets under own settings, variables, secrets kept out of messages."""

    def settle(frames):
        for frame in frames:
            yield pd.DataFrame([_settled(int(k), name) for k, name in zip(frame["s_suppkey"], frame["s_name"])], columns=["k", "refused", "url", "page_size", "parameters", "told", "missing"]).astype({"page_size": "Int64"})

    found = K.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return found.mapInPandas(settle, "k long, refused string, url string, page_size long, parameters string, told string, missing string")


def _settled(k: int, name: str) -> tuple:
    wrong = [{"name": f"{name}/{k}"}, {"preset": name}, {"mode": name}, {"preset": None, "url": ""}, {}][k % 5]
    settings = {"name": f"s{k}", "platform": "r", "preset": "apify", "vars": {"dataset_id": name}, "pagination": {"page_size": k}} | wrong
    try:
        source = paged.PagedSource(settings)
    except paged.SourceError as e:
        return k, next(w for w in ("preset", "mode", "url", "name") if re.search(rf"\b{w}\b", str(e))), None, None, None, None, None
    os.environ["APIFY_TOKEN"] = f"token-of-{k:09}"
    header = source.variables.expand(source.settings["headers"])["Authorization"]
    try:
        lacks = source.variables.expand({"x": ["${TARIFA_NOT_SET}"]})
    except config.ConfigError as e:
        lacks = re.search(r"TARIFA_\w+", str(e))[0]
    turns = source.settings["pagination"]
    return k, "", source.request({})["url"], turns["page_size"], f"{turns['offset_param']},{turns['limit_param']}", source.variables.redact(f"{header} of {name}"), lacks


# ---------------------------------------------------------------- sinks


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rivals = cascade.sides(spark, sf_dir)
    return cut(P.compare_rows(own, cut(J.match_all(own, rivals), "pairs"), rivals), "rows")


@query(cascade._BEST + "select k::varchar as sku, round(score, 1)::double as score, reason from best where m in (0, 3, 6)")
def review_file(spark, sf_dir):
    """The review list written as CSV and read back."""
    path = f"{folder(spark)}/review.csv"
    O.write_review_csv(_rows(spark, sf_dir), path)
    found = landing.read_file(spark, path)
    return found.select(F.col("我方SKU").alias("sku"), F.col("相似度").cast("double").alias("score"), F.col("判定依据").alias("reason"))


@query(cascade._BEST + "select k::varchar as sku_id, m < 7 as matched, case when m = 7 then '无候选商品' else reason end as reason, 'c' || k as category from best")
def html_report(spark, sf_dir):
    """The rows in the shards that the report page names."""
    path = O.render_html(_rows(spark, sf_dir), [("p0", "P<0>")], f"{folder(spark)}/page.html")
    page = files.read_text(spark, path)
    named = json.loads(re.search(r'<script type="application/json" id="data">(.*?)</script>', page, re.S)[1])
    rows = O.read_shards(spark, f"{path.rsplit('/', 1)[0]}/{named['folder']}")
    kind = "sku_id string, category string, rivals array<struct<matched: boolean, reason: string>>"
    return rows.select(F.from_json("row", kind).alias("r")).select("r.sku_id", F.col("r.rivals")[0]["matched"].alias("matched"), F.col("r.rivals")[0]["reason"].alias("reason"), "r.category")


@query("""select '比价完成：' || n || ' 个商品，' || priced || ' 个产出有效价差；我方偏高 ' || higher || ' 个，平均价差率 ' || printf('%+.1f', round(100.0 * total / priced, 1)) || '%' as line from (
  select count(*) as n, count(*) filter (where k % 16 < 7) as priced, count(*) filter (where k % 16 = 6) as higher, sum(case k % 16 when 2 then -0.5 when 6 then 1.0 else 0.0 end) filter (where k % 16 < 7) as total from (select p_partkey as k from part))""")
def console_line(spark, sf_dir):
    return spark.createDataFrame([(O.console_summary(_rows(spark, sf_dir)),)], "line string")
