"""Report aggregates, review list, row payload and the HTML page."""

from __future__ import annotations

import html
import json
from datetime import datetime
from functools import reduce
from string import Template
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import spec as S
from ..sources import files
from .compare import action_kind

#: Rows, or categories, of a shard of the report.
SHARD_ROWS = 2000
REVIEW_NOTE = "存在待复核的匹配关系"
# fixed values: histogram edges and labels, review columns
EDGES = [-0.30, -0.15, -0.05, 0.05, 0.15, 0.30]
LABELS = ["低 30%+", "低 15~30%", "低 5~15%", "持平 ±5%", "高 5~15%", "高 15~30%", "高 30%+"]
REVIEW_COLUMNS = ["我方SKU", "我方商品", "我方规格", "竞品平台", "竞品商品", "竞品规格", "匹配层级", "相似度", "置信度", "判定依据", "人工确认"]


def kpi_summary(rows: DataFrame) -> DataFrame:
    rate = F.col("diff_rate")
    hit = F.exists("pairs", lambda p: p["rival_uid"].isNotNull())
    out = rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.count(rate).alias("priced"), F.count_if(rate > 0).alias("higher"), F.count_if(rate < 0).alias("lower"), F.count_if(F.array_contains("notes", REVIEW_NOTE)).alias("need_review"), F.avg(rate).alias("avg_diff_rate"))
    return out.withColumn("match_rate", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def platform_summary(rows: DataFrame, competitors: DataFrame) -> DataFrame:
    """Per competitor (key, name): pairs, matched, rate and mean gap; those without data have zeros.
    A pair whose rival price is zero has no gap."""
    p = rows.select("price", "unit_price", F.col("spec.unit").alias("unit"), F.explode("pairs").alias("p"))
    r = F.col("p.rival")
    hit = F.col("p.rival_uid").isNotNull()
    unit = F.col("unit_price").isNotNull() & r["unit_price"].isNotNull() & (F.col("unit") == r["unit"])
    gap = F.when(unit, F.try_divide(F.col("unit_price") - r["unit_price"], r["unit_price"])).otherwise(F.try_divide(F.col("price") - r["price"], r["price"]))
    gap = F.when(hit & F.col("price").isNotNull() & r["price"].isNotNull(), gap)
    found = p.groupBy(F.col("p.platform").alias("key")).agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.avg(gap).alias("avg_diff_rate"))
    out = competitors.join(found, "key", "left").select("key", "name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("matched", F.lit(0)).alias("matched"), "avg_diff_rate")
    return out.withColumn("match_rate", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def gap_bin(rate: Column) -> Column:
    """The number of the half-open bin a rate lies in."""
    out = None
    for k, edge in enumerate(EDGES):
        out = F.when(rate < edge, k) if out is None else out.when(rate < edge, k)
    return out.otherwise(len(EDGES))


def diff_histogram(rows: DataFrame) -> DataFrame:
    """All seven bins with their counts, empty ones too."""
    counts = rows.filter("diff_rate is not null").groupBy(gap_bin(F.col("diff_rate")).alias("bin")).agg(F.count("*").alias("n"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") + 1).cast("int"))
    every = rows.sparkSession.range(len(LABELS)).select(F.col("id").cast("int").alias("bin"), label.alias("label"))
    return every.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))


def top_gaps(rows: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest gaps, equal ones in product order."""
    return rows.filter("diff_rate is not null").orderBy(F.desc("diff_rate"), "ord").limit(n)


def filter_rows(rows: DataFrame, query: str = "", action: str = "", category: str = "", review_only: bool = False) -> DataFrame:
    keep = [F.lit(True)]
    if query:
        keep.append(F.contains(F.lower(F.concat("title", F.lit(" "), "brand")), F.lit(query.lower())))
    if action:
        keep.append(F.col("action") == action)
    if category:
        keep.append(F.when(F.col("category") == "", "未分类").otherwise(F.col("category")) == category)
    if review_only:
        keep.append(F.exists("pairs", lambda p: p["rival_uid"].isNotNull() & p["need_review"]))
    return rows.filter(reduce(lambda a, b: a & b, keep))


def categories(rows: DataFrame) -> DataFrame:
    return rows.select(F.when(F.col("category") == "", "未分类").otherwise(F.col("category")).alias("category")).distinct().orderBy("category")


def review_rows(rows: DataFrame) -> DataFrame:
    """Pairs for a person to look at, under the columns of the review file."""
    p = rows.select("ord", "sku_id", "title", "spec", F.explode("pairs").alias("p")).filter("p.need_review")
    hit = F.col("p.rival_uid").isNotNull()
    values = [F.col("sku_id"), F.col("title"), S.spec_display(F.col("spec")), F.col("p.platform"), F.when(hit, F.col("p.rival.title")).otherwise("（判定为不匹配）"), F.when(hit, F.col("p.rival.spec")).otherwise(""), F.col("p.level"), F.round("p.score", 1), F.round("p.confidence", 2), F.col("p.reason"), F.lit("")]
    return p.orderBy("ord", "p.platform_ord").select(*[v.alias(n) for v, n in zip(values, REVIEW_COLUMNS)])


def row_payload(rows: DataFrame, competitors: list[tuple[str, str]]) -> DataFrame:
    """Flat report rows; ``rivals`` has one entry per configured competitor, matched or not."""
    def entry(key: str, name: str) -> Column:
        pair = F.get(F.filter("pairs", lambda p: p["platform"] == key), 0)
        hit, r = pair["rival_uid"].isNotNull(), pair["rival"]
        only = lambda c: F.when(hit, c)
        return F.struct(F.lit(name).alias("name"), F.coalesce(hit, F.lit(False)).alias("matched"), only(r["title"]).alias("title"), only(r["price"]).alias("price"), only(r["unit_price"]).alias("unit_price"), only(r["spec"]).alias("spec"), only(pair["level"]).alias("level"), only(F.round(pair["score"], 1)).alias("score"), only(F.round(pair["confidence"], 2)).alias("confidence"), F.coalesce(pair["reason"], F.lit("未参与匹配")).alias("reason"), only(pair["need_review"]).alias("need_review"), only(r["url"]).alias("url"))

    return rows.select(
        "ord", "sku_id", "title", "brand", F.when(F.col("category") == "", "未分类").otherwise(F.col("category")).alias("category"), S.spec_display(F.col("spec")).alias("spec"),
        "price", "unit_price", S.unit_price_label(F.col("spec")).alias("unit_label"), "benchmark_platform", "benchmark_price", "benchmark_unit_price", "diff", "diff_rate",
        "action", action_kind(F.col("action")).alias("action_kind"), "comparable", "notes", F.array(*[entry(k, n) for k, n in competitors]).alias("rivals"),
    )


def write_review_csv(rows: DataFrame, path: str) -> int:
    """The review list as CSV (UTF-8 with a byte order mark), written by the executors: one file, or a folder
    of files in order where the list is long; nothing without rows. It appears when all tasks have succeeded. Gives the number of rows."""
    spark, listed = rows.sparkSession, review_rows(rows)
    if listed.isEmpty():
        return 0
    told = Observation()
    parts = f"{path}.parts"
    marked = listed.observe(told, F.count(F.lit(1)).alias("n")).withColumnRenamed(REVIEW_COLUMNS[0], "\ufeff" + REVIEW_COLUMNS[0])
    marked.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(parts)
    found = [n for n in files.names(spark, parts) if n.startswith("part-")]
    files.remove(spark, path)
    files.move(spark, f"{parts}/{found[0]}" if len(found) == 1 else parts, path)
    files.remove(spark, parts)
    return told.get["n"]


def _scripts(lines: DataFrame, folder: str, size: int, place: Column) -> list[tuple]:
    """Ordered lines as scripts of ``size`` lines at most, written by the executors; (name, lines, first ``place``) of
    each. Only these are read by the driver, one for ``size`` lines."""
    spark = lines.sparkSession
    lines.write.mode("overwrite").option("maxRecordsPerFile", size).text(folder)
    index = spark.read.text(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    out = []
    for k, r in enumerate(index.orderBy("first").collect()):  # as many as there are files
        files.move(spark, f"{folder}/{r['name']}", f"{folder}/{k:06}.js")
        out.append((f"{k:06}.js", r["n"], r["first"]))
    return out


def write_shards(rows: DataFrame, competitors: list[tuple[str, str]], folder: str, size: int = SHARD_ROWS) -> list[tuple[str, int]]:
    """The row payload as scripts of ``size`` rows at most, in product order, written by the executors; (name,
    rows) of each. A page on any disk can load them: each line hands over a row."""
    line = F.concat(F.lit("add("), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(")")).alias("value")
    ordered = row_payload(rows, competitors).orderBy("ord").select(line)
    return [found[:2] for found in _scripts(ordered, folder, size, F.regexp_extract("value", r'^add\(\{"ord":(-?\d+)', 1).cast("long"))]


def write_categories(rows: DataFrame, folder: str, size: int = SHARD_ROWS) -> list[tuple[str, int, str]]:
    """The categories, in order, as scripts of ``size`` at most, written by the executors; (name, categories, first
    one) of each. Each line hands over a category: there may be as many as products, too many for a page."""
    line = F.concat(F.lit("kind("), F.to_json(F.struct("category")), F.lit(")")).alias("value")
    name = F.get_json_object(F.expr("substring(value, 6, length(value) - 6)"), "$.category")
    return _scripts(categories(rows).select(line), folder, size, name)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(row,) of every row of the shards, as JSON."""
    return spark.read.option("pathGlobFilter", "*.js").text(folder).select(F.regexp_extract("value", r"^add\((.*)\)$", 1).alias("row"))


_PAGE = Template("""<!doctype html><html lang="zh"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>$title</title>
<style>:root{--critical:#b3261e;--serious:#b5620a;--neutral:#3d4a5c;--good:#1f7a3a;--muted:#8a8f98}
body{font:14px/1.5 system-ui,sans-serif;max-width:1100px;margin:2em auto;padding:0 1em;color:#222}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ddd;padding:4px 8px;text-align:left}
.cards{display:flex;flex-wrap:wrap;gap:12px}.cards div{border:1px solid #ddd;border-radius:8px;padding:8px 16px}.cards b{display:block;font-size:20px}
.bar{display:grid;grid-template-columns:9em 1fr 4em;gap:8px;align-items:center}.bar i{display:block;height:14px;background:#5b7aa8;border-radius:3px}.bar.up i{background:var(--critical)}.bar.down i{background:var(--good)}
.critical{color:var(--critical);font-weight:600}.serious{color:var(--serious)}.neutral{color:var(--neutral)}.good{color:var(--good)}.muted{color:var(--muted)}
tr.row{cursor:pointer}td.panel{background:#f7f8fa}.flag{background:#fff3cd;border-radius:3px;padding:0 4px}form{display:flex;gap:8px;margin:8px 0}</style></head><body>
<h1>$title</h1><p class="muted">$generated</p><div class="cards">$kpi</div>
<h2>价差分布</h2>$histogram<h2>建议动作</h2><div class="cards">$counts</div><h2>平台</h2><table><tr><th>平台</th><th>参与</th><th>匹配</th><th>匹配率</th><th>平均价差</th></tr>$platforms</table>
<h2>价差 TOP</h2><table>$top</table>
<h2>明细</h2><form onsubmit="return false"><input id="q" placeholder="搜索商品或品牌"><select id="a"><option value="">全部动作</option>$actions</select>
<input id="k" placeholder="查找品类" hidden><select id="c"><option value="">全部品类</option></select><button id="next" type="button" hidden>后续品类</button><label><input type="checkbox" id="r">待复核</label><span id="n" class="muted"></span></form>
<table><thead><tr><th>SKU</th><th>商品</th><th>规格</th><th>售价</th><th>单价</th><th>对标</th><th>对标价</th><th>价差</th><th>动作</th><th>说明</th></tr></thead><tbody id="rows"></tbody></table>
<p><button id="more">更多</button></p><script type="application/json" id="data">$data</script><script type="application/json" id="kinds">$kinds</script>
<script>
const shards=JSON.parse(document.getElementById('data').textContent),rows=[],box=id=>document.getElementById(id),PAGE=200;let next=0,limit=PAGE;
const add=x=>rows.push(x),total=shards.files.reduce((n,f)=>n+f[1],0);
function script(src,then){const s=document.createElement('script');s.src=src;s.onload=s.onerror=()=>{s.remove();then()};document.head.append(s)}
function load(then){if(next>=shards.files.length)return then();script(shards.folder+'/'+shards.files[next++][0],then)}
const kinds=JSON.parse(box('kinds').textContent),named=[],kind=x=>named.push(x.category);let asked=0,at=0;
const before=(a,b)=>{a=[...a];b=[...b];const i=a.findIndex((x,i)=>x!==b[i]);return i<0?a.length<b.length:i<b.length&&a[i].codePointAt()<b[i].codePointAt()};
function offer(n,text){const mine=++asked;script(kinds.folder+'/'+kinds.files[n][0],()=>{const found=named.splice(0).filter(x=>!before(x,text)),c=box('c'),was=c.value;if(mine!==asked)return;
if(!found.length&&n+1<kinds.files.length)return offer(n+1,text);if(was&&!found.includes(was))found.unshift(was);at=n;
c.replaceChildren(c.options[0],...found.map(x=>new Option(x,x,false,x===was)));box('next').hidden=n+1>=kinds.files.length})}
function find(text){let low=0,high=kinds.files.length;while(high-low>1){const mid=low+high>>1;if(before(text,kinds.files[mid][2]))high=mid;else low=mid}offer(low,text)}
const money=v=>v===null?'—':'¥'+v.toFixed(2),each=(v,l)=>v===null?'—':v.toFixed(2)+' '+l,rate=v=>v===null?'—':(v>0?'+':'')+(100*v).toFixed(1)+'%';
const cell=(tr,text,kind)=>{const td=tr.insertCell();td.textContent=text;if(kind)td.className=kind;return td};
const review=x=>x.rivals.some(y=>y.matched&&y.need_review);
function panel(x){const t=document.createElement('table');for(const y of x.rivals){const tr=t.insertRow();cell(tr,y.name);if(!y.matched){cell(tr,y.reason,'muted').colSpan=6;continue}
const name=cell(tr,'');if(/^https?:/.test(y.url||'')){const a=document.createElement('a');a.href=y.url;a.rel='noopener';a.target='_blank';a.textContent=y.title;name.append(a)}else name.textContent=y.title;
cell(tr,y.spec);cell(tr,money(y.price));cell(tr,each(y.unit_price,x.unit_label));cell(tr,y.level+' · '+y.score+' · '+y.confidence);const why=cell(tr,y.reason);if(y.need_review){const f=document.createElement('span');f.className='flag';f.textContent='待复核';why.prepend(f,' ')}}return t}
function show(){const q=box('q').value.toLowerCase(),a=box('a').value,c=box('c').value,r=box('r').checked,body=box('rows');let n=0;body.replaceChildren();
for(const x of rows){if(n>=limit)break;if(q&&!(x.title+' '+x.brand).toLowerCase().includes(q)||a&&x.action!==a||c&&x.category!==c||r&&!review(x))continue;n++;
const tr=body.insertRow();tr.className='row';cell(tr,x.sku_id);cell(tr,x.title);cell(tr,x.spec);cell(tr,money(x.price));cell(tr,each(x.unit_price,x.unit_label));cell(tr,x.benchmark_platform||'—');cell(tr,money(x.benchmark_price));cell(tr,rate(x.diff_rate),x.action_kind);cell(tr,x.action,x.action_kind);cell(tr,x.notes.join('；'),'muted');
tr.onclick=()=>{const next=tr.nextSibling;if(next&&next.className==='open'){next.remove();return}const p=document.createElement('tr');p.className='open';const td=p.insertCell();td.colSpan=10;td.className='panel';td.append(panel(x));tr.after(p)}}
box('n').textContent=n+' / '+rows.length+' / '+total;if(n<limit&&next<shards.files.length)load(show)}
for(const id of ['q','a','c','r'])box(id).addEventListener('input',()=>{limit=PAGE;show()});box('more').onclick=()=>{limit+=PAGE;show()};
box('k').addEventListener('input',()=>find(box('k').value));box('next').onclick=()=>offer(at+1,'');if(kinds.files.length){box('k').hidden=kinds.files.length<2;offer(0,'')}show();
</script></body></html>""")


def _cells(rows: list[list]) -> str:
    return "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)


def render_html(rows: DataFrame, competitors: list[tuple[str, str]], path: str, title: str = "比价报告", top_n: int = 20) -> str:
    """A page of aggregates. Its rows and categories lie beside it in shards (``<name>_rows``, ``<name>_categories``) that
    executors have written and that the page loads as they are needed, so the size of the catalogue doesn't matter."""
    spark = rows.sparkSession
    kpi = kpi_summary(rows).first().asDict()
    names = spark.createDataFrame(competitors or [("", "")], "key string, name string").filter("key <> ''")
    per = [[r["name"], r["total"], r["matched"], f"{100 * r['match_rate']:.0f}%", "" if r["avg_diff_rate"] is None else f"{100 * r['avg_diff_rate']:+.1f}%"] for r in platform_summary(rows, names).collect()]
    beside = lambda what: f"{path.removesuffix('.html')}_{what}"
    named = lambda folder, found: {"folder": quote(folder.rsplit("/", 1)[-1]), "files": found}
    shards = named(beside("rows"), write_shards(rows, competitors, beside("rows")))
    kept = named(beside("categories"), write_categories(rows, beside("categories")))
    bins = diff_histogram(rows).orderBy("bin").collect()
    most = max((r["n"] for r in bins), default=0) or 1
    side = lambda k: "up" if k > len(EDGES) // 2 else "down" if k < len(EDGES) // 2 else ""
    bars = "".join(f'<div class="bar {side(r["bin"])}"><span>{r["label"]}</span><i style="width:{100 * r["n"] // most}%"></i><span>{r["n"]}</span></div>' for r in bins)
    kinds = {r["action"]: (r["n"], r["kind"]) for r in action_counts(rows).withColumn("kind", action_kind(F.col("action"))).collect()}
    card = lambda name, value, kind="": f'<div>{html.escape(name)}<b class="{kind}">{html.escape(str(value))}</b></div>'
    shown = {"商品": kpi["total"], "已匹配": f"{kpi['matched']} ({100 * kpi['match_rate']:.0f}%)", "有效价差": kpi["priced"], "我方偏高": kpi["higher"], "我方偏低": kpi["lower"], "平均价差": "—" if kpi["avg_diff_rate"] is None else f"{100 * kpi['avg_diff_rate']:+.1f}%", "待复核": kpi["need_review"]}
    top = [[r["title"], f"{100 * r['diff_rate']:+.1f}%", r["action"]] for r in top_gaps(rows, top_n).select("title", "diff_rate", "action").collect()]
    options = lambda values: "".join(f"<option>{html.escape(v)}</option>" for v in values)
    page = _PAGE.substitute(
        title=html.escape(title), generated=datetime.now().strftime("%Y-%m-%d %H:%M"), kpi="".join(card(k, v) for k, v in shown.items()),
        histogram=bars, counts="".join(card(k, n, kind) for k, (n, kind) in kinds.items()), platforms=_cells(per), top=_cells(top),
        actions=options(sorted(kinds)), data=json.dumps(shards).replace("</", "<\\/"), kinds=json.dumps(kept, ensure_ascii=False).replace("<", "\\u003c"),
    )
    files.write_text(spark, path, page)
    return path


def console_summary(rows: DataFrame) -> str:
    k = kpi_summary(rows).first()
    mean = f"，平均价差率 {100 * k['avg_diff_rate']:+.1f}%" if k["avg_diff_rate"] is not None else ""
    return f"比价完成：{k['total']} 个商品，{k['priced']} 个产出有效价差；我方偏高 {k['higher']} 个{mean}"
