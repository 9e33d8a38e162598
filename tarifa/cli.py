"""Commands: collect, compare, fetch, serve, trigger, demo."""

from __future__ import annotations

import argparse
import logging
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import compare as P
from .operators import judge as J
from .operators import matching as M
from .operators import products as R
from .operators import report as O
from .operators.tables import cut, released
from .schemas import SELF
from .sources import landing
from .sources.config import ConfigError, load_config
from .sources.paged import PagedSource, SourceError

log = logging.getLogger(__name__)


def session() -> SparkSession:
    return SparkSession.builder.appName("tarifa").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _platforms(config: dict) -> list[tuple[str, str]]:
    own = config.get("self") or {}
    return [(SELF, own.get("name", "我方")), *((c["key"], c["name"]) for c in config.get("competitors") or [])]


def _collect(config: dict, spark: SparkSession):
    ingest = config.get("ingest") or {}
    return landing.collect(spark, ingest.get("inbox_dir", "data/inbox"), _platforms(config), ingest.get("archive_dir"))


def match_config(config: dict) -> M.MatchConfig:
    m = config.get("matching") or {}
    rules, fuzzy, judge = m.get("rules") or {}, m.get("fuzzy") or {}, m.get("llm") or {}
    return M.MatchConfig(
        barcode=rules.get("enable_barcode", True), brand_spec=rules.get("enable_brand_spec", True), top_k=fuzzy.get("top_k", 5), auto_accept=fuzzy.get("auto_accept", 88), reject_below=fuzzy.get("reject_below", 55),
        spec_penalty=fuzzy.get("spec_mismatch_penalty", 12), judge=("verdicts" if J.load(judge.get("judge")) else "unavailable") if judge.get("enabled", True) else "disabled", accept_confidence=judge.get("accept_confidence", 0.7),
        batch_size=judge.get("batch_size", 20), concurrency=judge.get("max_concurrency", 4),
    )


def compare_config(config: dict) -> P.CompareConfig:
    c = config.get("compare") or {}
    return P.CompareConfig(benchmark=c.get("benchmark", "min"), **{k: v for k, v in (c.get("thresholds") or {}).items() if k in ("critical_high", "warn_high", "warn_low")})


def collect(config: dict, args) -> int:
    spark = session()
    with released(spark):
        products = _collect(config, spark)
        counts = {} if products is None else {r.platform: r.products for r in R.platform_counts(products).collect()}
    for key, name in _platforms(config):
        print(f"{name} ({key}): {counts.get(key, 0)}")
    return 0


def compare(config: dict, args) -> int:
    if getattr(args, "fetch", False) and fetch(config, args):
        log.warning("some sources failed; going on with what the inbox has")
    spark = session()
    with released(spark):
        return _compare(config, spark)


def _compare(config: dict, spark: SparkSession) -> int:
    products = _collect(config, spark)
    products = None if products is None else cut(products, "products")
    own = None if products is None else products.filter(f"platform = '{SELF}'")
    if own is None or own.isEmpty():
        print("no own products: put self_*.csv into the inbox", file=sys.stderr)
        return 1
    rivals = products.filter(f"platform <> '{SELF}'")
    if rivals.isEmpty():
        print("no rival products", file=sys.stderr)
        return 1
    llm = (config.get("matching") or {}).get("llm") or {}
    pairs = cut(M.match_all(own, rivals, match_config(config), judge=J.load(llm.get("judge")), store=llm.get("verdicts")), "pairs")
    rows = cut(P.compare_rows(own, pairs, rivals, compare_config(config)), "rows")
    report = config.get("report") or {}
    out = report.get("output_dir", "data/output")
    page = O.render_html(rows, _platforms(config)[1:], f"{out}/{report.get('html_name', '比价报告.html')}", top_n=report.get("top_n", 20))
    review = f"{out}/待人工复核.csv"
    n = O.write_review_csv(rows, review)
    print(O.console_summary(rows), f"报告：{page}", *([f"待复核清单：{review} ({n})"] if n else []), sep="\n")
    return 0


def fetch(config: dict, args) -> int:
    ingest = config.get("ingest") or {}
    sources, wanted = ingest.get("cloud") or [], getattr(args, "source", None)
    chosen = [s for s in sources if (s.get("name") == wanted if wanted else s.get("enabled"))]
    if not chosen:
        print(f"no source {wanted!r}; configured: {[s.get('name') for s in sources]}" if wanted else "no source is enabled", file=sys.stderr)
        return 1 if wanted else 0
    known, failed = {k for k, _ in _platforms(config)}, 0
    for s in chosen:
        if s.get("platform") not in known:
            log.warning("[%s] platform %r isn't configured, its rows won't be compared", s.get("name"), s.get("platform"))
        try:
            path, n = PagedSource(s).fetch_to(ingest.get("inbox_dir", "data/inbox"))
            print(f"{s['name']}: {n} {path or ''}")
        except SourceError as e:
            failed += 1
            log.error("%s", e)
    return int(failed > 0)


def serve(config: dict, args) -> int:
    from .sources.receiver import serve as run

    ingest = config.get("ingest") or {}
    http = ingest.get("http") or {}
    run(ingest.get("inbox_dir", "data/inbox"), args.host or http.get("host", "127.0.0.1"), args.port or http.get("port", 8770), http.get("token", ""))
    return 0


def trigger(config: dict, args) -> int:
    from .sources import robots

    c = (config.get("ingest") or {}).get("yingdao") or {}
    job = robots.Job(args.robot or c.get("robot_uuid", ""), c.get("schedule_uuid", ""))
    if not job.robot:
        print("no robot: give --robot or configure robot_uuid", file=sys.stderr)
        return 1
    try:
        service = robots.Robots((c.get("access_key_id", ""), c.get("access_key_secret", "")), c.get("base_url", robots.BASE_URL))
        print(robots.run(service, job, interval=c.get("poll_interval_sec", 10), timeout=c.get("poll_timeout_sec", 1800)))
    except robots.RobotError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def demo(config: dict, args) -> int:
    inbox = (config.get("ingest") or {}).get("inbox_dir", "data/inbox")
    files = sorted(Path("data/samples").glob("*.csv"))
    if not files:
        print("no samples in data/samples", file=sys.stderr)
        return 1
    Path(inbox).mkdir(parents=True, exist_ok=True)
    for f in files:
        shutil.copy(f, inbox)
    return compare(config, args)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarifa", description="Product matching and price comparison on Spark")
    parser.add_argument("-c", "--config", default="config.yaml")
    parser.add_argument("-v", "--verbose", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {f.__name__: f for f in (collect, compare, fetch, serve, trigger, demo)}
    made = {name: sub.add_parser(name) for name in commands}
    made["compare"].add_argument("--fetch", action="store_true")
    made["fetch"].add_argument("--source")
    made["serve"].add_argument("--host")
    made["serve"].add_argument("--port", type=int)
    made["trigger"].add_argument("--robot")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    try:
        return commands[args.command](load_config(args.config), args)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
