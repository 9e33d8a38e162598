"""An API on this machine that serves given records in every way that sources page through: it
stands for the services behind the source queries, so that they run whole and offline."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from urllib.parse import parse_qs

from ..sources.receiver import _Quiet, _Threads, _wsgi_server


def _asked(environ: dict) -> dict[str, str]:
    return {k: v[0] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}


def serve(records: list[dict], refuse_every: int = 7) -> str:
    """The base URL. One answer in ``refuse_every`` is a 503 that the next try doesn't get."""
    calls = [0]

    def offset(environ: dict, body: dict) -> dict:
        at, n = int(_asked(environ)["offset"]), int(_asked(environ)["limit"])
        return {"data": {"list": records[at : at + n], "offset": at + n, "left": max(0, len(records) - at - n)}}

    def cursor(environ: dict, body: dict) -> dict:
        at = int(_asked(environ).get("cursor", 0))
        return {"items": records[at : at + 9], "next": str(at + 9) if at + 9 < len(records) else ""}

    def page(environ: dict, body: dict) -> list:
        at = (body["page"] - 1) * body["size"]
        return records[at : at + body["size"]]

    def scrape(environ: dict, body: dict) -> dict:
        part = body["url"].rsplit("/", 1)[1]
        if part == "broken":
            return {"success": False, "error": "no such page"}
        return {"success": True, "data": {"json": {"products": records[int(part) :: 4]}}}

    paths: dict[str, Callable] = {"/offset": offset, "/cursor": cursor, "/page": page, "/scrape": scrape}

    def app(environ: dict, start_response: Callable) -> list[bytes]:
        calls[0] += 1
        body = json.loads(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)) or b"null")
        busy = calls[0] % refuse_every == 0
        data = json.dumps({} if busy else paths[environ["PATH_INFO"]](environ, body)).encode()
        start_response("503 Busy" if busy else "200 OK", [("Content-Type", "application/json"), ("Retry-After", "0"), ("Content-Length", str(len(data)))])
        return [data]

    server = _wsgi_server("127.0.0.1", 0, app, _Threads, _Quiet)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"
