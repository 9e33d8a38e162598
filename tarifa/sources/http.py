"""JSON over HTTP: one exchange as a value, and patience with services that are busy or away."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count
from typing import Any

LONGEST_TOLD, LONGEST_OWN = 60, 30


@dataclass(frozen=True)
class Answer:
    """What came back. Status 0 is a failure of the network, with its text."""

    status: int
    text: str = ""
    data: Any = None
    is_json: bool = False
    retry_after: str = ""

    @property
    def good(self) -> bool:
        return 0 < self.status < 400

    @property
    def passing(self) -> bool:
        """Whether the same request may do better later."""
        return self.status in (0, 429) or self.status >= 500

    def pause(self, nth: int) -> int:
        """Seconds to wait after the ``nth`` failure: as told, or twice as long each time."""
        return min(int(self.retry_after), LONGEST_TOLD) if self.retry_after.isdigit() else min(2**nth, LONGEST_OWN)

    def __str__(self) -> str:
        return f"HTTP {self.status}: {self.text[:300]}" if self.status else f"network error: {self.text[:300]}"


def exchange(session: Any, method: str, url: str, *, headers: dict, timeout: float, params: dict | None = None, body: Any = None) -> Answer:
    """Sends one request with ``session`` (of the requests package, made where none is given)."""
    import requests

    try:
        got = (session or requests).request(method, url, params=params, json=body, headers=headers, timeout=timeout)
    except requests.RequestException as e:
        return Answer(0, str(e))
    told = str(got.headers.get("Retry-After") or "")
    try:
        return Answer(got.status_code, got.text, got.json(), True, told)
    except ValueError:
        return Answer(got.status_code, got.text, retry_after=told)


def patiently(attempt: Callable[[], Answer], retries: int, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The first answer that isn't passing, or the last one after so many retries."""
    for nth in count(1):
        answer = attempt()
        if not answer.passing or nth > retries:
            return answer
        sleep(answer.pause(nth))
