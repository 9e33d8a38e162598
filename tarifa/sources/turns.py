"""How the pages of a list follow each other: one small object for each kind of pagination."""

from __future__ import annotations

from typing import Any

from .config import at_path


class Turns:
    """A list of one page. Kinds with more pages tell where the first one begins and, from an answer and the
    number of its items, where the next does: None after the last."""

    kind = "none"

    def __init__(self, settings: dict):
        self.settings = settings
        self.size = int(settings.get("page_size", 100))

    def first(self) -> Any:
        return None

    def after(self, at: Any, answer: Any, n: int) -> Any:
        return None

    def parameters(self, at: Any) -> dict[str, Any]:
        """What a request says to get the page that begins ``at``."""
        said = {self.settings.get(f"{self.kind}_param", self.kind): at, self.settings.get("limit_param"): self.size}
        return {name: value for name, value in said.items() if name and value is not None} if self.kind != "none" else {}

    def _left(self, answer: Any) -> float | None:
        """How many items the service says are left, if it is asked to."""
        path = self.settings.get("remaining_path")
        left = at_path(answer, path) if path else None
        return None if left is None else float(left)

    def _is_last(self, answer: Any, n: int) -> bool:
        return n == 0 or (left := self._left(answer)) is not None and left <= 0


class _Counted(Turns):
    """A page shorter than asked for is the last, unless the service counts what's left."""

    def _is_last(self, answer: Any, n: int) -> bool:
        return super()._is_last(answer, n) or (n < self.size and not self.settings.get("remaining_path"))


class Pages(_Counted):
    kind = "page"

    def first(self) -> int:
        return int(self.settings.get("start", 1))

    def after(self, at: int, answer: Any, n: int) -> int | None:
        return None if self._is_last(answer, n) else at + 1


class Offsets(_Counted):
    """The service may name the next offset; one that stands still ends the list."""

    kind = "offset"

    def first(self) -> int:
        return int(self.settings.get("start", 0))

    def after(self, at: int, answer: Any, n: int) -> int | None:
        if self._is_last(answer, n):
            return None
        path = self.settings.get("next_offset_path")
        named = at_path(answer, path) if path else None
        following = at + n if named is None else int(named)
        return None if following == at else following


class Cursors(Turns):
    kind = "cursor"

    def after(self, at: Any, answer: Any, n: int) -> Any:
        return None if self._is_last(answer, n) else at_path(answer, self.settings.get("cursor_path", "next_cursor")) or None


KINDS = {c.kind: c for c in (Turns, Pages, Offsets, Cursors)}


def turns_of(settings: dict) -> Turns:
    return KINDS.get(settings.get("type", "none"), Turns)(settings)
