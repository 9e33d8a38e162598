"""Configuration: YAML files, recursive merging, ${NAME} expansion and redaction of secrets."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_NAME = re.compile(r"\$\{([A-Za-z_]\w*)\}", re.A)
SHORTEST_SECRET = 4


class ConfigError(ValueError):
    pass


def load_config(path: str) -> dict:
    import yaml

    if not Path(path).is_file():
        raise ConfigError(f"no configuration at {path}")
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the values of ``over``, mappings merged at every depth; neither is changed."""
    out = {k: merged(v, {}) if isinstance(v, Mapping) else v for k, v in base.items()}
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def at_path(data: Any, path: str) -> Any:
    """The value at 'a.b.0.c'; '' is the data itself, None where there's nothing."""
    for step in path.split(".") if path else []:
        if isinstance(data, Mapping):
            data = data.get(step)
        elif isinstance(data, list) and step.lstrip("-").isdigit() and -len(data) <= int(step) < len(data):
            data = data[int(step)]
        else:
            return None
    return data


class Variables:
    """Values for ${NAME}: those given, then the environment, whose values count as secret."""

    def __init__(self, given: Mapping[str, Any] | None = None, label: str = ""):
        self.given, self.label, self.secrets = given or {}, label, set()

    def expand(self, value: Any) -> Any:
        if isinstance(value, Mapping):
            return {k: self.expand(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.expand(v) for v in value]
        return _NAME.sub(lambda m: self._value(m[1]), value) if isinstance(value, str) else value

    def _value(self, name: str) -> str:
        own = self.given.get(name)
        if own is not None and str(own).strip():
            return str(own)
        value = os.environ.get(name, "")
        if not value:
            raise ConfigError(f"[{self.label}] the variable {name} has no value")
        self.hide(value)
        return value

    def hide(self, secret: str) -> None:
        if len(secret) >= SHORTEST_SECRET:
            self.secrets.add(secret)

    def redact(self, text: str) -> str:
        for secret in sorted(self.secrets, key=len, reverse=True):
            text = text.replace(secret, "***")
        return text
