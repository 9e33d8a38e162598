"""Values inside JSON records: native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_path(record: Column, path: str) -> Column:
    """The value at 'a.b.0.c' of JSON text, as text (JSON for objects and arrays); '' is the record
    itself, null where there's nothing."""
    if not path:
        return record
    steps = (f"[{step}]" if re.fullmatch(r"\d+", step) else f"['{step}']" for step in path.split("."))
    return F.get_json_object(record, "$" + "".join(steps))
