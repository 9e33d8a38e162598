"""Package specifications: quantity, unit, count and the total in a base unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import DEFAULT, Lexicon
from . import titles
from .text import let


def is_parsed(spec: Column) -> Column:
    return F.coalesce(spec["total_base"] > 0, F.lit(False))


def parse_spec(title: Column, spec_text: Column | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """The specification of normalised texts: the field's if it gives a positive total, else the title's."""
    return titles.spec_column(title, F.lit("") if spec_text is None else spec_text, lexicon)


def general(x: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros, as '%g' in C."""
    return let(x, _general)


def _general(x: Column) -> Column:
    science = F.format_string("%.5e", x)
    power = F.substring_index(science, "e", -1).cast("int")  # of ten, after rounding
    places = 5 - power
    fixed = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(places, F.lit(0)).cast("string"), F.lit("f")), x)
    fixed = F.when(places > 0, F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    whole = x.cast("long")  # most totals are whole, and need neither format nor pattern
    return F.when((whole == x) & (F.abs(x) < 1e6), whole.cast("string")).when((power < -4) | (places < 0), F.regexp_replace(science, r"\.?0*e", "e")).otherwise(fixed)


def spec_display(spec: Column) -> Column:
    return let(spec, _spec_display)


def _spec_display(spec: Column) -> Column:
    mark = F.when(spec["unit"] == "weight", "g").otherwise("ml")
    total = general(spec["total_base"])
    many = F.concat(general(spec["qty_base"]), mark, F.lit("×"), spec["count"].cast("string"), F.lit(" (合计"), total, mark, F.lit(")"))
    raw = F.when(F.coalesce(spec["raw"], F.lit("")) != "", spec["raw"]).otherwise("未解析")
    return F.when(~is_parsed(spec), raw).when(spec["unit"] == "count", F.concat(total, F.lit("件"))).when(spec["count"] > 1, many).otherwise(F.concat(total, mark))


def unit_price(price: Column, spec: Column) -> Column:
    """Price per 100 g, 100 ml or piece; null without a price or a specification."""
    each = F.when(is_parsed(spec) & price.isNotNull(), F.try_divide(price, spec["total_base"]))
    return F.when(spec["unit"] == "count", each).otherwise(each * 100)


def unit_price_label(spec: Column) -> Column:
    return F.when(~is_parsed(spec), "—").when(spec["unit"] == "weight", "元/100g").when(spec["unit"] == "volume", "元/100ml").when(spec["unit"] == "count", "元/件").otherwise("—")
