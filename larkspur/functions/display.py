"""How values read in reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_applicable(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("not applicable"))


def yes_no(col: Column, unknown: str = "not enough evidence") -> Column:
    return F.when(col, "yes").when(~col, "no").otherwise(unknown)


def percent(rate: Column, unknown: str = "not available") -> Column:
    return F.when(rate.isNotNull(), F.format_string("%.2f%%", rate.cast("double") * 100)).otherwise(unknown)


def request_count(count: Column, status: Column) -> Column:
    """A count, where the way of access lets requests be counted."""
    return F.when(status == "available", count.cast("string")).otherwise("unavailable")


def json_text(number: Column) -> Column:
    """A number as JSON shows it: a whole one without a fraction, NaN as null."""
    value = F.when(~F.isnan(number), number)
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def json_number(value: Any) -> Any:
    """A whole double as an integer; NaN as None."""
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value
