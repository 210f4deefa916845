"""Numbers from dirty text; what is not a plain number is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def _text(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def safe_double(col: Column) -> Column:
    text = _text(col)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_long(col: Column) -> Column:
    """An integer text, or a number's whole part."""
    text = _text(col)
    return F.when(text.rlike(INTEGER), text.try_cast("long"))
