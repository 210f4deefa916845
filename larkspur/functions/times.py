"""Strict timestamps: ISO 8601 with a zone, anything else is null."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

ISO = r"(?s)^(\d{4}-\d{2}-\d{2}).(\d{2})(:\d{2})?(:\d{2})?(?:[.,](\d{1,6})\d*)?(?:(Z)|([+-]\d{2}):?(\d{2})?)$"


#: The form that the JVM reads as it stands.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"


def strict_timestamp(col: Column) -> Column:
    """The instant of a text that names its zone; the session's zone plays no part.

    Texts in the usual form are read at once; the parts of any other are put together
    in that form first.
    """
    raw = col.cast("string")
    return F.when(raw.rlike(CANONICAL), raw.try_cast("timestamp")).otherwise(_other_form(raw))


def _other_form(raw: Column) -> Column:
    text = strip(raw)

    def part(i: int, absent: str) -> Column:
        found = F.regexp_extract(text, ISO, i)
        return F.when(found == "", absent).otherwise(found)

    zone = F.when(F.regexp_extract(text, ISO, 6) == "Z", "+00:00").otherwise(F.concat(F.regexp_extract(text, ISO, 7), F.lit(":"), part(8, "00")))
    rebuilt = F.concat(F.regexp_extract(text, ISO, 1), F.lit("T"), F.regexp_extract(text, ISO, 2), part(3, ":00"), part(4, ":00"), F.lit("."), part(5, "0"), zone)
    return F.when(text.rlike(ISO), rebuilt.try_cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, negative ones kept."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6) / F.lit(86400.0)


def instant(at: datetime) -> Column:
    return F.lit(at.isoformat()).cast("timestamp")
