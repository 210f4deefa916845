"""Fields of captured pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import safe_double

# What a page says that blocks its reader, and the statuses that do.
BLOCK_PHRASES = ["captcha", "robot check", "enter the characters you see below", "access denied", "sorry, we just need to make sure you're not a robot", "/ap/signin", "validatecaptcha"]
BLOCK_STATUSES = [401, 403, 429]
# How pages write ratings, votes, item ids and the number of the next page.
STARS = r"([0-5](?:\.\d+)?)\s+out of\s+5"
VOTES = r"([\d,]+)"
ITEM_IN_URL = r"/(?:product-reviews|dp)/([A-Z0-9]{10})"
ITEM_IN_PAGE = r"/(?:product-reviews|customer-reviews|dp|portal/customer-reviews)/([A-Z0-9]{10})"
NEXT_PAGE = r"""(?:pageNumber|page-number)(?:&quot;|"|=|%22|:)+\s*(?:&quot;|")?(\d+)"""
NEXT_TOKEN = "nextpagetoken"


def _first(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def is_blocked(text: Column, status: Column | None = None) -> Column:
    """By status, by emptiness, or by any of the phrases in any case."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    said = F.lit(False)
    for phrase in BLOCK_PHRASES:
        said = said | lower.contains(phrase)
    blank = ~lower.rlike(r"(?U)[^\s\x1c-\x1f]")
    return said | blank | (F.coalesce(status.isin(BLOCK_STATUSES), F.lit(False)) if status is not None else F.lit(False))


def tells_of_block(text: str, status: int | None = None) -> bool:
    """The same test for one text in hand."""
    lower = text.lower()
    return status in BLOCK_STATUSES or not text.strip() or any(p in lower for p in BLOCK_PHRASES)


def scrub_url(url: Column) -> Column:
    """The query of a URL gives way to an ellipsis."""
    return F.regexp_replace(url, r"(?s)\?.*\z", "?...")


def clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def star_rating(text: Column) -> Column:
    return safe_double(_first(text, STARS))


def helpful_votes(text: Column, default_zero: bool = False) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text, VOTES, 1), ",", "")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(0 if default_zero else None).cast("long"))
        .when(F.lower(text).startswith("one person"), F.lit(1).cast("long"))
        .when(digits != "", digits.try_cast("long"))
    )


def item_id(url: Column, html: Column | None = None) -> Column:
    """From the URL, else from the links of the page."""
    found = _first(url, ITEM_IN_URL)
    return found if html is None else F.coalesce(found, _first(html, ITEM_IN_PAGE))


def next_page_number(text: Column) -> Column:
    return _first(text, NEXT_PAGE).try_cast("long")


def has_next_page_token(text: Column) -> Column:
    return F.lower(text).contains(NEXT_TOKEN)
