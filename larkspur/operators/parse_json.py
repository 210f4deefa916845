"""Landed JSON pages to review rows: three feeds, one schema.

Input: one row per page with ``payload`` (the page's text) and what is known about the
request: page, cursor, source_url and, per feed, the app's name, id, country and
language. A payload that is not JSON yields no row and no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_double, safe_long
from ..schema import REVIEW_TYPES

LABEL = "struct<label:string>"
STEAM = (
    "struct<cursor:string,reviews:array<struct<recommendationid:string,language:string,review:string,timestamp_created:string,"
    "voted_up:boolean,votes_up:string,votes_funny:string,author:struct<steamid:string,playtime_forever:string,playtime_at_review:string>>>>"
)
APPLE = f"array<struct<id:{LABEL},title:{LABEL},content:{LABEL},`im:rating`:{LABEL},updated:{LABEL},author:struct<name:{LABEL}>,`im:voteSum`:{LABEL},`im:version`:{LABEL}>>"
GOOGLE = "array<struct<reviewId:string,userName:string,content:string,score:string,thumbsUpCount:string,reviewCreatedVersion:string,at:string,replyContent:string,repliedAt:string>>"


def text_or_null(col: Column) -> Column:
    return F.nullif(col.cast("string"), F.lit(""))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def review_row(**made: Column) -> list[Column]:
    """The 27 columns: those made, the rest null."""
    made.setdefault("collected_at", now())
    return [made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in REVIEW_TYPES.items()]


def _known(pages: DataFrame, *names: str) -> dict[str, Column]:
    return {n: F.col(n) if n in pages.columns else F.lit(None) for n in names}


def steam(pages: DataFrame) -> DataFrame:
    """Cursor pages: an object with ``reviews``; ids become text, counters whole numbers."""
    known = _known(pages, "app_id", "source_url", "page", "cursor", "collected_at")
    rows = pages.select(*[c.alias(f"__{n}") for n, c in known.items()], F.explode(F.from_json("payload", STEAM)["reviews"]).alias("r"))
    r = F.col("r")
    return rows.select(*review_row(
        source=F.lit("steam"),
        item_id=F.col("__app_id"),
        review_id=r["recommendationid"],
        review_text=r["review"],
        recommendation=r["voted_up"],
        review_date=r["timestamp_created"],
        author_id=r["author"]["steamid"],
        helpful_votes=safe_long(r["votes_up"]),
        funny_votes=safe_long(r["votes_funny"]),
        playtime_forever=safe_long(r["author"]["playtime_forever"]),
        playtime_at_review=safe_long(r["author"]["playtime_at_review"]),
        language=r["language"],
        source_url=F.col("__source_url"),
        raw_page_number=F.col("__page"),
        raw_cursor=F.col("__cursor"),
        **({"collected_at": F.col("__collected_at")} if "collected_at" in pages.columns else {}),
    ))


def apple(pages: DataFrame) -> DataFrame:
    """RSS pages: ``feed.entry``, one object or an array; entries without a rating are no reviews."""
    known = _known(pages, "app_name", "app_id", "country", "language", "source_url", "page", "collected_at")
    entries = F.from_json(F.get_json_object("payload", "$.feed.entry"), APPLE)
    rows = pages.select(*[c.alias(f"__{n}") for n, c in known.items()], F.explode(entries).alias("e")).where(F.col("e")["im:rating"].isNotNull())

    def label(*path: str) -> Column:
        at = F.col("e")
        for p in path:
            at = at[p]
        return text_or_null(at["label"])

    return rows.select(*review_row(
        source=F.lit("apple_app_store"),
        app_name=F.col("__app_name"),
        item_id=F.col("__app_id"),
        review_id=label("id"),
        review_title=label("title"),
        review_text=label("content"),
        rating=safe_double(label("im:rating")),
        review_date=label("updated"),
        author_name=label("author", "name"),
        helpful_votes=safe_long(label("im:voteSum")),
        app_version=label("im:version"),
        language=F.col("__language"),
        country=F.col("__country"),
        source_url=F.col("__source_url"),
        raw_page_number=F.col("__page"),
        **({"collected_at": F.col("__collected_at")} if "collected_at" in pages.columns else {}),
    ))


def google_play(pages: DataFrame) -> DataFrame:
    """Wrapper pages: an array of records."""
    known = _known(pages, "app_name", "package_id", "country", "language", "source_url", "page", "cursor", "collected_at")
    rows = pages.select(*[c.alias(f"__{n}") for n, c in known.items()], F.explode(F.from_json("payload", GOOGLE)).alias("r"))
    r = F.col("r")
    return rows.select(*review_row(
        source=F.lit("google_play"),
        app_name=F.col("__app_name"),
        item_id=F.col("__package_id"),
        package_id=F.col("__package_id"),
        review_id=text_or_null(r["reviewId"]),
        review_text=text_or_null(r["content"]),
        rating=safe_double(r["score"]),
        review_date=text_or_null(r["at"]),
        author_name=text_or_null(r["userName"]),
        helpful_votes=safe_long(r["thumbsUpCount"]),
        app_version=text_or_null(r["reviewCreatedVersion"]),
        language=F.col("__language"),
        country=F.col("__country"),
        developer_response=text_or_null(r["replyContent"]),
        developer_response_date=text_or_null(r["repliedAt"]),
        source_url=F.col("__source_url"),
        raw_page_number=F.col("__page"),
        raw_cursor=F.col("__cursor"),
        **({"collected_at": F.col("__collected_at")} if "collected_at" in pages.columns else {}),
    ))


def cursors(pages: DataFrame) -> DataFrame:
    """``pages`` with the cursor that a cursor page's response carries, and its raw row count."""
    read = F.from_json("payload", STEAM)
    return pages.withColumn("response_cursor", text_or_null(read["cursor"])).withColumn("review_count", F.coalesce(F.size(read["reviews"]), F.lit(0)).cast("long"))


def is_json(payload: Column) -> Column:
    return F.is_valid_json(payload) if hasattr(F, "is_valid_json") else F.try_parse_json(payload).isNotNull()
