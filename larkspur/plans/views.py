"""Inputs of the registered queries: review-shaped views of the driver's tables.

``REVIEWS`` is one SQL text that Spark and DuckDB both run; it makes the input only, and
each query's operator and its SQL are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import DEFAULT, Rules, check
from ..schema import REVIEW_TYPES
from ..sources.files import spread

REVIEWS = """
SELECT 'driver' AS source, d.source AS app_name, d.source AS item_id,
 CAST(d.doc_id AS VARCHAR(32)) AS review_id,
 CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE substr(split_part(d.text, chr(10), 1), 1, 60) END AS review_title,
 CASE WHEN d.doc_id % 29 = 0 THEN '   ' ELSE d.text END AS review_text,
 CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(1 + d.doc_id % 5 AS DOUBLE) END AS rating,
 l.quality = 1 AS recommendation,
 CASE WHEN d.doc_id % 19 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 'not-a-date'
      WHEN d.doc_id % 23 = 0 THEN '2026-07-05T00:00:00'
      ELSE concat('2026-07-0', CAST(1 + d.doc_id % 7 AS VARCHAR(2)), 'T',
                  lpad(CAST(d.doc_id % 24 AS VARCHAR(2)), 2, '0'), ':00:00',
                  CASE WHEN d.doc_id % 2 = 0 THEN 'Z' ELSE '-07:00' END) END AS review_date,
 CASE WHEN d.doc_id % 4 = 0 THEN 'gb' ELSE 'us' END AS country, d.lang AS language,
 '2026-07-08T00:00:00Z' AS collected_at, CAST(floor(d.doc_id / 50) AS INT) + 1 AS raw_page_number
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
#: The same, and a tenth of the rows once more under another app.
COPIES = "SELECT source, concat(app_name, '-copy') AS app_name, concat(item_id, '-copy') AS item_id, review_id, review_title, review_text, rating, recommendation, review_date, country, language, collected_at, raw_page_number FROM {reviews} WHERE CAST(review_id AS BIGINT) % 10 = 0"
#: As a tenth of the rows again in their own app.
REPEATS = "SELECT * FROM {reviews} WHERE CAST(review_id AS BIGINT) % 10 = 0"

# Keywords that the invented prose of the driver's documents holds.
KEYWORDS = {"login": ["the"], "payment": ["in"], "performance": ["de", "la"], "subscription": ["und", "der"], "delivery": ["password"], "customer_service": ["apache license", "mit license"]}


def rules() -> Rules:
    return check(DEFAULT | {"topic_signal_keywords": KEYWORDS})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVIEWS, documents=spread(table(spark, sf_dir, "documents")), labels=table(spark, sf_dir, "labels"))


def full(df: DataFrame) -> DataFrame:
    """All 27 columns; what the view lacks is null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in REVIEW_TYPES.items()])


def with_copies(spark: SparkSession, sf_dir: str, more: str = COPIES) -> DataFrame:
    base = reviews(spark, sf_dir)
    return base.unionByName(spark.sql(more, reviews=base))


def sql_reviews() -> str:
    return REVIEWS.format(documents="documents", labels="labels")


def sql_with(more: str = "") -> str:
    """The CTE ``reviews`` and, with ``more``, ``allrows`` with the copies."""
    text = f"WITH reviews AS ({sql_reviews()})"
    return text + (f", allrows AS (SELECT * FROM reviews UNION ALL {more.format(reviews='reviews')})" if more else "")


def normal(column: str) -> str:
    """SQL of a normalised text: what the driver's documents hold beyond ASCII is covered."""
    kept = f"CASE WHEN regexp_matches({column}, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]') THEN {column} ELSE '' END"
    return f"trim(regexp_replace(replace(lower(coalesce({kept}, '')), 'ß', 'ss'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"


WORD_SQL = "[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*"


def _topic(topic: str) -> str:
    words = "|".join(k.replace(" ", "\\s+") for k in KEYWORDS[topic])
    return f"regexp_matches(whole, '(^|[^\\p{{L}}\\p{{N}}_])(?:{words})($|[^\\p{{L}}\\p{{N}}_])')"


def sql_features(tail: str = "") -> str:
    """CTEs up to ``features``: the derived columns that queries use."""
    topics = ", ".join(f"{_topic(t)} AS {t}_topic_signal" for t in KEYWORDS)
    stamp = "CASE WHEN regexp_matches(review_date, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN epoch_us(try_cast(review_date AS TIMESTAMPTZ)) END"
    reference, collected = "epoch_us(CAST('2026-07-07T00:00:00Z' AS TIMESTAMPTZ))", "epoch_us(CAST(collected_at AS TIMESTAMPTZ))"
    return f"""{sql_with()},
texts AS (SELECT *, {normal('review_title')} AS ntitle, {normal('review_text')} AS ntext, {stamp} AS us FROM reviews),
counted AS (
  SELECT *, trim(concat(ntitle, ' ', ntext)) AS whole, CAST(length(ntext) AS BIGINT) AS review_text_character_count,
    CAST(len(regexp_extract_all(ntext, '{WORD_SQL}')) AS BIGINT) AS review_text_word_count,
    CAST(length(ntitle) AS BIGINT) AS title_character_count, CAST(len(regexp_extract_all(ntitle, '{WORD_SQL}')) AS BIGINT) AS title_word_count,
    CASE WHEN ntext <> '' THEN sha256(ntext) END AS body_print,
    CASE WHEN trim(concat(ntitle, ntext)) <> '' THEN sha256(CASE WHEN ntitle = '' THEN ntext WHEN ntext = '' THEN ntitle ELSE concat(ntitle, chr(10), ntext) END) END AS full_print,
    length(regexp_replace(trim(concat(ntitle, ' ', ntext)), '[^\\p{{L}}]', '', 'g')) AS letters,
    length(regexp_replace(trim(concat(ntitle, ' ', ntext)), '[^\\p{{Latin}}]', '', 'g')) AS latin,
    CAST(year(make_timestamp(us)) AS BIGINT) AS publication_year, CAST(month(make_timestamp(us)) AS BIGINT) AS publication_month, dayname(make_timestamp(us)) AS publication_day_of_week,
    ({reference} - us) / 1e6 / 86400.0 AS review_age_days, ({collected} - us) / 1e6 / 86400.0 AS review_age_at_collection_days
  FROM texts),
features AS (
  SELECT *, ntitle = '' AS missing_title, ntext = '' AS missing_review_text, rating IS NULL AS missing_rating, review_date IS NULL AS missing_publication_timestamp,
    us IS NULL AS publication_timestamp_missing_or_invalid, false AS has_developer_reply, false AS has_app_version,
    ntext = '' OR review_text_character_count < 15 OR review_text_word_count < 3 AS low_signal_text,
    CASE WHEN body_print IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY item_id, country, language, body_print) END AS repeated_review_body_group_size,
    CASE WHEN full_print IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY item_id, country, language, full_print) END AS repeated_full_content_group_size,
    CASE WHEN language = 'en' AND letters >= 3 THEN latin / letters >= 0.70 END AS language_script_consistent,
    CASE WHEN rating BETWEEN 1 AND 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating BETWEEN 4 AND 5 THEN 'positive' END AS weak_sentiment_label,
    {topics}
  FROM counted),
flagged AS (SELECT *, repeated_full_content_group_size > 1 AS repeated_full_content, repeated_review_body_group_size > 1 AS repeated_review_body FROM features)
{tail}"""
