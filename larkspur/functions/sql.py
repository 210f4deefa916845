"""The review functions as SQL: scalar functions that are SQL text themselves, and a table function over Arrow.

A scalar function made by ``CREATE TEMPORARY FUNCTION ... RETURN`` is an expression to the
optimizer, which folds it into the plan as if it were written out: no Python runs for it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..rules import Rules, default
from .text import topic_pattern
from .times import CANONICAL, ISO


def literal(text: str) -> str:
    """A SQL string of exactly this text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _part(i: int, absent: str) -> str:
    found = f"regexp_extract(trimmed(raw), {literal(ISO)}, {i})"
    return f"CASE WHEN {found} = '' THEN '{absent}' ELSE {found} END"


def statements(rules: Rules) -> list[str]:
    """The functions, those first that others use."""
    form = rules.section("text_normalization")["unicode_form"]
    fold = rules.section("text_normalization").get("casefold", True)
    topics = []
    for topic, words in rules.section("topic_signal_keywords").items():
        words = [unicodedata.normalize(form, str(w)) for w in words]
        topics.append(f"WHEN {literal(topic)} THEN text RLIKE {literal(topic_pattern([w.casefold() if fold else w for w in words]))}")
    zone = f"CASE WHEN regexp_extract(trimmed(raw), {literal(ISO)}, 6) = 'Z' THEN '+00:00' ELSE concat(regexp_extract(trimmed(raw), {literal(ISO)}, 7), ':', {_part(8, '00')}) END"
    rebuilt = f"concat(regexp_extract(trimmed(raw), {literal(ISO)}, 1), 'T', regexp_extract(trimmed(raw), {literal(ISO)}, 2), {_part(3, ':00')}, {_part(4, ':00')}, '.', {_part(5, '0')}, {zone})"
    low = rules.section("low_signal")
    edges = literal(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")
    return [
        f"trimmed(text STRING) RETURNS STRING RETURN regexp_replace(text, {edges}, '')",
        f"is_present(text STRING) RETURNS BOOLEAN RETURN coalesce(text <> 'NaN' AND text RLIKE {literal(r'(?U)[^\s\x1c-\x1f]')}, false)",
        "blank_to_null(text STRING) RETURNS STRING RETURN CASE WHEN is_present(text) THEN text END",
        f"strict_timestamp(raw STRING) RETURNS TIMESTAMP RETURN CASE WHEN raw RLIKE {literal(CANONICAL)} THEN try_cast(raw AS TIMESTAMP) WHEN trimmed(raw) RLIKE {literal(ISO)} THEN try_cast({rebuilt} AS TIMESTAMP) END",
        "days_between(later TIMESTAMP, earlier TIMESTAMP) RETURNS DOUBLE RETURN timestampdiff(MICROSECOND, earlier, later) / 1e6D / 86400.0D",
        f"has_topic(text STRING, topic STRING) RETURNS BOOLEAN RETURN CASE topic {' '.join(topics)} END",
        "weak_sentiment(rating DOUBLE) RETURNS STRING RETURN CASE WHEN rating BETWEEN 1 AND 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating BETWEEN 4 AND 5 THEN 'positive' END",
        f"is_low_signal(characters BIGINT, words BIGINT) RETURNS BOOLEAN RETURN coalesce(characters, 0) < {int(low['minimum_review_text_characters'])} OR coalesce(words, 0) < {int(low['minimum_review_text_words'])}",
    ]


RAW = "page_id long, review_id string, title string, body string, rating string, author string, badge string, helpful string, item_id string"


@F.arrow_udtf(returnType=RAW)
class ParsePages:
    """The reviews of whole batches of pages (page_id, payload): ``parse_review_pages(TABLE(pages))``.

    Spark takes no Arrow function behind LATERAL; there ``parse_review_html(payload)`` serves, row by row.
    """

    def eval(self, pages):
        from ..operators.html_reviews import raw_reviews

        out = [(i, r[0], r[1], r[2], r[3], r[5], r[6], r[7], r[8]) for i, text in zip(pages.column(0).to_pylist(), pages.column(1).to_pylist()) for r in raw_reviews(text)]
        columns = list(zip(*out)) or [()] * 9
        names = [f.strip().split()[0] for f in RAW.split(",")]
        yield pa.table({n: pa.array(c, pa.int64() if n == "page_id" else pa.string()) for n, c in zip(names, columns)})


def register_sql(spark: SparkSession, rules: Rules | None = None) -> None:
    for text in statements(rules or default()):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("parse_review_pages", ParsePages)
