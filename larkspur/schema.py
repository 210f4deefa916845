"""Fixed schemas: the review row, the features derived from it, requests and batches."""

from __future__ import annotations

from pyspark.sql import types as T

# The review row, in order, with the type each column has once parsed.
REVIEW_TYPES = {
    "source": "string",
    "app_name": "string",
    "item_id": "string",
    "package_id": "string",
    "item_name": "string",
    "review_id": "string",
    "review_title": "string",
    "review_text": "string",
    "rating": "double",
    "recommendation": "boolean",
    "review_date": "string",
    "author_id": "string",
    "author_name": "string",
    "verified_purchase": "boolean",
    "helpful_votes": "long",
    "funny_votes": "long",
    "playtime_forever": "long",
    "playtime_at_review": "long",
    "app_version": "string",
    "language": "string",
    "country": "string",
    "developer_response": "string",
    "developer_response_date": "string",
    "source_url": "string",
    "collected_at": "string",
    "raw_page_number": "long",
    "raw_cursor": "string",
}
REVIEW_COLUMNS = list(REVIEW_TYPES)

# Topics with a lexical signal each.
TOPICS = ["login", "payment", "performance", "subscription", "delivery", "customer_service"]
TOPIC_COLUMNS = [f"{topic}_topic_signal" for topic in TOPICS]

# The derived features, in order.
DERIVED_TYPES = {
    "publication_timestamp": "string",
    "review_text_character_count": "long",
    "review_text_word_count": "long",
    "title_character_count": "long",
    "title_word_count": "long",
    "has_review_text": "boolean",
    "has_title": "boolean",
    "publication_year": "long",
    "publication_month": "long",
    "publication_day_of_week": "string",
    "review_age_days": "double",
    "review_age_at_collection_days": "double",
    "publication_timestamp_missing_or_invalid": "boolean",
    "has_app_version": "boolean",
    "has_developer_reply": "boolean",
    "low_signal_text": "boolean",
    "repeated_full_content": "boolean",
    "repeated_full_content_fingerprint": "string",
    "repeated_full_content_group_size": "long",
    "repeated_review_body": "boolean",
    "repeated_review_body_fingerprint": "string",
    "repeated_review_body_group_size": "long",
    "missing_title": "boolean",
    "missing_review_text": "boolean",
    "missing_rating": "boolean",
    "missing_publication_timestamp": "boolean",
    "declared_language_available": "boolean",
    "language_script_consistent": "boolean",
    **dict.fromkeys(TOPIC_COLUMNS, "boolean"),
    "weak_sentiment_label": "string",
    "feature_rule_version": "string",
    "feature_reference_timestamp": "string",
}
FEATURE_COLUMNS = REVIEW_COLUMNS + list(DERIVED_TYPES)

# Columns that trace a feature row to where it came from.
LINEAGE_COLUMNS = ["source", "app_name", "item_id", "package_id", "item_name", "review_id", "country", "language", "source_url", "collected_at", "raw_page_number", "raw_cursor"]

# Flags whose rates are reported.
RATE_COLUMNS = [
    "missing_title",
    "missing_review_text",
    "missing_rating",
    "missing_publication_timestamp",
    "publication_timestamp_missing_or_invalid",
    "has_developer_reply",
    "has_app_version",
    "low_signal_text",
    "repeated_full_content",
    "repeated_review_body",
    *TOPIC_COLUMNS,
]
# Numbers whose distributions are reported.
NUMERIC_COLUMNS = ["review_text_character_count", "review_text_word_count", "title_character_count", "title_word_count", "review_age_days", "review_age_at_collection_days"]

CONTEXT = ["app_name", "country", "language"]
GROUP = ["app_name", "item_id", "country", "language"]


def struct(types: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in types.items()])


def review_schema() -> T.StructType:
    return struct(REVIEW_TYPES)


def text_schema() -> T.StructType:
    """The review row as files carry it: all strings."""
    return struct(dict.fromkeys(REVIEW_COLUMNS, "string"))


def feature_schema() -> T.StructType:
    return struct(REVIEW_TYPES | DERIVED_TYPES)


REQUEST_TYPES = {
    "source": "string",
    "run": "long",
    "url": "string",
    "status_code": "long",
    "success": "boolean",
    "elapsed_seconds": "double",
    "response_bytes": "long",
    "attempts": "long",
    "blocked": "boolean",
    "error": "string",
}
