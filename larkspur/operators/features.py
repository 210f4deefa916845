"""The 37 derived features of a review: one row in, one row out.

All text work is one projection with one Arrow stage. Group sizes of repeated content
come from an aggregate that keeps only groups of two and more: partial sums before the
shuffle take the heat out of a text that everyone posts, and what is left is usually
small enough for the runtime to broadcast instead of moving the reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, casefolded, is_present, normalized, script_consistent, strip, topic_signal, weak_sentiment, word_count
from ..functions.times import days_between, instant, strict_timestamp
from ..rules import Rules, default
from ..schema import FEATURE_COLUMNS, REVIEW_COLUMNS, TOPICS

#: Which identifier names the app: the first that is present.
APP_FIELDS = ["item_id", "package_id", "item_name", "app_name"]
KINDS = {"repeated_full_content": "__full", "repeated_review_body": "__body"}
SCOPE = ["__source", "__app", "__country", "__language"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return df


def app_identifier(fold=casefolded) -> Column:
    named = [F.when(is_present(F.col(f)), F.concat(F.lit(f"{f}:"), fold(F.col(f)))) for f in APP_FIELDS]
    return F.coalesce(*named, F.lit(""))


def with_text(reviews: DataFrame, rules: Rules) -> DataFrame:
    """Normalised title and body, and the scope in which repetition counts."""
    return reviews.select(
        "*",
        normalized(F.col("review_title"), rules).alias("__title"),
        normalized(F.col("review_text"), rules).alias("__text"),
        casefolded(F.col("source")).alias("__source"),
        app_identifier().alias("__app"),
        casefolded(F.col("country")).alias("__country"),
        casefolded(F.col("language")).alias("__language"),
    )


def fingerprints(df: DataFrame, rules: Rules) -> DataFrame:
    """SHA-256 of body, and of title and body; null for texts under the minimum."""
    least = int(rules.section("repeated_content").get("minimum_normalized_characters", 1))
    full = strip(F.concat("__title", F.lit("\n"), "__text"))
    return df.withColumns({"__full": F.when(F.length(full) >= least, F.sha2(full, 256)), "__body": F.when(F.length("__text") >= least, F.sha2("__text", 256))})


def with_group_sizes(df: DataFrame, scope: list[str] = SCOPE, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Each fingerprint column's group size within the scope, flag and fingerprint.

    The kind is part of the key, so both joins read one and the same aggregate.
    """
    keys = {name: F.concat(F.lit(f"{i}:"), F.col(c)) for i, (name, c) in enumerate(kinds.items())}
    both = df.select(*scope, F.explode(F.array(*keys.values())).alias("__key")).where("__key is not null")
    sizes = both.groupBy(*scope, "__key").count().where("count > 1")
    out = df
    for name, column in kinds.items():
        mine = sizes.select(*[F.col(c).alias(f"__of{c}") for c in scope], F.col("__key").alias("__of_key"), F.col("count").alias("__n"))
        same = [F.col(c) == F.col(f"__of{c}") for c in scope] + [keys[name] == F.col("__of_key")]
        out = out.join(mine, same, "left").drop(*[f"__of{c}" for c in scope], "__of_key")
        size = F.coalesce("__n", F.when(F.col(column).isNotNull(), 1).otherwise(0)).cast("long")
        out = out.withColumns({name: size > 1, f"{name}_fingerprint": F.col(column), f"{name}_group_size": size}).drop("__n")
    return out


def time_columns(rules: Rules) -> dict[str, Column]:
    at, collected = F.col("__published"), F.col("__collected")
    return {
        "publication_timestamp": F.col("review_date"),
        "publication_year": F.year(at).cast("long"),
        "publication_month": F.month(at).cast("long"),
        "publication_day_of_week": F.date_format(at, "EEEE"),
        "review_age_days": days_between(instant(rules.reference), at),
        "review_age_at_collection_days": days_between(collected, at),
        "publication_timestamp_missing_or_invalid": at.isNull(),
    }


def text_columns(rules: Rules) -> dict[str, Column]:
    title, text = F.col("__title"), F.col("__text")
    combined = F.trim(F.concat(title, F.lit(" "), text))
    chars, words = F.length(text).cast("long"), F.col("__words")
    low = rules.section("low_signal")
    return {
        "review_text_character_count": chars,
        "review_text_word_count": words,
        "title_character_count": F.length(title).cast("long"),
        "title_word_count": word_count(title, rules),
        "has_review_text": text != "",
        "has_title": title != "",
        "missing_title": title == "",
        "missing_review_text": text == "",
        "low_signal_text": (text == "") | (chars < low["minimum_review_text_characters"]) | (words < low["minimum_review_text_words"]),
        "language_script_consistent": script_consistent(combined, F.col("language"), rules),
        **{f"{topic}_topic_signal": topic_signal(combined, topic, rules) for topic in TOPICS},
    }


def presence_columns() -> dict[str, Column]:
    return {
        "has_app_version": is_present(F.col("app_version")),
        "has_developer_reply": is_present(F.col("developer_response")),
        "missing_rating": ~is_present(F.col("rating")),
        "missing_publication_timestamp": ~is_present(F.col("review_date")),
        "declared_language_available": is_present(F.col("language")),
    }


def generate(reviews: DataFrame, rules: Rules | None = None, keep: list[str] | None = None) -> DataFrame:
    """The feature frame: review columns and derived ones, in fixed order.

    ``keep`` names further input columns to carry along, such as a row number for
    the sink to sort by.
    """
    rules = rules or default()
    require(reviews, REVIEW_COLUMNS)
    base = reviews.select(*REVIEW_COLUMNS, *(keep or []))
    base = fingerprints(with_text(base, rules), rules)
    base = base.withColumns({"__words": word_count(F.col("__text"), rules), "__published": strict_timestamp(F.col("review_date")), "__collected": strict_timestamp(F.col("collected_at"))})
    base = base.withColumns(time_columns(rules) | text_columns(rules) | presence_columns() | {
        "weak_sentiment_label": weak_sentiment(F.col("rating")),
        "feature_rule_version": F.lit(rules.version),
        "feature_reference_timestamp": F.lit(rules.reference_text),
    })
    return with_group_sizes(base).select(*FEATURE_COLUMNS, *(keep or []))
