"""Quality profiles by source: totals, completeness, applicability, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import REVIEW_COLUMNS

# Which fields each source is expected to fill, and which it can't.
REQUIRED = {
    "steam": ["source", "item_id", "review_id", "review_text", "review_date"],
    "amazon": ["source", "item_id", "review_id", "review_text", "review_date"],
    "google_play": ["source", "app_name", "package_id", "review_id", "review_text", "rating", "review_date"],
    "apple_app_store": ["source", "app_name", "item_id", "review_id", "review_title", "review_text", "rating", "review_date"],
}
SPECIFIC = {
    "steam": ["recommendation", "author_id", "helpful_votes", "funny_votes", "playtime_forever", "playtime_at_review", "language"],
    "amazon": ["rating", "review_title", "author_name", "verified_purchase", "helpful_votes"],
    "google_play": ["author_name", "helpful_votes", "app_version", "language", "country", "developer_response", "developer_response_date"],
    "apple_app_store": ["author_name", "helpful_votes", "app_version", "language", "country"],
}
NOT_APPLICABLE = {
    "steam": ["rating", "review_title", "verified_purchase"],
    "amazon": ["recommendation", "funny_votes", "playtime_forever", "playtime_at_review"],
    "google_play": ["recommendation", "funny_votes", "playtime_forever", "playtime_at_review", "verified_purchase"],
    "apple_app_store": ["recommendation", "funny_votes", "playtime_forever", "playtime_at_review", "verified_purchase", "developer_response", "developer_response_date"],
}
NOTES = {
    "steam": {"rating": "Only a recommendation, yes or no, is given."},
    "google_play": {"access_method": "Read through an unofficial library; review its use before production."},
    "apple_app_store": {"developer_response": "Review records of this feed have shown none."},
}
#: The source that has a recommendation instead of a rating.
NO_RATING = "steam"


def empty_text(column: str = "review_text") -> Column:
    return strip(F.coalesce(F.col(column), F.lit(""))) == ""


def unique_count() -> Column:
    """Distinct ids; all rows, if none has an id."""
    return F.when(F.count("review_id") == 0, F.count("*")).otherwise(F.countDistinct("review_id"))


def profile(reviews: DataFrame, by: str = "source") -> DataFrame:
    """One row per source: totals, duplicates, gaps and raw text lengths."""
    rows = F.count("*")
    extra = F.count("review_id") - F.countDistinct("review_id")
    blank = F.count_if(empty_text())
    length = F.length(F.coalesce("review_text", F.lit("")))
    return reviews.groupBy(by).agg(
        rows.alias("total_rows"),
        unique_count().alias("unique_review_count"),
        extra.alias("duplicates_within_final_dataset"),
        (extra / rows).alias("duplicate_percentage_within_final_dataset"),
        blank.alias("empty_review_text_count"),
        (blank / rows).alias("empty_review_text_percentage"),
        F.when(F.coalesce(F.first(F.col("source")), F.lit("")) != NO_RATING, F.count_if(F.col("rating").isNull())).alias("missing_rating_count"),
        F.count_if(F.col("review_date").isNull()).alias("missing_date_count"),
        F.count_if(F.col("review_id").isNull()).alias("missing_review_id_count"),
        F.avg(length).alias("average_review_text_length"),
        F.min(length).cast("long").alias("minimum_review_text_length"),
        F.max(length).cast("long").alias("maximum_review_text_length"),
    )


def completeness(reviews: DataFrame, by: str = "source") -> DataFrame:
    """Share of non-null values of each review column; an empty text counts as one."""
    return reviews.groupBy(by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"completeness_{c}") for c in REVIEW_COLUMNS if c in reviews.columns])


def completeness_long(reviews: DataFrame, by: str = "source") -> DataFrame:
    wide = completeness(reviews, by).withColumnRenamed(by, "__by")
    fields = [c for c in REVIEW_COLUMNS if c in reviews.columns]
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"completeness_{c}").alias("completeness")) for c in fields])
    return wide.select(F.col("__by").alias(by), F.inline(parts))


def expected(source: Column) -> Column:
    """Fields that a source is expected to fill; none for an unknown source."""
    out = F.array().cast("array<string>")
    for name in REQUIRED:
        out = F.when(source == name, F.array(*[F.lit(f) for f in REQUIRED[name] + SPECIFIC[name]])).otherwise(out)
    return out


def missing_expected(reviews: DataFrame, by: str = "source", kind: Column | None = None) -> DataFrame:
    """Expected fields that no row of the group fills, in the order they are expected."""
    counts = F.create_map(*[x for c in REVIEW_COLUMNS for x in (F.lit(c), F.col(f"__n_{c}"))])
    wide = reviews.groupBy(by).agg(*[F.count(F.col(c)).alias(f"__n_{c}") for c in REVIEW_COLUMNS], F.first(kind if kind is not None else F.col("source")).alias("__kind"))
    return wide.select(by, F.filter(expected(F.col("__kind")), lambda f: F.element_at(counts, f) == 0).alias("missing_expected_fields"))


def available_fields(reviews: DataFrame, by: str = "source") -> DataFrame:
    """Columns with any value but null and the empty text, sorted; 0 and false are values."""
    some = [F.max(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"__s_{c}") for c in REVIEW_COLUMNS]
    wide = reviews.withColumn("__by", F.col(by)).groupBy("__by").agg(*some)
    names = F.array(*[F.when(F.col(f"__s_{c}"), c) for c in REVIEW_COLUMNS])
    return wide.select(F.col("__by").alias(by), F.array_sort(F.array_compact(names)).alias("available_metadata_fields"))


def request_stats(requests: DataFrame, by: str = "source") -> DataFrame:
    """Requests, successes, failures, blocks, success rate and mean time (nulls skipped)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return requests.groupBy(by).agg(
        F.count("*").alias("request_count"),
        F.count_if(ok).alias("successful_request_count"),
        F.count_if(~ok).alias("failed_request_count"),
        F.count_if(F.coalesce(F.col("blocked"), F.lit(False))).alias("blocked_request_count"),
        F.avg(ok.cast("double")).alias("request_success_rate"),
        F.avg("elapsed_seconds").alias("average_response_time"),
        F.array_sort(F.collect_set("status_code")).alias("status_codes"),
    )


def pagination_rate(offline: Column, status: Column, requests: Column, shown: Column) -> Column:
    """Pagination as a rate, as text where there is no number to give."""
    flag = F.when(shown, "1.0").otherwise("0.0")
    return (
        F.when(shown.isNotNull() & (offline | (status != "available")), flag)
        .when(requests == 0, F.lit(None).cast("string"))
        .when(shown.isNull(), "not enough evidence")
        .otherwise(flag)
    )


def flat(reviews: DataFrame, by: str = "source") -> DataFrame:
    """Profile, completeness and applicability as one wide row per source, lists as text."""
    out = profile(reviews, by).join(completeness(reviews, by), by).join(missing_expected(reviews, by), by)
    return applicability(out.withColumn("missing_expected_fields", F.array_join("missing_expected_fields", ", ")), by)


def applicability(rows: DataFrame, by: str = "source") -> DataFrame:
    """What a source is expected to fill and what it can't, as text."""
    for column, names in {"required_common_fields": REQUIRED, "source_specific_fields": SPECIFIC, "not_applicable_fields": NOT_APPLICABLE}.items():
        shown = F.lit("")
        for source, fields in names.items():
            shown = F.when(F.col(by) == source, ", ".join(fields)).otherwise(shown)
        rows = rows.withColumn(column, shown)
    return rows


#: Counts of a profile that are 0 for a source without rows; all else is null.
COUNTS = ["total_rows", "unique_review_count", "duplicates_within_final_dataset", "empty_review_text_count", "missing_date_count", "missing_review_id_count"]


def metrics(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each source of ``facts``, with rows or without: its whole quality profile.

    What requests would say is null where the way of access does not let them be counted.
    """
    counted = F.col("request_count_status") == "available"
    known = facts.select(
        "source",
        F.coalesce("request_count_status", F.lit("unavailable")).alias("request_count_status"),
        F.col("overlap_count").alias("cross_run_overlap_count"),
        F.col("overlap_rate").alias("cross_run_overlap_rate"),
        F.col("new_in_second_run").alias("new_records_in_second_run"),
        F.coalesce(F.greatest(F.size("metadata_fields"), F.lit(0)), F.lit(0)).cast("long").alias("metadata_fields_available_count"),
        F.coalesce("pages_attempted", F.lit(0)).alias("batches_attempted"),
        F.coalesce("pages_completed", F.lit(0)).alias("batches_completed"),
        F.when(counted, F.col("request_count")).alias("pagination_requests"),
        pagination_rate(F.coalesce("offline_parsed", F.lit(False)), F.coalesce("request_count_status", F.lit("unavailable")), F.col("request_count"), F.col("pagination")).alias("pagination_success_rate"),
        F.when(counted & (F.col("request_count") > 0), F.col("successful_requests") / F.col("request_count")).alias("http_request_success_rate"),
        F.when(counted, F.col("average_response_time")).alias("average_response_time"),
        F.when(counted, F.coalesce("blocked_requests", F.lit(0))).alias("blocked_request_count"),
        F.coalesce("parser_errors", F.lit(0)).alias("parser_error_count"),
    )
    rows = known.join(profile(reviews), "source", "left").join(completeness(reviews), "source", "left").join(missing_expected(reviews), "source", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS})
    rows = rows.withColumn("final_dataset_duplicate_count", F.col("duplicates_within_final_dataset"))
    rows = rows.withColumns({"overlap_across_repeat_runs": F.col("cross_run_overlap_count"), "repeat_run_overlap_rate": F.col("cross_run_overlap_rate")})
    # Without rows, every expected field is one that no row fills.
    rows = rows.withColumn("missing_expected_fields", F.array_join(F.coalesce("missing_expected_fields", expected(F.col("source"))), ", "))
    return applicability(rows)
