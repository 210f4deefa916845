"""Validation of a feature frame: summary, rates, tidy distributions, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONTEXT, LINEAGE_COLUMNS, NUMERIC_COLUMNS, RATE_COLUMNS
from ..session import cut
from . import sample as sampling
from .features import require
from .medians import medians, same_group
from .sample import as_bool

MISSING = "<missing>"
# What makes a review's identity, in its context.
IDENTITY = ["source", "item_id", "country", "language", "review_id"]


def rate(flag: str) -> Column:
    """Share of true values; 0 without rows."""
    return F.coalesce(F.avg(as_bool(F.col(flag)).cast("double")), F.lit(0.0))


def identity_uniqueness(features: DataFrame) -> DataFrame:
    """Rows, distinct identities (null as empty), and the surplus."""
    counted = features.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in IDENTITY]).count()
    rows = F.coalesce(F.sum("count"), F.lit(0)).cast("long")
    return counted.agg(rows.alias("output_row_count"), F.count("*").alias("unique_contextual_review_identity_count"), (rows - F.count("*")).alias("duplicate_contextual_identity_count"))


def label_counts(features: DataFrame) -> DataFrame:
    label = F.coalesce("weak_sentiment_label", F.lit(MISSING))
    return features.groupBy(label.alias("weak_sentiment_label")).agg(F.count("*").alias("review_count"))


def overall_rates(features: DataFrame) -> DataFrame:
    """One wide aggregate, a row per flag."""
    wide = features.agg(*[rate(c).alias(c) for c in RATE_COLUMNS])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("rate")) for c in RATE_COLUMNS])))


def contexts(features: DataFrame) -> DataFrame:
    """Distinct contexts and their rows; the sink sorts them, nulls last."""
    return features.groupBy(*CONTEXT).agg(F.count("*").alias("row_count"))


def versions(features: DataFrame) -> DataFrame:
    return features.agg(F.array_sort(F.collect_set("feature_rule_version")).alias("feature_rule_versions"), F.array_sort(F.collect_set("feature_reference_timestamp")).alias("feature_reference_timestamps"))


LINE = "struct<metric:string,value:string,count:bigint,rate:double,minimum:double,median:double,mean:double,maximum:double>"


def _line(metric: str, value, count, share=None, numbers=None) -> Column:
    null = F.lit(None).cast("double")
    return F.struct(
        F.lit(metric).alias("metric"),
        (F.lit(value) if value else F.lit(None).cast("string")).alias("value"),
        count.alias("count"),
        (share if share is not None else null).alias("rate"),
        *[(n if numbers else null).cast("double").alias(name) for name, n in zip(("minimum", "median", "mean", "maximum"), numbers or [null] * 4)],
    ).cast(LINE)


def distributions(features: DataFrame) -> DataFrame:
    """Tidy rows per context: six numbers, sixteen flags, ratings, publication years.

    One wide aggregate makes all but the ratings and the medians; a second, small one makes
    the ratings, and the medians come by selection. All read the columns they need from one
    table that is made once, without texts.
    """
    features = cut(features.select(*CONTEXT, "rating", "publication_year", *NUMERIC_COLUMNS, *RATE_COLUMNS))
    rows = F.count("*").alias("row_count")
    numbers = [*NUMERIC_COLUMNS, "publication_year"]
    wide = features.groupBy(*CONTEXT).agg(
        rows,
        *[f(F.col(c)).alias(f"__{name}_{c}") for c in numbers for name, f in (("n", F.count), ("min", F.min), ("avg", F.avg), ("max", F.max))],
        *[F.count_if(as_bool(F.col(c))).alias(f"__t_{c}") for c in RATE_COLUMNS],
    )

    middle = medians(features, CONTEXT, numbers)
    wide = wide.join(middle.select(*[F.col(c).alias(f"__{c}") for c in CONTEXT], *[F.col(c).alias(f"__med_{c}") for c in numbers]), same_group(CONTEXT))

    def of(c):
        return [F.col(f"__{name}_{c}") for name in ("min", "med", "avg", "max")]

    lines = [_line(c, None, F.col(f"__n_{c}"), None, of(c)) for c in NUMERIC_COLUMNS]
    lines += [_line(c, "true", F.col(f"__t_{c}"), F.col(f"__t_{c}") / F.col("row_count")) for c in RATE_COLUMNS]
    lines.append(_line("publication_time_coverage", "valid", F.col("__n_publication_year"), F.col("__n_publication_year") / F.col("row_count"), of("publication_year")))
    tidy = wide.select(*CONTEXT, "row_count", F.inline(F.array(*lines)))
    return tidy.unionByName(rating_histogram(features), allowMissingColumns=True)


def rating_histogram(features: DataFrame) -> DataFrame:
    """Counts of each rating as text, absent ones in a bucket, with each context's total."""
    value = F.coalesce(F.col("rating").cast("string"), F.lit(MISSING))
    counts = features.groupBy(*CONTEXT, value.alias("value")).agg(F.count("*").alias("count"))
    # One row per context and rating: the totals are a window over this small table.
    from pyspark.sql import Window

    total = F.sum("count").over(Window.partitionBy(*CONTEXT))
    return counts.select(*CONTEXT, total.alias("row_count"), F.lit("rating_distribution").alias("metric"), "value", "count", (F.col("count") / total).alias("rate"))


def summary(features: DataFrame, input_rows: int | None = None) -> dict:
    """The report's head, as a dictionary: a few single-row aggregates."""
    require(features, LINEAGE_COLUMNS)
    identity = identity_uniqueness(features).first()
    stamps = versions(features).first()
    rows = identity["output_row_count"]
    return {
        "input_row_count": rows if input_rows is None else input_rows,
        "output_row_count": rows,
        "row_count_preserved": input_rows is None or input_rows == rows,
        "unique_contextual_review_identity_count": identity["unique_contextual_review_identity_count"],
        "duplicate_contextual_identity_count": identity["duplicate_contextual_identity_count"],
        "lineage_fields_retained": True,
        "lineage_fields": LINEAGE_COLUMNS,
        "feature_rule_versions": stamps["feature_rule_versions"],
        "feature_reference_timestamps": stamps["feature_reference_timestamps"],
        "weak_sentiment_label_counts": {r["weak_sentiment_label"]: r["review_count"] for r in label_counts(features).orderBy(F.desc("review_count"), "weak_sentiment_label").collect()},
        "overall_rates": {r["flag"]: r["rate"] for r in overall_rates(features).collect()},
    }


def build(features: DataFrame, input_rows: int | None = None, sample_size: int = sampling.SIZE) -> dict:
    """Summary, distributions and annotation sheet of a feature frame."""
    return {"summary": summary(features, input_rows), "distributions": distributions(features), "manual_sample": sampling.annotation_sheet(features, sample_size)}
