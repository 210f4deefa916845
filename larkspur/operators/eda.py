"""Exploratory tables per app, item, storefront and language.

Null keys are groups of their own. A single aggregate yields a table wherever one can;
only medians, which are selected, are joined to theirs, by keys that may be null. Every table has its full
schema, with rows or without.

``tables`` makes all ten from one read of the reviews. What is kept of a row is slim: its keys,
its length, one bit a field for what it lacks, and its text only if that is of low signal. Of
these rows come *cells* (group and rating), from which six tables are added up, and *ids* (group
and review id), from which two are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import GROUP, REVIEW_COLUMNS
from ..session import cut, table_of
from .medians import medians, same_group

LOW_SIGNAL_LENGTH = 15
#: Duplicate ids that a summary names.
SAMPLE_IDS = 25
LANGUAGE_NOTE = "The language is the one that was asked for; none is detected here."


def keys() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in GROUP]


def text_length() -> Column:
    """Code points of the stripped raw text; 0 without one."""
    return F.length(strip(F.coalesce(F.col("review_text"), F.lit(""))))


def with_length(reviews: DataFrame, least: int = LOW_SIGNAL_LENGTH) -> DataFrame:
    return reviews.withColumn("text_length", text_length().cast("long")).withColumn("is_low_signal", (F.col("text_length") < least) | F.col("review_text").isNull())


def review_volume(reviews: DataFrame) -> DataFrame:
    ids = F.count("review_id")
    return reviews.groupBy(*GROUP).agg(
        F.count("*").alias("review_count"),
        F.countDistinct("review_id").alias("unique_review_count"),
        (ids - F.countDistinct("review_id")).alias("duplicate_count"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*GROUP, "rating").agg(F.count("*").alias("review_count"))


def text_length_stats(reviews: DataFrame, least: int = LOW_SIGNAL_LENGTH) -> DataFrame:
    """Lengths are made once, without texts; their medians come by selection."""
    lengths = cut(with_length(reviews, least).select(*GROUP, "text_length", "is_low_signal"))
    low, count = F.sum(F.col("is_low_signal").cast("long")), F.count("*")
    table = lengths.groupBy(*GROUP).agg(
        count.alias("review_count"),
        F.min("text_length").alias("minimum_text_length"),
        F.max("text_length").alias("maximum_text_length"),
        F.avg("text_length").alias("average_text_length"),
        low.alias("low_signal_review_count"),
        F.sum((F.col("text_length") == 0).cast("long")).alias("empty_text_count"),
        (low / count).alias("low_signal_rate"),
    )
    middle = medians(lengths, GROUP, ["text_length"]).withColumnsRenamed({c: f"__{c}" for c in GROUP})
    joined = table.join(middle, same_group(GROUP))
    return joined.select(*GROUP, "review_count", "minimum_text_length", "maximum_text_length", "average_text_length", F.col("text_length").alias("median_text_length"), "low_signal_review_count", "empty_text_count", "low_signal_rate")


def date_coverage(reviews: DataFrame) -> DataFrame:
    """Dates compare as text, as they were received."""
    return reviews.groupBy(*GROUP).agg(
        F.count("review_date").alias("dated_review_count"),
        F.count_if(F.col("review_date").isNull()).alias("undated_review_count"),
        F.min("review_date").alias("earliest_review_date"),
        F.max("review_date").alias("latest_review_date"),
    )


def missing_fields(reviews: DataFrame) -> DataFrame:
    """One wide aggregate, then a row for each group and field."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"__n{i}") if c in reviews.columns else F.count("*").alias(f"__n{i}") for i, c in enumerate(REVIEW_COLUMNS)]
    wide = reviews.groupBy(*GROUP).agg(F.count("*").alias("__rows"), *counts)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__n{i}").alias("missing_count")) for i, c in enumerate(REVIEW_COLUMNS)])
    long = wide.select(*GROUP, "__rows", F.inline(fields))
    return long.select(*GROUP, "field", "missing_count", (F.col("missing_count") / F.col("__rows")).alias("missing_rate"))


def duplicate_records(reviews: DataFrame) -> DataFrame:
    apps = F.array_join(F.array_sort(F.collect_set("app_name")), ", ")
    found = reviews.where("review_id is not null").groupBy("review_id").agg(F.count("*").alias("duplicate_count"), apps.alias("apps"))
    return found.where("duplicate_count > 1")


def duplicate_ids(reviews: DataFrame) -> DataFrame:
    """Ids that occur more than once, a row each, sorted."""
    return duplicate_records(reviews).select("review_id").orderBy("review_id")


def duplicate_id_sample(reviews: DataFrame, size: int = SAMPLE_IDS) -> DataFrame:
    """The first of them."""
    return duplicate_ids(reviews).limit(size)


def language_notes(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*GROUP).agg(F.count("*").alias("review_count")).select(
        *GROUP, "review_count", F.lit(False).alias("language_detection_available"), F.col("country").alias("region_storefront"), F.lit(LANGUAGE_NOTE).alias("issue_note")
    )


def low_signal_reviews(reviews: DataFrame, least: int = LOW_SIGNAL_LENGTH) -> DataFrame:
    return with_length(reviews, least).where("is_low_signal").select(*GROUP, "review_id", "rating", "review_date", "text_length", "review_text")


def slim_rows(reviews: DataFrame, least: int = LOW_SIGNAL_LENGTH) -> DataFrame:
    """What the ten tables need of a row; bit i of ``lacks`` is set where it has no i-th field."""
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") if c in reviews.columns else F.lit(1 << i).cast("long") for i, c in enumerate(REVIEW_COLUMNS)]
    lacks = reduce(lambda a, b: a.bitwiseOR(b), bits)
    text = F.when(F.col("is_low_signal"), F.col("review_text"))
    return with_length(reviews, least).select(*GROUP, "rating", "review_id", "review_date", "text_length", "is_low_signal", text.alias("review_text"), lacks.alias("lacks"))


def cells_of(slim: DataFrame) -> DataFrame:
    """One row a group and rating: counts, ends and sums that add up to those of the group."""
    return slim.groupBy(*GROUP, "rating").agg(
        F.count("*").alias("rows"),
        F.count("review_date").alias("dated"),
        F.min("review_date").alias("earliest"),
        F.max("review_date").alias("latest"),
        F.min("text_length").alias("shortest"),
        F.max("text_length").alias("longest"),
        F.sum("text_length").alias("length"),
        F.count_if("is_low_signal").alias("low"),
        F.count_if(F.col("text_length") == 0).alias("blank"),
        *[F.count_if(F.col("lacks").bitwiseAND(F.lit(1 << i)) != 0).alias(f"lacks_{i}") for i in range(len(REVIEW_COLUMNS))],
    )


def groups_of(cells: DataFrame) -> DataFrame:
    """One row a group, from its cells."""
    added = ["rows", "dated", "length", "low", "blank", *[f"lacks_{i}" for i in range(len(REVIEW_COLUMNS))]]
    ends = [(F.min, "earliest"), (F.max, "latest"), (F.min, "shortest"), (F.max, "longest")]
    return cells.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in added], *[f(c).alias(c) for f, c in ends])


def ids_of(slim: DataFrame) -> DataFrame:
    """One row a group and review id, with its number of rows."""
    return slim.where("review_id is not null").groupBy(*GROUP, "review_id").agg(F.count("*").alias("rows"))


def tables(reviews: DataFrame, batches: DataFrame | None = None, errors: list[str] | None = None, least: int = LOW_SIGNAL_LENGTH) -> dict[str, DataFrame]:
    """All ten tables, sorted as they are written.

    The reviews are read once, here; the tables are plans over what is kept of them.
    """
    spark = reviews.sparkSession
    batches = batches if batches is not None else spark.createDataFrame([], "status string")
    slim = table_of(slim_rows(reviews, least))
    cells, ids = cut(cells_of(slim)), cut(ids_of(slim))
    groups = cut(groups_of(cells))
    named = [F.col(c).alias(f"__{c}") for c in GROUP]
    by_id = ids.groupBy(*named).agg(F.count("*").alias("unique"), F.sum("rows").alias("known"))
    unique, known = F.coalesce("unique", F.lit(0)), F.coalesce("known", F.lit(0))
    middle = medians(slim.select(*GROUP, "text_length"), GROUP, ["text_length"]).withColumnsRenamed({c: f"__{c}" for c in GROUP})
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"lacks_{i}").alias("missing_count")) for i, c in enumerate(REVIEW_COLUMNS)])
    apps = F.array_join(F.array_sort(F.collect_set("app_name")), ", ")
    lengths = groups.join(middle.withColumnRenamed("text_length", "median"), same_group(GROUP)).select(
        *GROUP,
        F.col("rows").alias("review_count"),
        F.col("shortest").alias("minimum_text_length"),
        F.col("longest").alias("maximum_text_length"),
        (F.col("length") / F.col("rows")).alias("average_text_length"),
        F.col("median").alias("median_text_length"),
        F.col("low").alias("low_signal_review_count"),
        F.col("blank").alias("empty_text_count"),
        (F.col("low") / F.col("rows")).alias("low_signal_rate"),
    )
    return {
        "review_volume_by_app": groups.join(by_id, same_group(GROUP), "left").select(*GROUP, F.col("rows").alias("review_count"), unique.alias("unique_review_count"), (known - unique).alias("duplicate_count")).orderBy(*keys()),
        "rating_distribution": cells.select(*GROUP, "rating", F.col("rows").alias("review_count")).orderBy(*keys(), F.col("rating").asc_nulls_last()),
        "review_text_length": lengths.orderBy(*keys()),
        "date_coverage": groups.select(
            *GROUP, F.col("dated").alias("dated_review_count"), (F.col("rows") - F.col("dated")).alias("undated_review_count"), F.col("earliest").alias("earliest_review_date"), F.col("latest").alias("latest_review_date")
        ).orderBy(*keys()),
        "missing_fields": groups.select(*GROUP, "rows", F.inline(fields)).select(*GROUP, "field", "missing_count", (F.col("missing_count") / F.col("rows")).alias("missing_rate")).orderBy(*keys()),
        "duplicate_records": ids.groupBy("review_id").agg(F.sum("rows").alias("duplicate_count"), apps.alias("apps")).where("duplicate_count > 1").orderBy("review_id"),
        "language_region_issues": groups.select(
            *GROUP, F.col("rows").alias("review_count"), F.lit(False).alias("language_detection_available"), F.col("country").alias("region_storefront"), F.lit(LANGUAGE_NOTE).alias("issue_note")
        ).orderBy(*keys()),
        "low_signal_reviews": slim.where("is_low_signal").select(*GROUP, "review_id", "rating", "review_date", "text_length", "review_text"),
        "pagination_depth_and_failures": batches,
        "errors": spark.createDataFrame([(e,) for e in errors or []], "error string"),
    }
