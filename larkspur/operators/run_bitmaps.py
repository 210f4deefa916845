"""How runs overlap, from a bitmap of each run's ids.

Ids get codes from a dictionary that grows by what is new: an id's code is its bucket and its
place in it, so codes stay dense without a global order. A run is then a few bitmaps, 4 KB for
32,768 codes; what comes later is merged into them by ``or``, and overlaps, distinct and new ids
of any number of runs are ``and`` and ``or`` of bitmaps, not a distinct count over all rows.

Rows without an id are in no bitmap; a run of such rows only is an empty run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collect import has_id

#: Buckets of the dictionary; each numbers its own ids.
BUCKETS = 256


def coded(ids: DataFrame, dictionary: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The dictionary (review_id, code) with the ids that it lacks added; codes in it stay."""
    fresh = ids.where(has_id()).select("review_id").distinct()
    if dictionary is not None:
        fresh = fresh.join(dictionary, "review_id", "left_anti")
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("review_id"), F.lit(buckets)))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("review_id")) - 1
    if dictionary is None:
        return fresh.select("review_id", (nth * buckets + F.col("bucket")).cast("long").alias("code"))
    next_free = dictionary.groupBy(F.pmod("code", F.lit(buckets)).alias("bucket")).agg((F.max(F.floor(F.col("code") / buckets)) + 1).alias("free"))
    added = fresh.withColumn("nth", nth).join(next_free, "bucket", "left")
    added = added.select("review_id", ((F.coalesce("free", F.lit(0)) + F.col("nth")) * buckets + F.col("bucket")).cast("long").alias("code"))
    return dictionary.select("review_id", "code").unionByName(added)


def bitmaps(rows: DataFrame, dictionary: DataFrame, by: list[str] | None = None, run: str = "run") -> DataFrame:
    """``by``, run, part and bits: the ids of each run. A run without ids has one empty part."""
    by = by or []
    marked = rows.join(dictionary, "review_id", "left")
    parts = marked.where("code is not null").groupBy(*by, run, F.bitmap_bucket_number("code").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    none = rows.select(*by, run).distinct().select(*by, run, F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("bits"))
    return parts.unionByName(none)


def merged(stored: DataFrame, more: DataFrame, by: list[str] | None = None, run: str = "run") -> DataFrame:
    """Bitmaps of both: what has come later is joined to its run."""
    return stored.unionByName(more).groupBy(*(by or []), run, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def overlap(stored: DataFrame, by: list[str] | None = None, run: str = "run", first: int = 1, second: int = 2) -> DataFrame:
    """Per ``by``: runs, whether repetition is shown, ids in all runs, distinct ids, the overlap rate and the second run's new ids."""
    by = by or []
    bits = stored.where("part is not null")
    filled = bits.groupBy(*by, run).agg(F.sum(F.bitmap_count("bits")).alias("ids"))
    runs = stored.select(*by, run).distinct().join(filled, [*by, run], "left").groupBy(*by).agg(F.count("*").alias("runs"), F.bool_and(F.coalesce(F.col("ids") > 0, F.lit(False))).alias("all_filled"), F.max((F.col(run) == second).cast("int")).alias("has_second"))

    def of(number: int):
        return F.bitmap_or_agg(F.when(F.col(run) == number, F.col("bits")))

    parts = bits.groupBy(*by, "part").agg(F.count("*").alias("in_runs"), F.bitmap_and_agg("bits").alias("shared"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("distinct"), F.bitmap_count(F.bitmap_or_agg(F.when(F.col(run).isin(first, second), F.col("bits")))).alias("either"), F.bitmap_count(of(first)).alias("before"))
    joined = runs.join(parts, by, "left") if by else runs.crossJoin(parts) if not parts.isEmpty() else runs.select("*", *[F.lit(None).cast(k).alias(c) for c, k in parts.dtypes])
    whole = joined.groupBy(*by, "runs", "all_filled").agg(
        F.coalesce(F.sum(F.when(F.col("in_runs") == F.col("runs"), F.bitmap_count("shared"))), F.lit(0)).alias("shared"),
        F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct_ids"),
        F.coalesce(F.sum(F.col("either") - F.col("before")), F.lit(0)).alias("fresh"),
    )
    again = F.col("runs") >= 2
    return whole.select(
        *by, "runs", (again & F.col("all_filled")).alias("repeated_collection_demonstrated"), F.when(again, F.col("shared")).otherwise(0).alias("overlap_count"), "distinct_ids",
        (F.when(again, F.col("shared")).otherwise(0) / F.nullif(F.col("distinct_ids"), F.lit(0))).alias("overlap_rate"), F.when(again, F.col("fresh")).alias("new_records_in_second_run"),
    )
