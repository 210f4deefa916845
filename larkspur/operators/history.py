"""A long history of review ids that new rows are held against, without moving it.

The history is a table bucketed by the id: rows are hashed to its buckets and join where the
buckets lie, so each run shuffles what has come, never what is known. New ids are appended in
the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collect import has_id

#: Ids of a bucket, about.
BUCKET_IDS = 2_000_000


def buckets_for(ids: int) -> int:
    """How many buckets a history of so many ids should begin with; it keeps them for good."""
    return max(8, -(-ids // BUCKET_IDS))


def remember(rows: DataFrame, table: str, path: str, buckets: int, key: str = "review_id") -> None:
    """Adds the ids of ``rows`` that ``table`` lacks; makes the table at ``path`` if there is none.

    One task writes a bucket, so a run adds one file to each.
    """
    spark = rows.sparkSession
    ids = rows.where(has_id(key)).select(F.col(key).cast("string").alias(key)).distinct()
    if spark.catalog.tableExists(table):
        ids = ids.join(known(spark, table, key), key, "left_anti")
    dealt = ids.repartition(buckets, key)
    dealt.write.format("parquet").mode("append").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def known(spark: SparkSession, table: str, key: str = "review_id") -> DataFrame:
    return spark.table(table).select(key)


def unseen(rows: DataFrame, table: str, key: str = "review_id") -> DataFrame:
    """Rows whose id the history does not hold; rows without an id pass."""
    fresh = rows.where(has_id(key)).join(known(rows.sparkSession, table, key), key, "left_anti")
    return rows.where(~has_id(key)).unionByName(fresh.select(*rows.columns))
