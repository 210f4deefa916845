"""Incremental dedup: review ids that earlier batches held do not come again.

State is keyed by source and id. Rows without an id have no state and are never
duplicates: they pass beside the dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collect import has_id
from ..schema import review_schema

KEY = ["source", "review_id"]


def deduplicated(stream: DataFrame, watermark: tuple[str, str] | None = None, key: list[str] | None = None) -> DataFrame:
    """A stream's first rows of each id.

    With ``watermark`` (column, delay) state is dropped as time passes, and an id that
    comes again later than that counts as new; without it, state grows with the ids.
    """
    key = key or KEY
    with_id, without = stream.where(has_id(key[-1])), stream.where(~has_id(key[-1]))
    if watermark:
        column, delay = watermark
        return with_id.withWatermark(column, delay).dropDuplicatesWithinWatermark(key).unionByName(without)
    return with_id.dropDuplicates(key).unionByName(without)


def landed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Review JSON lines as they arrive in a folder."""
    return spark.readStream.schema(review_schema()).json(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, watermark: tuple[str, str] | None = None, key: list[str] | None = None):
    """Runs over what is there now, appends Parquet to ``out``; call again for what comes later."""
    writer = deduplicated(stream, watermark, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_counts(stream: DataFrame, at: str = "review_time", delay: str = "7 days") -> DataFrame:
    """Reviews per source and day, late ones within ``delay`` counted."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "source").agg(F.count("*").alias("review_count"))
