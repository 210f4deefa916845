"""Scans of landed files: review CSVs, feature CSVs, raw pages, saved captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import feature_schema, text_schema

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
#: Row number in file order, for sinks that must keep it.
ROW = "__row"


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out; any larger one as it is.

    A small file is often one row group, which is one task for all text work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def normalized_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV, all columns text; blanks read as null, which means the same everywhere.

    Columns may stand in any order; those that are no review columns are left out.
    """
    raw = spark.read.options(**CSV | {"enforceSchema": True}).option("inferSchema", False).csv(path)
    absent = [c for c in text_schema().names if c not in raw.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return raw.select(*[F.col(c).cast("string").alias(c) for c in text_schema().names])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with an increasing number in scan order; no shuffle, gaps between partitions."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def features(spark: SparkSession, path: str) -> DataFrame:
    """A feature CSV with its schema; texts such as NA stay texts."""
    raw = spark.read.options(**CSV).option("inferSchema", False).csv(path)
    types = {f.name: f.dataType for f in feature_schema()}
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) for c in types if c in raw.columns])


def landed_pages(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Raw pages, a file each: payload and the file it came from.

    Page and run numbers are read from names as the collectors write them
    (``..._run<r>_page<p>_<stamp>.json``).
    """
    name = F.col("file")
    text = spark.read.text(path, wholetext=whole).select(F.col("value").alias("payload"), F.input_file_name().alias("file"))
    return text.withColumn("page", F.regexp_extract(name, r"_page(\d+)_", 1).try_cast("long")).withColumn("run", F.coalesce(F.regexp_extract(name, r"_run(\d+)_", 1).try_cast("long"), F.lit(1)))


def saved_captures(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Saved response files with their place in the list, and errors for those that can't be read."""
    from pathlib import Path

    found, errors = [], []
    for path in paths:
        if "://" in path or Path(path).is_file():
            found.append(path)
        else:
            errors.append(f"saved response {path} can't be read")
    if not found:
        return spark.createDataFrame([], "payload string, file string, batch long"), errors
    pages = None
    for nth, path in enumerate(found, 1):
        one = landed_pages(spark, path).select("payload", "file").withColumn("batch", F.lit(nth).cast("long"))
        pages = one if pages is None else pages.unionByName(one)
    return pages, errors
