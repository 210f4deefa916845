"""A session with the settings the operators count on."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session-wide settings; sizes are left to the cluster's own configuration.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A checkpoint's files go when nothing on the driver refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "larkspur", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where driver and executors are one process may it be a temporary one; anywhere else
    a folder that is not shared would lose rows without a word, so none is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="larkspur-")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared folder; for slim rows that several plans read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table_of(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; for wide rows, which a checkpoint does not compress."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of intermediates that nothing refers to any more.

    It does so as the driver's memory is collected, which a driver of small plans and many
    rounds may not come to for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
