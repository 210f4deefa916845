import json

import pytest

from larkspur.sources import sinks
from larkspur.sources.store import MANIFEST, StorePath, bundle


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_a_bundle_appears_whole(spark, tmp_path):
    at = StorePath(spark, f"file://{tmp_path}/runs/one")
    with bundle(at) as stage:
        (stage / "a.txt").write_text("é\n")
        sinks.write_csv(spark.range(3), str(stage / "b.csv"))
        assert not at.exists()
    assert at.exists() and (at / "a.txt").read_text() == "é\n" and spark.read.csv(str(at / "b.csv"), header=True).count() == 3
    listed = json.loads((at / MANIFEST).read_text())["files"]
    assert set(listed) == {"a.txt", "b.csv"} and listed["a.txt"] == 3
    assert names(tmp_path / "runs") == ["one"]


def test_a_failure_between_two_files_leaves_nothing(spark, tmp_path):
    at = StorePath(spark, str(tmp_path / "runs" / "one"))
    with pytest.raises(RuntimeError):
        with bundle(at) as stage:
            (stage / "first.txt").write_text("x")
            raise RuntimeError("in between")
    assert names(tmp_path / "runs") == []


def test_what_exists_stays(spark, tmp_path):
    at = StorePath(spark, str(tmp_path / "runs" / "one"))
    at.mkdir()
    with pytest.raises(FileExistsError):
        with bundle(at):
            raise AssertionError("not reached")
    # Another run makes the folder while this one writes: the rename finds it, and this one leaves nothing.
    other = StorePath(spark, str(tmp_path / "runs" / "two"))
    with pytest.raises(FileExistsError):
        with bundle(other) as stage:
            (stage / "mine.txt").write_text("x")
            other.mkdir()
            (other / "theirs.txt").write_text("y")
    assert names(tmp_path / "runs") == ["one", "two"] and names(tmp_path / "runs" / "two") == [".theirs.txt.crc", "theirs.txt"]
    assert sinks.unique_folder(other).name == "two_2"


def test_the_store_of_the_path_is_asked(spark, tmp_path):
    """Through a mount that only Hadoop's file system knows."""
    conf = spark._jsc.hadoopConfiguration()
    (tmp_path / "kept").mkdir()
    conf.set("fs.viewfs.mounttable.shelf.link./kept", f"file://{tmp_path}/kept")
    at = StorePath(spark, "viewfs://shelf/kept") / "run-1"
    assert str(at) == "viewfs://shelf/kept/run-1" and not at.exists()
    with bundle(at) as stage:
        (stage / "x.json").write_text("{}")
    assert at.exists() and (tmp_path / "kept" / "run-1" / "x.json").read_text() == "{}"
    rows = spark.range(5).selectExpr("id AS n", "concat('t', id) AS t")
    folder = sinks.write_features(rows, "viewfs://shelf/kept", "features 7", order="n")
    assert str(folder) == "viewfs://shelf/kept/features-7" and spark.read.json(str(folder / "review_features.jsonl")).count() == 5
    with pytest.raises(FileExistsError):
        sinks.write_features(rows, "viewfs://shelf/kept", "features 7", order="n")


def test_a_failed_feature_run_can_be_repeated(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(10).select(F.col("id").alias("n"), F.when(F.col("id") < 20, F.col("id")).alias("x"))
    bad = rows.withColumn("x", F.when(F.col("n") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="bad row"):
        sinks.write_features(bad, str(tmp_path), "r", order="n")
    assert names(tmp_path) == []
    assert sinks.write_features(rows, str(tmp_path), "r", order="n").name == "r"


def test_reports_are_bundles(spark, tmp_path):
    out = {"summary": {"overall_rates": {}, "weak_sentiment_label_counts": {}, "output_row_count": 0, "unique_contextual_review_identity_count": 0}, "distributions": spark.range(1), "manual_sample": spark.range(1)}
    at = sinks.write_validation_report(out, str(tmp_path), "r")
    assert {MANIFEST, "feature_distributions.csv", "manual_validation_sample.csv", "feature_validation_report.md"} <= set(names(tmp_path / at.name))
