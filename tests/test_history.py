import random

import pytest

from larkspur.operators import collect, history, run_bitmaps


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "review_id string, app string, run long, seq long")


def test_history_is_not_shuffled(spark, tmp_path):
    rng = random.Random(2)
    old = rows_of(spark, [(str(rng.randrange(500)), "a", 1, i) for i in range(400)] + [(None, "a", 1, 1000), ("", "a", 1, 1001)])
    new = rows_of(spark, [(rng.choice([None, "", str(rng.randrange(700))]), "b", 2, i) for i in range(300)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history.remember(old.where("seq < 200"), "ids_seen", str(tmp_path / "ids"), 8)
        history.remember(old, "ids_seen", str(tmp_path / "ids"), 8)
        assert spark.table("ids_seen").count() == old.where("review_id <> ''").select("review_id").distinct().count()
        got = history.unseen(new, "ids_seen")
        assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in collect.unseen(new, old).collect())
        plan = got._jdf.queryExecution().sparkPlan().toString()
        executed = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in executed and "SortMergeJoin" in plan
        # One exchange, that of the new rows; none stands above the history's scan.
        lines = executed.split("\n")
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        deep = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        above, depth = [], deep[at]
        for i in range(at - 1, -1, -1):
            if deep[i] < depth:
                depth = deep[i]
                above.append(lines[i])
                if "SortMergeJoin" in lines[i]:
                    break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)
        assert executed.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS ids_seen")


@pytest.mark.parametrize("seed", range(2))
def test_bitmaps_equal_counting(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *map(str, range(60))]), rng.choice("ab"), rng.choice([1, 2, 3]), i) for i in range(200)]
    df = rows_of(spark, rows)
    first, later = df.where("seq < 90"), df.where("seq >= 90")
    codes = run_bitmaps.coded(first, buckets=4)
    more = run_bitmaps.coded(later, codes, buckets=4)
    assert more.count() == more.select("code").distinct().count() == df.where("review_id is not null").select("review_id").distinct().count()
    kept = {r["review_id"]: r["code"] for r in codes.collect()}
    assert kept.items() <= {r["review_id"]: r["code"] for r in more.collect()}.items()
    stored = run_bitmaps.merged(run_bitmaps.bitmaps(first, codes), run_bitmaps.bitmaps(later, more))
    got = run_bitmaps.overlap(stored).first()
    want = collect.repeatability(df).first()
    assert (got["runs"], got["repeated_collection_demonstrated"], got["overlap_count"]) == tuple(want)[:3] and got["overlap_rate"] == pytest.approx(want["overlap_rate"])
    assert got["new_records_in_second_run"] == collect.new_in_second_run(df).first()[0]
    by_app = {r["app"]: r["overlap_count"] for r in run_bitmaps.overlap(run_bitmaps.merged(run_bitmaps.bitmaps(first, codes, ["app"]), run_bitmaps.bitmaps(later, more, ["app"]), ["app"]), ["app"]).collect()}
    assert by_app == {app: len([r for r in collect.run_overlap(df, ["app"]).collect() if r["app"] == app]) for app in "ab"}


def test_runs_without_ids(spark):
    df = rows_of(spark, [(None, "a", 1, 0), (None, "a", 2, 1)])
    got = run_bitmaps.overlap(run_bitmaps.bitmaps(df, run_bitmaps.coded(df))).first()
    assert (got["runs"], got["repeated_collection_demonstrated"], got["overlap_count"], got["overlap_rate"], got["new_records_in_second_run"]) == (2, False, 0, None, 0)
    one = rows_of(spark, [("1", "a", 1, 0)])
    got = run_bitmaps.overlap(run_bitmaps.bitmaps(one, run_bitmaps.coded(one))).first()
    assert (got["runs"], got["overlap_count"], got["new_records_in_second_run"]) == (1, 0, None)
