import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import eda, medians


def plain(rows, column):
    by = {}
    for r in rows:
        if r[column] is not None:
            by.setdefault(r[0], []).append(r[column])
    return {k: statistics.median(v) for k, v in by.items()}


@pytest.mark.parametrize("bins,ranked", [(medians.BINS, medians.RANKED), (4, 3)])
def test_medians_equal_sorting(spark, bins, ranked):
    """Odd and even counts, ties, nulls, null keys, outliers, infinities, one value; few bins ask for many rounds."""
    rng = random.Random(4)
    rows = [(None, float(i), None) for i in range(7)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 5])), -3.0) for _ in range(100)]
    rows += [("wide", rng.uniform(-1, 1) * 10 ** rng.randint(-9, 300), float(i)) for i in range(301)]
    rows += [("tail", float(i % 5), 1e300 if i == 0 else i / 7) for i in range(40)]
    rows += [("ends", x, None) for x in (-math.inf, math.inf, 2.0, 3.0)]
    rows += [("close", 1.0 + i * 2**-52, 5e-324 * i) for i in range(60)] + [("none", None, None)]
    table = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: (r["x"], r["y"]) for r in medians.medians(table, ["k"], ["x", "y"], bins, ranked).collect()}
    assert set(got) == {r[0] for r in rows}
    for at, column in ((0, 1), (1, 2)):
        want = plain(rows, column)
        assert {k: v[at] for k, v in got.items() if v[at] is not None} == want


def test_without_keys_and_rows(spark):
    table = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert [tuple(r) for r in medians.medians(table, [], ["x"], ranked=2).collect()] == [(4.5,)]
    assert medians.medians(table.where("x < 0").withColumn("k", F.lit(1)), ["k"], ["x"]).count() == 0


def test_a_million_distinct_ages_in_one_group(spark):
    """The group's values never meet in one state: bins are counted, and few rows are left to rank."""
    n = 1_000_001
    ages = spark.range(n).select(F.lit("one").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 997.0 - 300).alias("age"))
    at = time.time()
    got = medians.medians(ages, ["k"], ["age"]).first()
    assert got["age"] == (n // 2) / 997.0 - 300
    assert time.time() - at < 120


def test_no_plan_holds_distinct_values(spark):
    from .test_review_operators import frame, typed
    from .cases import review

    rows = typed(frame(spark, [review(str(i), review_text="x" * i) for i in range(9)]))
    plan = eda.text_length_stats(rows)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan
    assert eda.text_length_stats(rows).first()["median_text_length"] == 4.0
