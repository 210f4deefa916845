import random
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql.types import StructType

from larkspur.operators import collect
from larkspur.streaming import acceptance

SCHEMA = "review_id string, app string, page long, seq long"


def stream_of(spark, tmp_path, batches, made):
    """What a stream makes of landings, each read by a run of its own."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        acceptance.run(made(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def batches(seed, n=3):
    rng = random.Random(seed)
    return [[(rng.choice([None, "", *map(str, range(12))]), rng.choice("abc"), rng.choice([None, 1, 2]), 100 * b + i) for i in range(40)] for b in range(n)]


def test_repeats_are_recorded_across_runs(spark, tmp_path):
    landed = batches(1)
    got = stream_of(spark, tmp_path, landed, lambda s: acceptance.with_repeats(s, ["review_id"])).collect()
    seen, count, want = {}, Counter(), []
    for rows in landed:
        for i, app, page, seq in rows:
            if not i:
                want.append((i, app, page, seq, False, seq, page, 1))
                continue
            repeat = i in seen
            first = seen.setdefault(i, (seq, page))
            count[i] += 1
            want.append((i, app, page, seq, repeat, *first, count[i]))
    assert Counter(map(tuple, got)) == Counter(want)
    # The rows that are no repeats are those that a batch job over everything accepts.
    whole = spark.createDataFrame([r for rows in landed for r in rows], SCHEMA)
    assert sorted(r["seq"] for r in got if not r["is_repeat"]) == sorted(r["seq"] for r in collect.accepted(whole).collect())


def test_a_run_without_news_adds_nothing(spark, tmp_path):
    landed = batches(2, 1)
    out = stream_of(spark, tmp_path, [landed[0]], lambda s: acceptance.with_repeats(s, ["review_id"]))
    rows = out.count()
    acceptance.run(acceptance.with_repeats(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["review_id"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows == 40


def test_expired_ids_come_as_new(spark, tmp_path):
    """State of an id goes after its expiry; here that is at once."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "a", 1, 1)], SCHEMA).write.parquet(folder)
    written = acceptance.recorded(StructType.fromDDL(SCHEMA))
    query = acceptance.start(acceptance.with_repeats(spark.readStream.schema(SCHEMA).parquet(folder), ["review_id"], expiry_ms=1), out, str(tmp_path / "state"))
    try:
        for rows in (1, 2):
            until = time.time() + 40
            while time.time() < until and (not (tmp_path / "out" / "_spark_metadata").exists() or spark.read.schema(written).parquet(out).count() < rows):
                time.sleep(0.5)
            if rows == 1:
                spark.createDataFrame([("1", "a", 2, 2)], SCHEMA).write.mode("append").parquet(folder)
    finally:
        query.stop()
    got = spark.read.schema(written).parquet(out)
    assert sorted((r["seq"], r["is_repeat"]) for r in got.collect()) == [(1, False), (2, False)]


@pytest.mark.parametrize("cap", [1, 7, 1000])
def test_caps_hold_over_runs(spark, tmp_path, cap):
    landed = batches(3)
    got = stream_of(spark, tmp_path, landed, lambda s: acceptance.within_caps(s, ["app"], cap)).collect()
    whole = spark.createDataFrame([r for rows in landed for r in rows], SCHEMA)
    want = collect.capped(whole, cap, ["app"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


class Held:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_batch_may_come_in_pieces_and_out_of_order():
    made = acceptance.Capped(5, "seq", ["seq", "x"])
    made.taken = Held()
    order = random.Random(6).sample(range(50), 50)
    pieces = [pd.DataFrame({"seq": order[i : i + 7], "x": [f"x{s}" for s in order[i : i + 7]]}) for i in range(0, 50, 7)]
    (out,) = made.handleInputRows(("a",), iter(pieces), None)
    assert out["seq"].tolist() == [0, 1, 2, 3, 4] and out["x"].tolist() == ["x0", "x1", "x2", "x3", "x4"]
    assert made.taken.value == (5,) and not list(made.handleInputRows(("a",), iter(pieces), None))


class HeldMap:
    """A map state in memory."""

    def __init__(self):
        self.values = {}

    def getValue(self, key):
        return self.values.get(key)

    def updateValue(self, key, value):
        self.values[key] = value


def test_a_call_takes_a_bucket_of_ids():
    made = acceptance.FirstWins("seq", "page", ["review_id", "page", "seq"], None)
    made.first, arrived = HeldMap(), Row("review_id", "page", "seq", acceptance.ID)
    landings = [[("a", 7, 3), ("b", None, 1), ("a", 2**53 + 1, 2)], [("b", 5, 9), ("c", 6, 8), ("b", 4, 7)]]
    got = [[tuple(r) for r in made.handleInputRows((0,), iter([arrived(*r, r[0]) for r in rows]), None)] for rows in landings]
    assert got[0] == [("b", None, 1, False, 1, None, 1), ("a", 2**53 + 1, 2, False, 2, 2**53 + 1, 1), ("a", 7, 3, True, 2, 2**53 + 1, 2)]
    assert got[1] == [("b", 4, 7, True, 1, None, 2), ("c", 6, 8, False, 8, 6, 1), ("b", 5, 9, True, 1, None, 3)]


def test_pages_stay_whole_beside_absent_ones(spark, tmp_path):
    """Numbers beyond 2 to the 53 do not pass through floats."""
    far = 2**53 + 1
    got = stream_of(spark, tmp_path, [[("1", "a", far, 1), ("1", "a", None, 2)]], lambda s: acceptance.with_repeats(s, ["app", "review_id"])).collect()
    assert sorted((r["seq"], r["page"], r["is_repeat"], r["first_page"]) for r in got) == [(1, far, False, far), (2, None, True, far)]
