import pytest

from larkspur.sources import landed
from larkspur.streaming import acceptance


def land(folder, names):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in names.items():
        (folder / name).write_text(text, encoding="utf-8")


PAGES = {f"steam_{app}_run{run}_page{page}_20260101T000000Z.json": f"{app}{run}{page}é" for app in ("440", "my_app") for run in (1, 2) for page in (1, 2, 3)} | {"google_play_run1_page9_x.json": "g", "notes.txt": "no page"}


@pytest.fixture
def folder(spark, tmp_path):
    landed.register(spark)
    land(tmp_path / "raw" / "deep", PAGES)
    return tmp_path / "raw"


def test_pages_and_their_names(spark, folder):
    got = spark.read.format(landed.FORMAT).load(str(folder)).collect()
    assert {r["name"]: r["payload"] for r in got} == {n: t for n, t in PAGES.items() if n != "notes.txt"}
    assert {(r["source"], r["app"]) for r in got} == {("steam", "440"), ("steam", "my_app"), ("google_play", None)}
    assert spark.read.format(landed.FORMAT).load(f"file://{folder}").count() == len(got)


@pytest.mark.parametrize("where,want", [("run = 2", 6), ("page IN (1, 9)", 5), ("run = 1 AND page > 2", 3), ("run <= 1 AND app = '440'", 3), ("page >= 2 AND page < 3 AND upper(payload) LIKE '440%'", 2), ("app IS NULL", 1), ("run = 7", 0)])
def test_filters_are_answered_by_names(spark, folder, where, want):
    assert spark.read.format(landed.FORMAT).load(str(folder)).where(where).count() == want


def test_partitions_are_pruned_before_they_are_planned(spark, folder):
    """A file for each partition: as many tasks as files that match, and unreadable ones that don't are never opened."""
    (folder / "deep" / "steam_440_run9_page1_x.json").write_bytes(b"\xff\xfe")
    df = spark.read.format(landed.FORMAT).option("bytes_per_partition", 1).load(str(folder))
    assert df.where("run = 2").rdd.getNumPartitions() == 6
    assert df.where("run = 2 AND page = 3").rdd.getNumPartitions() == 2
    assert df.where("run < 3").count() == 13
    with pytest.raises(Exception, match="utf-8"):
        df.where("run = 9").collect()


def test_pages_are_dealt_by_size():
    pages = [landed.Page(str(i), str(i), 10, i, "s", None, 1, i) for i in range(7)]
    assert [len(p.pages) for p in landed.dealt(pages, 30)] == [3, 3, 1] and landed.dealt([], 30) == [] and len(landed.dealt(pages, 1)) == 7


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, folder):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: acceptance.run(spark.readStream.format(landed.FORMAT).load(str(folder)), out, state)
    run()
    assert spark.read.parquet(out).count() == 13
    land(folder, {"steam_440_run3_page1_x.json": "late"})
    run()
    run()
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("name").distinct().count() == 14 and rows.where("run = 3").first()["payload"] == "late"
