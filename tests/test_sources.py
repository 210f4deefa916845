import json

import pytest

from larkspur import cli, config, runs
from larkspur.schema import review_schema
from larkspur.sources import feeds, files, sinks
from larkspur.sources.http import PoliteClient, scrub_url
from larkspur.streaming import dedup

from . import cases


class Script:
    """Answers by URL, in order, and notes what was asked."""

    def __init__(self, answer):
        self.answer, self.asked, self.now = answer, [], 0.0

    def client(self, delay=1.0):
        return PoliteClient(20, delay, open=self.open, clock=lambda: self.now, sleep=self.sleep)

    def open(self, url, headers, timeout):
        self.asked.append(url)
        got = self.answer(url, len(self.asked))
        if isinstance(got, Exception):
            raise got
        return got

    def sleep(self, seconds):
        self.now += seconds


def test_client_paces_and_retries():
    script = Script(lambda url, n: (503, b"") if n == 1 else (200, b"x"))
    client = script.client(1.5)
    got = client.get("http://a/?token=s")
    assert got.request["success"] and got.request["attempts"] == 2 and len(script.asked) == 2
    before = script.now
    client.get("http://a/")
    assert script.now - before == pytest.approx(1.5)
    broken = Script(lambda url, n: OSError("no route")).client().get("http://a/")
    assert broken.body is None and broken.request["attempts"] == 1 and not broken.request["success"]
    assert Script(lambda u, n: (403, b"")).client().get("http://a/").request["blocked"]
    assert scrub_url("http://a/b?token=s") == "http://a/b?..." and scrub_url("http://a/b") == "http://a/b"


def test_config_clamps(tmp_path, monkeypatch):
    file = tmp_path / "c.yaml"
    file.write_text("assessment: {max_reviews_per_item: 900, request_delay_seconds: 0, repeat_runs: 0}\nsteam: {app_ids: ['STEAM_APP_ID_1', 440], reviews_per_page: 99}\namazon: {review_urls: ['http://secret/?t=1']}\napple_app_store: {country: US, validation_total_reviews: 99999999, validation_targets: [{app_id: 1, app_name: A}, {app_id: APPLE_APP_ID_2}]}\n")
    got = config.load(file)
    assert (got.assessment.max_reviews_per_item, got.assessment.request_delay_seconds, got.assessment.repeat_runs) == (100, 1.0, 1)
    assert got.steam.real_app_ids == ["440"] and got.steam.reviews_per_page == 50
    assert [t.app_id for t in got.apple_app_store.validation_targets] == ["1"] and got.apple_app_store.validation_targets[0].country == "us"
    assert got.apple_app_store.validation_total_reviews == 50_000
    echo = json.dumps(got.sanitized())
    assert "secret" not in echo and got.sanitized()["amazon"]["review_urls_count"] == 1
    assert config.load(tmp_path / "none.yaml").assessment.max_reviews_per_item == 100
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.yaml")
    monkeypatch.setenv("X_JSON", '{"a": 1}')
    assert config.json_from_environment("X_JSON") == {"a": "1"} and config.json_from_environment("Y_JSON") == {}
    monkeypatch.setenv("X_JSON", "[")
    with pytest.raises(ValueError):
        config.json_from_environment("X_JSON")
    assert "cursor=%2A" in got.steam.url("440", "*")


def steam_page(ids, cursor):
    return json.dumps({"cursor": cursor, "reviews": [{"recommendationid": str(i), "review": "x", "author": {}} for i in ids]}).encode()


def test_steam_paging(spark, tmp_path):
    """Two runs over three pages with a cap of five."""
    pages = {"%2A": steam_page([1, 2], "c1"), "c1": steam_page([3, 4], "c2"), "c2": steam_page([5, 6], "c3")}
    script = Script(lambda url, n: (200, pages[url.rsplit("cursor=", 1)[1]]))
    app = config.AppConfig(config.Assessment(max_reviews_per_item=5, max_pages_per_item=3), config.Steam(app_ids=("440",)))
    fact, kept = runs.assess(spark, app, str(tmp_path), "steam", script.client())
    got = fact.first()
    assert sorted(r["review_id"] for r in kept.collect()) == ["1", "2", "3", "4", "5"]
    assert got["pagination"] and got["repeated"] and got["request_count"] == 6 and got["successful_requests"] == 6
    assert [p["cursor"] for p in feeds.steam(app, Script(lambda url, n: (200, pages[url.rsplit("cursor=", 1)[1]])).client()).pages][:3] == ["*", "c1", "c2"]
    assert len(list((tmp_path / "data/raw/steam").glob("*.json"))) == 6
    landed = files.landed_pages(spark, str(tmp_path / "data/raw/steam"))
    assert sorted((r["run"], r["page"]) for r in landed.collect()) == [(r, p) for r in (1, 2) for p in (1, 2, 3)]
    again = runs.landed_run(spark, str(tmp_path / "data/raw/steam"), "steam", str(tmp_path / "landed"))
    assert sorted(r["review_id"] for r in again.collect()) == ["1", "2", "3", "4", "5", "6"] and (tmp_path / "landed/steam_reviews.csv").exists()


def entry(i):
    return {"id": {"label": str(i)}, "im:rating": {"label": "5"}, "content": {"label": f"text {i}"}}


def test_validation_run(spark, tmp_path):
    def answer(url, n):
        if "/id=2/" in url:
            return (500, b"")
        number = int(url.split("page=")[1].split("/")[0])
        return (200, json.dumps({"feed": {"entry": [entry(1)] if number == 1 else []}}).encode())

    targets = (config.Target("A", "1"), config.Target("B", "2"))
    app = config.AppConfig(apple_app_store=config.Apple(validation_targets=targets))
    first = runs.validation_run(spark, app, str(tmp_path), "run 1", client=Script(answer).client())
    second = runs.validation_run(spark, app, str(tmp_path), "run 1", client=Script(answer).client())
    assert (first.name, second.name) == ("run_1", "run_1_2")
    summary = json.loads((first / "summary.json").read_text())
    assert summary["reviews_collected"] == 1 and not summary["target_reached"] and summary["shortfall_reason"] == "requests_failed"
    landing = feeds.apple_validation(app, Script(answer).client())
    assert [p["status"] for p in landing.pages] == ["ok", "empty_page", "request_failed"]
    assert (first / "missing_fields.csv").exists() and (first / "summary.md").exists()


def test_captures_and_comparison(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.html").write_text(cases.saved_page(f"R{i}", "t", "b", "4.0", ""))
    app = config.AppConfig(amazon=config.Amazon(review_urls=("https://h/dp/B00TTD9BRC?secret=1",), saved_response_files=(str(tmp_path / "1.html"), str(tmp_path / "2.html"), str(tmp_path / "gone.html"))))
    folder = runs.assessment_run(spark, app, str(tmp_path), ("steam", "amazon"), skip={"steam": "offline only"})
    summary = json.loads((folder / "test_run_summary.json").read_text())
    amazon = next(f for f in summary["facts"] if f["source"] == "amazon")
    assert amazon["reviews"] == 2 and amazon["pagination"] is True and amazon["parser_errors"] == 1 and amazon["offline_parsed"] is True
    metrics = {r["source"]: r for r in spark.read.option("header", True).csv(str(folder / "data_quality_metrics.csv")).collect()}
    assert metrics["amazon"]["total_rows"] == "2" and metrics["amazon"]["pagination_success_rate"] == "1.0" and metrics["amazon"]["parser_error_count"] == "1"
    assert metrics["steam"]["total_rows"] == "0" and metrics["steam"]["average_review_text_length"] is None and metrics["steam"]["missing_expected_fields"].startswith("source, item_id")
    report = (folder / "report.md").read_text()
    assert "Not executed: offline only" in report and "- Saved response batches: 3" in report and "Live access was not tested" in report
    assert spark.read.option("header", True).csv(str(tmp_path / "data/processed/steam_reviews.csv")).count() == 0
    assert "secret=1" not in (folder / "test_run_summary.json").read_text() and "secret=1" not in (folder / "report.md").read_text()


def test_google_play_runs(spark, tmp_path, monkeypatch):
    def fetch(package, token, count):
        return ([{"reviewId": f"g{token or 0}", "content": "x", "score": 5}], None if token else "1")

    fact, kept = runs.assess(spark, config.AppConfig(), str(tmp_path), "google_play", object(), fetch)
    assert sorted(r["review_id"] for r in kept.collect()) == ["g0", "g1"] and fact.first()["overlap_count"] == 2
    folder = runs.assessment_run(spark, config.AppConfig(), str(tmp_path), ("google_play", "apple_app_store"), fetch=fetch, skip={"apple_app_store": "not selected"})
    assert "- Requests: unavailable" in (folder / "report.md").read_text() and (folder / "metadata_matrix.csv").exists()
    (tmp_path / "somewrapper.py").write_text("def fetch(package, token, count):\n    return [], None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    args = cli.parser().parse_args(["assess", "--source", "google_play", "--google-play-wrapper", "somewrapper:fetch"])
    assert "google_play" not in cli._skips(args) and cli.wrapper(args.google_play_wrapper)("p", None, 1) == ([], None)
    assert cli._skips(cli.parser().parse_args(["assess", "--source", "app_stores"])) == {"google_play": "no wrapper is installed"}

    def broken(package, token, count):
        raise RuntimeError("down")

    assert feeds.google_play(config.AppConfig(), broken).errors


def test_streaming_dedup(spark, tmp_path):
    def land(name, ids):
        rows = [cases.review(i) | {"rating": None} for i in ids]
        spark.createDataFrame([tuple(r.values()) for r in rows], review_schema()).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    land("a", ["1", "1", None, "2"])
    run = lambda: dedup.ingest(dedup.landed_reviews(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    land("b", ["2", "3", None])
    run()
    assert sorted(str(r["review_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "None", "None"]


def test_report_tables_say_that_they_stop(spark):
    assert sinks.markdown_table(spark.range(5), 3).endswith("The first 3 rows; the CSV holds all.") and "CSV" not in sinks.markdown_table(spark.range(3), 3)


def test_intermediates_need_a_shared_folder():
    from types import SimpleNamespace

    from larkspur.session import shared_folder

    def on(master, named=None):
        conf = SimpleNamespace(get=lambda key: named)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))

    assert shared_folder(on("yarn", "hdfs:///x")) == "hdfs:///x" and shared_folder(on("local[4]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]", "k8s://h"):
        with pytest.raises(RuntimeError):
            shared_folder(on(master))


def test_empty_outputs(spark, tmp_path):
    sinks.ensure_outputs(spark, str(tmp_path), ["steam_reviews"])
    assert spark.read.option("header", True).csv(str(tmp_path / "steam_reviews.csv")).count() == 0
    assert "status" in spark.read.json(str(tmp_path / "steam_reviews.jsonl")).columns


def test_live_captures(spark, tmp_path):
    from larkspur.operators.parse_fields import tells_of_block

    pages = {"http://h/dp/B00TTD9BRC?s=1": (200, cases.saved_page("R1", "t", "b", "4.0", "").encode()), "http://h/2": (200, b"Robot Check"), "http://h/3": (503, b""), "http://h/4": OSError("x")}
    app = config.AppConfig(amazon=config.Amazon(review_urls=("AMAZON_REVIEW_URL_1", *pages)))
    landing = feeds.amazon(app, Script(lambda url, n: pages[url]).client(), tells_of_block)
    assert [r["blocked"] for r in landing.requests] == [False, True, False, False] and len(landing.errors) == 1 and len(landing.warnings) == 2
    fact, kept = runs.assess(spark, app, str(tmp_path), "amazon", Script(lambda url, n: pages[url]).client())
    (row,) = kept.collect()
    assert row["review_id"] == "R1" and row["item_id"] == "B00TTD9BRC" and row["raw_page_number"] == 1 and fact.first()["blocked"]
    assert not runs.assess(spark, app.without_live_amazon(), str(tmp_path), "amazon", object())[0].first()["executed"]


def test_daily_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [("a", "2026-01-01T10:00:00Z"), ("a", "2026-01-01T23:00:00Z"), ("b", "2026-01-02T01:00:00Z")]
    spark.createDataFrame(rows, "source string, at string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, at string").json(str(tmp_path / "in")).withColumn("review_time", F.col("at").cast("timestamp"))
    query = dedup.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["source"], r["review_count"]) for r in spark.table("daily").collect()) == [("a", 2), ("b", 1)]
