import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import annotation, collect, compare, eda, features, html_reviews, parse_fields, parse_json, quality, report, sample
from larkspur.plans import catalogue
from larkspur.schema import FEATURE_COLUMNS, REVIEW_COLUMNS, TOPIC_COLUMNS, review_schema, text_schema

from . import cases
from .cases import REVIEWS, review


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], text_schema())


def typed(df):
    return df.withColumn("rating", F.col("rating").try_cast("double"))


def test_eda_tables(spark):
    rows = [review("1", review_text="Great app"), review("2", review_text="ok", review_date=None), review("2", review_text=None, app_name="Other"), review(None, item_id=None, review_text=" ")]
    tables = eda.tables(typed(frame(spark, rows)), errors=["e"], least=5)
    assert len(tables) == 10
    volume = {r["item_id"] and r["app_name"]: r for r in tables["review_volume_by_app"].collect()}
    assert (volume["Harbour"]["review_count"], volume["Harbour"]["unique_review_count"], volume["Harbour"]["duplicate_count"]) == (2, 2, 0)
    assert volume[None]["review_count"] == 1
    lengths = {r["app_name"]: r for r in tables["review_text_length"].where("item_id is not null").collect()}
    assert lengths["Harbour"]["low_signal_review_count"] == 1 and lengths["Harbour"]["median_text_length"] == 5.5 and lengths["Other"]["empty_text_count"] == 1
    dates = tables["date_coverage"].where("item_id is not null and app_name = 'Harbour'").first()
    assert (dates["dated_review_count"], dates["undated_review_count"], dates["earliest_review_date"]) == (1, 1, "2026-06-27T06:00:00Z")
    missing = tables["missing_fields"]
    assert missing.count() == 3 * 27 and missing.where("field = 'review_date' and app_name = 'Harbour' and item_id is not null").first()["missing_count"] == 1
    assert [tuple(r) for r in tables["duplicate_records"].collect()] == [("2", 2, "Harbour, Other")]
    assert tables["errors"].count() == 1 and tables["low_signal_reviews"].count() == 3
    none = eda.tables(spark.createDataFrame([], review_schema()))
    assert all(none[n].count() == 0 and none[n].columns == tables[n].columns for n in tables if n != "pagination_depth_and_failures")


def test_all_tables_equal_each_on_its_own(spark):
    rng = random.Random(12)

    def maybe(*values):
        return rng.choice([None, *values])

    rows = [
        review(maybe(*map(str, range(120))), app_name=maybe("Harbour", "Quay"), item_id=maybe("31"), country=maybe("nz", "is"), language=maybe("en"), rating=maybe("1", "4", "4.5"), review_title=maybe("t"),
               review_text=maybe("", " ", "\u2003short ", "a text that says enough", "x" * 40), review_date=maybe("2026-06-27T06:00:00Z", "2026-05-01"))
        for _ in range(400)
    ]
    given = typed(frame(spark, rows)).drop("app_version")
    alone = {
        "review_volume_by_app": eda.review_volume(given),
        "rating_distribution": eda.rating_distribution(given),
        "review_text_length": eda.text_length_stats(given),
        "date_coverage": eda.date_coverage(given),
        "missing_fields": eda.missing_fields(given),
        "duplicate_records": eda.duplicate_records(given),
        "language_region_issues": eda.language_notes(given),
        "low_signal_reviews": eda.low_signal_reviews(given),
    }
    together = eda.tables(given)
    for name, df in alone.items():
        assert together[name].dtypes == df.dtypes, name
        assert Counter(map(repr, together[name].collect())) == Counter(map(repr, df.collect())), name


def test_ten_tables_read_the_reviews_once(spark, tmp_path):
    typed(frame(spark, [review(str(i), review_text="a longer text of this review") for i in range(50)])).write.parquet(str(tmp_path / "reviews"))
    tables = eda.tables(spark.read.parquet(str(tmp_path / "reviews")))
    for df in tables.values():
        assert str(tmp_path) not in df._jdf.queryExecution().toString()


def test_quality(spark):
    rows = [review("1", source="steam", review_text="abc"), review("1", source="steam", review_text="")]
    df = typed(frame(spark, rows))
    got = quality.profile(df).first()
    assert got["duplicates_within_final_dataset"] == 1 and got["empty_review_text_count"] == 1 and got["missing_rating_count"] is None and got["unique_review_count"] == 1
    assert quality.completeness(df).first()["completeness_review_id"] == 1.0
    assert quality.missing_expected(df).first()["missing_expected_fields"] == ["recommendation", "author_id", "helpful_votes", "funny_votes", "playtime_forever", "playtime_at_review"]
    assert "review_text" in quality.available_fields(df).first()["available_metadata_fields"]
    none = frame(spark, [review(None), review(None)])
    assert quality.profile(typed(none)).first()["unique_review_count"] == 2
    assert quality.flat(df).first()["not_applicable_fields"] == "rating, review_title, verified_purchase"
    rate = spark.createDataFrame([(True, "available", 0, True), (False, "available", 0, None), (False, "available", 3, None), (False, "available", 3, False), (False, "unavailable", 0, True)], "o boolean, s string, n long, p boolean")
    assert [r[0] for r in rate.select(quality.pagination_rate(F.col("o"), F.col("s"), F.col("n"), F.col("p"))).collect()] == ["1.0", None, "not enough evidence", "0.0", "1.0"]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        text = rng.choice(["log in fails again and again", "nice", "refund please, it crashes", "good game overall indeed"]) + (f" {i % 40}" if i % 3 else "")
        rows.append(review(f"r{i}", app_name=f"App {i % 3}", item_id=str(i % 3), country=["us", "gb", None][i % 3], rating=rng.choice(["1", "2", "3", "4", "5", None]), review_text=text, review_title=f"t{i % 7}"))
    return features.generate(frame(spark, rows)).cache()


def plain_sample(rows, size):
    """The sampler's rules, one pick at a time."""
    rows = sorted(rows, key=lambda r: r["__rank"])
    picked = []
    groups = []
    for field in sample.VALUE_STRATA:
        for value in dict.fromkeys(r[field] for r in rows if r[field] is not None):
            groups.append([r for r in rows if r[field] == value])
    groups += [[r for r in rows if r[f]] for f in sample.FLAG_STRATA]
    for group in groups:
        free = [r for r in group if r not in picked]
        if free and len(picked) < size:
            picked.append(free[0])
    while len(picked) < min(size, len(rows)):
        added = False
        for label in sample.CLASSES:
            free = [r for r in rows if r["weak_sentiment_label"] == label and r not in picked]
            if free and len(picked) < size:
                picked.append(free[0])
                added = True
        if not added:
            picked.append(next(r for r in rows if r not in picked))
    return [r["review_id"] for r in picked]


@pytest.mark.parametrize("size", [1, 7, 60, 135, 400])
def test_sample_equals_the_plain_loop(made, size):
    rows = [r.asDict() for r in sample.ranked(made).collect()]
    got = [r["review_id"] for r in sample.sample(made, size).orderBy("__order").collect()]
    assert got == plain_sample(rows, size)


def test_annotation_sheet_and_peers(made):
    sheet = sample.annotation_sheet(made, 60).collect()
    by = {r["review_id"]: r for r in made.collect()}
    flagged = [r for r in sheet if r["repeated_review_body"]]
    assert flagged and all(r["annotation_status"] == "pending" for r in sheet)
    for r in sheet:
        peer = r["repeated_review_body_example_review_id"]
        assert bool(peer) == r["repeated_review_body"]
        if peer:
            a, b = by[r["review_id"]], by[peer]
            assert a["repeated_review_body_fingerprint"] == b["repeated_review_body_fingerprint"] and a["country"] == b["country"] and peer != r["review_id"]
    with pytest.raises(ValueError):
        sample.sample(made, 0)
    with pytest.raises(ValueError):
        sample.sample(made.drop("rating"))


def test_report(made):
    got = report.summary(made, 300)
    assert got["output_row_count"] == 300 and got["row_count_preserved"] and got["duplicate_contextual_identity_count"] == 0
    assert sum(got["weak_sentiment_label_counts"].values()) == 300
    rows = made.collect()
    assert got["overall_rates"]["login_topic_signal"] == pytest.approx(sum(r["login_topic_signal"] for r in rows) / 300)
    lines = report.distributions(made).collect()
    ratings = {(r["app_name"], r["country"]): set() for r in rows}
    for r in rows:
        ratings[r["app_name"], r["country"]].add(r["rating"])
    assert len(lines) == sum(23 + len(v) for v in ratings.values())
    for line in lines:
        if line["metric"] == "rating_distribution":
            group = [r for r in rows if (r["app_name"], r["country"]) == (line["app_name"], line["country"])]
            assert line["count"] == Counter((r["rating"] or "<missing>") for r in group)[line["value"]] and line["row_count"] == len(group)
    with pytest.raises(ValueError):
        report.summary(made.drop("source_url"))
    assert report.overall_rates(made.limit(0)).where("rate = 0").count() == 16


def arrivals(spark, rows):
    return spark.createDataFrame(rows, "review_id string, app string, run long, page long, seq long")


def plain_steam(rows, cap):
    """The collector's loop over landed rows."""
    seen, held, runs, out, stopped = set(), {}, {}, [], set()
    for review_id, app, run, _, seq in sorted(rows, key=lambda r: r[4]):
        ids = runs.setdefault((app, run), set())
        if len(ids) >= cap or (app, run) in stopped:
            stopped.add((app, run))
            continue
        if review_id:
            ids.add(review_id)
        if review_id and review_id in seen:
            continue
        if len(held.setdefault(app, set())) >= cap:
            continue
        if review_id:
            seen.add(review_id)
            held[app].add(review_id)
        out.append(seq)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_steam_collection_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for app in ("x", "y", "z"):
        for run in (1, 2):
            for page in range(1, 5):
                for _ in range(5):
                    rows.append((rng.choice([None, *map(str, range(14 + 4 * seed))]), app, run, page, seq))
                    seq += 1
    got = sorted(r["seq"] for r in collect.steam_collect(arrivals(spark, rows), 6).collect())
    assert got == plain_steam(rows, 6)


def test_dedup_caps_and_overlap(spark):
    rows = [("1", "a", 1, 1, 0), (None, "a", 1, 1, 1), ("1", "a", 1, 2, 2), ("2", "a", 1, 2, 3), (None, "a", 2, 1, 4), ("2", "a", 2, 1, 5), ("3", "a", 2, 1, 6)]
    df = arrivals(spark, rows)
    assert sorted(r["seq"] for r in collect.accepted(df).collect()) == [0, 1, 3, 4, 6]
    assert [r["seq"] for r in collect.capped(collect.accepted(df), 3).orderBy("seq").collect()] == [0, 1, 3]
    assert [r["review_id"] for r in collect.run_overlap(df).collect()] == ["2"]
    assert collect.new_in_second_run(df).first()[0] == 1 and collect.new_in_second_run(df.where("run = 1")).first()[0] is None
    assert collect.run_overlap(df.where("run = 1")).count() == 0
    assert tuple(collect.repeatability(df).first()) == (2, True, 1, pytest.approx(1 / 3))
    assert sorted(r["seq"] for r in collect.unseen(df, df.where("seq = 0")).collect()) == [1, 3, 4, 5, 6]
    pages = collect.page_ids(df.where("run = 1").withColumnRenamed("page", "raw_page_number"), ["app"]).orderBy("raw_page_number").collect()
    assert [(p["overlap_with_previous"], p["distinct_from_previous"]) for p in pages] == [(0, None), (1, False)]


def test_page_status_and_shortfall(spark):
    rows = [(1, 404, False, None, 0), (2, 404, False, None, 0), (2, 500, False, None, 0), (1, 200, True, False, 0), (1, 200, True, True, 0), (1, 200, True, True, 4)]
    df = spark.createDataFrame(rows, "page long, status_code long, success boolean, parsed boolean, review_count long")
    out = [r["status"] for r in collect.page_status(df).collect()]
    assert out == ["request_failed", "pagination_limit_or_unavailable_page", "request_failed", "json_parse_error", "empty_page", "ok"]
    batch = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert collect.shortfall(batch(*out)).first()[0] == "page_depth_limited"
    assert collect.shortfall(batch("ok", "empty_page")).first()[0] == "empty_pages"
    assert collect.shortfall(batch("ok", "target_limit_not_reached")).first()[0] == "targets_exhausted"
    assert collect.shortfall(batch("ok", "odd")).first()[0] == "configured_limits"


def page(spark, *payloads, **more):
    known = {"app_name": "App", "app_id": "440", "package_id": "com.x", "country": "us", "language": "en", "source_url": "http://u/?k=1", "page": 2, "cursor": "*"} | more
    kinds = ", ".join(f"{k} {'long' if k == 'page' else 'string'}" for k in known)
    return spark.createDataFrame([(p, *known.values()) for p in payloads], f"payload string, {kinds}")


def test_json_parsers(spark):
    payload = cases.steam_page([("x1", "well made", True, 5), ("x2", "", False, None)])
    a, b = parse_json.steam(page(spark, payload, "not json", "{}")).collect()
    assert (a["review_id"], a["item_id"], a["recommendation"], a["helpful_votes"], a["playtime_forever"], a["review_date"], a["author_id"], a["raw_cursor"]) == ("x1", "440", True, 5, 90, "1751328000", "sx1", "*")
    assert b["review_text"] == "" and b["helpful_votes"] is None and b["recommendation"] is False and b["collected_at"]
    assert parse_json.steam(page(spark, payload)).columns == REVIEW_COLUMNS
    assert parse_json.cursors(page(spark, payload)).first()["response_cursor"] == "c2"
    many = cases.apple_page(cases.apple_entry("about the app", title="Harbour"), cases.apple_entry("e5", "2", "11", title="Leaky", content="Water came in"))
    one = cases.apple_page(cases.apple_entry("e6", "unrated", title="", content="Alone on its page"))
    rows = parse_json.apple(page(spark, many, one, "[]")).collect()
    assert [(r["review_id"], r["rating"], r["helpful_votes"], r["review_title"], r["review_text"]) for r in rows] == [("e5", 2.0, 11, "Leaky", "Water came in"), ("e6", None, None, None, "Alone on its page")]
    (g,) = parse_json.google_play(page(spark, cases.google_batch(("p9", "fine", 2, "noted")))).collect()
    assert (g["review_id"], g["rating"], g["helpful_votes"], g["app_version"], g["developer_response"], g["developer_response_date"], g["package_id"]) == ("p9", 2.0, 14, "2.1", "noted", None, "com.x")


def test_html_parsers(spark):
    import json

    ajax = "&&&".join([json.dumps(["append", "#x", cases.HTML]), "broken", json.dumps(["loaded"])])
    ajax = ajax.replace("&&&broken&&&", "&&&[broken&&&")
    wrapped = json.dumps({"a": [{"html": cases.HTML}]})
    empty = '<div id="customer_review-R3"></div>'
    pages = spark.createDataFrame([(p, None if i else "https://h/product-reviews/B00TTD9BRC/?x=1", i) for i, p in enumerate([cases.HTML, wrapped, ajax, empty, "nothing", None])], "payload string, source_url string, page long")
    rows = {r["raw_page_number"]: r for r in html_reviews.reviews(pages).collect()}
    assert set(rows) == {0, 1, 2, 3}
    for i in range(3):
        r = rows[i]
        assert (r["review_id"], r["review_title"], r["review_text"], r["rating"], r["verified_purchase"], r["helpful_votes"], r["author_name"]) == ("K7", "Sturdy little lamp", "Bright & quiet", 3.5, True, 2048, "Ada")
    assert rows[0]["item_id"] == "B00TTD9BRC" and rows[1]["item_id"] == "B0HARBOUR1"
    assert rows[3]["review_text"] is None and rows[3]["rating"] is None and rows[3]["helpful_votes"] == 0 and rows[3]["verified_purchase"] is False
    spark.udtf.register("parse_review_html", html_reviews.html_reviews)
    assert spark.sql("SELECT review_id FROM parse_review_html('<div data-hook=\"review\" id=\"z\"></div>')").first()[0] == "z"


def test_json_is_walked_in_the_jvm(spark):
    """As the Python walk, but for the order of an object's fields; deeper JSON goes to Python whole."""
    import json

    rng = random.Random(8)
    box = "<div data-hook='review' id='x{}'></div>"

    def nested(depth):
        kind = rng.randrange(5) if depth else 0
        if kind < 2:
            return rng.choice([box.format(rng.randrange(99)), "plain", 7, None, True, 1.5])
        if kind < 4:
            return [nested(depth - 1) for _ in range(rng.randrange(4))]
        return {k: nested(depth - 1) for k in ("a", "b", "c")[: rng.randrange(4)]}

    texts = [json.dumps(nested(4)) for _ in range(60)] + ["&&&".join(["[1]", *(json.dumps([nested(2)]) for _ in range(3)), "[2]"]) for _ in range(20)]
    texts += ['{"data-hook": 1}', '{"a": "data-hook", "a": "data-hook too"}', "[data-hook", '["x"]&&&["data-hook"]&&&[data-hook', " " + json.dumps([box]) + "\n", box, "", None]
    pages = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "payload string, page long")
    made = html_reviews.unwrapped(pages)
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
    for depth in (html_reviews.DEPTH, 1):
        for r in html_reviews.unwrapped(pages, depth).collect():
            text = texts[r["page"]]
            html = html_reviews.unwrap(r["html"]) if r["deep"] else r["html"]
            assert html == (text if text is None else html_reviews.unwrap(text)), (depth, text)
    deep = {r["page"] for r in html_reviews.unwrapped(pages, 1).where("deep").collect()}
    assert deep and not html_reviews.unwrapped(pages).where("deep and page < 80").count()


def test_capture_fields(spark):
    cases_ = [("Robot Check", 200, True), ("", 200, True), (" \n", 200, True), ("fine", 403, True), ("fine", 200, False), ("go to /AP/SIGNIN", 200, True)]
    df = spark.createDataFrame([(t, s) for t, s, _ in cases_], "t string, s long")
    assert [r[0] for r in df.select(parse_fields.is_blocked(F.col("t"), F.col("s"))).collect()] == [w for *_, w in cases_]
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one("http://a/b?token=1\nx", parse_fields.scrub_url) == "http://a/b?..."
    assert one("One person found", parse_fields.helpful_votes) == 1 and one("", parse_fields.helpful_votes) is None
    assert one('x "pageNumber":"12"', parse_fields.next_page_number) == 12 and one("a nextPageToken", parse_fields.has_next_page_token)


def fact(source, **known):
    names = [f.strip().split()[0] for f in compare.FACTS.replace("\n", " ").split(",")]
    base = {"source": source, "executed": True, "request_count": 10, "successful_requests": 10, "request_count_status": "available", "live": True, "reviews": 8, "pagination": True, "repeated": True, "incremental": True, "blocked": False, "errors": 0, "metadata_fields": ["source"], "total_rows": 8, "access_method_type": "public feed"}
    return tuple((base | known).get(n) for n in names)


def test_comparison(spark):
    def table(*rows):
        return spark.createDataFrame(list(rows), compare.FACTS)

    saved = {"request_count": 0, "successful_requests": 0, "offline_parsed": True, "live": False}
    known = table(fact("steam"), fact("amazon", **saved), fact("google_play", access_method_type="third-party wrapper"), fact("apple_app_store", incremental=False))
    assert compare.comparison(known).count() == 6 and compare.store_comparison(known).count() == 8 and compare.metadata_matrix(known).count() == 21
    assert compare.by_criterion(compare.comparison(known), "Accessibility").first()["amazon_assessment"] == "offline only"
    assert compare.recommendation(known).startswith("Begin with steam; amazon parses")
    assert compare.store_recommendation(known).startswith("Neither")
    assert compare.store_recommendation(table(fact("google_play"), fact("apple_app_store", errors=2))).startswith("Prefer google_play")
    assert compare.recommendation(table(fact("steam"), fact("amazon", blocked=True))).startswith("Begin with steam; amazon matters")
    assert compare.recommendation(table(fact("steam", blocked=True), fact("amazon"))).startswith("Amazon may")
    assert compare.recommendation(table(fact("steam"), fact("amazon", successful_requests=4))).startswith("Go in phases")
    none = known.withColumn("executed", F.lit(False)).withColumn("skipped_reason", F.lit("off"))
    assert {r["steam_assessment"] for r in compare.comparison(none).where("criterion <> 'Commercial value'").collect()} == {"insufficient"}
    assert {r["confidence"] for r in compare.store_comparison(none).collect()} == {"low", "medium qualitative"}
    assert compare.recommendation(none).startswith("No source")


def test_annotation(spark):
    df = spark.createDataFrame([("negative", "negative", "yes", "no", "login=yes;payment=no"), ("neutral", "positive", "no", "YES", None)], "weak_sentiment_label string, human_sentiment string, sentiment_agreement string, mixed_or_unclear string, topic_signal_relevance string")
    assert {r["weak_sentiment_label"]: r["agreement_rate"] for r in annotation.agreement(df).collect()} == {"negative": 1.0, "neutral": 0.0, "Overall": 0.5}
    assert annotation.topic_relevance(df).count() == 2 and annotation.unclear_rate(df).first()[2] == 0.5
    assert annotation.crosstab(df).where("weak_sentiment_label = 'neutral'").first()["positive"] == 1


def test_feature_columns_are_complete():
    assert len(REVIEW_COLUMNS) == 27 and len(FEATURE_COLUMNS) == 64 and len(TOPIC_COLUMNS) == 6


def test_display(spark):
    from larkspur.functions import display

    df = spark.createDataFrame([(True, 0.1234, 3, "available"), (False, None, 3, "off"), (None, 1.0, None, "available")], "b boolean, r double, n long, s string")
    got = df.select(display.yes_no(F.col("b")), display.percent(F.col("r")), display.request_count(F.col("n"), F.col("s")), display.not_applicable(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("yes", "12.34%", "3", "3"), ("no", "not available", "unavailable", "3"), ("not enough evidence", "100.00%", None, "not applicable")]
    assert [display.json_number(v) for v in (None, float("nan"), 2.0, 2.5, 3)] == [None, None, 2, 2.5, 3]
