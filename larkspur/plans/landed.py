"""Registered queries of collectors, files and reports: each works a table of the driver's
through files that it writes, or through a feed that serves the table page by page.

Feeds serve ``nation`` as reviews of ``region`` as apps, all of both tables.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as configs
from .. import runs
from ..functions import display
from ..functions.sql import register_sql
from ..functions.numbers import safe_double, safe_long
from ..operators import compare, eda, features, findings, html_reviews, parse_fields, quality, sample
from ..rules import DEFAULT, check
from ..session import shared_folder, table_of
from ..sources import feeds, files, landed, sinks
from ..sources.http import PoliteClient
from ..streaming import acceptance
from .registry import query
from .views import REPEATS, full, reviews, rules, sql_features, sql_with, table, with_copies


def folder(spark) -> str:
    """A new folder for files of a query; its path without a scheme, for those that go by it."""
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}".removeprefix("file:")


def nations(spark, sf_dir: str) -> dict[int, list[tuple[int, str]]]:
    """(key, name) of the nations of each region; two small dimension tables."""
    out = {r["r_regionkey"]: [] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        out[r["n_regionkey"]].append((r["n_nationkey"], r["n_name"]))
    return out


def client(answer) -> PoliteClient:
    """A client of a feed that is a function from URL to text; its clock takes a second a request."""
    ticks = iter(range(1 << 62))
    return PoliteClient(20, 1.0, open=lambda url, headers, timeout: (200, answer(url).encode()), clock=lambda: float(next(ticks)), sleep=lambda seconds: None)


# Collectors.


def _steam(spark, sf_dir):
    """Two runs over all regions, two nations a page, nation 0 in each; four reviews an app at most."""
    by_region = nations(spark, sf_dir)
    first = [n for found in by_region.values() for n in found if n[0] == 0]
    served = {str(app): sorted({*first, *found}) for app, found in by_region.items()}

    def answer(url):
        app = url.split("/appreviews/")[1].split("?")[0]
        at = url.rsplit("cursor=", 1)[1]
        start = 0 if at == "%2A" else int(at)
        rows = [{"recommendationid": str(key), "review": name, "votes_up": key % 7, "voted_up": key % 2 == 0, "author": {"steamid": app}} for key, name in served[app][start : start + 2]]
        return json.dumps({"cursor": str(start + 2), "reviews": rows})

    app = configs.AppConfig(configs.Assessment(max_reviews_per_item=4, max_pages_per_item=3, repeat_runs=2), configs.Steam(app_ids=(*served, "STEAM_APP_ID_9")))
    return runs.assess(spark, app, folder(spark), "steam", client(answer))


_STEAM_SQL = """WITH listed AS (SELECT n_regionkey AS app, n_nationkey AS id FROM nation UNION SELECT r_regionkey, 0 FROM region),
read AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY id) AS n FROM listed) WHERE n <= 4),
kept AS (SELECT id, CAST(min(app) AS VARCHAR) AS app FROM read GROUP BY id)"""


@query(_STEAM_SQL + " SELECT CAST(id AS VARCHAR) AS review_id, app AS item_id, n_name AS review_text, CAST(id % 7 AS BIGINT) AS helpful_votes, id % 2 = 0 AS recommendation, 'steam' AS source FROM kept JOIN nation ON id = n_nationkey")
def collected_steam(spark, sf_dir):
    _, kept = _steam(spark, sf_dir)
    return kept.select("review_id", "item_id", "review_text", "helpful_votes", "recommendation", "source")


@query(_STEAM_SQL + """ SELECT 'steam' AS source, true AS executed, (SELECT 4 * count(*) FROM region) AS request_count, (SELECT 4 * count(*) FROM region) AS successful_requests, count(*) AS reviews,
 (SELECT 2 * count(*) FROM read) AS raw_reviews, true AS pagination, true AS repeated, CAST(2 AS BIGINT) AS runs, count(*) AS overlap_count, CAST(1 AS DOUBLE) AS overlap_rate, CAST(0 AS BIGINT) AS new_in_second_run, CAST(0 AS BIGINT) AS errors FROM kept""")
def collected_facts(spark, sf_dir):
    facts, _ = _steam(spark, sf_dir)
    return facts.select("source", "executed", "request_count", "successful_requests", "reviews", "raw_reviews", "pagination", "repeated", "runs", "overlap_count", "overlap_rate", "new_in_second_run", "errors")


def _apple_page(rows, start: int) -> str:
    entries = [{"id": {"label": "app"}}] + [{"id": {"label": str(key)}, "content": {"label": name}, "im:rating": {"label": str(1 + key % 5)}} for key, name in rows[start : start + 2]]
    return json.dumps({"feed": {"entry": entries}})


@query("""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation)
SELECT CAST(n_nationkey AS VARCHAR) AS review_id, CAST(n_regionkey AS VARCHAR) AS item_id, n_name AS review_text, CAST(1 + n_nationkey % 5 AS DOUBLE) AS rating FROM ranked WHERE n_regionkey < 3 AND n <= 3 OR n_regionkey = 3 AND n <= 2""")
def validated_apple(spark, sf_dir):
    """A whole validation run, read back from its files: three reviews a target, 13 as the goal.

    Pages hold two, so the first three targets read four, and the fourth needs one page.
    """
    served = nations(spark, sf_dir)

    def answer(url):
        app, number = url.split("/id=")[1].split("/")[0], int(url.split("page=")[1].split("/")[0])
        return _apple_page(served[int(app)], 2 * (number - 1))

    targets = tuple(configs.Target(f"App {app}", str(app)) for app in served)
    app = configs.AppConfig(apple_app_store=configs.Apple(validation_targets=targets, validation_reviews_per_target=3, validation_total_reviews=13))
    root = folder(spark)
    name = runs.validation_run(spark, app, root, "nations", client=client(answer)).name
    read = files.normalized_reviews(spark, f"{root}/data/processed/{app.apple_app_store.validation_output_dir}/{name}/reviews.csv")
    return read.select("review_id", "item_id", "review_text", F.col("rating").cast("double").alias("rating"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS review_id, n_name AS review_text, CAST(1 + n_nationkey % 5 AS DOUBLE) AS rating, 'com.nations' AS package_id FROM nation")
def collected_google(spark, sf_dir):
    """Two runs of batches of four through a wrapper."""
    rows = [n for found in nations(spark, sf_dir).values() for n in found]

    def fetch(package, token, count):
        start = int(token or 0)
        records = [{"reviewId": str(key), "content": name, "score": 1 + key % 5} for key, name in rows[start : start + 4]]
        return records, str(start + 4) if start + 4 < len(rows) else None

    app = configs.AppConfig(configs.Assessment(max_pages_per_item=10), google_play=configs.GooglePlay(package_id="com.nations"))
    _, kept = runs.assess(spark, app, folder(spark), "google_play", None, fetch)
    return kept.select("review_id", "review_text", "rating", "package_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS review_id, n_name AS review_title, CAST(n_regionkey AS DOUBLE) AS rating, CAST(n_nationkey * 1000 AS BIGINT) AS helpful_votes, true AS verified_purchase, CAST(NULL AS BIGINT) AS raw_page_number, 'B0NATIONS1' AS item_id FROM nation")
def saved_captures(spark, sf_dir):
    """A saved file for each region, one review a nation: as HTML, in JSON and in AJAX chunks."""
    root, paths = folder(spark), []
    for region, found in nations(spark, sf_dir).items():
        boxes = "".join(f"<div data-hook='review' id='customer_review-{key}'><b data-hook='review-title'>{name}</b><i data-hook='review-star-rating'>{region}.0 out of 5 stars</i><u data-hook='avp-badge'>V</u><s data-hook='helpful-vote-statement'>{key},000 people</s></div>" for key, name in found)
        html = "<a href='/dp/B0NATIONS1'>x</a>" + boxes
        text = [html, json.dumps({"a": [{"b": html}]}), json.dumps(["x", html]) + "&&&" + json.dumps(["done"])][region % 3]
        path = Path(f"{root}/{region}.txt")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        paths.append(str(path))
    app = configs.AppConfig(amazon=configs.Amazon(saved_response_files=tuple(paths)))
    _, kept = runs.assess(spark, app, root, "amazon")
    return kept.select("review_id", "review_title", "rating", "helpful_votes", "verified_purchase", "raw_page_number", "item_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS app_id, n_name AS app_name, CASE WHEN n_nationkey % 2 = 0 THEN 'gb' ELSE 'us' END AS country FROM nation WHERE n_nationkey % 5 <> 0")
def configured_targets(spark, sf_dir):
    """A configuration with a target for each nation, every fifth a placeholder, loaded from its file."""
    listed = [{"app_id": f"APPLE_APP_ID_{key}" if key % 5 == 0 else key, "app_name": name} | ({"country": "GB"} if key % 2 == 0 else {}) for found in nations(spark, sf_dir).values() for key, name in found]
    path = Path(f"{folder(spark)}/config.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"apple_app_store": {"validation_targets": listed}}), encoding="utf-8")
    got = configs.load(path).apple_app_store.validation_targets
    return spark.createDataFrame([(t.app_id, t.app_name, t.country) for t in got], "app_id string, app_name string, country string")


@query("SELECT n_nationkey::BIGINT AS asked, least(n_nationkey * 10 - 20, 100)::BIGINT AS reviews_per_item, greatest(n_nationkey - 3, 1)::BIGINT AS pages, greatest(n_nationkey / 4.0, 1.0)::DOUBLE AS delay, least(greatest(n_nationkey * 5, 1), 50)::BIGINT AS per_page FROM nation")
def configured_limits(spark, sf_dir):
    """What limits a configuration may ask for and gets."""
    out = []
    for key in sorted(key for found in nations(spark, sf_dir).values() for key, _ in found):
        limits = configs.Assessment.of({"max_reviews_per_item": key * 10 - 20, "max_pages_per_item": key - 3, "request_delay_seconds": key / 4})
        steam = configs.Steam.of({"reviews_per_page": key * 5})
        out.append((key, limits.max_reviews_per_item, limits.max_pages_per_item, float(limits.request_delay_seconds), steam.reviews_per_page))
    return spark.createDataFrame(out, "asked long, reviews_per_item long, pages long, delay double, per_page long")


# Files.


@query(sql_with() + "SELECT review_id, app_name, nullif(review_title, '') AS review_title, nullif(review_text, '') AS review_text, CAST(rating AS VARCHAR) AS rating, review_date, CAST(raw_page_number AS VARCHAR) AS raw_page_number FROM reviews")
def review_files(spark, sf_dir):
    """The reviews written as CSV and read back, all columns text."""
    root = folder(spark)
    sinks.write_reviews(full(reviews(spark, sf_dir)), root, "reviews")
    return files.normalized_reviews(spark, f"{root}/reviews.csv").select("review_id", "app_name", "review_title", "review_text", "rating", "review_date", "raw_page_number")


@query(sql_features("SELECT review_id, review_text_character_count, low_signal_text, round(review_age_days, 6) AS review_age_days, body_print AS repeated_review_body_fingerprint, weak_sentiment_label, row_number() OVER (ORDER BY CAST(review_id AS BIGINT)) AS place FROM flagged"))
def feature_files(spark, sf_dir):
    """The feature frame written in the order of the rows and read back, with its types."""
    root = folder(spark)
    rows = full(reviews(spark, sf_dir)).withColumn(files.ROW, F.col("review_id").cast("long"))
    made = features.generate(rows, rules(), keep=[files.ROW])
    at = sinks.write_features(made, root, "all reviews", order=files.ROW)
    kept = ["review_id", "review_text_character_count", "low_signal_text", "review_age_days", "repeated_review_body_fingerprint", "weak_sentiment_label"]
    back = files.numbered(files.features(spark, str(at / "review_features.csv")).withColumn("file", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start")))
    back = table_of(back.select("file", "block", files.ROW, *kept))  # the files are parsed once
    per = back.groupBy("file", "block").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(Window.orderBy("file", "block")) - F.col("rows"))  # a row a split
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy(files.ROW))
    placed = back.withColumn("nth", nth).join(per, ["file", "block"])
    return placed.select("review_id", "review_text_character_count", "low_signal_text", F.round("review_age_days", 6).alias("review_age_days"), "repeated_review_body_fingerprint", "weak_sentiment_label", (F.col("before") + F.col("nth")).cast("long").alias("place"))


@query("SELECT event_id, CAST(user_id % 4 + 1 AS BIGINT) AS run, CAST(event_id AS BIGINT) AS page, event_type AS payload FROM events")
def landed_files(spark, sf_dir):
    """Raw pages in files named as collectors name them, a file an event; read without listing them on the driver."""
    root = folder(spark)
    named = F.concat(F.lit("feed_run"), (F.col("user_id") % 4 + 1).cast("string"), F.lit("_page"), F.col("event_id").cast("string"), F.lit("_x"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), named.alias("name"))
    # A line stands for a file here, under the file's name; tasks write what they read.
    events.select("name", "value").write.json(root)
    text = spark.read.schema("name string, value string").json(root)
    page, run = F.regexp_extract("name", r"_page(\d+)_", 1).cast("long"), F.regexp_extract("name", r"_run(\d+)_", 1).cast("long")
    return text.select(page.alias("event_id"), run.alias("run"), page.alias("page"), F.col("value").alias("payload"))


@query("SELECT page_id % 4 + 1 AS run, page_id AS page, md5(html) AS payload, 'once' AS how FROM pages WHERE page_id % 4 IN (1, 2) UNION ALL SELECT page_id % 4 + 1, page_id, md5(html), 'stream' FROM pages")
def landed_source(spark, sf_dir):
    """Pages, a file each, through the source: those of two runs by a filter, and all as a stream that runs twice."""
    root = folder(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4 + 1).alias("run"), "html")

    def land(batches):
        Path(f"{root}/pages").mkdir(parents=True, exist_ok=True)
        for frame in batches:
            for page, run, text in frame.itertuples(index=False):
                Path(f"{root}/pages/feed_app_run{run}_page{page}_x.html").write_text(text, encoding="utf-8", newline="")
            yield frame.iloc[:0]

    landed.register(spark)
    for part in ("page_id % 2 = 0", "page_id % 2 = 1"):
        rows.where(part).mapInPandas(land, rows.schema).write.format("noop").mode("overwrite").save()
        acceptance.run(spark.readStream.format(landed.FORMAT).load(f"{root}/pages"), f"{root}/out", f"{root}/state")
    once = spark.read.format(landed.FORMAT).load(f"{root}/pages").where("run IN (2, 3)").withColumn("how", F.lit("once"))
    both = once.unionByName(spark.read.parquet(f"{root}/out").withColumn("how", F.lit("stream")))
    return both.select("run", "page", F.md5("payload").alias("payload"), "how")


# Parsers.


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat(' ', CAST(event_id AS VARCHAR), ' ') WHEN 1 THEN concat(CAST(event_id AS VARCHAR), '.5') WHEN 2 THEN concat('-', CAST(event_id AS VARCHAR)) WHEN 3 THEN event_type WHEN 4 THEN concat(CAST(event_id AS VARCHAR), 'f') ELSE '' END AS v FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(trim(v) AS DOUBLE) END AS as_double, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN CAST(trim(v) AS BIGINT) END AS as_long FROM t""")
def safe_numbers(spark, sf_dir):
    d, kind = F.col("event_id").cast("string"), F.col("event_id") % 6
    text = F.when(kind == 0, F.concat(F.lit(" "), d, F.lit(" "))).when(kind == 1, F.concat(d, F.lit(".5"))).when(kind == 2, F.concat(F.lit("-"), d)).when(kind == 3, F.col("event_type")).when(kind == 4, F.concat(d, F.lit("f"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", safe_double(text).alias("as_double"), safe_long(text).alias("as_long"))


#: A page's own html with a link to the next page in it, in one of three forms, or with none.
_PAGER = "CASE page_id % 4 WHEN 0 THEN concat('{{\"pageNumber\":\"', CAST(page_id + 2 AS {string}), '\"}}') WHEN 1 THEN concat('?pageNumber=', CAST(page_id + 2 AS {string}), '&x') WHEN 2 THEN concat('page-number=&quot;', CAST(page_id + 2 AS {string})) ELSE '' END"
_NEXT_PAGES = "SELECT page_id, concat(html, ' <i>', " + _PAGER + ", '</i>', CASE WHEN page_id % 3 = 0 THEN ' nextPageToken' ELSE '' END) AS text FROM {pages}"


@query("WITH t AS (" + _NEXT_PAGES.format(string="VARCHAR", pages="pages") + """), found AS (SELECT page_id, text, regexp_extract_all(text, '(?:pageNumber=|"pageNumber":"|page-number=&quot;)(\\d+)', 1) AS n FROM t)
SELECT page_id, CASE WHEN len(n) > 0 THEN CAST(n[1] AS BIGINT) END AS next_page, contains(text, 'nextPageToken') AS has_token FROM found""")
def next_pages(spark, sf_dir):
    """The next page's number and whether there is a token, found in whole pages."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages_in")
    pages = spark.sql(_NEXT_PAGES.format(string="STRING", pages="pages_in"))
    return pages.select("page_id", parse_fields.next_page_number(F.col("text")).alias("next_page"), parse_fields.has_next_page_token(F.col("text")).alias("has_token"))


@query("SELECT CAST(page_id AS VARCHAR) AS review_id, CAST(page_id % 6 AS DOUBLE) AS rating, CASE WHEN page_id % 2 = 0 THEN 'B0PAGES001' END AS item_id FROM pages")
def unwrapped_captures(spark, sf_dir):
    """A review a page, in its own div, wrapped in JSON or in AJAX chunks beside the page's own text."""
    box = F.concat(F.when(F.col("page_id") % 2 == 0, "<a href='/product-reviews/B0PAGES001'>x</a>").otherwise(""), F.lit("<div id='customer_review-"), F.col("page_id").cast("string"), F.lit("'><span data-hook='review-star-rating'>"), (F.col("page_id") % 6).cast("string"), F.lit(".0 out of 5</span></div>"))
    in_json = F.to_json(F.struct(F.array(F.struct(box.alias("review_html"), F.col("url"), F.col("html").alias("page"))).alias("deep")))
    chunks = F.concat(F.to_json(F.array(F.lit("append"), box)), F.lit("&&&[broken&&&"), F.to_json(F.array(F.lit("end"))))
    text = F.when(F.col("page_id") % 3 == 0, box).when(F.col("page_id") % 3 == 1, in_json).otherwise(chunks)
    return html_reviews.reviews(table(spark, sf_dir, "pages").select(text.alias("payload"))).select("review_id", "rating", "item_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'no' ELSE 'not enough evidence' END AS flag, CASE WHEN event_id % 4 = 0 THEN 'not available' ELSE concat(CAST(event_id % 50 AS VARCHAR), '.00%') END AS share,
 CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) ELSE 'unavailable' END AS requests, CASE WHEN event_id % 5 = 0 THEN 'not applicable' ELSE CAST(event_id AS VARCHAR) END AS shown FROM events""")
def displayed_values(spark, sf_dir):
    d = F.col("event_id")
    flag = F.when(d % 3 == 0, True).when(d % 3 == 1, False)
    status = F.when(F.col("event_type") == "click", "available").otherwise("unavailable")
    return table(spark, sf_dir, "events").select("event_id", display.yes_no(flag).alias("flag"), display.percent(F.when(d % 4 != 0, (d % 50) / 100)).alias("share"), display.request_count(F.col("user_id"), status).alias("requests"), display.not_applicable(F.when(d % 5 != 0, d)).alias("shown"))


@query("SELECT DISTINCT CAST(o_custkey AS DOUBLE) / 4 AS value, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey // 4 AS VARCHAR) ELSE CAST(CAST(o_custkey AS DOUBLE) / 4 AS VARCHAR) END AS shown FROM orders")
def json_numbers(spark, sf_dir):
    """Numbers as JSON has them: whole ones without a fraction."""
    values = table(spark, sf_dir, "orders").select((F.col("o_custkey").cast("double") / 4).alias("value")).distinct()
    return values.select("value", display.json_text(F.col("value")).alias("shown"))


# Features, samples, tables.


_IDENTIFIED = "SELECT review_id, CASE WHEN CAST(review_id AS BIGINT) % 5 = 0 THEN item_id WHEN CAST(review_id AS BIGINT) % 5 = 1 THEN '  ' END AS item_id, CASE WHEN CAST(review_id AS BIGINT) % 5 IN (1, 2) THEN concat(' Pkg.', app_name) END AS package_id, CASE WHEN CAST(review_id AS BIGINT) % 5 = 3 THEN 'ITEM' END AS item_name, CASE WHEN CAST(review_id AS BIGINT) % 5 < 4 THEN app_name END AS app_name FROM {reviews}"


@query(sql_with() + ", i AS (" + _IDENTIFIED.format(reviews="reviews") + ") SELECT review_id, CASE WHEN trim(item_id) <> '' THEN concat('item_id:', lower(trim(item_id))) WHEN trim(package_id) <> '' THEN concat('package_id:', lower(trim(package_id))) WHEN trim(item_name) <> '' THEN concat('item_name:', lower(item_name)) WHEN trim(app_name) <> '' THEN concat('app_name:', lower(app_name)) ELSE '' END AS app_identifier FROM i")
def identifier_fallbacks(spark, sf_dir):
    rows = spark.sql(_IDENTIFIED, reviews=reviews(spark, sf_dir))
    return rows.select("review_id", features.app_identifier().alias("app_identifier"))


_PRESENT = "SELECT review_id, CASE CAST(review_id AS BIGINT) % 3 WHEN 0 THEN '1.2' WHEN 1 THEN ' ' END AS app_version, CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'Thanks' WHEN 1 THEN '' END AS developer_response, CASE WHEN CAST(review_id AS BIGINT) % 5 <> 0 THEN language END AS language, rating, review_date FROM {reviews}"


@query(sql_with() + ", i AS (" + _PRESENT.format(reviews="reviews") + ") SELECT review_id, CAST(review_id AS BIGINT) % 3 = 0 AS has_app_version, CAST(review_id AS BIGINT) % 4 = 0 AS has_developer_reply, rating IS NULL AS missing_rating, review_date IS NULL AS missing_publication_timestamp, language IS NOT NULL AS declared_language_available FROM i")
def presence_flags(spark, sf_dir):
    rows = spark.sql(_PRESENT, reviews=reviews(spark, sf_dir))
    return rows.select("review_id", *[c.alias(n) for n, c in features.presence_columns().items()])


def _changed_rules(key: int):
    """A rule set of its own for each key, some of them wrong."""
    section = {0: {"rule_version": f"v{key}"}, 1: {"rule_version": " "}, 2: {"reference_timestamp": "2026-07-07"}, 3: {"low_signal": {"minimum_review_text_characters": key, "minimum_review_text_words": -1}}, 4: {"topic_signal_keywords": {"login": []}}}
    return DEFAULT | section[key % 5]


@query("SELECT CAST(n_nationkey AS BIGINT) AS rule, n_nationkey % 5 = 0 AS accepted, CASE WHEN n_nationkey % 5 = 0 THEN concat('v', CAST(n_nationkey AS VARCHAR)) END AS version FROM nation")
def checked_rules(spark, sf_dir):
    """Rule sets, one a nation, of which those with a wrong section are refused."""
    out = []
    for key in sorted(key for found in nations(spark, sf_dir).values() for key, _ in found):
        try:
            out.append((key, True, check(_changed_rules(key)).version))
        except ValueError:
            out.append((key, False, None))
    return spark.createDataFrame(out, "rule long, accepted boolean, version string")


# Scope: the least rank of another review with the same body, country, language and item.
_RANKED = "concat(sha256(concat_ws('|', coalesce(source, 'nan'), coalesce(app_name, 'nan'), coalesce(country, 'nan'), coalesce(review_id, 'nan'))), sha256(concat_ws('|', review_title, review_text, CAST(rating AS VARCHAR))))"


@query(sql_features(f""", ranked AS (SELECT *, {_RANKED} AS r FROM flagged WHERE body_print IS NOT NULL),
mine AS (SELECT * FROM ranked WHERE repeated_review_body ORDER BY r LIMIT 135),
met AS (SELECT m.review_id, o.review_id AS peer, o.review_text AS body, row_number() OVER (PARTITION BY m.r ORDER BY o.r) AS n FROM mine m JOIN ranked o
  ON m.body_print = o.body_print AND lower(trim(m.country)) = lower(trim(o.country)) AND lower(m.language) = lower(o.language) AND lower(m.item_id) = lower(o.item_id) AND m.review_id <> o.review_id)
SELECT review_id, peer AS repeated_review_body_example_review_id, body AS repeated_review_body_example_body FROM met WHERE n = 1"""))
def sample_peers(spark, sf_dir):
    """Peers of the flagged rows of the least ranks, as many as a sample has; candidates are all rows."""
    made = sample.ranked(features.generate(full(reviews(spark, sf_dir)), rules()))
    flagged = made.where("repeated_review_body").orderBy("__rank").limit(sample.SIZE)
    found = sample.peers(flagged, made, "repeated_review_body")
    return found.join(flagged.select("__rank", "review_id"), "__rank").select("review_id", "repeated_review_body_example_review_id", "repeated_review_body_example_body")


_GROUPS = "app_name, item_id, country, language"


@query(sql_with(REPEATS) + f""", g AS (SELECT {_GROUPS}, count(*) AS n, max(CASE WHEN review_date IS NULL THEN 0 ELSE 1 END) AS d FROM allrows GROUP BY {_GROUPS})
SELECT 'review_volume_by_app' AS name, count(*) AS row_count FROM g UNION ALL SELECT 'rating_distribution', count(*) FROM (SELECT DISTINCT {_GROUPS}, rating FROM allrows) UNION ALL SELECT 'review_text_length', count(*) FROM g
UNION ALL SELECT 'date_coverage', count(*) FROM g UNION ALL SELECT 'missing_fields', 27 * count(*) FROM g UNION ALL SELECT 'duplicate_records', count(*) FROM (SELECT review_id FROM allrows GROUP BY review_id HAVING count(*) > 1)
UNION ALL SELECT 'language_region_issues', count(*) FROM g UNION ALL SELECT 'low_signal_reviews', count(*) FROM allrows WHERE review_text IS NULL OR length(regexp_replace(review_text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')) < 15
UNION ALL SELECT 'pagination_depth_and_failures', 0 UNION ALL SELECT 'errors', 1""")
def eda_tables(spark, sf_dir):
    """All ten tables at once, and how many rows each has."""
    tables = eda.tables(full(with_copies(spark, sf_dir, REPEATS)), errors=["one"])
    out = None
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(sql_with() + f"SELECT {_GROUPS}, count(*) AS review_count, row_number() OVER (ORDER BY app_name NULLS LAST, item_id NULLS LAST, country NULLS LAST, language NULLS LAST) AS place FROM (SELECT * REPLACE (CASE WHEN CAST(review_id AS BIGINT) % 6 = 0 THEN NULL ELSE language END AS language) FROM reviews) GROUP BY {_GROUPS}")
def ordered_volume(spark, sf_dir):
    """Groups in the order in which the table is written: ascending, absent keys last."""
    rows = reviews(spark, sf_dir).withColumn("language", F.when(F.col("review_id").cast("long") % 6 != 0, F.col("language")))
    ordered = eda.review_volume(rows).orderBy(*eda.keys()).withColumn("__at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("__at"))  # one row a group
    return ordered.select(*_GROUPS.split(", "), "review_count", place.cast("long").alias("place"))


# Facts of four sources: requests and reviews dealt to them by id; the fourth has none.

FACTS = """
SELECT q.source, q.source <> 'apple_app_store' AS executed, CASE WHEN q.source = 'apple_app_store' THEN 'switched off' END AS skipped_reason, concat(q.source, ' access') AS access_method,
 CASE WHEN q.source = 'google_play' THEN 'third-party wrapper' ELSE 'public feed' END AS access_method_type, CASE WHEN q.source = 'amazon' THEN CAST(0 AS BIGINT) ELSE q.requests END AS request_count,
 CASE WHEN q.source = 'amazon' THEN CAST(0 AS BIGINT) ELSE q.fine END AS successful_requests, CASE WHEN q.source = 'google_play' THEN 'unavailable' ELSE 'available' END AS request_count_status,
 q.source <> 'amazon' AS live, q.source = 'amazon' AS offline_parsed, CASE WHEN q.source = 'amazon' THEN q.requests ELSE CAST(0 AS BIGINT) END AS saved_batches, coalesce(r.reviews, CAST(0 AS BIGINT)) AS reviews, q.raw AS raw_reviews,
 q.requests AS pages_attempted, q.fine AS pages_completed, q.requests AS batches, q.pages > 1 AS pagination, q.users > 1 AS repeated, q.source = 'steam' AS incremental, q.users AS runs,
 CASE WHEN q.source = 'amazon' THEN NULL ELSE q.fine END AS overlap_count, CASE WHEN q.source = 'amazon' THEN NULL ELSE q.fine * 1.0E0 / q.requests END AS overlap_rate, q.users AS new_in_second_run, q.blocks > 0 AS blocked,
 q.requests - q.fine AS errors, q.blocks AS warnings, CASE WHEN q.source = 'google_play' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS limitations, q.unparsed AS parser_errors,
 split(CASE WHEN q.source = 'google_play' THEN 'source,app_name,item_id,package_id,review_id,review_text,rating,review_date' ELSE 'source,item_id,review_id' END, ',') AS metadata_fields,
 coalesce(r.reviews, CAST(0 AS BIGINT)) AS total_rows, coalesce(r.ids, CAST(0 AS BIGINT)) AS unique_rows, coalesce(r.reviews - r.ids, CAST(0 AS BIGINT)) AS duplicates, coalesce(r.blank, CAST(0 AS BIGINT)) AS empty_text, q.elapsed AS average_response_time, q.blocks AS blocked_requests
FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'steam' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_play' ELSE 'apple_app_store' END AS source, count(*) AS requests, count(CASE WHEN event_type <> 'error' THEN 1 END) AS fine,
  CAST(sum(event_id % 5) AS BIGINT) AS raw, count(DISTINCT event_id % 5) AS pages, count(DISTINCT user_id) AS users, count(CASE WHEN event_type = 'error' AND event_id % 3 = 2 THEN 1 END) AS blocks,
  count(CASE WHEN event_id % 13 = 0 THEN 1 END) AS unparsed, avg(value) AS elapsed FROM {events} GROUP BY 1) q
LEFT JOIN (SELECT CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'steam' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_play' END AS source, count(*) AS reviews, count(DISTINCT review_id) AS ids, count(CASE WHEN trim(coalesce(review_text, '')) = '' THEN 1 END) AS blank FROM {reviews} GROUP BY 1) r ON q.source = r.source
"""
_SQL_FACTS = sql_with(REPEATS) + ", facts AS (" + FACTS.format(events="events", reviews="allrows") + "), f AS (SELECT *, CASE WHEN request_count > 0 THEN successful_requests / request_count END AS rate FROM facts) "


def facts(spark, sf_dir) -> DataFrame:
    return spark.sql(FACTS, events=table(spark, sf_dir, "events"), reviews=with_copies(spark, sf_dir, REPEATS)).withColumn("status_codes", F.array(F.lit(200).cast("long")))


def played(spark, sf_dir) -> DataFrame:
    """The reviews of the sources; the fourth source has none."""
    kind = F.col("review_id").cast("long") % 4
    source = F.when(kind == 0, "steam").when(kind == 1, "amazon").when(kind == 2, "google_play")
    return full(with_copies(spark, sf_dir, REPEATS)).withColumn("source", source).where("source is not null")


@query(_SQL_FACTS + "SELECT source, CAST(CASE WHEN executed AND reviews > 0 THEN 2 ELSE 0 END + CASE WHEN pagination THEN 1 ELSE 0 END + CASE WHEN repeated THEN 1 ELSE 0 END + CASE WHEN incremental THEN 1 ELSE 0 END - CASE WHEN access_method_type LIKE '%third-party%' THEN 1 ELSE 0 END - CASE WHEN errors > 0 THEN 1 ELSE 0 END AS BIGINT) AS viability_score FROM f")
def viability_score(spark, sf_dir):
    return compare.viability(facts(spark, sf_dir))


_ACCESS = "CASE WHEN NOT executed THEN 'insufficient' WHEN source = 'amazon' AND offline_parsed AND request_count = 0 THEN 'offline only' WHEN blocked THEN 'weak' WHEN rate = 1 THEN 'strong' WHEN source = 'amazon' AND request_count > 0 THEN 'unresolved' ELSE 'mixed' END"
_FIRST_TWO = {
    "Accessibility": _ACCESS,
    "Review volume": "CASE WHEN NOT executed THEN 'insufficient' ELSE 'limited test' END",
    "Available metadata": "CASE WHEN NOT executed THEN 'insufficient' WHEN len(metadata_fields) >= 8 THEN 'strong coverage' ELSE 'limited coverage' END",
    "Data quality": "CASE WHEN NOT executed THEN 'insufficient' WHEN total_rows = 0 THEN 'no rows' WHEN duplicates = 0 AND coalesce(overlap_count, 0) > 0 THEN 'consistent' WHEN parser_errors > 0 THEN 'mixed' ELSE 'acceptable' END",
    "Commercial value": "CASE WHEN source = 'amazon' THEN 'broad product relevance' ELSE 'rich feedback, limited to games' END",
    "Long-term maintainability": "CASE WHEN NOT executed THEN 'insufficient' WHEN source = 'steam' THEN 'stronger' ELSE 'riskier' END",
}
_STORES = {
    "Consistent accessibility": "CASE WHEN NOT executed THEN 'insufficient' WHEN request_count > 0 AND rate = 1 THEN 'strong' WHEN source = 'google_play' AND reviews > 0 THEN 'feasible, unofficial' ELSE 'inconclusive' END",
    "Pagination or batching": "CASE WHEN NOT executed THEN 'insufficient' WHEN pagination THEN 'demonstrated' ELSE 'not demonstrated' END",
    "Available metadata": "CASE WHEN NOT executed THEN 'insufficient' WHEN len(metadata_fields) >= 8 THEN 'strong coverage' ELSE 'limited coverage' END",
    "Repeated collection": "CASE WHEN NOT executed THEN 'insufficient' WHEN repeated THEN 'demonstrated' ELSE 'not demonstrated' END",
    "Access limitations": "CASE WHEN NOT executed THEN 'insufficient' WHEN limitations > 0 OR errors > 0 THEN 'material' ELSE 'none material' END",
    "Data quality": "CASE WHEN NOT executed THEN 'insufficient' WHEN total_rows = 0 THEN 'no rows' WHEN duplicates = 0 AND parser_errors = 0 THEN 'acceptable' ELSE 'mixed' END",
    "Long-term maintainability": "CASE WHEN NOT executed THEN 'insufficient' WHEN access_method_type LIKE '%third-party%' THEN 'riskier' ELSE 'stronger' END",
    "Commercial value and generalizability": "CASE WHEN NOT executed THEN 'insufficient' ELSE 'strong fit' END",
}


def _sql_table(cases: dict[str, str], a: str, b: str, known: str, qualitative: str) -> str:
    parts = [f"SELECT '{c}' AS criterion, (SELECT {case} FROM f WHERE source = '{a}') AS {a}_assessment, (SELECT {case} FROM f WHERE source = '{b}') AS {b}_assessment, CASE WHEN '{c}' = '{qualitative}' THEN 'medium qualitative' WHEN (SELECT bool_or({known}) FROM f WHERE source IN ('{a}', '{b}')) THEN 'limited' ELSE 'low' END AS confidence" for c, case in cases.items()]
    return " UNION ALL ".join(parts)


@query(_SQL_FACTS + _sql_table(_FIRST_TWO, "amazon", "steam", "executed", "Commercial value"))
def source_comparison(spark, sf_dir):
    return compare.comparison(facts(spark, sf_dir)).select("criterion", "amazon_assessment", "steam_assessment", "confidence")


@query(_SQL_FACTS + _sql_table(_STORES, "google_play", "apple_app_store", "executed AND reviews > 0", "Commercial value and generalizability"))
def store_comparison(spark, sf_dir):
    return compare.store_comparison(facts(spark, sf_dir)).select("criterion", "google_play_assessment", "apple_app_store_assessment", "confidence")


@query(_SQL_FACTS + "SELECT 'Data quality' AS criterion, " + f"(SELECT {_FIRST_TWO['Data quality']} FROM f WHERE source = 'steam') AS steam_assessment, (SELECT concat('duplicates=', duplicates, '; overlap=', coalesce(CAST(overlap_count AS VARCHAR), 'none'), '; empty_text=', empty_text, '; parser_errors=', parser_errors) FROM f WHERE source = 'amazon') AS amazon_evidence")
def criterion_row(spark, sf_dir):
    return compare.by_criterion(compare.comparison(facts(spark, sf_dir)), "Data quality").select("criterion", "steam_assessment", "amazon_evidence")


_MATRIX = "source app_name item_id package_id review_id review_title review_text rating review_date author_name author_id helpful_votes app_version language country developer_response developer_response_date source_url raw_page_number raw_cursor collected_at"


def _state(source: str) -> str:
    return f"(SELECT CASE WHEN reviews = 0 THEN 'not verified' WHEN list_contains(metadata_fields, field) THEN 'available' ELSE 'unavailable' END FROM f WHERE source = '{source}') AS {source}"


@query(_SQL_FACTS + f"SELECT field, {_state('google_play')}, {_state('apple_app_store')} FROM (SELECT unnest(string_split('{_MATRIX}', ' ')) AS field)")
def metadata_matrix(spark, sf_dir):
    return compare.metadata_matrix(facts(spark, sf_dir))


@query(_SQL_FACTS + """, s AS (SELECT (executed AND reviews > 0 AND NOT blocked AND rate = 1) AS steady FROM f WHERE source = 'steam'), a AS (SELECT * FROM f WHERE source = 'amazon'),
v AS (SELECT source, CASE WHEN executed AND reviews > 0 THEN 2 ELSE 0 END + CASE WHEN pagination THEN 1 ELSE 0 END + CASE WHEN repeated THEN 1 ELSE 0 END + CASE WHEN incremental THEN 1 ELSE 0 END - CASE WHEN access_method_type LIKE '%third-party%' THEN 1 ELSE 0 END - CASE WHEN errors > 0 THEN 1 ELSE 0 END AS score FROM f)
SELECT CASE WHEN steady AND executed AND reviews > 0 AND offline_parsed AND request_count = 0 THEN 'Begin with steam; amazon parses offline, live access stays open.' WHEN steady AND (blocked OR request_count = 0) THEN 'Begin with steam; amazon matters commercially and needs work on access.'
 WHEN executed AND reviews > 0 AND NOT blocked AND coalesce(rate, 1) = 1 AND request_count > 0 AND pagination THEN 'Amazon may serve a next prototype; test it more widely.'
 WHEN steady AND NOT (executed AND reviews > 0 AND NOT blocked AND coalesce(rate, 1) = 1) THEN 'Go in phases: steam first, then amazon once access is shown.' ELSE 'No source wins on this evidence; run more tests.' END AS first_phase,
 (SELECT CASE WHEN g.score = p.score THEN 'Neither app store can be chosen on this evidence; pilot only.' WHEN g.score > p.score THEN 'Prefer google_play as the primary app store and keep apple_app_store as the second; watch access, schema and limits.' ELSE 'Prefer apple_app_store as the primary app store and keep google_play as the second; watch access, schema and limits.' END
  FROM v g, v p WHERE g.source = 'google_play' AND p.source = 'apple_app_store') AS app_stores FROM s, a""")
def recommendations(spark, sf_dir):
    known = facts(spark, sf_dir)
    return spark.createDataFrame([(compare.recommendation(known), compare.store_recommendation(known))], "first_phase string, app_stores string")


@query("WITH t AS (SELECT event_id, event_id % 2 = 0 AS offline, CASE WHEN event_id % 3 = 0 THEN 'unavailable' ELSE 'available' END AS status, event_id % 5 AS n, CASE event_id % 7 WHEN 0 THEN NULL ELSE event_id % 7 < 4 END AS shown FROM events) SELECT event_id, CASE WHEN shown IS NOT NULL AND (offline OR status <> 'available') THEN CASE WHEN shown THEN '1.0' ELSE '0.0' END WHEN n = 0 THEN NULL WHEN shown IS NULL THEN 'not enough evidence' WHEN shown THEN '1.0' ELSE '0.0' END AS pagination_success_rate FROM t")
def pagination_rates(spark, sf_dir):
    d = F.col("event_id")
    status = F.when(d % 3 == 0, "unavailable").otherwise("available")
    rate = quality.pagination_rate(d % 2 == 0, status, d % 5, F.when(d % 7 != 0, d % 7 < 4))
    return table(spark, sf_dir, "events").select("event_id", rate.alias("pagination_success_rate"))


_METRICS = ["source", "total_rows", "unique_review_count", "final_dataset_duplicate_count", "duplicates_within_final_dataset", "duplicate_percentage_within_final_dataset", "cross_run_overlap_count", "cross_run_overlap_rate", "new_records_in_second_run", "overlap_across_repeat_runs", "repeat_run_overlap_rate",
    "empty_review_text_count", "empty_review_text_percentage", "missing_rating_count", "missing_date_count", "missing_review_id_count", "average_review_text_length", "minimum_review_text_length", "maximum_review_text_length", "metadata_fields_available_count", "request_count_status", "batches_attempted", "batches_completed",
    "pagination_requests", "pagination_success_rate", "http_request_success_rate", "average_response_time", "blocked_request_count", "parser_error_count", "completeness_rating", "completeness_app_version", "missing_expected_fields", "not_applicable_fields"]


@query(_SQL_FACTS + """, rows AS (SELECT *, CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'steam' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_play' END AS played FROM allrows),
p AS (SELECT played, count(*) AS n, count(DISTINCT review_id) AS ids, CAST(count_if(trim(coalesce(review_text, '')) = '') AS BIGINT) AS blank, CAST(count_if(rating IS NULL) AS BIGINT) AS no_rating, CAST(count_if(review_date IS NULL) AS BIGINT) AS no_date, avg(length(coalesce(review_text, ''))) AS mean,
  CAST(min(length(coalesce(review_text, ''))) AS BIGINT) AS least, CAST(max(length(coalesce(review_text, ''))) AS BIGINT) AS most FROM rows WHERE played IS NOT NULL GROUP BY played)
SELECT source, coalesce(n, 0) AS total_rows, coalesce(ids, 0) AS unique_review_count, coalesce(n - ids, 0) AS final_dataset_duplicate_count, coalesce(n - ids, 0) AS duplicates_within_final_dataset, round((n - ids) / n, 6) AS duplicate_percentage_within_final_dataset,
 overlap_count AS cross_run_overlap_count, round(overlap_rate, 6) AS cross_run_overlap_rate, new_in_second_run AS new_records_in_second_run, overlap_count AS overlap_across_repeat_runs, round(overlap_rate, 6) AS repeat_run_overlap_rate,
 coalesce(blank, 0) AS empty_review_text_count, round(blank / n, 6) AS empty_review_text_percentage, CASE WHEN source <> 'steam' THEN no_rating END AS missing_rating_count, coalesce(no_date, 0) AS missing_date_count, CAST(0 AS BIGINT) AS missing_review_id_count,
 round(mean, 6) AS average_review_text_length, least AS minimum_review_text_length, most AS maximum_review_text_length, CAST(CASE WHEN source = 'google_play' THEN 8 ELSE 3 END AS BIGINT) AS metadata_fields_available_count, request_count_status, pages_attempted AS batches_attempted, pages_completed AS batches_completed,
 CASE WHEN source <> 'google_play' THEN request_count END AS pagination_requests, CASE WHEN pagination THEN '1.0' ELSE '0.0' END AS pagination_success_rate, round(CASE WHEN source <> 'google_play' THEN rate END, 6) AS http_request_success_rate, round(CASE WHEN source <> 'google_play' THEN average_response_time END, 4) AS average_response_time,
 CASE WHEN source <> 'google_play' THEN blocked_requests END AS blocked_request_count, parser_errors AS parser_error_count, round(1 - no_rating / n, 6) AS completeness_rating, CASE WHEN n > 0 THEN CAST(0 AS DOUBLE) END AS completeness_app_version,
 CASE source WHEN 'steam' THEN 'author_id, helpful_votes, funny_votes, playtime_forever, playtime_at_review' WHEN 'amazon' THEN 'author_name, verified_purchase, helpful_votes' WHEN 'google_play' THEN 'package_id, author_name, helpful_votes, app_version, developer_response, developer_response_date'
  ELSE 'source, app_name, item_id, review_id, review_title, review_text, rating, review_date, author_name, helpful_votes, app_version, language, country' END AS missing_expected_fields,
 CASE source WHEN 'steam' THEN 'rating, review_title, verified_purchase' WHEN 'amazon' THEN 'recommendation, funny_votes, playtime_forever, playtime_at_review' WHEN 'google_play' THEN 'recommendation, funny_votes, playtime_forever, playtime_at_review, verified_purchase'
  ELSE 'recommendation, funny_votes, playtime_forever, playtime_at_review, verified_purchase, developer_response, developer_response_date' END AS not_applicable_fields
FROM f LEFT JOIN p ON f.source = p.played""")
def quality_metrics(spark, sf_dir):
    """The whole profile of four sources, one of them the one without ratings, one without rows."""
    out = quality.metrics(played(spark, sf_dir), facts(spark, sf_dir)).select(*_METRICS)
    shares = ("duplicate_percentage_within_final_dataset", "cross_run_overlap_rate", "repeat_run_overlap_rate", "empty_review_text_percentage", "average_review_text_length", "http_request_success_rate", "completeness_rating")
    return out.withColumns({c: F.round(c, 6) for c in shares} | {"average_response_time": F.round("average_response_time", 4)})


@query(_SQL_FACTS + """SELECT source, CASE WHEN NOT executed THEN 'Not executed: switched off' ELSE concat('- Live collection: ', CASE WHEN live THEN 'yes' ELSE 'no' END) END AS first_line,
 CASE WHEN executed THEN concat('- Requests: ', CASE WHEN source = 'google_play' THEN 'unavailable' ELSE CAST(request_count AS VARCHAR) END) END AS requests,
 CASE WHEN executed THEN concat('- Overlap rate: ', CASE WHEN overlap_rate IS NULL THEN 'not applicable' ELSE concat(printf('%.2f', 100 * overlap_rate), '%') END) END AS overlap FROM f""")
def source_findings(spark, sf_dir):
    known = facts(spark, sf_dir)
    text = findings.findings(known, quality.metrics(played(spark, sf_dir), known)).withColumn("lines", F.split("text", "\n"))
    found = lambda start: F.get(F.filter("lines", lambda x: x.startswith(start)), F.lit(0))
    return text.select("source", F.get("lines", F.lit(0)).alias("first_line"), found("- Requests:").alias("requests"), found("- Overlap rate:").alias("overlap"))


# The SQL surface: the Spark side is SQL text only.


_FLAGS = """SELECT review_id, is_present(review_title) AS has_title, strict_timestamp(review_date) AS published, weak_sentiment(rating) AS label,
 round(days_between(strict_timestamp(collected_at), strict_timestamp(review_date)), 6) AS age_days,
 has_topic(lower(trim(regexp_replace(coalesce(blank_to_null(review_text), ''), '\\\\s+', ' '))), 'delivery') AS delivery
FROM reviews_in"""


@query(sql_features("SELECT review_id, ntitle <> '' AS has_title, make_timestamp(us) AS published, weak_sentiment_label AS label, round(review_age_at_collection_days, 6) AS age_days, regexp_matches(ntext, '(^|[^\\p{L}\\p{N}_])(?:password)($|[^\\p{L}\\p{N}_])') AS delivery FROM flagged"))
def sql_review_flags(spark, sf_dir):
    """Presence, instants, ages, topics and labels by SQL functions that are SQL themselves."""
    register_sql(spark, rules())
    reviews(spark, sf_dir).createOrReplaceTempView("reviews_in")
    return spark.sql(_FLAGS)


_PAGES_IN = "SELECT page_id, concat('<div id=\"customer_review-', CAST(page_id AS {string}), '\" data-hook=\"review\"><b data-hook=\"review-title\">page ', CAST(page_id AS {string}), '</b><i data-hook=\"review-star-rating\">', CAST(page_id % 6 AS {string}), '.0 out of 5 stars</i></div>', html) AS payload FROM {pages}"


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS review_id, concat('page ', CAST(page_id AS VARCHAR)) AS title, CAST(page_id % 6 AS DOUBLE) AS stars FROM pages")
def sql_page_reviews(spark, sf_dir):
    """Whole pages with a review before them, parsed by a table function over Arrow batches."""
    register_sql(spark, rules())
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages_in")
    spark.sql(_PAGES_IN.format(string="STRING", pages="pages_in")).createOrReplaceTempView("payloads_in")
    return spark.sql("SELECT page_id, review_id, title, CAST(substr(rating, 1, 3) AS DOUBLE) AS stars FROM parse_review_pages(TABLE(SELECT page_id, payload FROM payloads_in))")
