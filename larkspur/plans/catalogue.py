"""The registered queries of the review operators, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_present, normalized, script_consistent, topic_signal, weak_sentiment, word_count
from ..functions.times import days_between, instant, strict_timestamp
from ..operators import annotation, collect, eda, features, history, html_reviews, parse_fields, parse_json, quality, report, run_bitmaps, sample
from ..schema import CONTEXT, FEATURE_COLUMNS, GROUP, NUMERIC_COLUMNS, RATE_COLUMNS, TOPICS
from ..session import cut, shared_folder
from ..streaming import acceptance, dedup
from .registry import query
from .views import COPIES, REPEATS, full, reviews, rules, sql_features, sql_with, table, with_copies

G = ", ".join(GROUP)
C = ", ".join(CONTEXT)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def feature_frame(spark, sf_dir: str) -> DataFrame:
    return features.generate(full(reviews(spark, sf_dir)), rules())


# Text, time and derived features.


@query(sql_with() + """SELECT coalesce(CASE WHEN rating BETWEEN 1 AND 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating BETWEEN 4 AND 5 THEN 'positive' END, '<missing>') AS weak_sentiment_label,
  count(*) AS review_count FROM reviews GROUP BY 1""")
def weak_label_counts(spark, sf_dir):
    return report.label_counts(reviews(spark, sf_dir).select(weak_sentiment(F.col("rating")).alias("weak_sentiment_label")))


@query(sql_features("SELECT review_id, review_text_character_count, review_text_word_count, title_character_count, title_word_count, ntext <> '' AS has_review_text, ntitle <> '' AS has_title, low_signal_text FROM flagged"))
def text_features(spark, sf_dir):
    base = reviews(spark, sf_dir).select("review_id", normalized(F.col("review_title"), rules()).alias("__title"), normalized(F.col("review_text"), rules()).alias("__text"), "language")
    base = base.withColumn("__words", word_count(F.col("__text"), rules()))
    made = features.text_columns(rules())
    names = ["review_text_character_count", "review_text_word_count", "title_character_count", "title_word_count", "has_review_text", "has_title", "low_signal_text"]
    return base.select("review_id", *[made[n].alias(n) for n in names])


@query(sql_features("""SELECT review_id, CAST(publication_year AS DOUBLE) AS publication_year, CAST(publication_month AS DOUBLE) AS publication_month, publication_day_of_week, round(review_age_days, 6) AS review_age_days,
  round(review_age_at_collection_days, 6) AS review_age_at_collection_days, publication_timestamp_missing_or_invalid, missing_publication_timestamp FROM flagged"""))
def time_features(spark, sf_dir):
    base = reviews(spark, sf_dir).withColumns({"__published": strict_timestamp(F.col("review_date")), "__collected": strict_timestamp(F.col("collected_at"))})
    made = features.time_columns(rules()) | {"missing_publication_timestamp": ~is_present(F.col("review_date"))}
    made.pop("publication_timestamp")
    made |= {n: made[n].cast("double") for n in ("publication_year", "publication_month")}
    return rounded(base.select("review_id", *[c.alias(n) for n, c in made.items()]), "review_age_days", "review_age_at_collection_days")


@query("""SELECT event_id, round((epoch_us(CAST('2026-07-07T00:00:00' AS TIMESTAMP)) - epoch_us(CAST(ts AS TIMESTAMP))) / 1e6 / 86400.0, 6) AS age_days FROM events""")
def event_age(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", strict_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))))
    return events.select("event_id", F.round(days_between(instant(rules().reference), F.col("at")), 6).alias("age_days"))


@query(sql_features("SELECT review_id, language_script_consistent FROM flagged"))
def script_consistency(spark, sf_dir):
    base = reviews(spark, sf_dir).select("review_id", "language", normalized(F.col("review_title"), rules()).alias("t"), normalized(F.col("review_text"), rules()).alias("b"))
    both = F.trim(F.concat("t", F.lit(" "), "b"))
    return base.select("review_id", script_consistent(both, F.col("language"), rules()).alias("language_script_consistent"))


@query(sql_features("SELECT review_id, " + ", ".join(f"{t}_topic_signal" for t in TOPICS) + " FROM flagged"))
def topic_signals(spark, sf_dir):
    base = reviews(spark, sf_dir).select("review_id", normalized(F.col("review_title"), rules()).alias("t"), normalized(F.col("review_text"), rules()).alias("b"))
    base = base.select("review_id", F.trim(F.concat("t", F.lit(" "), "b")).alias("both"))
    return base.select("review_id", *[topic_signal(F.col("both"), t, rules()).alias(f"{t}_topic_signal") for t in TOPICS])


def _repeated(spark, sf_dir, scope):
    base = features.fingerprints(features.with_text(full(reviews(spark, sf_dir)), rules()), rules())
    return features.with_group_sizes(base, scope)


@query(sql_features("""SELECT review_id, body_print AS repeated_review_body_fingerprint,
  CASE WHEN body_print IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY language, body_print) END AS repeated_review_body_group_size,
  body_print IS NOT NULL AND count(*) OVER (PARTITION BY language, body_print) > 1 AS repeated_review_body FROM flagged"""))
def repeated_body(spark, sf_dir):
    """Scoped by source and language, where the driver's copies meet."""
    return _repeated(spark, sf_dir, ["__source", "__language"]).select("review_id", "repeated_review_body_fingerprint", "repeated_review_body_group_size", "repeated_review_body")


@query(sql_features("SELECT review_id, full_print AS repeated_full_content_fingerprint, repeated_full_content_group_size, repeated_full_content FROM flagged"))
def repeated_full(spark, sf_dir):
    return _repeated(spark, sf_dir, features.SCOPE).select("review_id", "repeated_full_content_fingerprint", "repeated_full_content_group_size", "repeated_full_content")


@query(sql_features("SELECT review_id, concat('item_id:', lower(item_id)) AS app_identifier, lower(country) AS country_key FROM flagged"))
def app_identifier(spark, sf_dir):
    return full(reviews(spark, sf_dir)).select("review_id", features.app_identifier().alias("app_identifier"), F.lower("country").alias("country_key"))


@query(sql_features(f"""SELECT source, app_name, item_id, review_id, language, country, {', '.join(n if 'age' not in n else f'round({n}, 6) AS {n}' for n in NUMERIC_COLUMNS)}, {', '.join(RATE_COLUMNS)},
  full_print AS repeated_full_content_fingerprint, body_print AS repeated_review_body_fingerprint, language_script_consistent, weak_sentiment_label, '1.1.0' AS feature_rule_version, '2026-07-07T00:00:00Z' AS feature_reference_timestamp FROM flagged"""))
def review_features(spark, sf_dir):
    """The whole feature frame, the columns that vary here."""
    names = ["source", "app_name", "item_id", "review_id", "language", "country", *NUMERIC_COLUMNS, *RATE_COLUMNS, "repeated_full_content_fingerprint", "repeated_review_body_fingerprint", "language_script_consistent", "weak_sentiment_label", "feature_rule_version", "feature_reference_timestamp"]
    return rounded(feature_frame(spark, sf_dir).select(*names), "review_age_days", "review_age_at_collection_days")


# Exploratory tables.


@query(sql_with(REPEATS) + f"SELECT {G}, count(*) AS review_count, count(DISTINCT review_id) AS unique_review_count, count(review_id) - count(DISTINCT review_id) AS duplicate_count FROM allrows GROUP BY {G}")
def review_volume(spark, sf_dir):
    return eda.review_volume(with_copies(spark, sf_dir, REPEATS))


@query(sql_with() + f"SELECT {G}, rating, count(*) AS review_count FROM reviews GROUP BY {G}, rating")
def rating_distribution(spark, sf_dir):
    return eda.rating_distribution(reviews(spark, sf_dir))


@query(sql_with() + f""", lengths AS (SELECT *, CAST(length(regexp_replace(coalesce(review_text, ''), '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')) AS BIGINT) AS n FROM reviews)
SELECT {G}, count(*) AS review_count, min(n) AS minimum_text_length, max(n) AS maximum_text_length, round(avg(n), 6) AS average_text_length, CAST(median(n) AS DOUBLE) AS median_text_length,
  CAST(count_if(n < 15 OR review_text IS NULL) AS BIGINT) AS low_signal_review_count, CAST(count_if(n = 0) AS BIGINT) AS empty_text_count, round(count_if(n < 15 OR review_text IS NULL) / count(*), 6) AS low_signal_rate
FROM lengths GROUP BY {G}""")
def text_length_stats(spark, sf_dir):
    return rounded(eda.text_length_stats(reviews(spark, sf_dir)), "average_text_length", "low_signal_rate")


@query(sql_with() + f"SELECT {G}, count(review_date) AS dated_review_count, CAST(count_if(review_date IS NULL) AS BIGINT) AS undated_review_count, min(review_date) AS earliest_review_date, max(review_date) AS latest_review_date FROM reviews GROUP BY {G}")
def date_coverage(spark, sf_dir):
    return eda.date_coverage(reviews(spark, sf_dir))


_HAVE = ["source", "app_name", "item_id", "review_id", "review_title", "review_text", "rating", "recommendation", "review_date", "country", "language", "collected_at", "raw_page_number"]
_ALL = features.REVIEW_COLUMNS


def _null_count(c: str) -> str:
    return f"count(*) - count({c})" if c in _HAVE else "count(*)"


@query(sql_with() + " UNION ALL ".join(f"SELECT {G}, '{c}' AS field, CAST({_null_count(c)} AS BIGINT) AS missing_count, round(({_null_count(c)}) / count(*), 6) AS missing_rate FROM reviews GROUP BY {G}" for c in _ALL))
def missing_fields(spark, sf_dir):
    return rounded(eda.missing_fields(full(reviews(spark, sf_dir))), "missing_rate")


@query(sql_with(COPIES) + "SELECT review_id, count(*) AS duplicate_count, string_agg(DISTINCT app_name, ', ' ORDER BY app_name) AS apps FROM allrows WHERE review_id IS NOT NULL GROUP BY review_id HAVING count(*) > 1")
def duplicate_records(spark, sf_dir):
    return eda.duplicate_records(with_copies(spark, sf_dir))


@query(sql_with(COPIES) + "SELECT review_id FROM allrows WHERE review_id IS NOT NULL GROUP BY review_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return eda.duplicate_ids(with_copies(spark, sf_dir))


@query(sql_with(COPIES) + "SELECT review_id FROM allrows WHERE review_id IS NOT NULL GROUP BY review_id HAVING count(*) > 1 ORDER BY review_id LIMIT 25")
def duplicate_id_sample(spark, sf_dir):
    """The ids that a summary names: a limit is the feature."""
    return eda.duplicate_id_sample(with_copies(spark, sf_dir))


@query(sql_with() + f"SELECT {G}, count(*) AS review_count, false AS language_detection_available, country AS region_storefront, 'The language is the one that was asked for; none is detected here.' AS issue_note FROM reviews GROUP BY {G}")
def language_notes(spark, sf_dir):
    return eda.language_notes(reviews(spark, sf_dir))


@query(sql_with() + f""", lengths AS (SELECT *, CAST(length(trim(coalesce(review_text, ''))) AS BIGINT) AS text_length FROM reviews)
SELECT {G}, review_id, rating, review_date, text_length, review_text FROM lengths WHERE text_length < 15 OR review_text IS NULL""")
def low_signal_reviews(spark, sf_dir):
    return eda.low_signal_reviews(reviews(spark, sf_dir))


# Quality.


@query(sql_with(REPEATS) + """SELECT app_name, count(*) AS total_rows, CASE WHEN count(review_id) = 0 THEN count(*) ELSE count(DISTINCT review_id) END AS unique_review_count,
  count(review_id) - count(DISTINCT review_id) AS duplicates_within_final_dataset, round((count(review_id) - count(DISTINCT review_id)) / count(*), 6) AS duplicate_percentage_within_final_dataset,
  CAST(count_if(trim(coalesce(review_text, '')) = '') AS BIGINT) AS empty_review_text_count, round(count_if(trim(coalesce(review_text, '')) = '') / count(*), 6) AS empty_review_text_percentage,
  CAST(count_if(rating IS NULL) AS BIGINT) AS missing_rating_count, CAST(count_if(review_date IS NULL) AS BIGINT) AS missing_date_count, CAST(count_if(review_id IS NULL) AS BIGINT) AS missing_review_id_count,
  round(avg(length(coalesce(review_text, ''))), 6) AS average_review_text_length, CAST(min(length(coalesce(review_text, ''))) AS BIGINT) AS minimum_review_text_length, CAST(max(length(coalesce(review_text, ''))) AS BIGINT) AS maximum_review_text_length
FROM allrows GROUP BY app_name""")
def quality_profile(spark, sf_dir):
    out = quality.profile(with_copies(spark, sf_dir, REPEATS), "app_name")
    return rounded(out, "duplicate_percentage_within_final_dataset", "empty_review_text_percentage", "average_review_text_length")


@query(sql_with() + " UNION ALL ".join(f"SELECT app_name, '{c}' AS field, round(1 - ({_null_count(c)}) / count(*), 6) AS completeness FROM reviews GROUP BY app_name" for c in _ALL))
def field_completeness(spark, sf_dir):
    return rounded(quality.completeness_long(full(reviews(spark, sf_dir)), "app_name"), "completeness")


# Each app of the view plays one of the four sources.
_PLAYED = "CASE CAST(replace(app_name, 'src', '') AS INT) % 4 WHEN 0 THEN 'steam' WHEN 1 THEN 'amazon' WHEN 2 THEN 'google_play' ELSE 'apple_app_store' END"


def _expected_sql(c: str) -> str:
    empty = "false" if c in _HAVE else "true"
    test = f"(count({c}) = 0)" if c in _HAVE else empty
    return f"CASE WHEN {test} THEN '{c}' END"


_EXPECTED = {
    "steam": "source item_id review_id review_text review_date recommendation author_id helpful_votes funny_votes playtime_forever playtime_at_review language".split(),
    "amazon": "source item_id review_id review_text review_date rating review_title author_name verified_purchase helpful_votes".split(),
    "google_play": "source app_name package_id review_id review_text rating review_date author_name helpful_votes app_version language country developer_response developer_response_date".split(),
    "apple_app_store": "source app_name item_id review_id review_title review_text rating review_date author_name helpful_votes app_version language country".split(),
}


@query(sql_with() + f", played AS (SELECT *, {_PLAYED} AS played FROM reviews) " + " UNION ALL ".join(
    f"SELECT app_name, concat_ws(',', {', '.join(_expected_sql(c) for c in names)}) AS missing_expected_fields FROM played WHERE played = '{s}' GROUP BY app_name" for s, names in _EXPECTED.items()))
def missing_expected_fields(spark, sf_dir):
    out = quality.missing_expected(full(reviews(spark, sf_dir)), "app_name", F.expr(_PLAYED))
    return out.withColumn("missing_expected_fields", F.array_join("missing_expected_fields", ","))


@query(sql_with() + "SELECT app_name, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') THEN '{c}' END" for c in sorted(_HAVE)) + ") AS available_metadata_fields FROM reviews GROUP BY app_name")
def available_fields(spark, sf_dir):
    out = quality.available_fields(full(reviews(spark, sf_dir)), "app_name")
    return out.withColumn("available_metadata_fields", F.array_join("available_metadata_fields", ","))


_REQUESTS = """SELECT event_type AS source, user_id, event_id, event_type <> 'error' AS success, value AS elapsed_seconds,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 404 WHEN event_id % 3 = 1 THEN 500 ELSE 403 END ELSE 200 END AS status_code,
  event_type = 'error' AND event_id % 3 = 2 AS blocked, event_id % 13 <> 0 AS parsed, CAST(event_id % 5 AS BIGINT) AS review_count,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS page FROM {events}"""


def requests(spark, sf_dir):
    return spark.sql(_REQUESTS, events=table(spark, sf_dir, "events"))


@query("WITH r AS (" + _REQUESTS.format(events="events") + """) SELECT source, count(*) AS request_count, CAST(count_if(success) AS BIGINT) AS successful_request_count, CAST(count_if(NOT success) AS BIGINT) AS failed_request_count,
  CAST(count_if(blocked) AS BIGINT) AS blocked_request_count, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS request_success_rate, round(avg(elapsed_seconds), 4) AS average_response_time FROM r GROUP BY source""")
def request_stats(spark, sf_dir):
    out = quality.request_stats(requests(spark, sf_dir)).drop("status_codes")
    return rounded(rounded(out, "request_success_rate"), "average_response_time", places=4)


# Feature validation.


@query(sql_features(" UNION ALL ".join(f"SELECT '{c}' AS flag, round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS rate FROM flagged" for c in RATE_COLUMNS)))
def overall_rates(spark, sf_dir):
    return rounded(report.overall_rates(feature_frame(spark, sf_dir)), "rate")


def _numeric_sql(c: str, metric: str, value: str, share: str) -> str:
    return f"SELECT {C}, count(*) AS row_count, '{metric}' AS metric, {value} AS value, count({c}) AS count, {share} AS rate, round(CAST(min({c}) AS DOUBLE), 6) AS minimum, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(CAST(avg({c}) AS DOUBLE), 6) AS mean, round(CAST(max({c}) AS DOUBLE), 6) AS maximum FROM flagged GROUP BY {C}"


_NULLS = "CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS maximum"
_DISTRIBUTIONS = [_numeric_sql(c, c, "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)") for c in NUMERIC_COLUMNS]
_DISTRIBUTIONS += [f"SELECT {C}, count(*), '{c}', 'true', CAST(count_if({c}) AS BIGINT), round(count_if({c}) / count(*), 6), {_NULLS} FROM flagged GROUP BY {C}" for c in RATE_COLUMNS]
_DISTRIBUTIONS.append(_numeric_sql("publication_year", "publication_time_coverage", "'valid'", "round(count(publication_year) / count(*), 6)"))
_DISTRIBUTIONS.append(f"SELECT {C}, CAST(sum(n) OVER (PARTITION BY {C}) AS BIGINT), 'rating_distribution', value, n, round(n / sum(n) OVER (PARTITION BY {C}), 6), {_NULLS} FROM (SELECT {C}, coalesce(CAST(rating AS VARCHAR), '<missing>') AS value, count(*) AS n FROM flagged GROUP BY {C}, rating)")


@query(sql_features(" UNION ALL ".join(_DISTRIBUTIONS)))
def feature_distributions(spark, sf_dir):
    return rounded(report.distributions(feature_frame(spark, sf_dir)), "rate", "minimum", "median", "mean", "maximum")


@query(sql_with(REPEATS) + "SELECT count(*) AS output_row_count, count(DISTINCT concat_ws('|', source, item_id, country, language, review_id)) AS unique_contextual_review_identity_count, count(*) - count(DISTINCT concat_ws('|', source, item_id, country, language, review_id)) AS duplicate_contextual_identity_count FROM allrows")
def identity_uniqueness(spark, sf_dir):
    return report.identity_uniqueness(with_copies(spark, sf_dir, REPEATS))


@query(sql_with() + f"SELECT {C}, count(*) AS row_count FROM reviews GROUP BY {C}")
def context_rows(spark, sf_dir):
    return report.contexts(reviews(spark, sf_dir))


@query("SELECT '1.1.0' AS versions, '2026-07-07T00:00:00Z' AS stamps")
def rule_versions(spark, sf_dir):
    out = report.versions(feature_frame(spark, sf_dir))
    return out.select(F.array_join("feature_rule_versions", ",").alias("versions"), F.array_join("feature_reference_timestamps", ",").alias("stamps"))


# The sample: strata one after the other (a recursive table of taken ranks), then classes in turn.
_RANK = "concat(sha256(concat_ws('|', coalesce(source, 'nan'), coalesce(app_name, 'nan'), coalesce(country, 'nan'), coalesce(review_id, 'nan'))), sha256(concat_ws('|', review_title, review_text, CAST(rating AS VARCHAR))))"


@query(sql_features(f"""SELECT review_id, row_number() OVER (ORDER BY {_RANK}) AS place, substr({_RANK}, 1, 64) AS stable_rank FROM flagged"""))
def stable_ranks(spark, sf_dir):
    """Places of all candidates: a global rank, so ranks are counted per slice first."""
    ranked = cut(sample.ranked(reviews(spark, sf_dir)).select("review_id", "__rank").withColumn("slice", F.substring("__rank", 1, 2)))
    before = ranked.groupBy("slice").count().withColumn("before", F.sum("count").over(Window.orderBy("slice")) - F.col("count"))  # at most 256 rows
    place = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("__rank"))
    return ranked.join(F.broadcast(before.drop("count")), "slice").select("review_id", place.cast("long").alias("place"), F.substring("__rank", 1, 64).alias("stable_rank"))


_VALUES, _FLAGS = ["weak_sentiment_label", "app_name", "country"], ["low_signal_text", "repeated_full_content", "repeated_review_body", *(f"{t}_topic_signal" for t in ("login", "payment", "performance", "subscription", "delivery", "customer_service"))]
_STRATA = [f"SELECT {i} AS f, {c} AS v, r FROM ranked WHERE {c} IS NOT NULL" for i, c in enumerate(_VALUES)]
_STRATA += [f"SELECT {len(_VALUES) + i}, 'true', r FROM ranked WHERE {c}" for i, c in enumerate(_FLAGS)]
_SAMPLE = f""", ranked AS (SELECT *, {_RANK} AS r FROM flagged),
rows AS ({" UNION ALL ".join(_STRATA)}),
strata AS (SELECT f, v, row_number() OVER (ORDER BY f, min(r)) AS n FROM rows GROUP BY f, v),
members AS (SELECT s.n, x.r FROM rows x JOIN strata s ON x.f = s.f AND x.v = s.v),
picks(n, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT p.n + 1, CASE WHEN min(m.r) IS NULL OR len(any_value(p.taken)) >= 135 THEN any_value(p.taken) ELSE list_append(any_value(p.taken), min(m.r)) END
  FROM picks p LEFT JOIN members m ON m.n = p.n + 1 AND NOT list_contains(p.taken, m.r)
  WHERE p.n < (SELECT max(n) FROM strata) GROUP BY p.n),
done AS (SELECT taken FROM picks WHERE n = (SELECT max(n) FROM strata)),
seeds AS (SELECT unnest(taken) AS r, generate_subscripts(taken, 1) - 1 AS o FROM done),
kinds AS (SELECT r, CASE weak_sentiment_label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 ELSE 3 END AS k FROM ranked WHERE r NOT IN (SELECT r FROM seeds)),
turns AS (SELECT r, k, row_number() OVER (PARTITION BY k ORDER BY r) AS t FROM kinds),
rest AS (SELECT r, (SELECT count(*) FROM seeds) + row_number() OVER (ORDER BY CASE WHEN k < 3 THEN 0 ELSE 1 END, t, k, r) - 1 AS o FROM turns),
chosen AS (SELECT r, o FROM seeds UNION ALL SELECT r, o FROM rest WHERE o < 135)
SELECT CAST(c.o AS BIGINT) AS sample_order, x.review_id, x.app_name, x.country, x.weak_sentiment_label FROM chosen c JOIN ranked x ON x.r = c.r"""


@query(sql_features(_SAMPLE).replace("WITH reviews AS", "WITH RECURSIVE reviews AS", 1))
def stable_sample(spark, sf_dir):
    out = sample.sample(feature_frame(spark, sf_dir))
    return out.select(F.col("__order").cast("long").alias("sample_order"), "review_id", "app_name", "country", "weak_sentiment_label")


@query(sql_features(f""", ranked AS (SELECT *, {_RANK} AS r FROM flagged WHERE body_print IS NOT NULL),
pairs AS (SELECT a.review_id, b.review_id AS peer, row_number() OVER (PARTITION BY a.r ORDER BY b.r) AS n FROM ranked a JOIN ranked b
  ON a.body_print = b.body_print AND lower(a.country) = lower(b.country) AND lower(a.language) = lower(b.language) AND lower(a.item_id) = lower(b.item_id) AND a.review_id <> b.review_id WHERE a.repeated_review_body)
SELECT review_id, peer AS repeated_review_body_example_review_id FROM pairs WHERE n = 1"""))
def duplicate_peers(spark, sf_dir):
    """Peers of all flagged rows by a window, since here they are more than a sample."""
    made = feature_frame(spark, sf_dir)
    keyed = sample.ranked(made.where("repeated_review_body"))
    keyed = cut(keyed.select("__rank", "review_id", "repeated_review_body_fingerprint", F.lower("country").alias("c"), F.lower("language").alias("l"), F.lower("item_id").alias("i")))
    group = ["repeated_review_body_fingerprint", "c", "l", "i"]
    best = keyed.groupBy(*group).agg(F.min(F.struct("__rank", "review_id")).alias("first"), F.min_by("review_id", "__rank").alias("first_id"))
    others = keyed.join(best, group)
    second = others.where(F.col("review_id") != F.col("first_id")).groupBy(*group).agg(F.min_by("review_id", "__rank").alias("second_id"))
    joined = others.join(second, group)
    peer = F.when(F.col("review_id") != F.col("first_id"), F.col("first_id")).otherwise(F.col("second_id"))
    return joined.select("review_id", peer.alias("repeated_review_body_example_review_id"))


# Collection.

_ARRIVALS = "SELECT review_id, app_name AS app, CAST(raw_page_number AS BIGINT) AS page, CAST(CAST(review_id AS BIGINT) AS BIGINT) AS seq FROM {reviews} UNION ALL SELECT CASE WHEN CAST(review_id AS BIGINT) % 30 = 0 THEN NULL ELSE review_id END, 'again', 1, CAST(review_id AS BIGINT) + 10000000 FROM {reviews} WHERE CAST(review_id AS BIGINT) % 10 = 0"


def arrivals(spark, sf_dir):
    return spark.sql(_ARRIVALS, reviews=reviews(spark, sf_dir))


def _sql_arrivals() -> str:
    return sql_with() + ", arrivals AS (" + _ARRIVALS.format(reviews="reviews") + ")"


@query(_sql_arrivals() + "SELECT review_id, app, seq, review_id IS NOT NULL AND row_number() OVER (PARTITION BY review_id ORDER BY seq) > 1 AS is_duplicate FROM arrivals")
def first_wins_dedup(spark, sf_dir):
    return collect.first_wins(arrivals(spark, sf_dir)).select("review_id", "app", "seq", "is_duplicate")


@query(_sql_arrivals() + """, kept AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY seq) AS nth FROM arrivals),
capped AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY seq) AS n FROM kept WHERE nth = 1 OR review_id IS NULL)
SELECT review_id, app, seq FROM capped WHERE n <= 20""")
def capped_targets(spark, sf_dir):
    return collect.capped(collect.accepted(arrivals(spark, sf_dir)), 20, ["app"]).select("review_id", "app", "seq")


@query(_sql_arrivals() + "SELECT review_id, app, seq FROM arrivals a WHERE review_id IS NULL OR review_id NOT IN (SELECT review_id FROM reviews WHERE CAST(review_id AS BIGINT) % 3 = 0)")
def unseen_reviews(spark, sf_dir):
    history = reviews(spark, sf_dir).where("CAST(review_id AS BIGINT) % 3 = 0")
    return collect.unseen(arrivals(spark, sf_dir), history).select("review_id", "app", "seq")


_RUNS = "SELECT review_id, app_name AS app, 1 AS run FROM {reviews} WHERE CAST(review_id AS BIGINT) % 3 <> 0 UNION ALL SELECT review_id, app_name, 2 FROM {reviews} WHERE CAST(review_id AS BIGINT) % 5 <> 0"


def runs(spark, sf_dir):
    return spark.sql(_RUNS, reviews=reviews(spark, sf_dir))


_SQL_RUNS = sql_with() + ", runs AS (" + _RUNS.format(reviews="reviews") + ") "


@query(_SQL_RUNS + "SELECT app, review_id FROM runs GROUP BY app, review_id HAVING count(DISTINCT run) = 2")
def cross_run_overlap(spark, sf_dir):
    return collect.run_overlap(runs(spark, sf_dir), ["app"])


@query(_SQL_RUNS + "SELECT count(DISTINCT review_id) AS new_records_in_second_run FROM runs WHERE run = 2 AND review_id NOT IN (SELECT review_id FROM runs WHERE run = 1)")
def new_in_second_run(spark, sf_dir):
    return collect.new_in_second_run(runs(spark, sf_dir))


@query(_SQL_RUNS + """, shared AS (SELECT review_id FROM runs GROUP BY review_id HAVING count(DISTINCT run) = 2)
SELECT CAST(2 AS BIGINT) AS runs, true AS repeated_collection_demonstrated, (SELECT count(*) FROM shared) AS overlap_count, round((SELECT count(*) FROM shared) / (SELECT count(DISTINCT review_id) FROM runs), 6) AS overlap_rate""")
def repeatability(spark, sf_dir):
    return rounded(collect.repeatability(runs(spark, sf_dir)), "overlap_rate")


@query(_SQL_RUNS + """, shared AS (SELECT app, review_id FROM runs GROUP BY app, review_id HAVING count(DISTINCT run) = 2),
fresh AS (SELECT DISTINCT app, review_id FROM runs WHERE run = 2 EXCEPT SELECT app, review_id FROM runs WHERE run = 1),
sizes AS (SELECT app, CAST(count(DISTINCT run) AS BIGINT) AS runs, count(DISTINCT review_id) AS distinct_ids FROM runs GROUP BY app)
SELECT app, runs, runs >= 2 AS repeated_collection_demonstrated, (SELECT count(*) FROM shared x WHERE x.app = s.app) AS overlap_count, distinct_ids, round((SELECT count(*) FROM shared x WHERE x.app = s.app) / distinct_ids, 6) AS overlap_rate,
 CASE WHEN runs >= 2 THEN (SELECT count(*) FROM fresh x WHERE x.app = s.app) END AS new_records_in_second_run FROM sizes s""")
def run_bitmap_overlap(spark, sf_dir):
    """Overlaps of each app's runs from stored bitmaps, which two landings were merged into."""
    rows, late = runs(spark, sf_dir), "CAST(review_id AS BIGINT) % 7 < 3 AND run = 2"
    root = f"{shared_folder(spark)}/bitmaps-{uuid.uuid4().hex}"
    early, later = rows.where(f"NOT ({late})"), rows.where(late)
    run_bitmaps.coded(early).write.parquet(f"{root}/codes-1")
    codes = spark.read.parquet(f"{root}/codes-1")
    run_bitmaps.bitmaps(early, codes, ["app"]).write.parquet(f"{root}/runs-1")
    run_bitmaps.coded(later, codes).write.parquet(f"{root}/codes-2")
    more = run_bitmaps.bitmaps(later, spark.read.parquet(f"{root}/codes-2"), ["app"])
    run_bitmaps.merged(spark.read.parquet(f"{root}/runs-1"), more, ["app"]).write.parquet(f"{root}/runs-2")
    return rounded(run_bitmaps.overlap(spark.read.parquet(f"{root}/runs-2"), ["app"]), "overlap_rate")


@query(_sql_arrivals() + "SELECT review_id, app, seq FROM arrivals a WHERE review_id IS NULL OR review_id NOT IN (SELECT review_id FROM reviews WHERE CAST(review_id AS BIGINT) % 3 = 0 OR CAST(review_id AS BIGINT) % 5 = 1)")
def unseen_in_history(spark, sf_dir):
    """Arrivals that a bucketed history, written by two runs, does not hold."""
    name = f"history_{uuid.uuid4().hex}"
    path, base = f"{shared_folder(spark)}/{name}", reviews(spark, sf_dir)
    for part in ("CAST(review_id AS BIGINT) % 3 = 0", "CAST(review_id AS BIGINT) % 3 = 0 OR CAST(review_id AS BIGINT) % 5 = 1"):
        history.remember(base.where(part), name, path, 8)
    return history.unseen(arrivals(spark, sf_dir), name).select("review_id", "app", "seq")


_PAGED = "SELECT 'all' AS app, CAST(raw_page_number AS BIGINT) AS raw_page_number, review_id FROM {reviews} UNION ALL SELECT 'all', CAST(raw_page_number AS BIGINT) + 1, review_id FROM {reviews} WHERE CAST(review_id AS BIGINT) % 97 = 0"


@query(sql_with() + ", paged AS (" + _PAGED.format(reviews="reviews") + """), pages AS (SELECT app, raw_page_number, count(*) AS review_count, list_sort(list_distinct(list(review_id))) AS ids FROM paged GROUP BY app, raw_page_number),
prior AS (SELECT *, lag(ids) OVER (PARTITION BY app ORDER BY raw_page_number) AS p FROM pages)
SELECT app, raw_page_number, review_count, CAST(coalesce(len(list_intersect(ids, p)), 0) AS BIGINT) AS overlap_with_previous, CASE WHEN len(p) > 0 THEN len(list_intersect(ids, p)) = 0 END AS distinct_from_previous FROM prior""")
def page_disjointness(spark, sf_dir):
    return collect.page_ids(spark.sql(_PAGED, reviews=reviews(spark, sf_dir)), ["app"]).drop("ids")


@query(sql_with() + """, pages AS (SELECT app_name AS app, CAST(raw_page_number AS BIGINT) AS n, count(*) AS c FROM reviews GROUP BY 1, 2) SELECT app, bool_or(n > 1 AND c > 0 AND n > f) AS pagination_demonstrated FROM (SELECT *, min(n) OVER (PARTITION BY app) AS f FROM pages) GROUP BY app""")
def pagination_shown(spark, sf_dir):
    """Ids are unique here, so every later page is distinct from the one before."""
    rows = reviews(spark, sf_dir).withColumn("app", F.col("app_name"))
    return collect.pagination_shown(collect.page_ids(rows, ["app"]), ["app"])


_CURSORS = "SELECT CAST(user_id AS BIGINT) AS app, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'same' ELSE CAST(event_id % 3 AS VARCHAR(8)) END AS response_cursor, CAST(event_id % 4 AS VARCHAR(8)) AS request_cursor, CAST(event_id % 5 AS BIGINT) AS review_count FROM {events}"


@query("WITH c AS (" + _CURSORS.format(events="events") + """), p AS (SELECT *, lag(response_cursor) OVER (PARTITION BY app ORDER BY seq) AS previous_cursor, sum(review_count) OVER (PARTITION BY app ORDER BY seq) AS total FROM c)
SELECT app, seq, previous_cursor, CASE WHEN previous_cursor IS NOT NULL THEN response_cursor <> previous_cursor END AS cursor_changed, coalesce(response_cursor = request_cursor OR response_cursor = previous_cursor, false) AS cursor_stuck,
 CASE WHEN review_count = 0 THEN 'empty_page' WHEN coalesce(response_cursor = request_cursor OR response_cursor = previous_cursor, false) THEN 'cursor_stuck' WHEN total >= 20 THEN 'cap' END AS stop_reason FROM p""")
def cursor_progress(spark, sf_dir):
    return collect.stops(spark.sql(_CURSORS, events=table(spark, sf_dir, "events")), ["app"], 20).select("app", "seq", "previous_cursor", "cursor_changed", "cursor_stuck", "stop_reason")


_STATUS = "CASE WHEN NOT success AND page > 1 AND status_code IN (400, 404) THEN 'pagination_limit_or_unavailable_page' WHEN NOT success THEN 'request_failed' WHEN NOT parsed THEN 'json_parse_error' WHEN review_count = 0 THEN 'empty_page' ELSE 'ok' END"
_SQL_STATUS = "WITH r AS (" + _REQUESTS.format(events="events") + f"), s AS (SELECT *, {_STATUS} AS status FROM r) "


@query(_SQL_STATUS + "SELECT event_id, user_id, page, status FROM s")
def page_status(spark, sf_dir):
    return collect.page_status(requests(spark, sf_dir)).select("event_id", "user_id", "page", "status")


@query(_SQL_STATUS + """SELECT user_id, CASE WHEN bool_or(status = 'pagination_limit_or_unavailable_page') THEN 'page_depth_limited' WHEN bool_or(status = 'request_failed') THEN 'requests_failed'
 WHEN bool_or(status = 'json_parse_error') THEN 'parse_errors' WHEN bool_or(status = 'empty_page') THEN 'empty_pages' ELSE 'targets_exhausted' END AS shortfall_reason FROM s GROUP BY user_id""")
def shortfall_reason(spark, sf_dir):
    return collect.shortfall(collect.page_status(requests(spark, sf_dir)), ["user_id"])


@query(sql_with() + ", targets AS (SELECT DISTINCT app_name FROM reviews UNION SELECT r_name FROM region) SELECT t.app_name, count(r.review_id) AS review_count, 'target_limit_not_reached' AS status FROM targets t LEFT JOIN reviews r ON t.app_name = r.app_name GROUP BY t.app_name HAVING count(r.review_id) < 50")
def unreached_targets(spark, sf_dir):
    """All apps and, with no review at all, the regions."""
    got = reviews(spark, sf_dir)
    targets = got.select("app_name").union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return collect.unreached_targets(targets, got, 50, ["app_name"])


#: Every review in its own app and, two thirds of them, in others that come before or after; the second run reads backwards.
_OFFERED = """SELECT review_id, CAST(CAST(substr(app_name, 4) AS INT) AS BIGINT) AS a, page, id FROM base
UNION ALL SELECT review_id, (id * 7 + 3) % 20, page, id FROM base WHERE id % 3 <> 0
UNION ALL SELECT CASE WHEN id % 30 = 1 THEN NULL ELSE review_id END, (id * 3 + 11) % 20, page, id FROM base WHERE id % 3 = 1"""
_OFFERS_BASE = "SELECT review_id, app_name, CAST(raw_page_number AS BIGINT) AS page, CAST(review_id AS BIGINT) AS id FROM {reviews}"
_OFFERS = """SELECT review_id, concat('app', CAST(a AS VARCHAR(4))) AS app, run, page,
 CAST(2 * a + run AS BIGINT) * 1000000000 + CASE WHEN run = 1 THEN id ELSE 500000000 - id END AS seq
FROM offered CROSS JOIN (VALUES (1), (2)) t(run)"""


@query(sql_with().replace("WITH", "WITH RECURSIVE", 1) + ", base AS (" + _OFFERS_BASE.format(reviews="reviews") + "), offered AS (" + _OFFERED + "), listed AS (" + _OFFERS + """),
arrived AS (SELECT DISTINCT * FROM listed),
marked AS (SELECT *, CASE WHEN review_id IS NOT NULL AND row_number() OVER (PARTITION BY app, run, review_id ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM arrived),
read AS (SELECT * FROM (SELECT *, coalesce(sum(new) OVER (PARTITION BY app, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM marked) WHERE seen < 10),
turns AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM read),
greedy(n, seen, held, ok) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false
  UNION ALL
  SELECT t.n, CASE WHEN fits AND t.review_id IS NOT NULL THEN list_append(g.seen, t.review_id) ELSE g.seen END,
    CASE WHEN fits AND t.review_id IS NOT NULL THEN list_append(g.held, t.app) ELSE g.held END, fits
  FROM (SELECT g.*, t.review_id, t.app, t.n AS tn,
      len(list_filter(g.held, lambda x: x = t.app)) < 10 AND (t.review_id IS NULL OR NOT list_contains(g.seen, t.review_id)) AS fits
    FROM greedy g JOIN turns t ON t.n = g.n + 1) g JOIN turns t ON t.n = g.tn)
SELECT t.review_id, t.app, CAST(t.run AS INT) AS run, t.page, CAST(t.seq AS BIGINT) AS seq FROM greedy g JOIN turns t ON t.n = g.n WHERE g.ok""")
def steam_collection(spark, sf_dir):
    """Two runs over every app with a cap of ten, one app after the other.

    Ids are read by up to three apps, and the runs of an app read different ids, so apps fill
    and pass ids on to later ones. The SQL takes them one by one in the order of arrival.
    """
    base = spark.sql(_OFFERS_BASE, reviews=reviews(spark, sf_dir))
    offered = spark.sql(_OFFERED.replace("FROM base", "FROM {base}"), base=base)
    rows = spark.sql(_OFFERS.replace("FROM offered", "FROM {offered}"), offered=offered).distinct()
    return collect.steam_collect(rows, 10).select("review_id", "app", "run", "page", "seq")


@query(sql_with() + "SELECT DISTINCT source, review_id FROM reviews")
def incremental_dedup(spark, sf_dir):
    """The view as a stream of landed files, with repeats, read up to what is there now."""
    root = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    rows = with_copies(spark, sf_dir, REPEATS).select("source", "review_id", "review_date")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    dedup.ingest(stream, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("source", "review_id")


#: Two landings of the arrivals: the reviews, and after them their repeats with some that are new.
_FIRST_LANDING, _SECOND_LANDING = "CAST(seq AS BIGINT) % 4 <> 1 AND app <> 'again'", "NOT (CAST(seq AS BIGINT) % 4 <> 1 AND app <> 'again')"


def in_two_runs(spark, rows, made) -> DataFrame:
    """What a stream writes that reads one landing, stops, and goes on when the other has come."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for landing in (_FIRST_LANDING, _SECOND_LANDING):
        rows.where(landing).write.mode("append").parquet(f"{root}/in")
        acceptance.run(made(spark.readStream.schema(rows.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


@query(_sql_arrivals() + f""", landed AS (SELECT *, CASE WHEN {_FIRST_LANDING} THEN 1 ELSE 2 END AS landing FROM arrivals),
told AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY landing, seq) AS n, first_value(seq) OVER (PARTITION BY review_id ORDER BY landing, seq) AS s, first_value(page) OVER (PARTITION BY review_id ORDER BY landing, seq) AS p FROM landed)
SELECT review_id, app, page, seq, review_id IS NOT NULL AND n > 1 AS is_repeat, CASE WHEN review_id IS NULL THEN seq ELSE s END AS first_seq, CASE WHEN review_id IS NULL THEN page ELSE p END AS first_page, CASE WHEN review_id IS NULL THEN 1 ELSE n END AS arrival FROM told""")
def recorded_repeats(spark, sf_dir):
    """Accepted rows and recorded repeats of a stream that ran twice."""
    return in_two_runs(spark, arrivals(spark, sf_dir), lambda stream: acceptance.with_repeats(stream, ["review_id"]))


@query(_sql_arrivals() + f""", landed AS (SELECT *, CASE WHEN {_FIRST_LANDING} THEN 1 ELSE 2 END AS landing FROM arrivals),
told AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY landing, seq) AS n FROM landed)
SELECT review_id, app, page, seq FROM told WHERE n <= 40""")
def streamed_caps(spark, sf_dir):
    """Forty rows an app over two runs: the second adds what the first left open."""
    return in_two_runs(spark, arrivals(spark, sf_dir), lambda stream: acceptance.within_caps(stream, ["app"], 40))


# Annotations: a sheet as annotators might have filled it.

_SHEET = """SELECT review_id, CASE WHEN rating BETWEEN 1 AND 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS weak_sentiment_label,
 CASE CAST(review_id AS BIGINT) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS human_sentiment,
 CASE WHEN CAST(review_id AS BIGINT) % 4 = 0 THEN 'no' ELSE 'Yes ' END AS sentiment_agreement, CASE WHEN CAST(review_id AS BIGINT) % 5 = 0 THEN 'yes' ELSE 'no' END AS mixed_or_unclear,
 CASE WHEN CAST(review_id AS BIGINT) % 6 = 0 THEN 'login=relevant; payment=irrelevant' WHEN CAST(review_id AS BIGINT) % 6 = 1 THEN 'login=relevant' ELSE '' END AS topic_signal_relevance,
 CAST(review_id AS BIGINT) % 7 = 0 AS repeated_review_body, CASE WHEN CAST(review_id AS BIGINT) % 14 = 0 THEN 'yes' ELSE 'no' END AS review_body_duplication_judgment
FROM {reviews} WHERE rating IS NOT NULL"""
_SQL_SHEET = sql_with() + ", sheet AS (" + _SHEET.format(reviews="reviews") + ") "


def sheet(spark, sf_dir):
    return spark.sql(_SHEET, reviews=reviews(spark, sf_dir))


@query(_SQL_SHEET + "SELECT coalesce(weak_sentiment_label, 'Overall') AS weak_sentiment_label, count(*) AS reviews, CAST(count_if(lower(trim(sentiment_agreement)) = 'yes') AS BIGINT) AS agreements, round(count_if(lower(trim(sentiment_agreement)) = 'yes') / count(*), 6) AS agreement_rate FROM sheet GROUP BY ROLLUP (weak_sentiment_label)")
def annotation_agreement(spark, sf_dir):
    return rounded(annotation.agreement(sheet(spark, sf_dir)), "agreement_rate")


@query(_SQL_SHEET + "SELECT weak_sentiment_label, CAST(count_if(human_sentiment = 'negative') AS BIGINT) AS negative, CAST(count_if(human_sentiment = 'neutral') AS BIGINT) AS neutral, CAST(count_if(human_sentiment = 'positive') AS BIGINT) AS positive FROM sheet GROUP BY 1")
def label_crosstab(spark, sf_dir):
    return annotation.crosstab(sheet(spark, sf_dir))


@query(_SQL_SHEET + "SELECT count(*) AS reviews, CAST(count_if(mixed_or_unclear = 'yes') AS BIGINT) AS mixed_or_unclear, round(count_if(mixed_or_unclear = 'yes') / count(*), 6) AS mixed_or_unclear_rate FROM sheet")
def unclear_rate(spark, sf_dir):
    return rounded(annotation.unclear_rate(sheet(spark, sf_dir)), "mixed_or_unclear_rate")


@query(_SQL_SHEET + ", e AS (SELECT trim(unnest(string_split(topic_signal_relevance, ';'))) AS entry FROM sheet) SELECT split_part(entry, '=', 1) AS signal, split_part(entry, '=', 2) AS judgement, count(*) AS activations FROM e WHERE entry <> '' GROUP BY 1, 2")
def topic_relevance(spark, sf_dir):
    return annotation.topic_relevance(sheet(spark, sf_dir))


@query(_SQL_SHEET + "SELECT count(*) AS flagged, CAST(count_if(review_body_duplication_judgment = 'yes') AS BIGINT) AS confirmed FROM sheet WHERE repeated_review_body")
def duplication_confirmed(spark, sf_dir):
    return annotation.duplication_confirmed(sheet(spark, sf_dir), "repeated_review_body", "review_body_duplication_judgment")


# Parsers: payloads are built from the documents, so the SQL knows what must come out.


def _payload(spark, sf_dir, built) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.to_json(built).alias("payload"), F.lit("app").alias("app_name"), F.lit("77").alias("app_id"), F.lit("pkg").alias("package_id"), F.lit("us").alias("country"), F.lit("en").alias("language"), F.lit("http://x/?a=1").alias("source_url"), F.col("doc_id").alias("page"), F.lit("*").alias("cursor"))


def label(col):
    return F.struct(col.cast("string").alias("label"))


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, nullif(text, '') AS review_text, CAST(1 + doc_id % 5 AS DOUBLE) AS rating, CAST(doc_id % 9 AS BIGINT) AS helpful_votes, doc_id AS raw_page_number, 'apple_app_store' AS source, '77' AS item_id FROM documents WHERE doc_id % 3 <> 0")
def apple_entries(spark, sf_dir):
    """A page per document; every third is app metadata without a rating."""
    d = F.col("doc_id")
    entry = F.struct(label(d).alias("id"), label(F.col("text")).alias("content"), F.when(d % 3 != 0, label(1 + d % 5)).alias("im:rating"), label(d % 9).alias("im:voteSum"), F.struct(label(F.lit("me")).alias("name")).alias("author"))
    pages = _payload(spark, sf_dir, F.struct(F.struct(F.array(entry).alias("entry")).alias("feed")))
    return parse_json.apple(pages).select("review_id", "review_text", "rating", "helpful_votes", "raw_page_number", "source", "item_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, text AS review_text, CAST(doc_id % 9 AS BIGINT) AS helpful_votes, doc_id % 2 = 0 AS recommendation, CAST(1000000 + doc_id AS VARCHAR) AS review_date, '5' AS author_id, lang AS language, '*' AS raw_cursor FROM documents")
def steam_reviews(spark, sf_dir):
    d = F.col("doc_id")
    record = F.struct(d.cast("string").alias("recommendationid"), F.col("lang").alias("language"), F.col("text").alias("review"), (d + 1000000).alias("timestamp_created"), (d % 2 == 0).alias("voted_up"), (d % 9).alias("votes_up"), F.struct(F.lit("5").alias("steamid")).alias("author"))
    pages = _payload(spark, sf_dir, F.struct(F.lit("c").alias("cursor"), F.array(record).alias("reviews")))
    return parse_json.steam(pages).select("review_id", "review_text", "helpful_votes", "recommendation", "review_date", "author_id", "language", "raw_cursor")


@query("SELECT CAST(doc_id AS VARCHAR) AS review_id, nullif(text, '') AS review_text, CAST(1 + doc_id % 5 AS DOUBLE) AS rating, CAST(doc_id % 9 AS BIGINT) AS helpful_votes, 'pkg' AS package_id, 'pkg' AS item_id FROM documents")
def google_reviews(spark, sf_dir):
    d = F.col("doc_id")
    record = F.struct(d.cast("string").alias("reviewId"), F.col("text").alias("content"), (1 + d % 5).alias("score"), (d % 9).alias("thumbsUpCount"), F.lit("").alias("replyContent"))
    return parse_json.google_play(_payload(spark, sf_dir, F.array(record))).select("review_id", "review_text", "rating", "helpful_votes", "package_id", "item_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:long>")["k"].alias("k"))


@query("SELECT page_id, regexp_replace(url, '\\?.*$', '?...') AS url FROM pages")
def url_scrub(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parse_fields.scrub_url(F.col("url")).alias("url"))


_PHRASES = " OR ".join(f"contains(lower(html), '{p}')" for p in ("captcha", "robot check", "enter the characters you see below", "access denied", "sorry, we just need to make sure you''re not a robot", "/ap/signin", "validatecaptcha"))


@query(f"SELECT page_id, {_PHRASES} OR trim(html) = '' OR CASE WHEN page_id % 10 = 0 THEN 403 ELSE 200 END IN (401, 403, 429) AS blocked FROM pages")
def block_detection(spark, sf_dir):
    status = F.when(F.col("page_id") % 10 == 0, 403).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", parse_fields.is_blocked(F.col("html"), status).alias("blocked"))


@query("""WITH t AS (SELECT page_id, concat(CAST(page_id % 6 AS VARCHAR), '.5 out of 5 stars') AS stars, CASE page_id % 3 WHEN 0 THEN 'One person found this helpful' WHEN 1 THEN concat(CAST(1 + page_id % 5 AS VARCHAR), ',', lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0'), ' people') ELSE '' END AS votes FROM pages)
SELECT page_id, try_cast(regexp_extract(stars, '([0-5](?:\\.\\d+)?)\\s+out of\\s+5', 1) AS DOUBLE) AS rating, CAST(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN (1 + page_id % 5) * 1000 + page_id % 1000 ELSE 0 END AS BIGINT) AS helpful_votes, 'B00TTD9BRC' AS item_id FROM t""")
def capture_fields(spark, sf_dir):
    d = F.col("page_id")
    votes = F.when(d % 3 == 0, "One person found this helpful").when(d % 3 == 1, F.concat((1 + d % 5).cast("string"), F.lit(","), F.lpad((d % 1000).cast("string"), 3, "0"), F.lit(" people"))).otherwise("")
    stars = F.concat((d % 6).cast("string"), F.lit(".5 out of 5 stars"))
    return table(spark, sf_dir, "pages").select("page_id", parse_fields.star_rating(stars).alias("rating"), parse_fields.helpful_votes(votes, True).alias("helpful_votes"), parse_fields.item_id(F.lit("https://h/dp/B00TTD9BRC/x")).alias("item_id"))


@query("SELECT CAST(page_id AS VARCHAR) AS review_id, regexp_extract(html, '<title>([^<&]*)', 1) AS t, CAST(page_id % 6 AS DOUBLE) AS rating, true AS verified_purchase, CAST(0 AS BIGINT) AS helpful_votes FROM pages".replace("regexp_extract(html, '<title>([^<&]*)', 1) AS t", "nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<&]*)', 1), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')), '') AS review_title"))
def html_review_rows(spark, sf_dir):
    """A capture per page, built around its title."""
    title = F.regexp_extract("html", "<title>([^<&]*)", 1)
    built = F.concat(F.lit("<div id='customer_review-"), F.col("page_id").cast("string"), F.lit("' data-hook='review'><a data-hook='review-title'><span>"), title, F.lit("</span></a><i data-hook='review-star-rating'>"), (F.col("page_id") % 6).cast("string"), F.lit(".0 out of 5 stars</i><span data-hook='avp-badge'>Verified</span></div>"))
    pages = table(spark, sf_dir, "pages").select(built.alias("payload"))
    return html_reviews.reviews(pages).select("review_id", "review_title", "rating", "verified_purchase", "helpful_votes")


assert set(FEATURE_COLUMNS) >= set(RATE_COLUMNS)
