import hashlib
import json
import re
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur import rules as rule_files
from larkspur.functions import casefolded, is_present, normalized, safe_double, strict_timestamp, topic_signal, weak_sentiment
from larkspur.functions.text import PLAIN, is_plain, normalizer
from larkspur.operators import features
from larkspur.schema import FEATURE_COLUMNS, text_schema
from larkspur.sources import files, sinks

from .cases import REVIEWS, TWINS, review


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([tuple(r.values()) for r in REVIEWS], text_schema())


@pytest.fixture(scope="module")
def made(frame):
    return {r["review_id"]: r for r in features.generate(frame).collect()}


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_columns_and_rows(frame):
    out = features.generate(frame)
    assert out.columns == FEATURE_COLUMNS and len(FEATURE_COLUMNS) == 64 and out.count() == len(REVIEWS)


def test_text_features(made):
    clean = "the password mail never came"
    assert (made["twin"]["review_text_character_count"], made["twin"]["review_text_word_count"]) == (len(clean), 5)
    assert made["twin"]["review_text"] == TWINS[0] and not made["twin"]["low_signal_text"]
    blank = made["nothing"]
    assert blank["missing_review_text"] and blank["missing_title"] and blank["low_signal_text"] and not blank["has_title"] and blank["review_text_character_count"] == 0
    assert made["wide"]["title_character_count"] == len("masse")
    assert made["wide"]["review_text_word_count"] == 6  # tides, 1, isn't, flagged, billingsgate, is


def test_time_features(made):
    twin = made["twin"]
    assert (twin["publication_year"], twin["publication_month"], twin["publication_day_of_week"]) == (2026, 6, "Saturday")
    assert twin["review_age_days"] == 9.75 and twin["review_age_at_collection_days"] == 2.5
    gone = made["impossible day"]
    assert gone["publication_year"] is None and gone["publication_timestamp_missing_or_invalid"] and not gone["missing_publication_timestamp"]
    assert made["three topics"]["review_age_days"] == pytest.approx(9 / 24) and made["three topics"]["publication_day_of_week"] == "Monday"  # 15:00 the day before, in UTC
    assert made["nothing"]["missing_publication_timestamp"] and made["nothing"]["publication_timestamp_missing_or_invalid"]
    assert made["greek"]["review_age_days"] == -2.5 and made["greek"]["review_age_at_collection_days"] == pytest.approx(1.5 / 24)
    assert made["wide"]["publication_timestamp_missing_or_invalid"]


def test_repetition(made):
    body = hashlib.sha256(b"the password mail never came").hexdigest()
    for r, title in (("twin", b"locked"), ("other twin", b"still locked")):
        assert made[r]["repeated_review_body"] and made[r]["repeated_review_body_group_size"] == 2 and made[r]["repeated_review_body_fingerprint"] == body
        assert not made[r]["repeated_full_content"] and made[r]["repeated_full_content_group_size"] == 1
        assert made[r]["repeated_full_content_fingerprint"] == hashlib.sha256(title + b"\nthe password mail never came").hexdigest()
    assert made["nothing"]["repeated_review_body_group_size"] == 0 and made["nothing"]["repeated_review_body_fingerprint"] is None


def test_repetition_scope(spark):
    rows = [review("s1", review_text="same"), review("s2", review_text="SAME "), review("s3", review_text="same", country="fj"), review("s4", review_text="same", item_id=None, app_name=" HARBOUR")]
    out = {r["review_id"]: r["repeated_review_body_group_size"] for r in features.generate(spark.createDataFrame([tuple(r.values()) for r in rows], text_schema())).collect()}
    assert out == {"s1": 2, "s2": 2, "s3": 1, "s4": 1}


def test_topics_script_and_labels(made):
    def topics(r):
        return {t for t in ("login", "payment", "performance", "subscription", "delivery", "customer_service") if made[r][f"{t}_topic_signal"]}

    assert topics("twin") == topics("other twin") == {"login"} and topics("impossible day") == {"performance"}
    assert topics("three topics") == {"payment", "subscription", "customer_service"}
    assert topics("wide") == topics("nothing") == set()  # billingsgate is not billing, flagged no lag
    assert [made[r]["language_script_consistent"] for r in ("twin", "nothing", "greek", "wide")] == [True, None, False, True]
    labels = {"twin": "negative", "impossible day": "neutral", "three topics": "positive", "nothing": None, "greek": "positive", "wide": None}
    assert {r: made[r]["weak_sentiment_label"] for r in labels} == labels
    assert made["other twin"]["has_developer_reply"] and made["other twin"]["has_app_version"] and not made["twin"]["has_developer_reply"] and not made["twin"]["has_app_version"]


def test_keywords_are_whole_tokens(spark):
    rules = rule_files.check(json.loads(json.dumps(rule_files.DEFAULT)) | {"topic_signal_keywords": rule_files.DEFAULT["topic_signal_keywords"] | {"login": ["log"]}})
    for text, want in (("catalog", False), ("cataloging works", False), ("a log!", True), ("log", True), ("_log", False), ("blog log2", False)):
        assert one(spark, text, lambda c: topic_signal(c, "login", rules)) is want


@pytest.mark.parametrize(("text", "want"), [(None, False), ("", False), ("   ", False), ("\x1c\x1f", False), ("x", True), ("NaN", False)])
def test_presence(spark, text, want):
    assert one(spark, text, is_present) is want


@pytest.mark.parametrize("text", ["  A  b\x1cC ", "Straße ﬁ ①", "plain ASCII \t text", "İstanbul", "　x"])
def test_normalisation_is_pythons(spark, text):
    import unicodedata

    assert one(spark, text, lambda c: normalized(c, rule_files.default())) == " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-07-05T00:00:00Z", "2026-07-05 00:00:00"), (" 2026-07-05 10:30+02:00 ", "2026-07-05 08:30:00"), ("2026-07-05T10:30:00.25-0700", "2026-07-05 17:30:00.25"), ("2026-07-05T10:30:00", None), ("2026-07-05", None), ("July 5", None), ("1767225600", None), ("2026-02-30T00:00:00Z", None)],
)
def test_strict_timestamps(spark, text, want):
    got = one(spark, text, lambda c: strict_timestamp(c).cast("string"))
    assert got == want


def test_numbers_and_labels(spark):
    for text, want in (("4", 4.0), (" 4.5 ", 4.5), ("4f", None), ("nan", None), ("1e1", 10.0), ("", None), (None, None)):
        assert one(spark, text, safe_double) == want
    for text, want in (("0", None), ("2", "negative"), ("2.5", None), ("3.0", "neutral"), ("4", "positive"), ("6", None), ("x", None)):
        assert one(spark, text, weak_sentiment) == want


def test_rules_are_checked(tmp_path):
    good = json.loads(json.dumps(rule_files.DEFAULT))
    file = tmp_path / "rules.yaml"
    import yaml

    file.write_text(yaml.safe_dump(good, allow_unicode=True), encoding="utf-8")
    assert rule_files.load(file).version == "1.1.0" and rule_files.load(file).reference_text == "2026-07-07T00:00:00Z"
    bad = [
        {"rule_version": " "},
        {"reference_timestamp": "2026-07-07T00:00:00"},
        {"text_normalization": {"unicode_form": "NFD"}},
        {"word_count": {"pattern": "("}},
        {"low_signal": {"minimum_review_text_characters": -1, "minimum_review_text_words": 3}},
        {"repeated_content": {"scope": ["source"], "fingerprint_algorithm": "sha256"}},
        {"missing_fields": {"fields": []}},
        {"language_indicator": {"minimum_latin_letter_ratio": 2, "minimum_letters": 3}},
        {"topic_signal_keywords": {"login": []}},
    ]
    for change in bad:
        with pytest.raises(ValueError):
            rule_files.check(good | change)
    with pytest.raises(ValueError):
        rule_files.check({k: v for k, v in good.items() if k != "low_signal"})
    with pytest.raises(ValueError):
        rule_files.load(tmp_path / "absent.yaml")


def test_custom_word_pattern(spark):
    rules = rule_files.check(json.loads(json.dumps(rule_files.DEFAULT)) | {"word_count": {"pattern": "[a-z]{3}"}})
    assert one(spark, "abcdef gh", lambda c: features.word_count(c, rules)) == 2


def test_csv_round_trip_keeps_rows_and_order(spark, frame, tmp_path):
    import csv

    from larkspur import runs
    from larkspur.schema import REVIEW_COLUMNS

    path = tmp_path / "in.csv"
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(REVIEW_COLUMNS)
        for r in REVIEWS + [review("q", review_text='a "quoted",\nline')]:
            writer.writerow([r[c] or "" for c in REVIEW_COLUMNS])
    folder = runs.feature_run(spark, str(path), None, str(tmp_path / "out"), "run 1")
    assert folder.name == "run-1"
    back = files.features(spark, str(folder / "review_features.csv"))
    assert [r["review_id"] for r in back.collect()] == [r["review_id"] for r in REVIEWS] + ["q"]
    assert back.where("review_id = 'q'").first()["review_text"] == 'a "quoted",\nline'
    with pytest.raises(FileExistsError):
        runs.feature_run(spark, str(path), None, str(tmp_path / "out"), "run 1")
    report = runs.report_run(spark, str(folder / "review_features.csv"), str(tmp_path / "reports"), "r", 8)
    assert json.loads((report / "feature_validation_summary.json").read_text())["row_count_preserved"] is True
    assert (report / "feature_validation_report.md").read_text().startswith("# ")
    with pytest.raises(ValueError):
        files.normalized_reviews(spark, str(report / "feature_distributions.csv"))


def test_run_ids_and_folders(tmp_path):
    assert sinks.feature_run_id(" a b/c ") == "a-b-c" and sinks.validation_run_id("a b.c") == "a_b_c" and sinks.validation_run_id(" ")
    with pytest.raises(ValueError):
        sinks.feature_run_id("///")
    for want in ("x", "x_2", "x_3"):
        folder = sinks.unique_folder(tmp_path / "x")
        folder.mkdir()
        assert folder.name == want


def test_registered_functions(spark):
    from larkspur import functions

    functions.register(spark)
    assert spark.sql("SELECT normalize_review_text('  Ａ B ')").first()[0] == "a b"
    assert spark.sql("SELECT casefold_text(' ẞ ')").first()[0] == "ss"
    assert spark.sql("SELECT * FROM parse_review_html('')").count() == 0


def test_one_python_stage_per_read(frame):
    """All text of a read crosses to Python once: one Arrow stage for the reviews, one for the counts."""
    plan = features.generate(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3


def test_sql_functions_are_expressions(spark):
    """SQL text all through: the plan has no Python, and values are those of the column functions."""
    from larkspur.functions import strict_timestamp, is_present, weak_sentiment
    from larkspur.functions.sql import register_sql

    register_sql(spark)
    stamps = ["2026-07-05T00:00:00Z", " 2026-07-05 01+02 ", "2026-07-05", "2026-02-30T10:00:00Z", None, "", "2026-07-05T00:00:00,5-0700", "x'\\"]
    spark.createDataFrame([(t, float(i)) for i, t in enumerate(stamps)], "t string, n double").createOrReplaceTempView("stamps")
    got = spark.sql("SELECT t, strict_timestamp(t) AS at, is_present(t) AS here, weak_sentiment(n) AS label, has_topic(t, 'login') AS topic, has_topic('i cannot log in', 'login') AS said, has_topic('x', 'no topic') AS none FROM stamps")
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = spark.table("stamps").select("t", strict_timestamp(F.col("t")).alias("at"), is_present(F.col("t")).alias("here"), weak_sentiment(F.col("n")).alias("label"))
    key = lambda r: str(r["t"])
    assert [tuple(r)[:4] for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    first = got.first()
    assert first["said"] is True and first["none"] is None
    page = "<div data-hook='review' id='customer_review-z'><b data-hook='review-title'>T</b></div>"
    spark.createDataFrame([(1, page), (2, None), (3, page + page.replace("-z", "-y"))], "page_id long, payload string").createOrReplaceTempView("captures")
    rows = spark.sql("SELECT page_id, review_id, title FROM parse_review_pages(TABLE(SELECT page_id, payload FROM captures))").collect()
    assert sorted(map(tuple, rows)) == [(1, "z", "T"), (3, "y", "T"), (3, "z", "T")]


def test_plain_letters_are_normalized_as_python_does(spark):
    """Each by itself, and beside what would combine with it, which makes a text no plain one."""
    plain = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if re.match(f"[{PLAIN}]", c)]
    assert not [c for c in plain if c > "\x7f" and (unicodedata.combining(c) or c.isspace())]
    texts = [f"A {c} {c}B" for c in plain] + ["e\u0301 A", "\u304b\u3099", "\uac00\u11a8", "\u1e9e", "\u03a3\u03a3 ", "\u0130", "\U0001f600 ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    for form in ("NFKC", "NFC"):
        how = rule_files.check(rule_files.DEFAULT | {"text_normalization": rule_files.DEFAULT["text_normalization"] | {"unicode_form": form}})
        got = {r[0]: (r[1], r[2]) for r in rows.select("v", normalized(F.col("v"), how), casefolded(F.col("v"))).collect()}
        want = {t: (" ".join(unicodedata.normalize(form, t).casefold().split()), t.strip().casefold()) for t in texts}
        assert got == want


def test_python_gets_no_plain_text_and_holds_no_batch_as_objects(spark):
    latin = "Größe d’été, señor — ЁЖ 大 が 가"
    assert one(spark, latin, is_plain) and not one(spark, "Σ", is_plain, "string")
    batch = pa.array(["Σίσυφος " * 1000] * 2000)  # 16 million characters
    tracemalloc.start()
    try:
        out = normalizer("NFKC", True, True, True).func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 2000 and out[1999].as_py() == " ".join(["σίσυφοσ"] * 1000) and peak < 8e6


def test_features_are_made_once_for_all_files(spark, tmp_path):
    """Two files, each sorted, and each sort with a sample: none of them makes the rows again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        made.add(1)
        return -i

    rows = spark.range(500).repartition(3).select(F.col("id").cast("string").alias("review_id"), counted("id").alias("at"))
    folder = sinks.write_features(rows, str(tmp_path), "once", order="at")
    assert made.value == 500 and not (tmp_path / f"{folder.name}-made").exists()
    back = [spark.read.csv(str(folder / "review_features.csv"), header=True), spark.read.json(str(folder / "review_features.jsonl"))]
    assert [[int(r["review_id"]) for r in b.collect()] for b in back] == [list(range(499, -1, -1))] * 2
    assert [p.name for p in tmp_path.iterdir()] == ["once"]
