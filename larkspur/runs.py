"""Whole runs: features, their validation, and source assessments, from input to files."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config as configs
from . import rules as rule_files
from .operators import collect, compare, eda, features, findings, html_reviews, parse_fields, parse_json, quality, report
from .schema import review_schema
from .sources import feeds, files, sinks
from .sources.http import PoliteClient
from .sources.store import StorePath, bundle

AGENT = "larkspur-review-analytics/0.1"
#: More rows than a page has.
PAGE_ROWS = 1_000_000


def feature_run(spark: SparkSession, reviews_csv: str, rules_file: str | None, root: str, run_id: str) -> StorePath:
    """Review CSV to feature files, rows in input order, as many as came in."""
    rules = rule_files.load(rules_file) if rules_file else rule_files.default()
    rows = files.numbered(files.normalized_reviews(spark, reviews_csv))
    made = features.generate(rows, rules, keep=[files.ROW])
    if made.count() != rows.count():
        raise RuntimeError("the number of rows has changed")
    return sinks.write_features(made, root, run_id, order=files.ROW)


def report_run(spark: SparkSession, features_csv: str, root: str, run_id: str, input_rows: int | None = None, sample_size: int = 135) -> StorePath:
    made = files.features(spark, features_csv).cache()
    try:
        return sinks.write_validation_report(report.build(made, input_rows, sample_size), root, run_id)
    finally:
        made.unpersist()


def client_for(config: configs.AppConfig, headers: dict[str, str] | None = None) -> PoliteClient:
    limits = config.assessment
    return PoliteClient(limits.request_timeout_seconds, limits.request_delay_seconds, {"User-Agent": AGENT} | (headers or {}))


def parsed_pages(pages: DataFrame, source: str) -> DataFrame:
    """Review rows of landed pages, with app, run, page and arrival order."""
    parse = {"steam": parse_json.steam, "apple_app_store": parse_json.apple, "google_play": parse_json.google_play}[source]
    known = pages.where("payload is not null").withColumn("__seq", F.col("seq"))
    # The parsers carry a page's number through; here that is its place among all pages.
    rows = parse(known.withColumn("page", F.col("__seq"))).withColumnRenamed("raw_page_number", "__page_seq").withColumn("__at", F.monotonically_increasing_id())
    place = known.select(F.col("__seq").alias("__page_seq"), F.coalesce("app_id", "package_id").alias("app"), "run", F.col("page").alias("raw_page_number"))
    nth = F.row_number().over(Window.partitionBy("__page_seq").orderBy("__at"))
    return rows.withColumn("seq", F.col("__page_seq") * PAGE_ROWS + nth).drop("__at").join(place, "__page_seq").drop("__page_seq")


def landed_run(spark: SparkSession, folder: str, source: str, out: str) -> DataFrame:
    """Reviews of raw pages that have landed in a folder of any store, each id once, saved.

    Pages count in the order of their apps, runs and numbers, as their files' names tell.
    """
    pages = files.landed_pages(spark, folder)
    app = F.regexp_extract(F.element_at(F.split("file", "/"), -1), rf"^{source}_(?:(.+?)_)?run\d+_page", 1)
    pages = pages.withColumn("app", app)
    slim = pages.select("file", F.row_number().over(Window.orderBy("app", "run", "page", "file")).cast("long").alias("seq"))  # names only
    known = {c: F.lit(None).cast(kind).alias(c) for c, kind in feeds.PAGE_TYPES.items() if c not in ("payload", "page", "run", "seq", "app_id", "package_id", "source")}
    numbered = pages.join(slim, "file").select("payload", "page", "run", "seq", F.col("app").alias("app_id"), F.col("app").alias("package_id"), F.lit(source).alias("source"), *known.values())
    kept = collect.accepted(parsed_pages(numbered, source))
    sinks.write_reviews(kept, out, f"{source}_reviews")
    return kept


def source_facts(spark: SparkSession, source: str, landing: feeds.Landing, rows: DataFrame, kept: DataFrame, **more: Any) -> DataFrame:
    """The one-row summary by which sources are compared."""
    profile = quality.profile(kept).first()
    repeat = collect.repeatability(rows).first()
    fields = quality.available_fields(kept).first()
    pages = collect.page_ids(rows, ["app", "run"])
    paged = any(r["pagination_demonstrated"] for r in collect.pagination_shown(pages, ["app", "run"]).collect())
    ok = [r for r in landing.requests if r["success"]]
    times = [r["elapsed_seconds"] for r in landing.requests if r["elapsed_seconds"] is not None]
    runs = repeat["runs"]
    known = {
        "source": source,
        "executed": True,
        "request_count": len(landing.requests),
        "successful_requests": len(ok),
        "request_count_status": "available",
        "live": bool(landing.requests),
        "reviews": kept.count(),
        "raw_reviews": rows.count(),
        "pages_attempted": len(landing.pages),
        "pages_completed": sum(p["status"] != "request_failed" and bool(p["parsed"]) for p in landing.pages),
        "batches": len(landing.pages),
        "pagination": paged,
        "repeated": repeat["repeated_collection_demonstrated"],
        "incremental": paged and (profile is not None and profile["missing_review_id_count"] < profile["total_rows"]),
        "runs": runs,
        "overlap_count": repeat["overlap_count"],
        "overlap_rate": repeat["overlap_rate"],
        "new_in_second_run": collect.new_in_second_run(rows).first()[0],
        "blocked": any(r["blocked"] for r in landing.requests),
        "errors": len(landing.errors),
        "warnings": len(landing.warnings),
        "limitations": 0,
        "parser_errors": len(landing.parser_errors),
        "average_response_time": sum(times) / len(times) if times else None,
        "blocked_requests": sum(bool(r["blocked"]) for r in landing.requests),
        "status_codes": sorted({r["status_code"] for r in landing.requests if r["status_code"] is not None}),
        "metadata_fields": fields["available_metadata_fields"] if fields else [],
        "total_rows": profile["total_rows"] if profile else 0,
        "unique_rows": profile["unique_review_count"] if profile else 0,
        "duplicates": profile["duplicates_within_final_dataset"] if profile else 0,
        "empty_text": profile["empty_review_text_count"] if profile else 0,
    } | more
    names = [f.strip().split()[0] for f in compare.FACTS.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(known.get(n) for n in names)], compare.FACTS)


def skipped(spark: SparkSession, source: str, reason: str) -> DataFrame:
    names = [f.strip().split()[0] for f in compare.FACTS.replace("\n", " ").split(",")]
    zero = {"request_count": 0, "successful_requests": 0, "reviews": 0, "errors": 0, "warnings": 0, "limitations": 0, "parser_errors": 0, "total_rows": 0, "metadata_fields": []}
    known = {"source": source, "executed": False, "skipped_reason": reason} | zero
    return spark.createDataFrame([tuple(known.get(n) for n in names)], compare.FACTS)


def assess(spark: SparkSession, config: configs.AppConfig, root: str, source: str, client=None, fetch=None) -> tuple[DataFrame, DataFrame]:
    """One source collected, deduplicated and saved: its facts and its reviews."""
    raw, limits = Path(root, "data", "raw", source), config.assessment
    if source == "amazon":
        return assess_captures(spark, config, root, client)
    part = {"steam": config.steam, "apple_app_store": config.apple_app_store, "google_play": config.google_play}[source]
    if not part.enabled:
        return skipped(spark, source, "disabled by configuration"), spark.createDataFrame([], review_schema())
    if source == "steam" and not config.steam.real_app_ids:
        return skipped(spark, source, "no app ids are configured"), spark.createDataFrame([], review_schema())
    client = client or client_for(config)
    landing = {"steam": lambda: feeds.steam(config, client, raw), "apple_app_store": lambda: feeds.apple(config, client, raw), "google_play": lambda: feeds.google_play(config, fetch, raw)}[source]()
    pages, _ = landing.frames(spark)
    rows = parsed_pages(pages, source).cache()
    cap = limits.max_reviews_per_item
    kept = collect.steam_collect(rows, cap) if source == "steam" else collect.capped(collect.accepted(rows), cap)
    kept = kept.cache()
    sinks.write_reviews(kept, f"{root}/data/processed", f"{source}_reviews")
    third = {"access_method_type": "third-party wrapper", "request_count_status": "unavailable", "limitations": 1} if source == "google_play" else {"access_method_type": "public feed"}
    return source_facts(spark, source, landing, rows, kept, **third), kept


def assess_captures(spark: SparkSession, config: configs.AppConfig, root: str, client=None) -> tuple[DataFrame, DataFrame]:
    """Saved response files, each a batch, in the order they are listed; then live pages, if any."""
    listed, urls = list(config.amazon.saved_response_files), config.amazon.real_urls
    if not config.amazon.enabled or not (listed or urls and client and config.amazon.live):
        return skipped(spark, "amazon", "no saved response file and no live URL"), spark.createDataFrame([], review_schema())
    pages, unread = files.saved_captures(spark, listed)
    saved = pages.select("payload", F.col("batch").alias("page"), F.lit(urls[0] if urls else None).cast("string").alias("source_url"))
    landing = feeds.Landing()
    if client and urls and config.amazon.live:
        landing = feeds.amazon(config, client, parse_fields.tells_of_block, Path(root, "data", "raw", "amazon"))
    landing.parser_errors += unread
    live, _ = landing.frames(spark)
    live = live.where("payload is not null").select("payload", (F.lit(len(listed) + 1) + F.col("seq")).alias("page"), "source_url")
    rows = html_reviews.reviews(saved.unionByName(live)).withColumn("__at", F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("raw_page_number").orderBy("__at"))
    rows = rows.withColumns({"app": F.lit("amazon"), "run": F.lit(1), "seq": F.col("raw_page_number") * PAGE_ROWS + nth}).drop("__at").cache()
    kept = collect.accepted(rows)
    kept = kept.withColumn("raw_page_number", F.when(F.col("raw_page_number") > len(listed), 1).cast("long"))
    sinks.write_reviews(kept, f"{root}/data/processed", "amazon_reviews")
    batches = collect.page_ids(rows.where(F.col("raw_page_number") <= len(listed)), ["app"])
    paged = collect.saved_pages_show_pagination(batches, ["app"]).first()
    more = {"offline_parsed": bool(listed), "saved_batches": len(listed), "pagination": bool(paged and paged[0]) if listed else None, "repeated": False, "overlap_count": None, "overlap_rate": None}
    more |= {} if landing.requests else {"blocked": None, "live": False}
    return source_facts(spark, "amazon", landing, rows, kept, **more), kept


def assessment_run(spark: SparkSession, config: configs.AppConfig, root: str, sources: tuple[str, str], client=None, fetch=None, skip: dict[str, str] | None = None) -> StorePath:
    """Two sources compared: summary, quality, comparison and text in ``reports``."""
    facts, kept = [], []
    for source in sources:
        if skip and source in skip:
            facts.append(skipped(spark, source, skip[source]))
            continue
        fact, rows = assess(spark, config, root, source, client, fetch)
        facts.append(fact)
        kept.append(rows)
    both = facts[0].unionByName(facts[1]).cache()
    stores = "google_play" in sources
    table = compare.store_comparison(both) if stores else compare.comparison(both)
    advice = compare.store_recommendation(both) if stores else compare.recommendation(both)
    folder = sinks.unique_folder(StorePath(spark, root) / "reports" / ("app_stores" if stores else "phase_1"))
    reviews = kept[0] if kept else spark.createDataFrame([], review_schema())
    for more in kept[1:]:
        reviews = reviews.unionByName(more, allowMissingColumns=True)
    metrics = quality.metrics(reviews, both).cache()
    sinks.ensure_outputs(spark, f"{root}/data/processed", [f"{r['source']}_reviews" for r in both.select("source").collect()])
    parts: dict[str, Any] = {f"Findings: {r['source']}": r["text"] for r in findings.findings(both, metrics).orderBy("source").collect()}  # a row a source
    parts |= {"Comparison": table, "Recommendation": advice}
    with bundle(folder) as stage:
        sinks.write_summary({"configuration": config.sanitized(), "facts": [r.asDict(True) for r in both.collect()], "recommendation": advice}, stage / "test_run_summary.json")
        sinks.write_csv(metrics, str(stage / "data_quality_metrics.csv"))
        sinks.write_csv(table, str(stage / "source_comparison.csv"))
        if stores:
            matrix = compare.metadata_matrix(both)
            sinks.write_csv(matrix, str(stage / "metadata_matrix.csv"))
            parts["Metadata"] = matrix
        sinks.write_markdown("Source assessment", parts, stage / "report.md")
    return folder


def validation_run(spark: SparkSession, config: configs.AppConfig, root: str, run_id: str | None = None, total: int | None = None, client=None) -> StorePath:
    """All app-store targets collected, capped and described by ten tables."""
    store = config.apple_app_store
    name = sinks.validation_run_id(run_id)
    folder = sinks.unique_folder(StorePath(spark, root) / "reports" / store.validation_output_dir / name)
    total = min(total or store.validation_total_reviews, configs.MAX_TOTAL)
    landing = feeds.apple_validation(config, client or client_for(config), Path(root, "data", "raw", store.validation_output_dir, folder.name), total)
    pages, _ = landing.frames(spark)
    rows = parsed_pages(pages, "apple_app_store").cache()
    kept = collect.capped(collect.accepted(rows), store.validation_reviews_per_target, ["app", "country", "language"], total).cache()
    batches = pages.drop("payload")
    targets = spark.createDataFrame([(t.app_id, t.app_name, t.country, t.language) for t in store.validation_targets], "item_id string, app_name string, country string, language string")
    short = collect.unreached_targets(targets, kept, store.validation_reviews_per_target, ["item_id", "country", "language"])
    batches = batches.unionByName(short.withColumnRenamed("item_id", "app_id").select("app_id", "app_name", "country", "language", "review_count", "status"), allowMissingColumns=True)
    reviews = kept.count()
    reason = None if reviews >= total else collect.shortfall(batches, errors=len(landing.errors), parser_errors=len(landing.parser_errors)).first()[0]
    sinks.write_reviews(kept, f"{root}/data/processed/{store.validation_output_dir}/{folder.name}", "reviews")
    tables = eda.tables(kept, batches, landing.errors + landing.parser_errors + landing.warnings, store.validation_low_signal_min_text_length)
    facts = {"run_id": name, "target_review_count": total, "reviews_collected": reviews, "target_reached": reason is None, "shortfall_reason": reason, "request_count": len(landing.requests), "successful_request_count": sum(r["success"] for r in landing.requests), "errors": landing.errors, "parser_errors": landing.parser_errors}
    with bundle(folder) as stage:
        sinks.write_tables(tables, stage)
        sinks.write_summary(facts, stage / "summary.json")
        sinks.write_markdown("App store validation", {"Status": f"{reviews} of {total} reviews; {reason or 'target reached'}", "Volume": tables["review_volume_by_app"]}, stage / "summary.md")
    return folder
