"""Comparing sources: evidence, assessments, viability, recommendation, metadata.

Facts are one row per source (``FACTS``). A comparison is criteria times facts, both of
them lists of a handful, turned into one row per criterion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = """source string, executed boolean, skipped_reason string, access_method string, access_method_type string,
 request_count long, successful_requests long, request_count_status string, live boolean, offline_parsed boolean,
 saved_batches long, reviews long, raw_reviews long, pages_attempted long, pages_completed long, batches long,
 pagination boolean, repeated boolean, incremental boolean, runs long, overlap_count long, overlap_rate double,
 new_in_second_run long, blocked boolean, errors long, warnings long, limitations long, parser_errors long,
 metadata_fields array<string>, total_rows long, unique_rows long, duplicates long, empty_text long,
 average_response_time double, blocked_requests long, status_codes array<long>"""

# The criteria of the two comparisons, in order.
CRITERIA = ["Accessibility", "Review volume", "Available metadata", "Data quality", "Commercial value", "Long-term maintainability"]
STORE_CRITERIA = ["Consistent accessibility", "Pagination or batching", "Available metadata", "Repeated collection", "Access limitations", "Data quality", "Long-term maintainability", "Commercial value and generalizability"]
# Metadata whose presence the matrix shows.
MATRIX_FIELDS = ["source", "app_name", "item_id", "package_id", "review_id", "review_title", "review_text", "rating", "review_date", "author_name", "author_id", "helpful_votes", "app_version", "language", "country", "developer_response", "developer_response_date", "source_url", "raw_page_number", "raw_cursor", "collected_at"]
#: Metadata columns from which coverage counts as good.
GOOD_COVERAGE = 8
THIRD_PARTY = "third-party"


def shown(col: Column, absent: str = "not applicable") -> Column:
    return F.coalesce(col.cast("string"), F.lit(absent))


def success_rate() -> Column:
    return F.when(F.col("request_count") > 0, F.col("successful_requests") / F.col("request_count"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _third_party() -> Column:
    return F.coalesce(F.col("access_method_type").contains(THIRD_PARTY), F.lit(False))


def viability(facts: DataFrame) -> DataFrame:
    """Points for rows, pagination, repetition and increments, minus those for risks."""
    score = (
        2 * (_flag("executed") & (F.col("reviews") > 0)).cast("int")
        + _flag("pagination").cast("int")
        + _flag("repeated").cast("int")
        + _flag("incremental").cast("int")
        - _third_party().cast("int")
        - (F.col("errors") > 0).cast("int")
    )
    return facts.select("source", score.cast("long").alias("viability_score"))


def _pairs(*parts) -> Column:
    return F.concat_ws("; ", *[F.concat(F.lit(f"{name}="), shown(col, "none")) for name, col in parts])


def _metadata() -> Column:
    return F.when(F.size("metadata_fields") > 0, F.array_join("metadata_fields", ", ")).otherwise("no metadata was seen")


def evidence() -> Column:
    c = F.col("criterion")
    quality = _pairs(("duplicates", F.col("duplicates")), ("overlap", F.col("overlap_count")), ("empty_text", F.col("empty_text")), ("parser_errors", F.col("parser_errors")))
    return (
        F.when(~_flag("executed"), F.concat(F.lit("not executed: "), shown(F.col("skipped_reason"), "no reason given")))
        .when((c == "Accessibility") & (F.col("source") == "amazon") & _flag("offline_parsed") & (F.col("request_count") == 0), _pairs(("live", F.lit("untested")), ("saved_batches", F.col("saved_batches")), ("reviews", F.col("reviews"))))
        .when(c == "Accessibility", _pairs(("requests", F.col("request_count")), ("success_rate", success_rate()), ("blocked", F.col("blocked")), ("pagination", F.col("pagination"))))
        .when(c == "Review volume", _pairs(("reviews", F.col("reviews")), ("raw", F.col("raw_reviews"))))
        .when(c == "Available metadata", _metadata())
        .when(c == "Data quality", quality)
        .when(c == "Commercial value", "a judgement, not a measurement")
        .when(c == "Long-term maintainability", _pairs(("parser_errors", F.col("parser_errors")), ("warnings", F.col("warnings")), ("blocked", F.col("blocked"))))
    )


def assessment() -> Column:
    """The first predicate that holds, criterion by criterion."""
    c, source, rows = F.col("criterion"), F.col("source"), F.coalesce("total_rows", F.lit(0))
    return (
        F.when((c == "Commercial value") & (source == "amazon"), "broad product relevance")
        .when(c == "Commercial value", "rich feedback, limited to games")
        .when(~_flag("executed"), "insufficient")
        .when((c == "Accessibility") & (source == "amazon") & _flag("offline_parsed") & (F.col("request_count") == 0), "offline only")
        .when((c == "Accessibility") & _flag("blocked"), "weak")
        .when((c == "Accessibility") & (success_rate() == 1.0), "strong")
        .when((c == "Accessibility") & (source == "amazon") & (F.col("request_count") > 0), "unresolved")
        .when(c == "Accessibility", "mixed")
        .when((c == "Long-term maintainability") & (source == "steam"), "stronger")
        .when(c == "Long-term maintainability", "riskier")
        .when(c == "Review volume", "limited test")
        .when((c == "Available metadata") & (F.size("metadata_fields") >= GOOD_COVERAGE), "strong coverage")
        .when(c == "Available metadata", "limited coverage")
        .when((c == "Data quality") & (rows == 0), "no rows")
        .when((c == "Data quality") & (F.coalesce("duplicates", F.lit(0)) == 0) & (F.coalesce("overlap_count", F.lit(0)) > 0), "consistent")
        .when((c == "Data quality") & (F.coalesce("parser_errors", F.lit(0)) > 0), "mixed")
        .when(c == "Data quality", "acceptable")
    )


def store_evidence() -> Column:
    c = F.col("criterion")
    return (
        F.when(~_flag("executed"), F.concat(F.lit("not executed: "), shown(F.col("skipped_reason"), "no reason given")))
        .when(c == "Consistent accessibility", _pairs(("method", F.col("access_method")), ("type", F.col("access_method_type")), ("requests", F.when(F.col("request_count_status") == "available", F.col("request_count"))), ("success_rate", F.when(F.col("request_count_status") == "available", success_rate())), ("live", F.coalesce("live", F.col("request_count") > 0)), ("errors", F.col("errors"))))
        .when(c == "Pagination or batching", _pairs(("attempted", F.col("pages_attempted")), ("completed", F.col("pages_completed")), ("shown", F.col("pagination")), ("batches", F.col("batches"))))
        .when(c == "Available metadata", _metadata())
        .when(c == "Repeated collection", _pairs(("runs", F.col("runs")), ("repeated", F.col("repeated")), ("overlap", F.col("overlap_count")), ("overlap_rate", F.col("overlap_rate")), ("new", F.col("new_in_second_run"))))
        .when(c == "Access limitations", _pairs(("limitations", F.col("limitations")), ("warnings", F.col("warnings")), ("errors", F.col("errors"))))
        .when(c == "Data quality", _pairs(("rows", F.col("total_rows")), ("unique", F.col("unique_rows")), ("duplicates", F.col("duplicates")), ("overlap", F.col("overlap_count")), ("empty_text", F.col("empty_text")), ("parser_errors", F.col("parser_errors"))))
        .when(c == "Long-term maintainability", _pairs(("type", F.col("access_method_type")), ("parser_errors", F.col("parser_errors"))))
        .when(c == "Commercial value and generalizability", "app reviews speak about products of every kind")
    )


def store_assessment() -> Column:
    c, rows = F.col("criterion"), F.coalesce("total_rows", F.lit(0))
    return (
        F.when(~_flag("executed"), "insufficient")
        .when((c == "Consistent accessibility") & (F.col("request_count") > 0) & (success_rate() == 1.0), "strong")
        .when((c == "Consistent accessibility") & (F.col("source") == "google_play") & (F.col("reviews") > 0), "feasible, unofficial")
        .when(c == "Consistent accessibility", "inconclusive")
        .when(c == "Pagination or batching", F.when(_flag("pagination"), "demonstrated").otherwise("not demonstrated"))
        .when(c == "Available metadata", F.when(F.size("metadata_fields") >= GOOD_COVERAGE, "strong coverage").otherwise("limited coverage"))
        .when(c == "Repeated collection", F.when(_flag("repeated"), "demonstrated").otherwise("not demonstrated"))
        .when(c == "Access limitations", F.when((F.col("limitations") > 0) | (F.col("errors") > 0), "material").otherwise("none material"))
        .when((c == "Data quality") & (rows == 0), "no rows")
        .when(c == "Data quality", F.when((F.coalesce("duplicates", F.lit(0)) == 0) & (F.coalesce("parser_errors", F.lit(0)) == 0), "acceptable").otherwise("mixed"))
        .when(c == "Long-term maintainability", F.when(_third_party(), "riskier").otherwise("stronger"))
        .when(c == "Commercial value and generalizability", "strong fit")
    )


def _table(facts: DataFrame, criteria: list[str], sources: list[str], proof: Column, verdict: Column, known: Column, qualitative: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(c).alias("criterion")) for i, c in enumerate(criteria)])
    rows = facts.where(F.col("source").isin(sources)).withColumn("__known", known).select("*", F.inline(listed))
    rows = rows.select("nth", "criterion", "source", "__known", proof.alias("evidence"), verdict.alias("assessment"))
    by_source = [F.max(F.when(F.col("source") == s, F.col(what))).alias(f"{s}_{what}") for what in ("evidence", "assessment") for s in sources]
    out = rows.groupBy("nth", "criterion").agg(*by_source, F.bool_or("__known").alias("__known"))
    confidence = F.when(F.col("criterion") == qualitative, "medium qualitative").when(F.col("__known"), "limited").otherwise("low")
    notes = F.when(F.col("criterion") == "Review volume", "capped by configuration").when(F.col("criterion") == qualitative, "judge apart from technical ease").otherwise("")
    return out.withColumn("confidence", confidence).withColumn("notes", notes).orderBy("nth").drop("nth", "__known")


def comparison(facts: DataFrame) -> DataFrame:
    """Six criteria for the two sources of the first phase."""
    return _table(facts, CRITERIA, ["amazon", "steam"], evidence(), assessment(), _flag("executed"), "Commercial value")


def store_comparison(facts: DataFrame) -> DataFrame:
    """Eight criteria for the two app stores."""
    known = _flag("executed") & (F.col("reviews") > 0)
    return _table(facts, STORE_CRITERIA, ["google_play", "apple_app_store"], store_evidence(), store_assessment(), known, "Commercial value and generalizability")


def by_criterion(table: DataFrame, criterion: str) -> DataFrame:
    """The row of a comparison that is about one criterion."""
    return table.where(F.col("criterion") == criterion)


def _facts_of(facts: DataFrame, source: str) -> dict:
    row = facts.where(F.col("source") == source).withColumn("rate", success_rate()).first()
    return row.asDict() if row else {}


def recommendation(facts: DataFrame) -> str:
    """Which of the first two sources to go on with; four predicates in order."""
    steam, amazon = _facts_of(facts, "steam"), _facts_of(facts, "amazon")
    steady = bool(steam.get("executed") and steam.get("reviews") and not steam.get("blocked") and steam.get("rate") == 1.0)
    parsed = bool(amazon.get("executed") and amazon.get("reviews") and amazon.get("offline_parsed"))
    reliable = bool(amazon.get("executed") and amazon.get("reviews") and not amazon.get("blocked") and amazon.get("rate") in (None, 1.0))
    live = bool(amazon.get("request_count"))
    if steady and parsed and not live:
        return "Begin with steam; amazon parses offline, live access stays open."
    if steady and (amazon.get("blocked") or not live):
        return "Begin with steam; amazon matters commercially and needs work on access."
    if reliable and live and amazon.get("pagination"):
        return "Amazon may serve a next prototype; test it more widely."
    if steady and not reliable:
        return "Go in phases: steam first, then amazon once access is shown."
    return "No source wins on this evidence; run more tests."


def store_recommendation(facts: DataFrame) -> str:
    """The app store of the higher viability score; none on a tie."""
    score = {r["source"]: r["viability_score"] for r in viability(facts).collect()}
    google, apple = score.get("google_play", 0), score.get("apple_app_store", 0)
    if google == apple:
        return "Neither app store can be chosen on this evidence; pilot only."
    best, other = ("google_play", "apple_app_store") if google > apple else ("apple_app_store", "google_play")
    return f"Prefer {best} as the primary app store and keep {other} as the second; watch access, schema and limits."


def metadata_matrix(facts: DataFrame, sources: tuple[str, ...] = ("google_play", "apple_app_store")) -> DataFrame:
    """Each field's state per source: available, unavailable, or unverified without rows."""
    fields = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(f).alias("field")) for i, f in enumerate(MATRIX_FIELDS)])
    rows = facts.where(F.col("source").isin(*sources)).select("source", "reviews", "metadata_fields", F.inline(fields))
    state = F.when(F.coalesce("reviews", F.lit(0)) == 0, "not verified").when(F.array_contains("metadata_fields", F.col("field")), "available").otherwise("unavailable")
    return rows.withColumn("state", state).groupBy("nth", "field").agg(*[F.max(F.when(F.col("source") == s, F.col("state"))).alias(s) for s in sources]).orderBy("nth").drop("nth")
