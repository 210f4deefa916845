"""What a run found out about each source, as text for its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import not_applicable, percent, request_count, yes_no
from .quality import NO_RATING, NOTES


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("none")))


def _if(test: Column, text: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(text))


def findings(facts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(source, text): the lines on each source, one row each; only why, for one not executed."""
    m = metrics.select("source", "final_dataset_duplicate_count", "cross_run_overlap_count", "cross_run_overlap_rate", "new_records_in_second_run", "empty_review_text_count", "not_applicable_fields")
    rows = facts.join(m, "source")
    live = F.coalesce("live", F.col("request_count") > 0, F.lit(False))
    amazon, apps = F.col("source") == "amazon", F.col("source").isin("google_play", "apple_app_store")
    offline = F.coalesce("offline_parsed", F.lit(False))
    codes = F.when(F.size("status_codes") > 0, F.array_join(F.transform("status_codes", lambda c: c.cast("string")), ", "))
    notes = F.lit(None).cast("string")
    for source, about in NOTES.items():
        notes = F.when(F.col("source") == source, "\n".join(f"- {field}: {note}" for field, note in about.items())).otherwise(notes)
    lines = [
        _line("Live collection", yes_no(live)),
        _line("Saved responses parsed", yes_no(offline)),
        _line("Saved response batches", F.coalesce("saved_batches", F.lit(0))),
        _line("Requests", request_count(F.col("request_count"), F.col("request_count_status"))),
        _line("Successful requests", request_count(F.col("successful_requests"), F.col("request_count_status"))),
        _line("Request counts", F.coalesce("request_count_status", F.lit("unavailable"))),
        _line("Status codes", codes),
        _line("Reviews", F.col("reviews")),
        _line("Duplicates in the final dataset", F.col("final_dataset_duplicate_count")),
        _line("Overlap across runs", not_applicable(F.col("cross_run_overlap_count"))),
        _line("Overlap rate", percent(F.col("cross_run_overlap_rate"), "not applicable")),
        _line("New records in the second run", not_applicable(F.col("new_records_in_second_run"))),
        _line("Blocked", yes_no(F.col("blocked"))),
        _line("Pagination shown", yes_no(F.col("pagination"))),
        _line("Empty texts", F.col("empty_review_text_count")),
        _line("Parser errors", F.coalesce("parser_errors", F.lit(0))),
        _line("Warnings", F.coalesce("warnings", F.lit(0))),
        F.when(apps, _line("Access", F.concat_ws(", ", "access_method", "access_method_type"))),
        F.when(apps, _line("Batches attempted", F.coalesce("pages_attempted", F.lit(0)))),
        F.when(apps, _line("Batches completed", F.coalesce("pages_completed", F.lit(0)))),
        F.when(apps, _line("Repeated collection shown", yes_no(F.col("repeated")))),
        F.when(apps, _line("Incremental collection feasible", yes_no(F.col("incremental")))),
        F.when(apps, _line("Access limitations", F.coalesce("limitations", F.lit(0)))),
        F.when(F.col("not_applicable_fields") != "", _line("Fields that do not apply", F.col("not_applicable_fields"))),
        _if(F.col("source") == NO_RATING, "- A rating does not apply: this source gives a recommendation."),
        _if(amazon & (F.col("request_count") > 0) & (F.col("successful_requests") < F.col("request_count")), "- The live request gave no usable reviews; live access stays open."),
        _if(amazon & offline & (F.coalesce("request_count", F.lit(0)) == 0), "- Live access was not tested; saved pages were parsed."),
        notes,
    ]
    skipped = F.concat(F.lit("Not executed: "), F.coalesce("skipped_reason", F.lit("no reason given")))
    return rows.select("source", F.when(F.coalesce("executed", F.lit(False)), F.concat_ws("\n", *lines)).otherwise(skipped).alias("text"))
