"""Collection semantics: first-wins dedup, caps, pages, runs and their overlaps.

Input rows carry their arrival order in ``seq``. Rows without an id are never
duplicates of one another and bypass every step that keys on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

STATUSES = ("ok", "empty_page", "request_failed", "pagination_limit_or_unavailable_page", "json_parse_error")


def has_id(column: str = "review_id") -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def first_wins(rows: DataFrame, key: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """``rows`` with ``is_duplicate``: whether the id has come before.

    The first arrival of each id is a minimum, partially aggregated, not a window over
    all arrivals of an id.
    """
    key = key or ["review_id"]
    firsts = rows.where(has_id()).groupBy(*key).agg(F.min(seq).alias("__first"))
    renamed = firsts.select(*[F.col(k).alias(f"__{k}") for k in key], "__first")
    joined = rows.join(renamed, [F.col(k) == F.col(f"__{k}") for k in key], "left")
    return joined.withColumn("is_duplicate", F.coalesce(has_id() & (F.col(seq) > F.col("__first")), F.lit(False))).select(*rows.columns, "is_duplicate")


def accepted(rows: DataFrame, key: list[str] | None = None, seq: str = "seq") -> DataFrame:
    return first_wins(rows, key, seq).where(~F.col("is_duplicate")).drop("is_duplicate")


def unseen(rows: DataFrame, history: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose id no earlier run holds; rows without an id pass."""
    key = key or ["review_id"]
    return rows.where(~has_id()).unionByName(rows.where(has_id()).join(history.select(*key).distinct(), key, "left_anti").select(*rows.columns))


def capped(rows: DataFrame, cap: int, by: list[str] | None = None, total: int | None = None, seq: str = "seq") -> DataFrame:
    """The first ``cap`` accepted rows of each target, and ``total`` of all."""
    out = rows
    if by:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(seq))).where(F.col("__n") <= cap).drop("__n")
    else:
        total = min(cap, total) if total else cap
    return out.orderBy(seq).limit(total) if total else out


def cap_marks(rows: DataFrame, by: list[str], cap: int, seq: str = "seq") -> DataFrame:
    """Per full group its ``mark``, the place of its ``cap``-th row; other groups have none.

    Of a group a task passes on its first ``cap`` rows at most.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(seq))
    few = rows.select(*by, seq).withColumn("__nth", nth).where(F.col("__nth") <= cap)
    return few.groupBy(*by).agg(F.max(seq).alias("mark"), F.count("*").alias("__n")).where(F.col("__n") >= cap).drop("__n")


def up_to_marks(rows: DataFrame, marks: DataFrame, by: list[str], seq: str = "seq", inclusive: bool = True) -> DataFrame:
    """Rows up to the marks of their groups; groups without a mark stay whole."""
    named = marks.select(*[F.col(c).alias(f"__{c}") for c in by], "mark")
    joined = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    within = F.col(seq) <= F.col("mark") if inclusive else F.col(seq) < F.col("mark")
    return joined.where(F.col("mark").isNull() | within).select(*rows.columns)


def deferred_acceptance(options: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Which of an id's options (app, review_id, seq) is taken, if each app takes ``cap`` ids, and the apps' marks.

    In arrival order, an id would be taken by the first app that still has room. Here ids
    propose instead: each to its earliest option, each app keeps its ``cap`` earliest
    proposals, and what comes after the last of those is refused for good, so that in the
    next round the refused ids propose to their next options. Ids and apps go by one order,
    so the fixed point is the one that arrival order leads to. All that a round hands on is a
    mark for each full app, and marks only fall.
    """
    options = cut(options)
    marks, before = None, None
    while True:
        alive = options if marks is None else up_to_marks(options, marks, ["app"])
        proposals = alive.groupBy("review_id").agg(F.min(F.struct("seq", "app")).alias("p")).select("p.app", "review_id", "p.seq")
        marks = cut(cap_marks(proposals, ["app"], cap))
        state = marks.agg(F.count("*"), F.sum(F.xxhash64("app", "mark").cast("decimal(20,0)"))).first()
        if state == before:
            return proposals, marks
        before = state


def steam_collect(rows: DataFrame, cap: int) -> DataFrame:
    """Rows kept of repeated runs over several apps, with a cap for each run and app.

    A run stops at the row before which it has seen ``cap`` distinct ids. Of what runs
    read, an id is taken once over all apps, and only while its app holds fewer than
    ``cap`` ids; an id that a full app passes over may still be taken by a later app. Rows
    without an id are taken while their app is open, and count toward nothing. No step
    gathers an app's, or all, rows in one place.
    """
    by_run = ["app", "run"]
    new_ids = rows.where(has_id()).groupBy(*by_run, "review_id").agg(F.min("seq").alias("seq"))
    read = cut(up_to_marks(rows, cap_marks(new_ids, by_run, cap), by_run))
    options = read.where(has_id()).groupBy("app", "review_id").agg(F.min("seq").alias("seq"))
    taken, marks = deferred_acceptance(options, cap)
    named = taken.select(F.col("app").alias("__app"), F.col("seq").alias("__seq"))
    with_id = read.where(has_id()).join(named, F.col("app").eqNullSafe(F.col("__app")) & (F.col("seq") == F.col("__seq")), "left_semi")
    without = up_to_marks(read.where(~has_id()), marks, ["app"], inclusive=False)
    return with_id.unionByName(without).select(*rows.columns)


def run_overlap(rows: DataFrame, by: list[str] | None = None, run: str = "run") -> DataFrame:
    """Ids that every run has, by group: sorted, none with fewer than two runs or an empty one."""
    by = by or []
    runs = rows.groupBy(*by).agg(F.countDistinct(run).alias("__runs"))
    with_ids = rows.where(has_id()).groupBy(*by, "review_id").agg(F.countDistinct(run).alias("__in"))
    joined = with_ids.join(runs, by) if by else with_ids.crossJoin(F.broadcast(runs))  # one row
    return joined.where("__runs >= 2 and __in = __runs").select(*by, "review_id")


def new_in_second_run(rows: DataFrame, run: str = "run", first: int = 1, second: int = 2) -> DataFrame:
    """How many ids the second run has that the first has not; null without a second run."""
    marked = rows.where(has_id()).groupBy("review_id").agg(F.max((F.col(run) == first).cast("int")).alias("a"), F.max((F.col(run) == second).cast("int")).alias("b"))
    runs = rows.agg(F.countDistinct(run).alias("n"))
    counted = marked.agg(F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("new_records"))
    return counted.crossJoin(F.broadcast(runs)).select(F.when(F.col("n") >= 2, F.col("new_records")).alias("new_records_in_second_run"))


def page_ids(rows: DataFrame, by: list[str], page: str = "raw_page_number") -> DataFrame:
    """One row per page: its ids, how many rows, and how it compares with the page before."""
    pages = rows.groupBy(*by, page).agg(F.count("*").alias("review_count"), F.array_sort(F.collect_set(F.when(has_id(), F.col("review_id")))).alias("ids"))
    before = F.lag("ids").over(Window.partitionBy(*by).orderBy(page))
    return (
        pages.withColumn("__before", before)
        .withColumn("overlap_with_previous", F.size(F.array_intersect("ids", F.coalesce("__before", F.array().cast("array<string>")))).cast("long"))
        .withColumn("distinct_from_previous", F.when(F.size(F.coalesce("__before", F.array().cast("array<string>"))) > 0, (F.size("ids") > 0) & (F.col("overlap_with_previous") == 0)))
        .drop("__before")
    )


def pagination_shown(pages: DataFrame, by: list[str], page: str = "raw_page_number") -> DataFrame:
    """Whether any page after the first has rows and shares none with the one before."""
    return pages.groupBy(*by).agg(F.coalesce(F.bool_or((F.col(page) > 1) & (F.col("review_count") > 0) & F.col("distinct_from_previous")), F.lit(False)).alias("pagination_demonstrated"))


def saved_pages_show_pagination(pages: DataFrame, by: list[str], page: str = "raw_page_number") -> DataFrame:
    """The stricter test of saved files: two at least, none empty, each later one distinct."""
    later = F.row_number().over(Window.partitionBy(*by).orderBy(page)) > 1
    marked = pages.withColumn("__later", later)
    every = F.bool_and((F.size("ids") > 0) & (~F.col("__later") | F.coalesce(F.col("distinct_from_previous"), F.lit(False))))
    return marked.groupBy(*by).agg(((F.count("*") >= 2) & every).alias("pagination_demonstrated"))


def cursor_progress(requests: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """Whether a response's cursor differs from the last response's and from the request's."""
    before = F.lag("response_cursor").over(Window.partitionBy(*by).orderBy(seq))
    moved = requests.withColumn("previous_cursor", before)
    stuck = (F.col("response_cursor") == F.col("request_cursor")) | (F.col("response_cursor") == F.col("previous_cursor"))
    return moved.withColumn("cursor_changed", F.when(F.col("previous_cursor").isNotNull(), F.col("response_cursor") != F.col("previous_cursor"))).withColumn("cursor_stuck", F.coalesce(stuck, F.lit(False)))


def stops(requests: DataFrame, by: list[str], cap: int, seq: str = "seq") -> DataFrame:
    """Where cursor paging ends: an empty page, no cursor, one that stands still, the cap."""
    rows = cursor_progress(requests, by, seq)
    reached = F.sum("review_count").over(Window.partitionBy(*by).orderBy(seq)) >= cap
    reason = (
        F.when(F.col("review_count") == 0, "empty_page")
        .when(F.coalesce(F.col("response_cursor"), F.lit("")) == "", "no_cursor")
        .when(F.col("cursor_stuck"), "cursor_stuck")
        .when(reached, "cap")
    )
    return rows.withColumn("stop_reason", reason)


def page_status(requests: DataFrame) -> DataFrame:
    """The status of each requested page: status_code, success, parsed and review_count decide."""
    status = (
        F.when(~F.coalesce("success", F.lit(False)) & (F.col("page") > 1) & F.col("status_code").isin(400, 404), "pagination_limit_or_unavailable_page")
        .when(~F.coalesce("success", F.lit(False)), "request_failed")
        .when(~F.coalesce("parsed", F.lit(True)), "json_parse_error")
        .when(F.coalesce("review_count", F.lit(0)) == 0, "empty_page")
        .otherwise("ok")
    )
    return requests.withColumn("status", status)


def unreached_targets(targets: DataFrame, collected: DataFrame, limit: int, by: list[str]) -> DataFrame:
    """A ``target_limit_not_reached`` row for each target that holds fewer rows than its limit."""
    counts = collected.groupBy(*by).agg(F.count("*").alias("review_count"))
    joined = targets.join(counts, by, "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    return joined.where(F.col("review_count") < limit).withColumn("status", F.lit("target_limit_not_reached"))


def shortfall(batches: DataFrame, by: list[str] | None = None, errors: int = 0, parser_errors: int = 0) -> DataFrame:
    """Why a run fell short: the first kind of trouble, in order of weight, that its pages show."""
    def some(status):
        return F.coalesce(F.bool_or(F.col("status") == status), F.lit(False))

    fine = F.coalesce(F.bool_and(F.col("status").isNull() | F.col("status").isin("ok", "target_limit_not_reached", "final_dataset")), F.lit(True))
    reason = (
        F.when(some("pagination_limit_or_unavailable_page"), "page_depth_limited")
        .when(some("request_failed") | F.lit(errors > 0), "requests_failed")
        .when(some("json_parse_error") | F.lit(parser_errors > 0), "parse_errors")
        .when(some("empty_page"), "empty_pages")
        .when(fine, "targets_exhausted")
        .otherwise("configured_limits")
    )
    return batches.groupBy(*(by or [])).agg(reason.alias("shortfall_reason"))


def repeatability(rows: DataFrame, run: str = "run") -> DataFrame:
    """Runs, whether repetition is shown (two runs, none empty), and the overlap rate."""
    per = rows.groupBy(run).agg(F.count_if(has_id()).alias("ids"))
    runs = per.agg(F.count("*").alias("runs"), F.coalesce(F.bool_and(F.col("ids") > 0), F.lit(False)).alias("all_filled"))
    shared = run_overlap(rows, run=run).agg(F.count("*").alias("overlap_count"))
    distinct = rows.agg(F.countDistinct(F.when(has_id(), F.col("review_id"))).alias("distinct_ids"))
    joined = runs.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(distinct))  # one row each
    return joined.select("runs", ((F.col("runs") >= 2) & F.col("all_filled")).alias("repeated_collection_demonstrated"), "overlap_count", (F.col("overlap_count") / F.nullif(F.col("distinct_ids"), F.lit(0))).alias("overlap_rate"))
