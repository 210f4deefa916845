"""Mixing sources to target weights with a time-varying curriculum.

Every source has a piecewise-linear weight schedule over training time [0, 1].
Its integral is the source's weight; its normalised running integral says which
share of the source's words has been demanded by time t. Targets share all words
by weight, stop at ``cap`` times the source's size, and the excess is reshared
(water filling, in closed form over one row per source). A document's place in
its source's word stream, inverted through that running integral, is its training
position; the result is range-sorted by position.

Everything is DataFrame expressions. The running word count of a source is never
one window over that source: documents fall into buckets by a hash of id and text, bucket
totals give each bucket's start, and windows run inside buckets, so a source with
a third of all rows spreads like any other, and so do rows without an id or of one id.

Defined cases: null or blank text has size 0 and takes nothing; a null source is
one source, ordered last; a null id is kept; repeated rows count separately and
each gets its own place; a source whose words are all missing gets target 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, power_of_two

#: Knots (time, weight) of the default schedules; their integrals are 1, 2 and 3.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (1.0, 4.5)),
)
#: Documents a bucket holds on average, so a window's sort stays small.
BUCKET_ROWS = 20_000
HASH_VALUES = 65_536


def integral(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _segments(knots) -> list[tuple]:
    """(time, length, weight at its start, at its end, integral before it)."""
    out, before = [], 0.0
    for a, b in zip(knots, knots[1:]):
        out.append((a[0], b[0] - a[0], a[1], b[1], before))
        before += (b[0] - a[0]) * (a[1] + b[1]) / 2
    return out


def position_of(share: Column, kind: Column, schedules) -> Column:
    """The time at which a schedule has met ``share`` of its whole integral."""
    chosen = None
    for i, knots in enumerate(schedules):
        need = share * F.lit(integral(knots))
        at = None
        for t, length, a, b, before in _segments(knots):
            rest = need - F.lit(before)
            root = F.sqrt(F.lit(a * a) + F.lit(2 * (b - a) / length) * rest)
            here = F.lit(t) + F.when(F.lit(a) + root > 0, F.lit(2.0) * rest / (F.lit(a) + root)).otherwise(F.lit(0.0))
            at = here if at is None else F.when(need >= F.lit(before), here).otherwise(at)
        chosen = F.when(kind == i, at) if chosen is None else chosen.when(kind == i, at)
    return chosen


def source_targets(sizes: DataFrame, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """``sizes`` (source, source_size), one row each, with kind, weight and target."""
    weights = F.array(*[F.lit(float(integral(k))) for k in schedules])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    everything = Window.partitionBy()
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("kind", (F.col("rank") - 1) % len(schedules))
        .withColumn("weight", F.element_at(weights, (F.col("kind") + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.sum("cap").over(by_need) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("capped_before")) / F.col("weight_left")).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "kind", "target")
    )


def _place(docs: DataFrame, schedules, cap: int, carry: tuple[str, ...]) -> DataFrame:
    """Every document's place in the mix; working columns start with two underscores."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("__id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("__key"),
        *[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    sized = sized if carry else cut(sized)  # slim rows are kept; texts are read again instead
    buckets = power_of_two(sized.count() / BUCKET_ROWS, 64, HASH_VALUES)
    sized = sized.withColumn("bucket", (F.conv(F.substring("__key", 1, 4), 16, 10).cast("int") / (HASH_VALUES // buckets)).cast("int"))
    totals = cut(sized.groupBy("source", "bucket").agg(F.sum("__size").alias("bucket_size")))
    targets = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedules, cap)
    starts = totals.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "before", "source_size", "kind", "target")
    placed = sized.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    placed = placed.select("d.*", F.col("s.before").alias("__before"), F.col("s.source_size").alias("__source_size"), F.col("s.kind").alias("__kind"), F.col("s.target").alias("__target"))
    inside = Window.partitionBy("source", "bucket").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.floor(F.col("__target") + F.lit(0.5))
    left = words - F.col("__copies") * F.col("__source_size") - F.col("__begin")
    return (
        placed.withColumn("__begin", F.col("__before") + F.sum("__size").over(inside) - F.col("__size"))
        .withColumn("__copies", F.when(F.col("__source_size") > 0, F.floor(words / F.col("__source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("__cut", F.greatest(F.lit(0), F.least(F.col("__size"), left)).cast("long"))
        .withColumn("__taken", F.col("__copies") * F.col("__size") + F.col("__cut"))
        .withColumn("__position", F.when(F.col("__taken") > 0, position_of(F.col("__begin") / F.col("__target"), F.col("__kind"), schedules)))
    )


def mix(docs: DataFrame, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """Per document: size, source_size, target, taken, copies, cut and position.

    ``taken`` counts words with repeats: ``copies`` whole passes, and ``cut`` words
    of one more pass, which only the document at the source's end takes in part.
    ``position`` is the first pass's training time, null where nothing is taken.
    """
    names = ("size", "source_size", "target", "taken", "copies", "cut", "position")
    placed = _place(docs, schedules, cap, ()).orderBy(F.col("__position").asc_nulls_last(), "__id")
    return placed.select(F.col("__id").alias("doc_id"), "source", *[F.col(f"__{n}").alias(n) for n in names])


def materialise(docs: DataFrame, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """``docs`` as mixed, all columns: a row for each whole pass and one for a part.

    Rows are range-sorted by their own training positions. A part is the text up to
    the end of its last word; ``n_chars``, where there is one, follows the text.
    """
    carried = {c: F.col(f"__carry_{i}") for i, c in enumerate(docs.columns)}
    placed = _place(docs, schedules, cap, tuple(docs.columns))
    passes = F.concat(F.array_repeat(F.lit(False), F.col("__copies").cast("int")), F.when(F.col("__cut") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = placed.where("__taken > 0").select("*", F.posexplode(passes).alias("__pass", "__part"))
    at = (F.col("__pass") * F.col("__source_size") + F.col("__begin")) / F.col("__target")
    out = out.orderBy(position_of(at, F.col("__kind"), schedules), "__id")
    words = F.regexp_extract_all(carried["text"], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("__cut").cast("int")), "")
    text = F.when(F.col("__part") & (F.col("__cut") < F.col("__size")), part).otherwise(carried["text"])
    made = carried | {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in carried else {})
    return out.select(*[made[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS key
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) AS kind FROM src),
weighed AS (SELECT *, CAST(kind + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, kind, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS DOUBLE)
     / sum(weight) OVER (ORDER BY cap / weight, kind, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, kind, least(CAST(cap AS DOUBLE), (max(level) OVER ()) * weight) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
     CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begin_at
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS copies FROM placed),
taken AS (
  SELECT *, CAST(copies * size + greatest(0, least(size, words - copies * source_size - begin_at)) AS BIGINT) AS taken,
     begin_at / target AS share FROM taking)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
  round(CASE WHEN taken > 0 THEN CASE kind
    WHEN 0 THEN 2.0 * share * 1.0 / (1.5 + sqrt(2.25 - 2.0 * share * 1.0))
    WHEN 1 THEN 2.0 * share * 2.0 / (2.0 + sqrt(4.0 + 0.0 * share * 2.0))
    ELSE 2.0 * share * 3.0 / (1.5 + sqrt(2.25 + 6.0 * share * 3.0)) END END, 9) AS position
FROM taken
"""
