"""Exact medians by selection: histograms narrow the range, only what is left is ranked.

A group's median lies in a range of values that counts can narrow without ordering anything:
the range is cut into ``BINS`` parts, the rows of each are counted, and the parts that hold
the middle rows become the next range, with the least and greatest value in them as its ends.
When a range holds at most ``RANKED`` rows, or one value, its values are counted each and the
middle ones picked. All groups and columns are narrowed together; no aggregate holds more than
``BINS`` counts of a group and column, whatever the number of distinct values.

Parts are of equal width on a scale that is linear near zero and logarithmic far from it, so
an outlier costs no more rounds than there are digits of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS = 512
#: Rows of a range that are counted by value.
RANKED = 4096
#: Infinite and NaN lie beyond the scale of any number; NaN is the greatest, as in Spark's order.
_FAR, _NAN = 800.0, 900.0


def scale(value: Column) -> Column:
    """A place on the scale: larger values are never before smaller ones."""
    place = F.asinh(value)
    return F.when(F.isnan(value), F.lit(_NAN)).when(F.abs(place) > _FAR, F.signum(value) * _FAR).otherwise(place)


def same_group(by: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]


def in_range(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """(group, c, v) of the values in their groups' ranges; a group's ranges meet each row once, as one array."""
    wide = ranges.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("low", "high").alias("r")))).alias("__r"))
    joined = values.join(wide, same_group(by)) if by else values.crossJoin(F.broadcast(wide))  # one row
    kept = F.filter("values", lambda x: (x["v"] >= F.col("__r")[x["c"]]["low"]) & (x["v"] <= F.col("__r")[x["c"]]["high"]))
    return joined.select(*by, F.inline(kept))


def narrowed(values: DataFrame, ranges: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Each range cut down to the parts that hold its middle rows."""
    ends = ranges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("c").alias("__c"), scale(F.col("low")).alias("at"), (scale(F.col("high")) - scale(F.col("low"))).alias("width"), "before", "first", "last")
    inside = in_range(values, ranges, by)
    met = inside.join(ends, [*same_group(by), F.col("c") == F.col("__c")])
    part = F.least(F.floor((scale(F.col("v")) - F.col("at")) / F.col("width") * bins), F.lit(bins - 1)).cast("int")
    counted = met.groupBy(*by, "c", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.any_value("before").alias("before"), F.any_value("first").alias("first"), F.any_value("last").alias("last"))
    running = Window.partitionBy(*by, "c").orderBy("part")  # at most ``bins`` rows
    placed = counted.withColumn("until", F.col("before") + F.sum("n").over(running)).withColumn("start", F.col("until") - F.col("n"))
    middle = placed.where((F.col("until") > F.col("first")) & (F.col("start") <= F.col("last")))
    return middle.groupBy(*by, "c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("start").alias("before"), F.sum("n").alias("n"), F.any_value("first").alias("first"), F.any_value("last").alias("last"))


def medians(rows: DataFrame, by: list[str], columns: list[str], bins: int = BINS, ranked: int = RANKED) -> DataFrame:
    """``by`` and the median of each column (null where it has no value), a row per group.

    ``rows`` is read several times: hand in a table or a checkpoint. Null keys are groups of
    their own; null values do not count.
    """
    given, by = by, [f"__g{i}" for i in range(len(by))]  # whatever the keys' names, they clash with none used here
    keys = [F.col(c).alias(g) for c, g in zip(given, by)]
    values = rows.select(*keys, F.filter(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]), lambda x: x["v"].isNotNull()).alias("values"))
    wide = rows.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"__{name}{i}") for i, c in enumerate(columns) for name, f in (("n", F.count), ("low", F.min), ("high", F.max))])
    wide = cut(wide)
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"__low{i}").alias("low"), F.col(f"__high{i}").alias("high"), F.col(f"__n{i}").alias("n")) for i in range(len(columns))])
    ranges = wide.select(*by, F.inline(each)).where("n > 0")
    ranges = cut(ranges.select(*by, "c", "low", "high", F.lit(0).cast("long").alias("before"), "n", F.floor((F.col("n") - 1) / 2).alias("first"), F.floor(F.col("n") / 2).alias("last")))
    done = []
    while True:
        # Values that the scale can't tell apart are few, and are counted by value.
        wanting = (F.col("n") > ranked) & (scale(F.col("low")) < scale(F.col("high")))
        done.append(ranges.where(~wanting))
        still = ranges.where(wanting)
        if still.isEmpty():
            break
        ranges = cut(narrowed(values, still, by, bins))
    final = reduce(DataFrame.unionByName, done)
    counted = in_range(values, final, by).groupBy(*by, "c", "v").agg(F.count("*").alias("k"))
    ends = final.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("c").alias("__c"), "before", "first", "last")
    until = F.sum("k").over(Window.partitionBy(*by, "c").orderBy("v"))
    placed = counted.withColumn("until", until).join(ends, [*same_group(by), F.col("c") == F.col("__c")]).withColumn("until", F.col("until") + F.col("before"))

    def at(place: str) -> Column:
        return F.min(F.when(F.col("until") > F.col(place), F.col("v")))

    found = placed.groupBy(*by, "c").agg(((at("first") + at("last")) / 2).alias("m"))
    pivoted = found.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*[F.max(F.when(F.col("c") == i, F.col("m"))).alias(f"__m{i}") for i in range(len(columns))])
    whole = wide.select(*by).join(pivoted, same_group(by), "left") if by else pivoted
    return whole.select(*[F.col(g).alias(c) for c, g in zip(given, by)], *[F.col(f"__m{i}").alias(c) for i, c in enumerate(columns)])
