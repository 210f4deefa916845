"""A deterministic, coverage-first sample for annotation, and duplicate peers.

Candidates are ranked by a hash of their identity. The sample takes (a) for each
stratum the best-ranked candidate not taken yet, (b) classes in turn, (c) the rest by
rank. Only (a) is sequential: its choices depend on one another. They are made on the
driver over the best few candidates of each stratum (as many as there are strata,
since each earlier stratum takes one at most), and (b) and (c) have a closed form: order
by the place within the class, then by class, then by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefolded, is_present
from ..schema import TOPIC_COLUMNS
from ..session import cut
from .features import APP_FIELDS, require

SIZE = 135
# What a stratum is made of, the order of classes, the columns of a sample.
VALUE_STRATA = ["weak_sentiment_label", "app_name", "country"]
FLAG_STRATA = ["low_signal_text", "repeated_full_content", "repeated_review_body", *TOPIC_COLUMNS]
CLASSES = ["negative", "neutral", "positive"]
IDENTITY = ["source", "app_name", "country", "review_id"]


def as_bool(col: Column) -> Column:
    """A flag as files carry it: a boolean, or a text that says true."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))) == "true", F.lit(False))


def stable_rank() -> Column:
    """Hex digest of the identity; absent parts read ``nan``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in IDENTITY]
    return F.sha2(F.concat_ws("|", *parts), 256)


def ranked(features: DataFrame) -> DataFrame:
    """Candidates with ``__rank``, unique: ties go by a digest of the text, then any way."""
    return features.withColumn("__rank", F.concat(stable_rank(), F.sha2(F.concat_ws("|", F.col("review_title"), F.col("review_text"), F.col("rating").cast("string")), 256)))


def strata(candidates: DataFrame, depth: int) -> DataFrame:
    """(field, value, __rank): the ``depth`` best of each stratum.

    A stratum's best are kept by a bounded minimum first, per slice of the ranks, so no
    stratum is sorted whole in one task.
    """
    values = [F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(VALUE_STRATA)]
    flags = [F.struct(F.lit(len(VALUE_STRATA) + i).alias("field"), F.when(as_bool(F.col(c)), "true").alias("value")) for i, c in enumerate(FLAG_STRATA)]
    long = candidates.select("__rank", F.explode(F.array(*values, *flags)).alias("s")).select("s.field", "s.value", "__rank").where("value is not null")
    slices = Window.partitionBy("field", "value", F.substring("__rank", 1, 2)).orderBy("__rank")
    few = long.withColumn("__n", F.row_number().over(slices)).where(F.col("__n") <= depth)
    best = Window.partitionBy("field", "value").orderBy("__rank")
    return few.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= depth).drop("__n")


def seeds(candidates: DataFrame, size: int) -> list[str]:
    """Ranks taken for coverage, in order; at most one per stratum."""
    first = strata(candidates, 1).groupBy("field", "value").agg(F.min("__rank").alias("first"))
    # A stratum gives a pick unless all its rows, at most ``size``, are picked: so many suffice.
    enough = 2 * size + len(VALUE_STRATA) + len(FLAG_STRATA)
    order = [(r["field"], r["first"], r["value"]) for r in first.orderBy("field", "first").limit(enough).collect()]
    depth = min(len(order), size)
    pools: dict[tuple, list[str]] = {}
    for r in strata(candidates, max(1, depth)).orderBy("__rank").collect():
        pools.setdefault((r["field"], r["value"]), []).append(r["__rank"])
    taken: list[str] = []
    for field, _, value in order:
        if len(taken) >= size:
            break
        free = next((x for x in pools.get((field, value), []) if x not in set(taken)), None)
        if free is not None:
            taken.append(free)
    return taken


def picks(candidates: DataFrame, size: int) -> DataFrame:
    """(``__order``, ``__pick``): the ranks that make the sample, at most ``size`` rows.

    ``candidates`` is slim: ranks, strata and labels.
    """
    spark = candidates.sparkSession
    taken = seeds(candidates, size)
    seeded = spark.createDataFrame([(i, r) for i, r in enumerate(taken)], "__order long, __pick string")
    label = F.col("weak_sentiment_label")
    kind = F.when(label == CLASSES[0], 0).when(label == CLASSES[1], 1).when(label == CLASSES[2], 2).otherwise(3)
    left = candidates.join(F.broadcast(seeded), F.col("__rank") == F.col("__pick"), "left_anti").withColumn("__class", kind)
    best = Window.partitionBy("__class", F.substring("__rank", 1, 2)).orderBy("__rank")
    few = left.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= size)
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy("__class").orderBy("__rank")))
    # Unlabelled rows come after all classes, by rank.
    turn = [F.when(F.col("__class") < 3, 0).otherwise(1), F.col("__n"), F.col("__class"), F.col("__rank")]
    few = few.orderBy(*turn).limit(size - len(taken))
    rest = few.select((F.lit(len(taken)) + F.row_number().over(Window.orderBy(*turn)) - 1).cast("long").alias("__order"), F.col("__rank").alias("__pick"))
    return seeded.unionByName(rest)


def sample(features: DataFrame, size: int = SIZE) -> DataFrame:
    """The sample in its order (``__order``), feature columns kept.

    The choice is made on slim rows, made once; the features are read once more for the
    rows chosen.
    """
    if size < 1:
        raise ValueError("the sample size must be positive")
    require(features, [*IDENTITY, "rating", "review_title", "review_text", *VALUE_STRATA, *FLAG_STRATA])
    candidates = ranked(features)
    chosen = picks(cut(candidates.select("__rank", *VALUE_STRATA, *FLAG_STRATA).dropDuplicates(["__rank"])), size)  # a repeated row is one candidate
    found = candidates.join(F.broadcast(chosen), F.col("__rank") == F.col("__pick"))  # at most ``size`` rows
    return found.drop("__pick").dropDuplicates(["__rank"])


def peers(flagged: DataFrame, candidates: DataFrame, prefix: str, by: str = "__rank") -> DataFrame:
    """For each flagged row the first other row of equal content and scope.

    Scope is source, app (the row's first present identifier), country and language,
    trimmed and case-folded, absent ones equal. The flagged side is a sample, so it is
    the broadcast one: at most its size in rows.
    """
    print_column = f"{prefix}_fingerprint"
    app = F.coalesce(*[F.when(is_present(F.col(c)), F.lit(c)) for c in APP_FIELDS])
    mine = flagged.where(as_bool(F.col(prefix)) & F.col(print_column).isNotNull()).select(
        F.col(by).alias("__of"),
        F.col("review_id").alias("__id"),
        F.col(print_column).alias("__print"),
        *[casefolded(F.col(c)).alias(f"__my_{c}") for c in ("source", "country", "language", *APP_FIELDS)],
        app.alias("__app_field"),
    )
    others = candidates.where(F.col(print_column).isNotNull()).select(
        by, "review_id", "review_title", "review_text", F.col(print_column).alias("__other"), *[casefolded(F.col(c)).alias(f"__o_{c}") for c in ("source", "country", "language", *APP_FIELDS)]
    )
    same = [F.col("__print") == F.col("__other"), ~F.col("review_id").eqNullSafe(F.col("__id"))]
    same += [F.col(f"__my_{c}") == F.col(f"__o_{c}") for c in ("source", "country", "language")]
    same += [F.coalesce(F.col("__app_field") != c, F.lit(True)) | (F.col(f"__my_{c}") == F.col(f"__o_{c}")) for c in APP_FIELDS]
    met = others.join(F.broadcast(mine), same)
    least = F.min_by(F.struct("review_id", "review_title", "review_text"), F.col(by))
    return met.groupBy("__of").agg(least.alias("p")).select(F.col("__of").alias(by), F.col("p.review_id").alias(f"{prefix}_example_review_id"), F.coalesce("p.review_title", F.lit("")).alias(f"{prefix}_example_title"), F.coalesce("p.review_text", F.lit("")).alias(f"{prefix}_example_body"))


def annotation_sheet(features: DataFrame, size: int = SIZE) -> DataFrame:
    """The sample as annotators get it, with peers and blank judgement columns."""
    candidates = ranked(features)
    out = sample(features, size)
    blank = F.lit("")
    sheet = out
    for prefix in ("repeated_full_content", "repeated_review_body"):
        sheet = sheet.join(peers(out, candidates, prefix), "__rank", "left")
    examples = [f"{p}_example_{c}" for p in ("repeated_full_content", "repeated_review_body") for c in ("review_id", "title", "body")]
    return sheet.orderBy("__order").select(
        F.lit("pending").alias("annotation_status"),
        "review_id",
        F.col("app_name").alias("app"),
        F.col("country").alias("storefront"),
        "rating",
        "weak_sentiment_label",
        "review_title",
        "review_text",
        *FLAG_STRATA,
        *[F.coalesce(c, blank).alias(c) for c in examples],
        *[blank.alias(c) for c in ("human_sentiment", "sentiment_agreement", "mixed_or_unclear", "topic_signal_relevance", "full_content_duplication_judgment", "review_body_duplication_judgment")],
    )
