"""What annotators said: agreement by weak label, crosstabs, topic relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the judgement columns may say.
SENTIMENTS = ["negative", "neutral", "positive"]
YES = "yes"
OVERALL = "Overall"


def agreement(sheet: DataFrame) -> DataFrame:
    """Rows, agreements and rate by weak label, and over all labels."""
    agrees = F.lower(F.trim("sentiment_agreement")) == YES
    counted = sheet.rollup("weak_sentiment_label").agg(F.count("*").alias("reviews"), F.count_if(agrees).alias("agreements"), F.grouping("weak_sentiment_label").alias("__all"))
    label = F.when(F.col("__all") == 1, OVERALL).otherwise(F.coalesce("weak_sentiment_label", F.lit("<missing>")))
    return counted.select(label.alias("weak_sentiment_label"), "reviews", "agreements", (F.col("agreements") / F.col("reviews")).alias("agreement_rate"))


def crosstab(sheet: DataFrame, values: list[str] = SENTIMENTS) -> DataFrame:
    """Weak labels against human ones; the columns are the allowed values."""
    counted = sheet.groupBy("weak_sentiment_label").pivot("human_sentiment", values).count()
    return counted.select("weak_sentiment_label", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def unclear_rate(sheet: DataFrame) -> DataFrame:
    unclear = F.count_if(F.lower(F.trim("mixed_or_unclear")) == YES)
    return sheet.agg(F.count("*").alias("reviews"), unclear.alias("mixed_or_unclear"), (unclear / F.count("*")).alias("mixed_or_unclear_rate"))


def topic_relevance(sheet: DataFrame) -> DataFrame:
    """Judgements of ``signal=value;signal=value`` lists, counted by signal and value."""
    entry = F.explode(F.split(F.coalesce("topic_signal_relevance", F.lit("")), ";")).alias("entry")
    parts = sheet.select(entry).where("trim(entry) <> ''").select(F.trim(F.split_part("entry", F.lit("="), F.lit(1))).alias("signal"), F.trim(F.split_part("entry", F.lit("="), F.lit(2))).alias("judgement"))
    return parts.groupBy("signal", "judgement").agg(F.count("*").alias("activations"))


def duplication_confirmed(sheet: DataFrame, prefix: str, judgement: str) -> DataFrame:
    """Of the flagged rows, how many annotators confirmed."""
    flagged = sheet.where(F.lower(F.col(prefix).cast("string")) == "true")
    return flagged.agg(F.count("*").alias("flagged"), F.count_if(F.lower(F.trim(judgement)) == YES).alias("confirmed"))
