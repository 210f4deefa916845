"""Column functions of the review operators."""

from .numbers import safe_double, safe_long
from .text import blank_to_null, casefolded, is_present, normalized, script_consistent, topic_signal, weak_sentiment, word_count
from .times import strict_timestamp

__all__ = ["blank_to_null", "casefolded", "is_present", "normalized", "register", "safe_double", "safe_long", "script_consistent", "strict_timestamp", "topic_signal", "weak_sentiment", "word_count"]


def register(spark) -> None:
    """All functions under SQL names: those of ``sql`` as SQL text, the normaliser and the HTML parsers in Python."""
    from ..operators.html_reviews import html_reviews
    from .sql import register_sql
    from .text import casefold_udf, normalizer

    spark.udf.register("normalize_review_text", normalizer("NFKC", True, True, True))
    spark.udf.register("casefold_text", casefold_udf)
    spark.udtf.register("parse_review_html", html_reviews)
    register_sql(spark)
