"""Text columns: presence, normalisation, counts, scripts, topics, weak labels.

Text of common letters (``PLAIN``) is normalised in the JVM. Only other text crosses to
Python, where Unicode normalisation and case folding live: the Python side gets null for
plain rows, so a mostly plain corpus ships next to nothing. What does cross stays in Arrow,
a few texts at a time apart, so a task's Python holds a batch's bytes and no objects of it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import DEFAULT_WORD, Rules
from .numbers import safe_double

#: White space as str.split() has it: Unicode white space and U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
EDGES = rf"(?U)^{SPACE}+|{SPACE}+$"
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
#: The default word pattern in Java's terms.
JAVA_WORD = rf"{LETTER_OR_DIGIT}++(?:['’]{LETTER_OR_DIGIT}++)*+"
#: ASCII white space that is not one plain space already.
ODD_SPACE = r"[\x09-\x0d\x1c-\x1f\x20]{2,}|[\x09-\x0d\x1c-\x1f]"

#: Characters that NFC and NFKC leave alone, that combine with none of their kind, and whose case
#: folding is their lower case, ``ß`` apart: ASCII, Latin and Cyrillic letters, common
#: punctuation, kana, common ideographs, Hangul syllables.
PLAIN = r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u012f\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u045f\u2012-\u2015\u2018-\u2022\u20ac\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Texts that leave Arrow together.
PIECE = 64


def is_present(col: Column) -> Column:
    """Neither null nor NaN nor blank."""
    text = col.cast("string")
    return F.coalesce((text != "NaN") & text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(is_present(col), col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGES, "")


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def is_plain(col: Column) -> Column:
    # The range in front spares ASCII characters the walk through the others.
    return is_ascii(col) | ~col.rlike(rf"[\x{{80}}-\x{{10ffff}}&&[^{PLAIN}]]")


def lowered(col: Column) -> Column:
    """The case folding of plain text."""
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def text_by_text(f, returns: T.DataType):
    """An Arrow function of one text, null for null."""
    kind, size = {"string": pa.string(), "bigint": pa.int64()}[returns.simpleString()], PIECE

    @F.arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return pa.nulls(len(texts), kind)
        pieces = (texts.slice(i, size).to_pylist() for i in range(0, len(texts), size))
        return pa.concat_arrays([pa.array([None if t is None else f(t) for t in piece], kind) for piece in pieces])

    return run


@cache
def normalizer(form: str, fold: bool, collapse: bool, trim: bool):
    """The Arrow function that does what the JVM has no built-in for."""

    def clean(text):
        text = unicodedata.normalize(form, text)
        text = text.casefold() if fold else text
        text = " ".join(text.split()) if collapse else text
        return text.strip() if trim else text

    return text_by_text(clean, T.StringType())


casefold_udf = text_by_text(lambda text: text.strip().casefold(), T.StringType())


def normalized(col: Column, rules: Rules) -> Column:
    """Text for matching and counting; empty where there is none."""
    how = rules.section("text_normalization")
    fold, collapse, trim = (bool(how.get(k, True)) for k in ("casefold", "collapse_whitespace", "trim"))
    text = F.coalesce(blank_to_null(col).cast("string"), F.lit(""))
    plain = lowered(text) if fold else text
    if collapse:
        plain = F.trim(F.regexp_replace(plain, ODD_SPACE, " "))
    elif trim:
        plain = strip(plain)
    # Null from Python stands for a text that did not go there.
    return F.coalesce(normalizer(how["unicode_form"], fold, collapse, trim)(F.when(~is_plain(text), text)), plain)


def casefolded(col: Column) -> Column:
    """Scope keys: trimmed and case-folded, without Unicode normalisation."""
    text = F.coalesce(blank_to_null(col).cast("string"), F.lit(""))
    # Never null, and the optimizer knows: as a join key it then needs no filter that would
    # evaluate the function once more.
    return F.coalesce(casefold_udf(F.when(~is_plain(text), text)), lowered(strip(text)), F.lit(""))


def word_count(text: Column, rules: Rules) -> Column:
    """Matches of the rules' word pattern; patterns other than the default run as Python's."""
    pattern = str(rules.section("word_count")["pattern"])
    if pattern == DEFAULT_WORD:
        return F.regexp_count(text, F.lit(JAVA_WORD)).cast("long")

    word = re.compile(pattern)
    count = text_by_text(lambda t: sum(1 for _ in word.finditer(t)), T.LongType())
    return F.coalesce(count(text), F.lit(0))


def script_consistent(text: Column, language: Column, rules: Rules) -> Column:
    """Whether a text in a supported language is mostly Latin; null if that can't be told.

    ASCII letters are Latin, so an ASCII text needs no count: it is asked for the least
    number of letters only, which a few characters answer.
    """
    how = rules.section("language_indicator")
    if not how.get("enabled", True):
        return F.lit(None).cast("boolean")
    least, ratio = int(how["minimum_letters"]), float(how["minimum_latin_letter_ratio"])
    base = F.split_part(F.lower(strip(language.cast("string"))), F.lit("-"), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]+|\p{N}+", ""))
    enough = text.rlike(rf"[A-Za-z](?:[^A-Za-z]*+[A-Za-z]){{{least - 1}}}")
    asked = is_present(language) & base.isin(list(how["supported_declared_languages"]))
    plain = F.when(enough, F.lit(True))
    other = F.when(letters >= least, latin / letters >= ratio)
    return F.when(asked, F.when(is_ascii(text), plain).otherwise(other))


def topic_pattern(keywords: list[str]) -> str:
    """Any keyword as a whole token or phrase, in Java's terms."""
    quoted = [r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in keyword.split()) for keyword in keywords]
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(quoted)})(?![\p{{L}}\p{{N}}_])"


def topic_signal(text: Column, topic: str, rules: Rules) -> Column:
    """Keywords are looked for as substrings first: most texts hold none and skip the pattern."""
    form = rules.section("text_normalization")["unicode_form"]
    fold = rules.section("text_normalization").get("casefold", True)
    words = [unicodedata.normalize(form, str(k)) for k in rules.section("topic_signal_keywords")[topic]]
    words = [w.casefold() if fold else w for w in words]
    maybe = reduce(lambda a, b: a | b, [text.contains(max(w.split(), key=len)) for w in words])
    return maybe & text.rlike(topic_pattern(words))


def weak_sentiment(rating: Column) -> Column:
    """A label from the rating alone; null between the classes and outside the scale."""
    value = safe_double(rating)
    return F.when(value.between(1, 2), "negative").when(value == 3, "neutral").when(value.between(4, 5), "positive")
