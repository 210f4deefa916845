"""Personal data: patterns propose, checksums confirm, context words adjust.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches per
kind, kept when their check holds; they carry scores but are never dropped for
one. Further kinds are proposed by patterns too and must reach ``min_score``: IBANs that
pass mod 97 do, whatever stands nearby; secrets do unless a word nearby speaks against
them; national numbers, which have no checksum, only with a word that speaks for them. An
IBAN may end at every token end up to 34 characters on, so words and numbers that follow
it do not hide it.

A document is handled alone, in one pass over Arrow batches: no shuffle, and a
worker holds one batch. Every pattern is linear in the text: starts are anchored
at run starts and quantifiers do not give back what they took (or, in an IBAN, give
back at most 19 characters), so a text of one endless run costs no more than any other.

Defined cases: a null text is empty and has no span; offsets count code points;
repeated rows give repeated results; null ids are kept; empty tables give nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "ssn")
KINDS = BASE + ADDED
#: The least score at which a span of an added kind is reported.
MIN_SCORE = 0.6
#: Code points on either side in which context words count.
CONTEXT = 40

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where an IBAN may start, and as far as the longest may reach; its end is sought inside.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ALNUM = re.compile("[A-Za-z0-9]")
SECRET = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?([^\s,;\"']{6,})", re.I)
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        line.split(":")
        for line in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
            "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV",
            "29:BR EG PS QA UA", "30:JO KW MU", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}
# Words that make a kind likelier when they stand nearby.
WORDS = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "secret": ("login", "credential", "account", "user"),
    "ssn": ("ssn", "social", "security", "tax"),
}
# Words that make a kind unlikelier when they stand nearby.
AGAINST = {
    "email": ("example", "placeholder"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "invoice", "tracking", "serial", "isbn"),
    "phone": ("order", "invoice", "serial", "part"),
    "iban": ("example", "sample"),
    "secret": ("example", "placeholder", "dummy", "sample", "forgot", "reset"),
    "ssn": ("order", "invoice", "part", "serial", "model"),
}
# Score of a confirmed proposal before its context counts, and what a word for or
# against it adds or takes.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.7, "ssn": 0.5}
NEARBY = 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, from each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(LOCAL))
        if local and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield at - local, end
        elif not local or not m:
            # The run before this @ can serve no later one: an @ ends it.
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start, 15 to 34 characters that end a token and pass mod 97.

    The country's own length is tried first, then all others from the longest, so a
    following word or number is taken in only where nothing else passes.
    """
    at = 0
    while m := IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        ends = []
        while end > start and len(number := text[start:end].replace(" ", "")) >= 15:
            if not ALNUM.match(text, end):
                ends.append((len(number) != IBAN_LENGTHS.get(number[:2]), -end, number))
            end -= 2 if text[end - 2] == " " else 1
        for _, end, number in sorted(ends):
            if mod97(number):
                at = -end
                yield start, at
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, each kind from left to right."""
    for s, e in emails(text):
        yield "email", s, e
    digits = any(c in text for c in "0123456789")
    if digits:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield "ip", m.start(), m.end()
        for m in CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(number) <= 19 and luhn(number):
                yield "card", m.start(), m.end()
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    yield "phone", m.start(), m.end()
        for s, e in ibans(text):
            yield "iban", s, e
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            yield "secret", m.start(1), m.end(1)
    if digits and "-" in text:
        for m in SSN.finditer(text):
            area, group, serial = m.group().split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", m.start(), m.end()


def speaks(words: tuple[str, ...], around: str) -> bool:
    return any(w in around and re.search(rf"\b{w}", around) for w in words)


def spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of KINDS, then start."""
    out = []
    for kind, start, end in proposals(text or ""):
        around = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
        score = round(min(1.0, SCORES[kind] + NEARBY * (speaks(WORDS[kind], around) - speaks(AGAINST[kind], around))), 2)
        if kind in BASE or score >= min_score:
            out.append((kind, start, end, score))
    return out


SPAN = "struct<kind:string,start:long,end:long,score:double>"


def find(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Per document: doc_id and ``pii``, an array of (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t.as_py(), min_score)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "pii"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, pii array<{SPAN}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans and their scores as text."""
    def joined(keep):
        return F.array_join(F.transform(F.filter("pii", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"), scores.alias("scores"))


def redact_text(text: str | None, min_score: float = MIN_SCORE) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; overlaps merge."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans(text, min_score)):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs``, all columns, with personal data replaced in ``text``."""
    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            yield pa.array([redact_text(t, min_score) for t in texts], pa.string())

    return docs.withColumn("text", clean(F.col("text").cast("string")))
