"""The versioned rule set of the feature operators: loading and checking."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from .schema import TOPICS

# What a rule file must say literally.
SCOPE = ["source", "app_identifier", "country", "language"]
MISSING_FIELDS = ["review_title", "review_text", "rating", "review_date"]
DEFAULT_WORD = "[^\\W_]+(?:['’][^\\W_]+)*"
SECTIONS = ["rule_version", "reference_timestamp", "text_normalization", "word_count", "low_signal", "repeated_content", "missing_fields", "language_indicator", "topic_signal_keywords"]

# The rule set in force.
DEFAULT: dict[str, Any] = {
    "rule_version": "1.1.0",
    "reference_timestamp": "2026-07-07T00:00:00Z",
    "text_normalization": {"unicode_form": "NFKC", "casefold": True, "collapse_whitespace": True, "trim": True},
    "word_count": {"pattern": DEFAULT_WORD, "unicode_aware": True},
    "low_signal": {"minimum_review_text_characters": 15, "minimum_review_text_words": 3},
    "repeated_content": {"scope": SCOPE, "minimum_normalized_characters": 1, "fingerprint_algorithm": "sha256"},
    "missing_fields": {"fields": MISSING_FIELDS},
    "language_indicator": {"enabled": True, "supported_declared_languages": ["en"], "minimum_latin_letter_ratio": 0.70, "minimum_letters": 3},
    "topic_signal_keywords": {
        "login": ["login", "log in", "sign in", "password", "authentication"],
        "payment": ["payment", "pay", "charged", "billing", "credit card", "refund"],
        "performance": ["slow", "lag", "lagging", "crash", "crashes", "freezes", "performance"],
        "subscription": ["subscription", "subscribe", "renewal", "premium plan", "cancel subscription"],
        "delivery": ["delivery", "delivered", "shipping", "courier", "order arrived"],
        "customer_service": ["customer service", "customer support", "support team", "help desk", "representative"],
    },
}


@dataclass(frozen=True)
class Rules:
    version: str
    reference: datetime
    raw: dict[str, Any]

    @property
    def reference_text(self) -> str:
        return self.reference.isoformat().replace("+00:00", "Z")

    def section(self, name: str) -> dict[str, Any]:
        return self.raw[name]


def _mapping(raw: dict, name: str) -> dict:
    if not isinstance(raw[name], dict):
        raise ValueError(f"{name} must be a mapping")
    return raw[name]


def _demand(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _instant(value: Any) -> datetime:
    try:
        at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
    except ValueError:
        at = datetime.min
    _demand(at.tzinfo is not None, "reference_timestamp must be an ISO-8601 time with a zone")
    return at.astimezone(timezone.utc)


def check(raw: Any) -> Rules:
    """A rule set from parsed file content; ValueError names what is wrong with it."""
    _demand(isinstance(raw, dict), "a rule file holds a mapping")
    absent = sorted(set(SECTIONS) - set(raw))
    _demand(not absent, f"rule sections are missing: {', '.join(absent)}")
    version = str(raw["rule_version"]).strip()
    _demand(bool(version), "rule_version must not be blank")
    reference = _instant(raw["reference_timestamp"])
    _demand(_mapping(raw, "text_normalization").get("unicode_form") in ("NFC", "NFKC"), "unicode_form must be NFC or NFKC")
    pattern = str(_mapping(raw, "word_count").get("pattern", ""))
    _demand(bool(pattern.strip()), "word_count.pattern must not be blank")
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise ValueError(f"word_count.pattern does not compile: {wrong}") from wrong
    low = _mapping(raw, "low_signal")
    for key in ("minimum_review_text_characters", "minimum_review_text_words"):
        _demand(isinstance(low.get(key), int) and low[key] >= 0, f"low_signal.{key} must be an integer of at least 0")
    repeated = _mapping(raw, "repeated_content")
    _demand(repeated.get("scope") == SCOPE, f"repeated_content.scope must be {SCOPE}")
    _demand(repeated.get("fingerprint_algorithm") == "sha256", "the fingerprint algorithm must be sha256")
    _demand(_mapping(raw, "missing_fields").get("fields") == MISSING_FIELDS, f"missing_fields.fields must be {MISSING_FIELDS}")
    language = _mapping(raw, "language_indicator")
    ratio, letters = language.get("minimum_latin_letter_ratio"), language.get("minimum_letters")
    _demand(isinstance(ratio, (int, float)) and 0 <= ratio <= 1, "minimum_latin_letter_ratio must lie within 0 and 1")
    _demand(isinstance(letters, int) and letters >= 1, "minimum_letters must be an integer of at least 1")
    topics = _mapping(raw, "topic_signal_keywords")
    for topic in TOPICS:
        words = topics.get(topic)
        _demand(isinstance(words, list) and words and all(str(w).strip() for w in words), f"topic {topic} needs a list of keywords, none blank")
    return Rules(version, reference, raw)


def load(path: str | Path) -> Rules:
    """Rules of a YAML or JSON file."""
    file = Path(path)
    _demand(file.exists(), f"no rule file at {file}")
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        return check(json.loads(text))
    import yaml

    return check(yaml.safe_load(text))


def default() -> Rules:
    return check(DEFAULT)
