"""Application configuration: defaults, clamps, targets, credentials from the environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any
from urllib.parse import quote

# Limits within which a configuration is kept.
MAX_REVIEWS_PER_ITEM, MIN_DELAY = 100, 1.0
MAX_STEAM_PAGE, MAX_GOOGLE_BATCH, MAX_APPLE_PAGE = 50, 100, 100
MAX_PER_TARGET, MAX_TOTAL, MAX_PAGES_PER_TARGET = 10_000, 50_000, 100
# How placeholders begin, the feeds' addresses; the classes' defaults are fixed too.
PLACEHOLDERS = {"steam": "STEAM_APP_ID", "amazon": "AMAZON_REVIEW_URL", "apple": "APPLE_APP_ID"}
STEAM_URL = "https://store.steampowered.com/appreviews/{app}?json=1&filter=recent&"
APPLE_URL = "https://itunes.apple.com/{country}/rss/customerreviews/page={page}/id={app}/sortby=mostrecent/json?l={language}"


def clamp(value: Any, low: int | None, high: int | None = None) -> int:
    number = int(value)
    number = number if low is None else max(low, number)
    return number if high is None else min(high, number)


@dataclass(frozen=True)
class Assessment:
    max_reviews_per_item: int = 100
    max_pages_per_item: int = 5
    request_delay_seconds: float = 1.5
    request_timeout_seconds: float = 20.0
    repeat_runs: int = 2

    @classmethod
    def of(cls, raw: dict) -> Assessment:
        got = asdict(cls()) | {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        return cls(
            clamp(got["max_reviews_per_item"], None, MAX_REVIEWS_PER_ITEM),
            clamp(got["max_pages_per_item"], 1),
            max(MIN_DELAY, float(got["request_delay_seconds"])),
            float(got["request_timeout_seconds"]),
            clamp(got["repeat_runs"], 1),
        )


def _texts(values: Any) -> tuple[str, ...]:
    return tuple(str(v) for v in values or [] if str(v).strip())


@dataclass(frozen=True)
class Steam:
    enabled: bool = True
    app_ids: tuple[str, ...] = ()
    language: str = "english"
    review_type: str = "all"
    purchase_type: str = "all"
    reviews_per_page: int = 20

    @classmethod
    def of(cls, raw: dict) -> Steam:
        got = asdict(cls()) | raw
        return cls(bool(got["enabled"]), _texts(got["app_ids"]), str(got["language"]), str(got["review_type"]), str(got["purchase_type"]), clamp(got["reviews_per_page"], 1, MAX_STEAM_PAGE))

    @property
    def real_app_ids(self) -> list[str]:
        return [a for a in self.app_ids if not a.startswith(PLACEHOLDERS["steam"])]

    def url(self, app_id: str, cursor: str) -> str:
        asked = {"language": quote(self.language), "review_type": quote(self.review_type), "purchase_type": quote(self.purchase_type), "num_per_page": self.reviews_per_page, "cursor": quote(cursor, safe="")}
        return STEAM_URL.format(app=quote(app_id, safe="")) + "&".join(f"{k}={v}" for k, v in asked.items())


@dataclass(frozen=True)
class Amazon:
    enabled: bool = True
    review_urls: tuple[str, ...] = ()
    saved_response_files: tuple[str, ...] = ()
    live: bool = True

    @classmethod
    def of(cls, raw: dict) -> Amazon:
        return cls(bool(raw.get("enabled", True)), _texts(raw.get("review_urls")), _texts(raw.get("saved_response_files")))

    @property
    def real_urls(self) -> list[str]:
        return [u for u in self.review_urls if not u.startswith(PLACEHOLDERS["amazon"])]


@dataclass(frozen=True)
class GooglePlay:
    enabled: bool = True
    app_name: str = "YouTube"
    package_id: str = "com.google.android.youtube"
    country: str = "us"
    language: str = "en"
    reviews_per_batch: int = 50

    @classmethod
    def of(cls, raw: dict) -> GooglePlay:
        got = asdict(cls()) | raw
        return cls(bool(got["enabled"]), str(got["app_name"]), str(got["package_id"]), str(got["country"]).lower(), str(got["language"]).lower(), clamp(got["reviews_per_batch"], 1, MAX_GOOGLE_BATCH))


@dataclass(frozen=True)
class Target:
    app_name: str
    app_id: str
    country: str = "us"
    language: str = "en"
    category: str | None = None


@dataclass(frozen=True)
class Apple:
    enabled: bool = True
    app_name: str = "YouTube"
    app_id: str = "544007664"
    country: str = "us"
    language: str = "en"
    reviews_per_page: int = 50
    validation_targets: tuple[Target, ...] = ()
    validation_reviews_per_target: int = 1000
    validation_total_reviews: int = 10_000
    validation_max_pages_per_target: int = 20
    validation_low_signal_min_text_length: int = 15
    validation_output_dir: str = "apple_app_store_validation"

    @classmethod
    def of(cls, raw: dict) -> Apple:
        got = asdict(cls()) | raw
        return cls(
            bool(got["enabled"]),
            str(got["app_name"]),
            str(got["app_id"]),
            str(got["country"]).lower(),
            str(got["language"]).lower(),
            clamp(got["reviews_per_page"], 1, MAX_APPLE_PAGE),
            targets_of(raw),
            clamp(got["validation_reviews_per_target"], 1, MAX_PER_TARGET),
            clamp(got["validation_total_reviews"], 1, MAX_TOTAL),
            clamp(got["validation_max_pages_per_target"], 1, MAX_PAGES_PER_TARGET),
            clamp(got["validation_low_signal_min_text_length"], 1),
            str(got["validation_output_dir"]),
        )

    @staticmethod
    def url(country: str, app_id: str, language: str, page: int) -> str:
        return APPLE_URL.format(country=country, page=page, app=app_id, language=language)


def targets_of(raw: dict) -> tuple[Target, ...]:
    """The listed targets, or the one app; placeholders are no targets."""
    listed = raw.get("validation_targets") or raw.get("apps")
    base = Apple()
    if not listed:
        listed = [{k: raw.get(k, getattr(base, k)) for k in ("app_name", "app_id")} | {"category": raw.get("category")}]
    if not isinstance(listed, list):
        raise ValueError("validation_targets must be a list")
    out = []
    for nth, item in enumerate(listed, 1):
        if not isinstance(item, dict):
            raise ValueError(f"validation target {nth} must be a mapping")
        app_id = str(item.get("app_id", "")).strip()
        if app_id and not app_id.startswith(PLACEHOLDERS["apple"]):
            place = {k: str(item.get(k, raw.get(k, getattr(base, k)))).lower() for k in ("country", "language")}
            out.append(Target(str(item.get("app_name", app_id)), app_id, place["country"], place["language"], str(item["category"]) if item.get("category") else None))
    return tuple(out)


@dataclass(frozen=True)
class AppConfig:
    assessment: Assessment = field(default_factory=Assessment)
    steam: Steam = field(default_factory=Steam)
    amazon: Amazon = field(default_factory=Amazon)
    google_play: GooglePlay = field(default_factory=GooglePlay)
    apple_app_store: Apple = field(default_factory=Apple)
    path: Path | None = None

    def sanitized(self) -> dict[str, Any]:
        """What reports may echo: URLs only as a count."""
        out = asdict(self)
        out.pop("path")
        out["amazon"]["review_urls_count"] = len(out["amazon"].pop("review_urls"))
        return out


    def without_live_amazon(self) -> AppConfig:
        """The same, but pages are never requested from the review URLs."""
        return replace(self, amazon=replace(self.amazon, live=False))


def load(path: str | Path) -> AppConfig:
    """A YAML or JSON file; one that is absent means defaults."""
    file, raw = Path(path), {}
    if file.exists():
        text = file.read_text(encoding="utf-8")
        if file.suffix == ".json":
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text) or {}
        if not isinstance(raw, dict):
            raise ValueError("a configuration holds a mapping")
    part = lambda name: raw.get(name) or {}
    return AppConfig(Assessment.of(part("assessment")), Steam.of(part("steam")), Amazon.of(part("amazon")), GooglePlay.of(part("google_play")), Apple.of(part("apple_app_store")), file)


def json_from_environment(name: str) -> dict[str, str]:
    """A JSON object of texts in an environment variable; empty if unset."""
    value = os.environ.get(name)
    if not value:
        return {}
    try:
        got = json.loads(value)
    except ValueError as wrong:
        raise ValueError(f"{name} must hold JSON") from wrong
    if not isinstance(got, dict):
        raise ValueError(f"{name} must hold a JSON object")
    return {str(k): str(v) for k, v in got.items()}
