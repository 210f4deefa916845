"""Collectors: paging loops over a client, landing raw pages.

A collector only fetches, lands payloads and records requests. Parsing, dedup, caps and
statistics are plans over what has landed. Loops end early once a cap is met; that is
all the control flow there is.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import AppConfig, Apple, Target
from ..schema import REQUEST_TYPES, struct

PAGE_TYPES = {
    "source": "string", "app_name": "string", "app_id": "string", "package_id": "string", "country": "string", "language": "string", "category": "string",
    "run": "long", "page": "long", "seq": "long", "cursor": "string", "response_cursor": "string", "source_url": "string",
    "status_code": "long", "success": "boolean", "parsed": "boolean", "review_count": "long", "status": "string", "payload": "string",
}


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


@dataclass
class Landing:
    """What a collection has fetched: pages and requests, in order; raw files if it has a folder."""

    folder: Path | None = None
    pages: list[dict[str, Any]] = field(default_factory=list)
    requests: list[dict[str, Any]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    parser_errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def add(self, name: str, payload: str | None, **known: Any) -> dict[str, Any]:
        page = dict.fromkeys(PAGE_TYPES) | known | {"payload": payload, "seq": len(self.pages)}
        self.pages.append(page)
        if self.folder and payload is not None and page["parsed"] is not False:
            self.folder.mkdir(parents=True, exist_ok=True)
            (self.folder / f"{name}_{stamp()}.json").write_text(payload, encoding="utf-8")
        return page

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Pages and requests as DataFrames."""
        pages = spark.createDataFrame([tuple(p[c] for c in PAGE_TYPES) for p in self.pages], struct(PAGE_TYPES))
        requests = spark.createDataFrame([tuple(r.get(c) for c in REQUEST_TYPES) for r in self.requests], struct(REQUEST_TYPES))
        return pages, requests


def _fetch(landing: Landing, client, url: str, name: str, **known: Any) -> tuple[dict[str, Any], Any]:
    """One request: its page is landed with what is known; the parsed payload or None."""
    reply = client.get(url, known["source"], known.get("run", 1))
    landing.requests.append(reply.request)
    known |= {"source_url": url, "status_code": reply.request["status_code"], "success": reply.request["success"], "review_count": 0}
    if not reply.request["success"]:
        return landing.add(name, None, **known), None
    try:
        got = json.loads(reply.text)
    except ValueError:
        landing.parser_errors.append(f"{name}: the response is not JSON")
        return landing.add(name, reply.text, **known, parsed=False), None
    return landing.add(name, reply.text, **known, parsed=True), got


def steam(config: AppConfig, client, folder: Path | None = None) -> Landing:
    """Apps x runs x cursor pages, each run from the first cursor."""
    landing, limits = Landing(folder), config.assessment
    for app_id in config.steam.real_app_ids:
        for run in range(1, limits.repeat_runs + 1):
            cursor, before, ids = "*", None, set()
            for number in range(1, limits.max_pages_per_item + 1):
                url = config.steam.url(app_id, cursor)
                page, got = _fetch(landing, client, url, f"steam_{app_id}_run{run}_page{number}", source="steam", app_id=app_id, run=run, page=number, cursor=cursor)
                if got is None:
                    if not page["success"]:
                        landing.errors.append(f"steam request failed for app {app_id}, page {number}")
                    break
                rows = got.get("reviews") or []
                following = str(got.get("cursor") or "")
                page |= {"review_count": len(rows), "response_cursor": following or None}
                landing.pages[page["seq"]] = page
                for r in rows:
                    if len(ids) < limits.max_reviews_per_item and r.get("recommendationid") is not None:
                        ids.add(str(r["recommendationid"]))
                if number > 1 and following and following == before:
                    landing.warnings.append(f"the cursor of app {app_id} stands still")
                if not rows or following in ("", cursor, before) or len(ids) >= limits.max_reviews_per_item:
                    break
                before, cursor = following, following
    return landing


def apple_entries(got: Any) -> list[dict]:
    entries = ((got or {}).get("feed") or {}).get("entry") or []
    entries = [entries] if isinstance(entries, dict) else entries
    return [e for e in entries if isinstance(e, dict) and "im:rating" in e]


def _apple_pages(landing: Landing, client, target: Target, run: int, pages: int, limit: int, prefix: str) -> int:
    """Pages of one target until it is full, empty or fails; returns the rows it could use."""
    rows = 0
    for number in range(1, pages + 1):
        if rows >= limit:
            break
        url = Apple.url(target.country, target.app_id, target.language, number)
        known = {"source": "apple_app_store", "app_name": target.app_name, "app_id": target.app_id, "country": target.country, "language": target.language, "category": target.category, "run": run, "page": number}
        page, got = _fetch(landing, client, url, f"{prefix}_{target.app_id}_run{run}_page{number}", **known)
        if got is None:
            late = number > 1 and page["status_code"] in (400, 404)
            page["status"] = "json_parse_error" if page["success"] else "pagination_limit_or_unavailable_page" if late else "request_failed"
            if page["status"] == "request_failed":
                landing.errors.append(f"request failed for {target.app_name}, page {number}")
            break
        found = apple_entries(got)
        page |= {"review_count": len(found), "status": "ok" if found else "empty_page"}
        landing.pages[page["seq"]] = page
        if not found:
            break
        rows += len(found)
    return rows


def apple(config: AppConfig, client, folder: Path | None = None) -> Landing:
    """Runs x pages of the one configured app."""
    landing, store = Landing(folder), config.apple_app_store
    target = Target(store.app_name, store.app_id, store.country, store.language)
    for run in range(1, config.assessment.repeat_runs + 1):
        _apple_pages(landing, client, target, run, config.assessment.max_pages_per_item, config.assessment.max_reviews_per_item, "apple_app_store")
    return landing


def apple_validation(config: AppConfig, client, folder: Path | None = None, total: int | None = None) -> Landing:
    """All validation targets in order, up to the limit of each and of the whole."""
    landing, store = Landing(folder), config.apple_app_store
    total, ids, rows = total or store.validation_total_reviews, set(), 0
    for target in store.validation_targets:
        if rows >= total:
            break
        limit = min(store.validation_reviews_per_target, total - rows)
        before = len(landing.pages)
        _apple_pages(landing, client, target, 1, store.validation_max_pages_per_target, limit, "apple_app_store")
        for page in landing.pages[before:]:
            for e in apple_entries(json.loads(page["payload"])) if page["parsed"] else []:
                key = (e.get("id") or {}).get("label")
                if key is None or key not in ids:
                    ids.add(key)
                    rows += 1
    return landing


def amazon(config: AppConfig, client, blocked, folder: Path | None = None) -> Landing:
    """One request per configured URL; a page that ``blocked`` (text, status) tells of is not landed."""
    landing = Landing(folder)
    for nth, url in enumerate(config.amazon.real_urls, 1):
        reply = client.get(url, "amazon")
        record = reply.request
        landing.requests.append(record)
        known = {"source": "amazon", "source_url": url, "page": 1, "run": 1, "status_code": record["status_code"], "success": record["success"], "review_count": 0}
        if reply.body is None:
            landing.errors.append(f"live request {nth} failed")
        elif not record["success"]:
            landing.warnings.append(f"live request {nth} was answered with status {record['status_code']}; nothing is parsed")
        elif blocked(reply.text, record["status_code"]):
            record |= {"blocked": True, "success": False}
            landing.warnings.append(f"live request {nth} met a block page; this URL ends here")
        else:
            landing.add(f"amazon_live_page{nth}", reply.text, **known, parsed=True, status="ok")
            continue
        landing.add("", None, **known, status="request_failed")
    return landing


def google_play(config: AppConfig, fetch, folder: Path | None = None) -> Landing:
    """Runs x batches through a wrapper ``fetch(package, token, count)`` giving (records, token)."""
    landing, store, limits = Landing(folder), config.google_play, config.assessment
    for run in range(1, limits.repeat_runs + 1):
        token, ids = None, set()
        for number in range(1, limits.max_pages_per_item + 1):
            if len(ids) >= limits.max_reviews_per_item:
                break
            known = {"source": "google_play", "app_name": store.app_name, "package_id": store.package_id, "country": store.country, "language": store.language, "run": run, "page": number, "cursor": token}
            try:
                records, token = fetch(store.package_id, token, store.reviews_per_batch)
            except Exception as wrong:  # the wrapper's own errors are of any kind
                landing.errors.append(f"google play batch {number} failed: {wrong}")
                landing.add("", None, **known, success=False, status="request_failed")
                break
            landing.add(f"google_play_run{run}_page{number}", json.dumps(records, ensure_ascii=False, default=str), **known, success=True, parsed=True, review_count=len(records), response_cursor=token)
            ids |= {r.get("reviewId") for r in records if r.get("reviewId")}
            if not records or not token:
                break
    return landing
