"""A polite HTTP client for live feeds: paced, two attempts, every request recorded."""

from __future__ import annotations

import logging
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any

LOG = logging.getLogger("larkspur.http")
# Statuses that are tried once more, and those that mean a block.
TRANSIENT, BLOCKING = frozenset([500, 502, 503, 504]), frozenset([401, 403, 429])
ATTEMPTS = 2


def scrub_url(url: str) -> str:
    """A URL without its query, which may hold secrets."""
    head, mark, _ = url.partition("?")
    return head + ("?..." if mark else "")


@dataclass
class Reply:
    body: bytes | None
    request: dict[str, Any]

    @property
    def text(self) -> str:
        return (self.body or b"").decode("utf-8", "replace")


@dataclass
class PoliteClient:
    """``open`` is what makes a request: (url, headers, timeout) to (status, body)."""

    timeout: float
    delay: float
    headers: dict[str, str] = field(default_factory=dict)
    open: Any = None
    clock: Any = time.monotonic
    sleep: Any = time.sleep
    _last: float | None = None

    def get(self, url: str, source: str = "", run: int = 1) -> Reply:
        if self._last is not None and (wait := self.delay - (self.clock() - self._last)) > 0:
            self.sleep(wait)
        for attempt in range(1, ATTEMPTS + 1):
            began = self.clock()
            record = {"source": source, "run": run, "url": url, "attempts": attempt, "status_code": None, "success": False, "response_bytes": None, "blocked": False, "error": None}
            try:
                status, body = (self.open or _urllib)(url, self.headers, self.timeout)
            except OSError as wrong:
                self._last = self.clock()
                LOG.warning("GET %s failed: %s", scrub_url(url), type(wrong).__name__)
                return Reply(None, record | {"elapsed_seconds": self._last - began, "error": str(wrong)})
            self._last = self.clock()
            record |= {"elapsed_seconds": self._last - began, "status_code": status, "success": 200 <= status < 300, "response_bytes": len(body), "blocked": status in BLOCKING}
            LOG.info("GET %s -> %s", scrub_url(url), status)
            if status not in TRANSIENT or attempt == ATTEMPTS:
                return Reply(body, record)
        raise AssertionError


def _urllib(url: str, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
            return got.status, got.read()
    except urllib.error.HTTPError as answered:
        return answered.code, answered.read()
