"""``python -m larkspur.cli features|report|assess|landed|validate``"""

from __future__ import annotations

import argparse
import importlib

from . import config, runs
from .session import session
from .sources import sinks

PAIRS = {"all": ("steam", "amazon"), "steam": ("steam", "amazon"), "amazon": ("steam", "amazon"), "app_stores": ("google_play", "apple_app_store"), "google_play": ("google_play", "apple_app_store"), "apple_app_store": ("google_play", "apple_app_store")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur")
    kinds = top.add_subparsers(dest="kind", required=True)
    features = kinds.add_parser("features", help="derive features from a review CSV")
    features.add_argument("--input", required=True)
    features.add_argument("--rules")
    features.add_argument("--output-root", default="data/features")
    features.add_argument("--run-id", required=True)
    report = kinds.add_parser("report", help="validate a feature CSV")
    report.add_argument("--features", required=True)
    report.add_argument("--output-root", default="reports/features")
    report.add_argument("--run-id", required=True)
    report.add_argument("--input-row-count", type=int)
    report.add_argument("--manual-sample-size", type=int, default=135)
    assess = kinds.add_parser("assess", help="collect and compare sources")
    assess.add_argument("--config", default="config.yaml")
    assess.add_argument("--source", choices=sorted(PAIRS), default="all")
    assess.add_argument("--offline-only", action="store_true")
    assess.add_argument("--report-only", action="store_true")
    assess.add_argument("--skip-live-amazon", action="store_true")
    assess.add_argument("--google-play-wrapper", metavar="MODULE:FUNCTION", help="fetch(package, token, count) that gives (records, token)")
    assess.add_argument("--root", default=".")
    landed = kinds.add_parser("landed", help="reviews of raw pages that have landed in a folder")
    landed.add_argument("--input", required=True)
    landed.add_argument("--source", choices=("steam", "apple_app_store", "google_play"), required=True)
    landed.add_argument("--output", default="data/processed")
    validate = kinds.add_parser("validate", help="collect all app-store targets")
    validate.add_argument("--config", default="config.yaml")
    validate.add_argument("--run-id")
    validate.add_argument("--max-reviews", type=int)
    validate.add_argument("--offline-only", action="store_true")
    validate.add_argument("--root", default=".")
    return top


def _skips(args) -> dict[str, str]:
    pair = PAIRS[args.source]
    if args.report_only:
        return dict.fromkeys(pair, "report only")
    skip = {s: "not selected" for s in pair if args.source in pair and s != args.source}
    if args.offline_only:
        skip |= {s: "offline only" for s in pair if s in ("steam", "apple_app_store", "google_play")}
    if "google_play" in pair and not args.google_play_wrapper:
        skip.setdefault("google_play", "no wrapper is installed")
    return skip


def wrapper(name: str | None):
    """The function that ``module:function`` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function or "fetch")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("larkspur")
    if args.kind == "features":
        print(runs.feature_run(spark, args.input, args.rules, args.output_root, args.run_id))
    elif args.kind == "report":
        print(runs.report_run(spark, args.features, args.output_root, args.run_id, args.input_row_count, args.manual_sample_size))
    elif args.kind == "landed":
        print(runs.landed_run(spark, args.input, args.source, args.output).count())
    elif args.kind == "assess":
        sinks.set_up_logging(args.root)
        settings, skips = config.load(args.config), _skips(args)
        live = not (args.offline_only or args.skip_live_amazon) and settings.amazon.real_urls and "amazon" not in skips
        headers = config.json_from_environment("AMAZON_HEADERS_JSON") if live else {}
        cookies = config.json_from_environment("AMAZON_COOKIES_JSON") if live else {}
        if cookies:
            headers["Cookie"] = "; ".join(f"{k}={v}" for k, v in cookies.items())
        # Without live pages there is no client, and nothing is requested.
        client = runs.client_for(settings, headers) if live or not args.offline_only and "steam" not in skips or "apple_app_store" in PAIRS[args.source] and "apple_app_store" not in skips else None
        settings = settings if live else settings.without_live_amazon()
        print(runs.assessment_run(spark, settings, args.root, PAIRS[args.source], client=client, fetch=wrapper(args.google_play_wrapper), skip=skips))
    elif not args.offline_only:
        sinks.set_up_logging(args.root)
        print(runs.validation_run(spark, config.load(args.config), args.root, args.run_id, args.max_reviews))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
