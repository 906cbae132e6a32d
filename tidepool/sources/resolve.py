"""Where a source's newest whole input lies: completed runs first, then the places where files are usually put."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import paged
from .readers import exists, first_existing, json_lines, listing, read_text
from .specs import SPECS, unify, with_businesses

#: Names of files and folders, in the order in which they are tried.
BATCH = re.compile(r"amazon_reviews_batch_(\d{6})_records_\d+\.jsonl$")
#: A batch of a run that was pulled as a stream.
PULLED = re.compile(r"^batch=\d+/part-.*\.parquet$")
REVIEWS, BUSINESSES = "yelp_academic_dataset_review.json", "yelp_academic_dataset_business.json"
PAIRS = (
    (f"yelp/current/{REVIEWS}", f"yelp/current/{BUSINESSES}"),
    (f"yelp/{REVIEWS}", f"yelp/{BUSINESSES}"),
    ("yelp/yelp_reviews.jsonl", "yelp/yelp_businesses.jsonl"),
    ("yelp_reviews.jsonl", "yelp_business.jsonl"),
)
CANDIDATES = {name: (f"{name}/current", f"{name}/{name}_reviews.jsonl", f"{name}_reviews.jsonl", name) for name in SPECS}


def _files(spark: SparkSession, folder: str) -> dict[str, tuple[str, int]]:
    """Path and time of change of a folder's files, by their path below it."""
    out = {}
    for path, _, changed in listing(spark, folder):
        inside = path.split(folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/", 1)
        if len(inside) == 2:
            out[inside[1]] = (path, changed)
    return out


def _runs(spark: SparkSession, base: str, source: str) -> dict[str, dict[str, tuple[str, int]]]:
    """Files by run."""
    runs: dict[str, dict] = {}
    for name, found in _files(spark, f"{base}/{source}/runs").items():
        run, _, rest = name.partition("/")
        if rest:
            runs.setdefault(run, {})[rest] = found
    return runs


def _checkpoint(spark: SparkSession, files: Mapping[str, tuple[str, int]]) -> dict:
    if "_checkpoint.json" not in files:
        return {}
    try:
        return json.loads(read_text(spark, files["_checkpoint.json"][0]) or "{}")
    except ValueError:
        return {}


def _newest(found: Mapping[str, int]) -> str | None:
    return max(found, key=lambda run: (found[run], run)) if found else None


def latest_run(spark: SparkSession, base: str, source: str = "amazon") -> str | None:
    """The folder of the newest run that has batches and is complete: it has a manifest, or its checkpoint says so."""
    done = {}
    for run, files in _runs(spark, base, source).items():
        if any(BATCH.search(f) or PULLED.search(f) for f in files) and ("manifest.json" in files or _checkpoint(spark, files).get("completed")):
            done[run] = max(t for _, t in files.values())
    run = _newest(done)
    return f"{base}/{source}/runs/{run}" if run else None


def incomplete_run(spark: SparkSession, base: str, source: str = "amazon", pinned: str | None = None) -> str | None:
    """The run to go on with: the one that the caller pins, or the newest whose checkpoint isn't complete."""
    if pinned:
        return pinned
    open_ = {}
    for run, files in _runs(spark, base, source).items():
        if "_checkpoint.json" in files and not _checkpoint(spark, files).get("completed"):
            open_[run] = max(t for _, t in files.values())
    return _newest(open_)


def batches(spark: SparkSession, run: str, total: int) -> list[str]:
    """The files of a run's batches 1 to ``total``, one each; anything else can't be gone on with."""
    found: dict[int, list[str]] = {}
    for name, (path, _) in _files(spark, run).items():
        if m := BATCH.search(name):
            found.setdefault(int(m[1]), []).append(path)
    wrong = [i for i in range(1, total + 1) if len(found.get(i, [])) != 1]
    if wrong:
        raise RuntimeError(f"{run} has no batch, or several, of number {wrong[:10]}")
    return [found[i][0] for i in range(1, total + 1)]


def reviews_and_businesses(spark: SparkSession, base: str, configured: str | None = None) -> tuple[str | None, str | None]:
    """Both files of one run, of one usual place, or of the place that is configured; else whatever either is found as."""
    done = {run: max(t for _, t in files.values()) for run, files in _runs(spark, base, "yelp").items() if {REVIEWS, BUSINESSES, "manifest.json"} <= set(files)}
    pairs = [(f"yelp/runs/{run}/{REVIEWS}", f"yelp/runs/{run}/{BUSINESSES}") for run in [_newest(done)] if run]
    places = [(f"{base}/{a}", f"{base}/{b}") for a, b in (*pairs, *PAIRS)]
    if configured:
        folder = configured.rsplit("/", 1)[0] if configured.endswith((REVIEWS, BUSINESSES)) else configured
        places.append((f"{folder}/{REVIEWS}", f"{folder}/{BUSINESSES}"))
    for a, b in places:
        if exists(spark, a) and exists(spark, b):
            return a, b
    return tuple(first_existing(spark, [p[i] for p in places[len(pairs) :]]) for i in (0, 1))


def input_path(spark: SparkSession, base: str, source: str, candidates: Sequence[str] | None = None) -> str | None:
    """A source's newest whole input."""
    if source == "yelp":
        return reviews_and_businesses(spark, base)[0]
    if source == "amazon" and (run := latest_run(spark, base)):
        return run
    return first_existing(spark, [f"{base}/{c}" for c in candidates or CANDIDATES[source]])


def load(spark: SparkSession, base: str, source: str, limit: int | None = None) -> DataFrame | None:
    """A source's newest input in the unified schema; None where there is none."""
    path = input_path(spark, base, source)
    if path is None:
        return None
    spec = SPECS[source]
    if exists(spark, f"{path}/batch=0"):  # a run that was pulled
        raw = paged.raw(spark, path, source)
        raw = raw if limit is None else raw.limit(limit)
    else:
        raw = json_lines(spark, path, spec.schema, limit, only_jsonl=not path.endswith(".json"))
    if source == "yelp":
        shops = reviews_and_businesses(spark, base)[1]
        raw = with_businesses(raw, json_lines(spark, shops, spec.schema, only_jsonl=False).select("business_id", "name", "categories") if shops else None)
    return unify(raw, spec)
