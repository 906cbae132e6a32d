"""Where a pipeline stands: its artefacts, sources, files and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.reviews import latest
from ..sources.readers import listing
from ..sources.specs import SPECS, unify
from ..sources.staging import footer_rows

LOGS = 25


def _when(changed: int | None) -> str | None:
    return datetime.fromtimestamp(changed / 1000, timezone.utc).isoformat() if changed is not None else None


def artefact(spark: SparkSession, name: str, path: str) -> dict:
    files = listing(spark, path)
    return {"name": name, "path": path, "exists": bool(files), "size_bytes": sum(f[1] for f in files) if files else None, "updated_at": _when(max((f[2] for f in files), default=None))}


def sources(spark: SparkSession, data: str) -> list[dict]:
    """Of each source, the places that have files."""
    out = []
    for source in SPECS:
        places = [f"{data}/{source}", f"{data}/{source}_reviews.jsonl", f"{data}/raw/{source}", f"{data}/processed/{source}"]
        found = {p: files for p in places if (files := listing(spark, p))}
        out.append({"source": source, "available": bool(found), "paths": list(found), "updated_at": _when(max((f[2] for files in found.values() for f in files), default=None))})
    return out


def files(spark: SparkSession, folders: Sequence[str], most: int = LOGS, ending: str = "") -> list[dict]:
    """The last ``most`` files of the folders, in order of path."""
    found = [f for folder in folders for f in listing(spark, folder) if f[0].endswith(ending)]
    return [{"name": p.rsplit("/", 1)[-1], "path": p, "size_bytes": size, "updated_at": _when(t)} for p, size, t in found][-most:]


def pipeline_status(spark: SparkSession, artefacts: Mapping[str, str], data: str, logs: Sequence[str] = (), jobs: str | None = None, index: DataFrame | None = None) -> dict:
    return {
        "artifacts": [artefact(spark, name, path) for name, path in artefacts.items()],
        "sources": sources(spark, data),
        "job_files": files(spark, [jobs], 10_000, ".py") if jobs else [],
        "log_files": files(spark, logs),
        "vector_store": {"exists": index is not None, "documents": index.count() if index is not None else 0},
    }


def dashboard_files(spark: SparkSession, enriched: str, normalized: str, data: str, queue: str | None = None, index: DataFrame | None = None) -> dict:
    """A summary without a scan: rows from footers, sources that have files, lines of the queue."""
    path = next((p for p in (enriched, normalized) if any(f[0].endswith(".parquet") for f in listing(spark, p))), None)
    return {
        "dataset_path": path,
        "total_reviews": footer_rows(spark, path) if path else 0,
        "sources_integrated": sum(s["available"] for s in sources(spark, data)),
        "indexed_documents": index.count() if index is not None else 0,
        "hitl_queue_items": spark.read.text(queue).where("trim(value) <> ''").count() if queue and listing(spark, queue) else 0,
        "latest_dataset_update": artefact(spark, "", path)["updated_at"] if path else None,
        "artifact_dirs": [artefact(spark, p.rsplit("/", 1)[-1], p) for p in (normalized, enriched)],
    }


def normalize_all(raw: Mapping[str, DataFrame], target: str) -> dict:
    """All sources unified, one row per review, written; and counters that the same pass has made."""
    seen = {name: Observation(f"{name}_rows") for name in raw}
    frames = [unify(df, SPECS[name]).observe(seen[name], F.count("*").alias("n")) for name, df in raw.items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    kept = Observation("kept_rows")
    latest(every).observe(kept, F.count("*").alias("n")).write.mode("overwrite").parquet(target)
    before, after = {name: o.get["n"] for name, o in seen.items()}, kept.get["n"]
    return {"source_counts": before, "rows_before": sum(before.values()), "rows_after": after, "removed_count": sum(before.values()) - after}
