"""A resumable pull of a paged service into a run's folder, with a checkpoint that people can read and a manifest.

Each micro-batch is a folder of its own (``batch=<n>``), named by the number
that the stream's checkpoint gives it, so a batch that runs again after a crash
replaces its own output. ``_checkpoint.json`` says after every batch how far
the run is; ``manifest.json`` appears when it is complete, and is what makes
the run one that ``resolve`` finds. A run that is complete returns its manifest
at once. What is done is taken from the stream's own checkpoint, never from the
files for people.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paged
from ..sources.readers import exists, read_text, write_text
from .events import observed

MANIFEST, PROGRESS, CHECKPOINT = "manifest.json", "_checkpoint.json", "_checkpoint"
#: What must stay as it was when a run goes on.
SETTINGS = ("run_id", "producer", "queries")


def _said(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return json.loads(text) if text else None


def manifest(spark: SparkSession, target: str) -> dict | None:
    """Of a run that is complete."""
    return _said(spark, f"{target}/{MANIFEST}")


def progress(spark: SparkSession, target: str) -> dict | None:
    return _said(spark, f"{target}/{PROGRESS}")


def _batch(target: str, number: int, size: int) -> dict:
    return {"last_successful_batch_index": number, "last_successful_batch_size": size, "last_successful_output_path": f"{target}/batch={number}", "total_batches": number + 1}


def pull(spark: SparkSession, producer: str, queries: Sequence[str], target: str, run: str, per_batch: int = paged.PER_BATCH, per_task: int = paged.PER_TASK, source: str = "") -> dict:
    """All records that the producer has now, below ``target``; a run that was cut short goes on after its last batch. Returns the manifest."""
    if done := manifest(spark, target):
        return done
    said = progress(spark, target)
    settings = {"run_id": run, "producer": producer, "queries": list(dict.fromkeys(queries)), "per_batch": per_batch, "source": source or producer}
    if said and (changed := [k for k in SETTINGS if said.get(k) != settings[k]]):
        raise RuntimeError(f"the run was begun with other settings: {', '.join(changed)}")
    have = paged.committed(spark, f"{target}/{CHECKPOINT}")
    now = {**(said or {"started_at": _now()}), **settings, "completed": False, "resumed": bool(said)}
    _write(spark, f"{target}/{PROGRESS}", {**now, "cumulative_records": sum(have.values()), "stream_state": have})
    spark.dataSource.register(paged.Pages)
    options = {"producer": producer, "queries": json.dumps(settings["queries"]), "per_batch": per_batch, "per_task": per_task, "start": json.dumps(have)}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        size = spark.read.parquet(f"{target}/batch={number}").count()  # from the footers
        before = paged.committed(spark, f"{target}/{CHECKPOINT}")
        _write(spark, f"{target}/{PROGRESS}", {**now, **_batch(target, number, size), "cumulative_records": sum(before.values()) + size, "stream_state": before})

    stream = observed(spark.readStream.format(paged.Pages.name()).options(**options).load(), "pulled", ("record",))
    query = stream.writeStream.queryName(run).foreachBatch(write).option("checkpointLocation", f"{target}/{CHECKPOINT}").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    state = paged.committed(spark, f"{target}/{CHECKPOINT}")
    each = paged.batches(spark, target).groupBy("batch").agg(F.count("*").alias("n")).collect() if exists(spark, f"{target}/batch=0") else []  # a row a batch
    sizes = {r.batch: r.n for r in each}
    if sum(sizes.values()) != sum(state.values()):
        raise RuntimeError(f"{target} holds {sum(sizes.values())} records and its checkpoint says {sum(state.values())}")
    last = max(sizes, default=None)
    whole = {**now, "completed": True, "finished_at": _now(), "cumulative_records": sum(state.values()), "stream_state": state, "total_batches": 0, **({} if last is None else _batch(target, last, sizes[last]))}
    _write(spark, f"{target}/{PROGRESS}", whole)
    return _write(spark, f"{target}/{MANIFEST}", whole)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _write(spark: SparkSession, path: str, said: dict) -> dict:
    write_text(spark, path, json.dumps(said, indent=1, sort_keys=True))
    return said
