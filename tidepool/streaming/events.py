"""What streams and jobs do, as one JSON event a batch that other tools can read.

Counts are made where the rows pass (``observed``), so an event costs no job of
its own. Events of a query lie below ``<folder>/<run>/`` in a file each, named
by batch, so that a batch that runs again replaces its event.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.readers import run_id, write_text

FIELDS = "event string, run string, query string, batch long, at string, status string, input_rows long, rows_per_second double, duration_ms long, counters map<string,long>, reason string"
log = logging.getLogger("tidepool")


def observed(rows: DataFrame, name: str = "rows", fields: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` counted as they pass, and how many lack each of the fields."""
    return rows.observe(name, *_counts(fields))


def _counts(fields: tuple[str, ...]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in fields)]


class Events(StreamingQueryListener):
    """One event a batch of every query of the session whose name is one of ``names`` (all: none given)."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = ()):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), names
        self.known: dict[str, str | None] = {}

    def _put(self, event: str, query: str | None, file: str, **fields) -> None:
        run = run_id(query or "unnamed")
        said = {"event": event, "run": run, "query": query, "at": datetime.now(timezone.utc).isoformat(timespec="milliseconds"), **fields}
        try:
            write_text(self.spark, f"{self.folder}/{run}/{file}.json", json.dumps(said, sort_keys=True))
        except Exception:  # a stream goes on without its events
            log.exception("an event of %s wasn't written", run)

    def _mine(self, name: str | None) -> bool:
        return not self.names or name in self.names

    def onQueryStarted(self, event) -> None:
        self.known[str(event.runId)] = event.name
        if self._mine(event.name):
            self._put("started", event.name, f"started-{event.runId}", status="running")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not self._mine(p.name):
            return
        counters = {f"{name}.{k}": v for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        if not counters and not p.numInputRows:
            return  # a look for data that found none
        self._put(
            "batch", p.name, f"batch-{p.batchId:09d}", status="done", batch=p.batchId, input_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, duration_ms=p.batchDuration, counters=counters,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.known.pop(str(event.runId), None)
        if self._mine(name):
            self._put("ended", name, f"ended-{event.runId}", status="failed" if event.exception else "completed", reason=event.exception)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events below a folder, as rows."""
    return spark.read.schema(FIELDS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)


def job_event(spark: SparkSession, folder: str, run: str, rows: DataFrame, write: Callable[[DataFrame], None], fields: tuple[str, ...] = (), name: str = "rows") -> dict:
    """Run a batch job (``write`` gets the rows) and leave its event: counts are those of the rows that were written."""
    seen = Observation(name)
    began = datetime.now(timezone.utc)
    said = {"event": "job", "run": run_id(run), "query": run, "at": began.isoformat(timespec="milliseconds")}
    try:
        write(rows.observe(seen, *_counts(fields)))
        said |= {"status": "completed", "counters": {f"{name}.{k}": v for k, v in seen.get.items()}}
    except Exception as e:
        said |= {"status": "failed", "reason": f"{type(e).__name__}: {e}"[:500]}
        raise
    finally:
        said["duration_ms"] = round((datetime.now(timezone.utc) - began).total_seconds() * 1000)
        write_text(spark, f"{folder.rstrip('/')}/{run_id(run)}/job.json", json.dumps(said, sort_keys=True))
    return said
