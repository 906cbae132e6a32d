"""The latest version of every review in a stream, however late it comes, in keyed state that expires.

``latest_wins`` keeps what orders the versions of a key (date, text, link) and
gives out a row whenever it beats the one before, so that the last row of a key
is what ``reviews.latest`` would pick from all rows. State lives in RocksDB,
not in the heap, and goes when a key had no better version for ``ttl``; a
version that comes later than that is taken as new. ``into_store`` puts each
batch's winners into a ``Store``, which then equals the batch answer; a batch
that runs again puts the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import Store

#: What orders versions: the latest date, then the lesser text, then the lesser link; nulls last in each.
ORDER = ("review_date", "review_text", "source_url")
_STATE = "day long, review_text string, source_url string"
#: State in RocksDB; and no batches without data, which a time to live would otherwise ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _beats(new: tuple, old: tuple) -> bool:
    """Versions as (microseconds, text, link)."""
    if new[0] != old[0]:
        return old[0] is None or (new[0] is not None and new[0] > old[0])
    for a, b in zip(new[1:], old[1:]):
        if a != b:
            return b is None or (a is not None and a < b)
    return False


class _Latest(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        have = tuple(self.best.get()) if self.best.exists() else None
        found = None
        for row in rows:
            version = (row["_tp_micros"], *(row[c] for c in ORDER[1:]))
            if have is None or _beats(version, have):
                have, found = version, row
        if found is not None:
            self.best.update(have)
            yield Row(**{c: v for c, v in found.asDict().items() if c != "_tp_micros"})

    def close(self) -> None:
        pass


def _first(batch: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("review_date").desc_nulls_last(), F.col("review_text").asc_nulls_last(), F.col("source_url").asc_nulls_last())
    return batch.withColumn("_tp_rank", F.row_number().over(w)).where("_tp_rank = 1").drop("_tp_rank")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_wins(stream: DataFrame, key: str = "review_id", ttl: str | None = "30 days") -> DataFrame:
    """Rows that beat every version of their key before them; rows without a key are left out. ``ttl``: None keeps state for good.

    The query must be started with the ``SETTINGS``.
    """
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = stream.where(F.col(key).isNotNull()).withColumn("_tp_micros", F.unix_micros(F.col("review_date").cast("timestamp")))
    return rows.groupBy(key).transformWithState(_Latest(ttl_ms), stream.schema, "Update", "none" if ttl is None else "processingTime")


def into_store(stream: DataFrame, store: Store, checkpoint: str, key: str = "review_id", ttl: str | None = "30 days", name: str | None = None) -> StreamingQuery:
    """Keep ``store`` at the latest version of every key until all that there is now has been taken."""

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch)

    writer = latest_wins(stream, key, ttl).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with settings(stream.sparkSession, SETTINGS):  # a query keeps those that it was started with
        return (writer.queryName(name) if name else writer).start()


def compacted(spark: SparkSession, changes: DataFrame, key: str = "review_id") -> DataFrame:
    """One row a key of an append-only log of changes."""
    return _first(changes, key)
