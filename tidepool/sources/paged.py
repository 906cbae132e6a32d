"""A stream over services that hand out records by number: pull, stop anywhere, and go on where the checkpoint says.

``spark.readStream.format("tidepool_pages")`` with

* ``producer``: "module:Class", on the Python path of the driver and the executors. ``Class()`` has
  ``available(query) -> int``, how many records there are by now, and
  ``read(query, start, end)``, which yields those records as dictionaries.
  A service that can only be read from its beginning derives from ``Replayed``;
* ``queries``: a JSON list of texts, each a sequence of its own;
* ``per_batch``, ``per_task``: records of a query that a micro-batch takes at
  most, and that one task reads of them;
* ``start``: a JSON object of the records that are done already, by query
  (``committed`` has it from a checkpoint), so that the first batch after a
  start is bounded too.

The offset is the number of records taken of each query. Only offsets pass
through the driver; pages are fetched by the tasks, whose ranges are the same
when a batch runs again. A producer that loses records makes the task fail
instead of skipping ahead, and offsets never go back.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import listing, read_text
from .specs import SPECS

#: Fixed value: records of a batch, as ingestion takes them unless told otherwise.
PER_BATCH, PER_TASK = 10_000, 1_000


class Replayed:
    """A producer whose service only yields everything from the beginning: what is done is read again and left out.

    Subclasses have ``records(query)`` and ``available(query)``.
    """

    def records(self, query: str) -> Iterator[dict]:
        raise NotImplementedError

    def available(self, query: str) -> int:
        raise NotImplementedError

    def read(self, query: str, start: int, end: int) -> Iterator[dict]:
        found = iter(self.records(query))
        if (lacking := start - sum(1 for _ in islice(found, start))) > 0:
            raise RuntimeError(f"the replay of {query!r} ended before record {start}: {lacking} more were done already")
        yield from islice(found, end - start)


class DatasetRows:
    """Rows of hosted datasets by offset, a page at a time; subclasses have ``fetch(url, params, headers) -> dict``.

    A query is a JSON object of dataset, config and split. Only the pages of a task's range are asked for.
    """

    #: Where rows are served, and how many at once.
    URL, PAGE = "https://datasets-server.huggingface.co/rows", 100

    def fetch(self, url: str, params: dict, headers: dict) -> dict:
        raise NotImplementedError

    def headers(self) -> dict:
        return {}

    def _page(self, query: str, offset: int, length: int) -> dict:
        return self.fetch(self.URL, {**json.loads(query), "offset": offset, "length": length}, self.headers())

    def available(self, query: str) -> int:
        return int(self._page(query, 0, 1).get("num_rows_total") or 0)

    def read(self, query: str, start: int, end: int) -> Iterator[dict]:
        while start < end:
            rows = self._page(query, start, min(self.PAGE, end - start)).get("rows") or []
            if not rows:
                return  # the source tells of records that are lacking
            for r in rows[: end - start]:
                yield r["row"]
            start += len(rows)


class Slice(InputPartition):
    def __init__(self, query: str, start: int, end: int):
        super().__init__((query, start, end))
        self.query, self.start, self.end = query, start, end


class Pages(DataSource):
    """Rows (query, number, record): the record as JSON, and its number within its query, from 0."""

    @classmethod
    def name(cls) -> str:
        return "tidepool_pages"

    def schema(self) -> str:
        return "query string, number long, record string"

    def streamReader(self, schema: T.StructType) -> PagesStream:
        return PagesStream(self.options)

    def reader(self, schema: T.StructType) -> PagesBatch:
        return PagesBatch(self.options)


class _Producer:
    def __init__(self, options: dict):
        self.name = options["producer"]
        self.queries = list(dict.fromkeys(json.loads(options.get("queries", "[]"))))
        self.per_batch, self.per_task = int(options.get("per_batch", PER_BATCH)), int(options.get("per_task", PER_TASK))
        if self.per_batch < 1 or self.per_task < 1:
            raise ValueError("per_batch and per_task are at least 1")
        self.done = {q: int(n) for q, n in json.loads(options.get("start", "{}")).items()}

    def producer(self):
        module, _, name = self.name.partition(":")
        return getattr(importlib.import_module(module), name)()

    def slices(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(q, at, min(at + self.per_task, n)) for q, n in sorted(end.items()) for at in range(start.get(q, 0), n, self.per_task)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        number = partition.start
        for record in self.producer().read(partition.query, partition.start, partition.end):
            yield partition.query, number, json.dumps(record, default=str)
            number += 1
        if number != partition.end:
            raise RuntimeError(f"{partition.query!r} has records up to {number} now; it said that it had {partition.end}")


class PagesStream(_Producer, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {q: 0 for q in self.queries}

    def latestOffset(self) -> dict:
        """As far as there are records, and a batch beyond what is done at most. Queries that were left out since keep their place."""
        made = self.producer()
        ahead = {q: max(self.done.get(q, 0), min(made.available(q), self.done.get(q, 0) + self.per_batch)) for q in self.queries}
        return self.done | ahead

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.done = {q: int(n) for q, n in end.items()}
        return self.slices(start, end)


class PagesBatch(_Producer, DataSourceReader):
    def partitions(self) -> list[Slice]:
        made = self.producer()
        return self.slices(self.done, {q: made.available(q) for q in self.queries})


def batches(spark: SparkSession, run: str) -> DataFrame:
    """(query, number, record, batch) of a run that ``streaming.pull`` has made, whole or not."""
    return spark.read.schema(Pages({}).schema() + ", batch int").option("basePath", run).parquet(f"{run}/batch=*")


def raw(spark: SparkSession, run: str, source: str) -> DataFrame:
    """A run's records in the source's raw shape; those that aren't JSON objects are left out."""
    parsed = batches(spark, run).select(F.from_json("record", SPECS[source].schema).alias("r"))
    return parsed.where("r is not null").select("r.*")


def committed(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Records of each query that a checkpoint's finished batches have; a batch that was planned and not finished will run again as it was."""
    numbers = lambda kind: {int(name) for path, _, _ in listing(spark, f"{checkpoint}/{kind}") if (name := path.rsplit("/", 1)[-1]).isdigit()}
    planned = numbers("offsets")
    if not planned:
        return {}
    last = max(numbers("commits") & planned, default=None)
    if last is None:
        return {}
    said = (read_text(spark, f"{checkpoint}/offsets/{last}") or "").strip().splitlines()
    return {q: int(n) for q, n in json.loads(said[-1]).items()}
