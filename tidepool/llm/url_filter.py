"""URL filters by host and path rules: a range join by sorting and one sweep.

A host's labels in reverse, each ended by a dot, are its canonical key:
``www.example.com`` is ``com.example.www.``. A rule for a host and all its
subdomains is then the interval of keys that begin with the rule's, and such
intervals are nested or apart. URLs and rules are dealt out by ranges of
(key, path, hash of the row), so that a host of any share of the URLs is cut
into several ranges; a rule goes to each range that its interval meets. Every
task has its rows sorted by Spark and sweeps over them once, a batch at a time,
with a stack of the rules' hosts that the present key lies in. The paths of one
host's rules are sorted too, and another stack gives each the rule that it lies
in; so the longest path that a URL's path begins with is found by bisection and
by going outwards.

The bounds of ranges come from a random sample of about ``SAMPLED`` keys a
range, which decides how even the ranges are and nothing else. A task holds the
rules of the hosts that its present key lies in, and no URLs but those of a
batch.

Defined results: a null URL or one without ``://`` has an empty host and path,
and no rule but one for the empty host fits it; ports and user names are part
of the host as they stand; of the rules that fit, the one with the longest host
and path together decides, then the longer host; of rules with the same host
and path that disagree, ``block`` does; no rule: ``default``. Nulls in rules
are empty texts. All columns of the input come back, but those named like
results are replaced. Repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import shards

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MADE = ["host", "path", "rule", "verdict"]
#: Keys sampled for each range, and a code point that follows all others.
SAMPLED, LAST = 50, "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased, and from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def canonical(host: Column) -> Column:
    """The labels in reverse, each ended by a dot; the empty host has the empty key, which all others begin with."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


@dataclass
class _Host:
    """The rules of one host. ``outer``: for each path the place of the longest other path that it begins with."""

    key: str
    paths: list[str] = field(default_factory=list)
    rules: list[tuple] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    open: list[int] = field(default_factory=list)

    def add(self, host: str, path: str, verdict: str) -> None:
        """Paths come in order."""
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        self.outer.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.rules.append((len(host) + len(path), len(host), host + path, verdict))

    def longest(self, path: str) -> tuple | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else None


class _Sweep:
    def __init__(self, default: str):
        self.stack: list[_Host] = []
        self.default = (None, default)
        self.last: tuple | None = None

    def _enter(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._enter(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(_Host(key))
        self.stack[-1].add(host, path, verdict)
        self.last = None

    def url(self, key: str, path: str) -> tuple:
        if self.last is None or self.last[:2] != (key, path):
            self._enter(key)
            fit = [r for h in self.stack if (r := h.longest(path))]
            self.last = (key, path, max(fit)[2:] if fit else self.default)
        return self.last[2]


def _judge(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(default)
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("_tp_key", "_tp_kind", "host", "path", "verdict"))
            for key, kind, host, path, verdict in zip(*columns):
                if kind:
                    found.append(sweep.url(key, path))
                else:
                    sweep.rule(key, host, path, verdict)
            urls = batch.filter(pc.equal(batch.column("_tp_kind"), 1))
            said = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([urls.column("_tp_row"), urls.column("host"), urls.column("path"), *said], names=["_tp_row", *MADE])

    return run


def bounds_of(keys: DataFrame, n: int) -> list[str]:
    """At most n - 1 bounds of ranges that hold about as many of the keys each."""
    rows = keys.count()
    if n < 2 or not rows:
        return []
    sample = sorted(r[0] for r in keys.sample(min(1.0, SAMPLED * n / rows), 17).collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has verdict, host and path.

    The other columns of ``pages`` travel with it: select those that are needed first.
    """
    spark = pages.sparkSession
    n = shards(spark)
    carried = [c for c in pages.columns if c not in MADE]
    host, path = host_and_path(F.col(url_col).cast("string"))
    row = F.struct(*(F.col(f"`{c}`") for c in carried))
    urls = pages.select(row.alias("_tp_row"), host.alias("host"), path.alias("path"), F.hex(F.xxhash64(*(F.col(f"`{c}`") for c in carried))).alias("_tp_hash"))
    urls = urls.withColumn("_tp_key", canonical(F.col("host")))
    place = F.concat("_tp_key", "path", F.lit("\0"), "_tp_hash")
    bounds = bounds_of(urls.select(place), n)

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.array([bisect_right(bounds, p) for p in places], np.int32))

    @F.pandas_udf("array<int>")
    def ranges_of(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_right(bounds, k), bisect_right(bounds, k + LAST) + 1)) for k in keys])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rules.select(F.translate(text("host"), UPPER, LOWER).alias("host"), text("path").alias("path"), text("verdict").alias("verdict"))
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("_tp_key", canonical(F.col("host")))
    own = own.withColumn("_tp_range", F.explode(ranges_of("_tp_key"))).withColumn("_tp_kind", F.lit(0)).withColumn("_tp_row", F.lit(None).cast(urls.schema["_tp_row"].dataType))
    asked = urls.withColumn("_tp_range", range_of(place)).withColumn("_tp_kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string")).drop("_tp_hash")
    dealt = own.unionByName(asked).repartitionById(n, F.col("_tp_range")).sortWithinPartitions("_tp_key", "_tp_kind", "path")
    schema = T.StructType([urls.schema["_tp_row"], *(T.StructField(c, T.StringType()) for c in MADE)])
    judged = dealt.select("_tp_key", "_tp_kind", "host", "path", "verdict", "_tp_row").mapInArrow(_judge(default), schema)
    return judged.select(*(F.col("_tp_row").getField(c).alias(c) for c in carried), *MADE)
