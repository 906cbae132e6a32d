"""Columns of numbers packed into binary rows that Spark deals out by shard.

Rows of a few numbers cost the JVM more than the numbers are worth; a task
therefore packs what it sends to a shard into one row: ``shard`` says where it
goes, ``kind`` what it holds, ``data`` has the count of its rows and each
column's values, ``extra`` any bytes besides.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "shard int, kind int, data binary, extra binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("extra", pa.binary())])
Blob = tuple[int, int, bytes, bytes | None]


def pack(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, dtypes: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for d in dtypes:
        out.append(np.frombuffer(blob, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def join(parts: list[list[np.ndarray]], dtypes: list) -> list[np.ndarray]:
    if not parts:
        return [np.zeros(0, d) for d in dtypes]
    return [np.concatenate(x) for x in zip(*parts)]


def deal(columns: list[np.ndarray], shard: np.ndarray, kind: int) -> Iterator[Blob]:
    """A blob for the rows of each shard, in their order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(s))):
        at = order[a:b]
        yield int(s[a]), kind, pack([c[at] for c in columns]), None


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """From the upper half of well-mixed 64-bit hashes, so that the lower half still tells keys of a shard apart."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def batches_of(rows: Iterable[Blob], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + len(r[3] or b"")
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[Blob]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)


def blobs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Blob]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()


def shards(spark: SparkSession) -> int:
    """Shards of an exchange: the session's number of shuffle partitions, which its owner sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange(rows: DataFrame, n: int) -> DataFrame:
    """Every shard in a task of its own."""
    return rows.repartitionById(n, F.col("shard"))


def binary_column(values: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column cut from one buffer at the bounds."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the session names. Where none is set, a session in one process gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[[^,]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidepool-"))
    return df.checkpoint()


def spill(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that the session names for checkpoints, on any of Hadoop's file systems. The files go when the driver's process ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(df.limit(0))
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Have the driver find out which shuffles nothing refers to any more, so that their files go now and not at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_document(kind: int, dtypes: list):
    """Blobs of a kind to one row per document (their first column): id, and the other columns as records."""

    def rows(batches):
        parts = [unpack(data, dtypes) for _, k, data, _ in blobs_in(batches) if k == kind]
        if not parts:
            return
        doc, *rest = join(parts, dtypes)
        del parts
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        record = np.empty(len(doc), record_type(dtypes))
        for i, c in enumerate(rest):
            record[f"f{i}"] = c[order]
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        for at in range(0, len(cuts) - 1, 20_000):
            c = cuts[at : at + 20_001]
            part = record[c[0] : c[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[c[:-1]]), binary_column(part.tobytes(), (c - c[0]) * record.dtype.itemsize)], names=["id", "found"])

    return rows


def record_type(dtypes: list) -> np.dtype:
    return np.dtype([(f"f{i}", d) for i, d in enumerate(dtypes[1:])])
