"""Readers and writers: JSON lines, parquet, run folders, tables, and the review queue."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import align, available, struct

QUEUE = struct("request_id string, created_at string, status string, query string, source_filter string, reason string, n_results int, flags strings, confidence double")


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, limit: int | None = None, only_jsonl: bool = True) -> DataFrame:
    """Records of .jsonl files or of folders of them; lines that aren't JSON objects are left out."""
    corrupt = "_tp_corrupt"
    wide = T.StructType([*schema, T.StructField(corrupt, T.StringType())])
    reader = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    df = (reader.option("pathGlobFilter", "*.jsonl") if only_jsonl else reader).json(paths)
    good = df.where(F.col(corrupt).isNull()).drop(corrupt)
    return good if limit is None else good.limit(limit)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Those of the columns that the files have; the scan reads no others. ``most``: a cap that the caller asks for."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*available(df, list(columns)))
    return df if most is None else df.limit(most)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if exists(spark, c)), None)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified) of the files below a folder of any Hadoop file system."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def signature(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and last change of a dataset: the key under which results may be remembered."""
    files = [f for f in listing(spark, path) if "/_" not in f[0].rsplit("/", 1)[-1]]
    return len(files), sum(f[1] for f in files), max((f[2] for f in files), default=0)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then renamed."""
    fs, p, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def run_id(text: str) -> str:
    """Fit for a folder's name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-")[:120] or "run"


class TitleCache:
    """Titles of products that lookups have found, as lines of JSON that grow (parent_asin, title)."""

    SCHEMA = struct("parent_asin string, title string")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def known(self) -> DataFrame:
        """(product_name, product_title), one title each; lines without either are left out."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "product_name string, product_title string")
        rows = self.spark.read.schema(self.SCHEMA).json(self.path).select(F.trim("parent_asin").alias("product_name"), F.trim("title").alias("product_title"))
        return rows.where("product_name <> '' and product_title <> ''").groupBy("product_name").agg(F.max("product_title").alias("product_title"))

    def look_up(self, names: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
        """Titles of the names; those that the cache lacks come from ``metadata`` (parent_asin, title) and are remembered."""
        wanted = names.select(F.trim("product_name").alias("product_name")).where("product_name <> ''").distinct()
        if metadata is not None:
            lacking = wanted.join(self.known(), "product_name", "left_anti")
            titles = metadata.select(F.trim("parent_asin").alias("parent_asin"), F.trim("title").alias("title")).where("title <> ''")
            found = titles.join(lacking.withColumnRenamed("product_name", "parent_asin"), "parent_asin", "left_semi")
            found.groupBy("parent_asin").agg(F.max("title").alias("title")).write.mode("append").json(self.path)
        return wanted.join(self.known(), "product_name")


class Runs:
    """A dataset as completed runs and a pointer to the current one: <root>/runs/<id>, and <root>/_CURRENT.json."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, name: str, promote: bool = True, files: int | None = None) -> str:
        """A run of its own; readers see it whole, when the pointer turns to it."""
        path = f"{self.root}/runs/{run_id(name)}"
        writer = df.write.mode("overwrite")
        (writer if files is None else writer.option("maxRecordsPerFile", files)).parquet(path)
        if promote:
            self.promote(name)
        return path

    def promote(self, name: str) -> None:
        if not exists(self.spark, f"{self.root}/runs/{run_id(name)}/_SUCCESS"):
            raise ValueError(f"run {name} isn't complete")
        write_text(self.spark, f"{self.root}/_CURRENT.json", json.dumps({"run": run_id(name)}))

    def current(self) -> str | None:
        """The promoted run, or else the newest complete one."""
        if said := read_text(self.spark, f"{self.root}/_CURRENT.json"):
            return f"{self.root}/runs/{json.loads(said)['run']}"
        done = [f for f in listing(self.spark, f"{self.root}/runs") if f[0].endswith("/_SUCCESS")]
        return max(done, key=lambda f: f[2])[0].removesuffix("/_SUCCESS") if done else None

    def remove_stale(self) -> list[str]:
        """Delete runs that aren't current; their names."""
        gone = self.stale()
        for name in gone:
            remove(self.spark, f"{self.root}/runs/{name}")
        return gone

    def stale(self) -> list[str]:
        """Runs that aren't current."""
        now = (self.current() or "").rsplit("/", 1)[-1]
        names = {f[0].split("/runs/", 1)[1].split("/", 1)[0] for f in listing(self.spark, f"{self.root}/runs")}
        return sorted(names - {now})

    def read(self) -> DataFrame:
        path = self.current()
        if path is None:
            raise FileNotFoundError(f"no complete run below {self.root}")
        return self.spark.read.parquet(path)


def load_table(df: DataFrame, table: str, schema: T.StructType | None = None) -> int:
    """Replace a catalog table by the frame, columns matched by name; the rows it then has."""
    (align(df, schema) if schema else df).write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table).count()


def merged(have: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Upsert: rows of ``new`` in place of those of ``have`` with the same key."""
    kept = have.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_tp_rank", F.row_number().over(w)).where("_tp_rank = 1").drop("_tp_rank")


def append_queue(requests: DataFrame, path: str) -> None:
    align(requests, QUEUE).write.mode("append").json(path)


def queue(spark: SparkSession, path: str, status: str | None = "pending", limit: int = 50) -> DataFrame:
    """Requests for people, newest first."""
    df = spark.read.schema(QUEUE).json(path).where("request_id is not null")
    if status:
        df = df.where(F.lower("status") == status.lower())
    return df.orderBy(F.desc("created_at"), "request_id").limit(limit)
