"""A keyed table in buckets, for changes that touch little of it.

Rows lie in ``bucket=<n>`` folders by a hash of their key. An upsert or a
deletion finds the buckets of the keys that change, reads and writes those
alone, and Spark's dynamic partition overwrite puts them in place when the job
has succeeded; all others stay as they are, files and all. A change that runs
again has the same result. The number of buckets is fixed when the store is
made: choose it so that a bucket is a file or a few.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import exists, read_text, remove, write_text

#: What the store is, and that it has had rows: dynamic overwrite leaves no marker of its own.
ABOUT, FILLED = "_store.json", "_FILLED"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        said = read_text(spark, f"{self.path}/{ABOUT}")
        if said is None:
            raise FileNotFoundError(f"no store at {path}")
        about = json.loads(said)
        self.key, self.buckets = about["key"], about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = 64) -> Store:
        """An empty store; one that is there already must have been made alike."""
        about = {"key": key, "buckets": buckets, "schema": json.loads(schema.json())}
        if "bucket" in schema.names or key not in schema.names:
            raise ValueError("the schema must have the key and no column called bucket")
        if exists(spark, f"{path}/{ABOUT}"):
            have = cls(spark, path)
            if (have.key, have.buckets, have.schema.simpleString()) != (key, buckets, schema.simpleString()):
                raise ValueError(f"{path} holds another store")
            return have
        write_text(spark, f"{path}/{ABOUT}", json.dumps(about))
        return cls(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])
        if not self._filled():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def _filled(self) -> bool:
        return exists(self.spark, f"{self.path}/{FILLED}")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def get(self, *keys) -> DataFrame:
        """Rows of the keys: reads their buckets alone."""
        wanted = self._bucketed(self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]])))
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        return self._stored().where(F.col("bucket").isin(buckets) & F.col(self.key).isin(*keys)).drop("bucket")

    def upsert(self, new: DataFrame) -> list[int]:
        """Put rows in, or in place of those with their keys; the buckets that were written. Rows without a key are left out.

        Of several new rows with one key the last in order of all columns counts.
        """
        fit = new.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self._change(fit.where(F.col(self.key).isNotNull()), keep=True)

    def delete(self, keys: DataFrame) -> list[int]:
        """Take the rows of the keys out; the buckets that were written."""
        gone = keys.select(F.col(self.key).cast(self.schema[self.key].dataType)).where(F.col(self.key).isNotNull()).distinct()
        return self._change(gone, keep=False)

    def _change(self, rows: DataFrame, keep: bool) -> list[int]:
        rows = self._bucketed(rows).persist()
        try:
            touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most a number a bucket
            if not touched or not (keep or self._filled()):
                return []
            have = self._stored().where(F.col("bucket").isin(touched)).join(rows.select(self.key, "bucket").distinct(), ["bucket", self.key], "left_anti")
            columns = [*self.schema.names, "bucket"]
            out = have.select(*columns)
            if keep:
                order = Window.partitionBy("bucket", self.key).orderBy(*(F.col(c).desc_nulls_last() for c in self.schema.names if c != self.key and not _unordered(self.schema[c].dataType)), F.lit(0))
                out = out.unionByName(rows.withColumn("_tp_rank", F.row_number().over(order)).where("_tp_rank = 1").select(*columns))
            left = touched if keep else sorted(r.bucket for r in out.select("bucket").distinct().collect())
            out.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            if not self._filled():
                write_text(self.spark, f"{self.path}/{FILLED}", "")
            for bucket in {*touched} - {*left}:  # dynamic overwrite doesn't see buckets without rows
                remove(self.spark, f"{self.path}/bucket={bucket}")
            return touched
        finally:
            rows.unpersist()


def _unordered(kind: T.DataType) -> bool:
    return isinstance(kind, (T.MapType, T.VariantType))
