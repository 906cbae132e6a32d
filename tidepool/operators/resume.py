"""Long jobs in numbered parts: each part is one folder, a marker says how far the job is, and a second run goes on there.

Rows belong to parts by a hash of their key, so parts don't depend on the order
in which files are read, and a part that runs again replaces its own output.
The input is read once: one write deals it out into a folder per part below the
target, and parts are taken from there, also by later runs. That copy goes when
the job is complete. What the input was is part of the marker, so a job can't
go on over files that have changed since.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import exists, read_text, remove, write_text

MARKER, STAGED = "_progress.json", "_staged"


def progress(spark: SparkSession, target: str) -> dict | None:
    text = read_text(spark, f"{target}/{MARKER}")
    return json.loads(text) if text else None


def check(saved: dict, settings: dict) -> None:
    """A job may go on only as it began."""
    changed = sorted(k for k in {*saved.get("settings", {}), *settings} if saved.get("settings", {}).get(k) != settings.get(k))
    if changed:
        raise RuntimeError(f"the saved progress was made with other settings: {', '.join(changed)}")


def input_of(df: DataFrame) -> str:
    """A digest of the names of the files that a frame reads; writers give new files new names. Frames without files have one of their own."""
    return hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()[:16]


def stage(df: DataFrame, folder: str, parts: int, key: str) -> None:
    """One pass over the input: its rows into ``_tp_part=<n>`` folders. A copy that is whole stays."""
    spark = df.sparkSession
    if exists(spark, f"{folder}/_SUCCESS"):
        return
    dealt = df.withColumn("_tp_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    width = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # several tasks a part where there are more tasks than parts: a null or frequent key doesn't meet in one
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant")), F.lit(-(-width // parts)))
    dealt.repartition(width, "_tp_part", spread).write.mode("overwrite").partitionBy("_tp_part").parquet(folder)


def staged_part(spark: SparkSession, folder: str, part: int, schema) -> DataFrame:
    """The rows of a part; none if the hash gave it none."""
    path = f"{folder}/_tp_part={part}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def run(df: DataFrame, make: Callable[[DataFrame], DataFrame], target: str, parts: int, settings: dict, key: str = "review_id") -> dict:
    """``make`` of every part of ``df`` below ``target``; parts that are done stay. Returns the last marker."""
    spark = df.sparkSession
    settings = json.loads(json.dumps({"parts": parts, "key": key, "input": input_of(df), **settings}, default=str))
    saved = progress(spark, target)
    done = 0
    if saved is not None:
        check(saved, settings)
        done = saved["parts_done"]
        lost = [i for i in range(done) if not exists(spark, f"{target}/part={i}/_SUCCESS")]
        if lost:
            raise RuntimeError(f"parts {lost[:10]} are said to be done and aren't there")
    said = saved or {"settings": settings, "parts_done": 0, "status": "running"}
    if done == parts:
        return said
    if saved is None:
        write_text(spark, f"{target}/{MARKER}", json.dumps(said))
    if parts > 1:
        stage(df, f"{target}/{STAGED}", parts, key)
    for i in range(done, parts):
        mine = staged_part(spark, f"{target}/{STAGED}", i, df.schema) if parts > 1 else df
        make(mine).write.mode("overwrite").parquet(f"{target}/part={i}")
        said = {"settings": settings, "parts_done": i + 1, "status": "completed" if i + 1 == parts else "running"}
        write_text(spark, f"{target}/{MARKER}", json.dumps(said))
    remove(spark, f"{target}/{STAGED}")
    return said


def result(spark: SparkSession, target: str) -> DataFrame:
    """All parts of a job that is complete."""
    saved = progress(spark, target)
    if not saved or saved["status"] != "completed":
        raise RuntimeError(f"{target} isn't complete")
    return spark.read.option("basePath", target).parquet(*(f"{target}/part={i}" for i in range(saved["parts_done"]))).drop("part")
