"""Files of any Hadoop file system, by the driver: copies, uploads, promotion with removal of stale files, line and row counts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _fs, exists, listing, read_text, write_text

MARKER = "_CURRENT.json"


def relative(path: str, root: str) -> str:
    """A file's path below a root; parts that lead out of it, or nowhere, are refused."""
    inside = path.split("://", 1)[-1].removeprefix("file:")
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    at = inside.find(f"{base}/")
    parts = (inside[at + len(base) + 1 :] if at >= 0 else inside).split("/")
    if at < 0 or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"{path} isn't below {root}")
    return "/".join(parts)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """One file; what was there is replaced when the copy is whole."""
    fs, p, jvm = _fs(spark, source)
    into, q, _ = _fs(spark, target)
    part = jvm.org.apache.hadoop.fs.Path(f"{target}.part")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, into, part, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    into.delete(q, False)
    into.rename(part, q)


def delete(spark: SparkSession, path: str) -> bool:
    """A file or a whole prefix; whether there was one."""
    fs, p, _ = _fs(spark, path)
    return bool(fs.delete(p, True))


def mirror(spark: SparkSession, source: str, target: str, marker: str = MARKER, on_progress: Callable[[dict], None] | None = None, every: int = 100) -> dict:
    """All files of a prefix into another one, in which no others remain but the marker.

    Everything is planned before the first file is touched, so a prefix that is refused changes nothing.
    """
    wanted = {relative(f[0], source): f[0] for f in listing(spark, source)}
    wanted.pop(marker, None)
    if not wanted:
        raise FileNotFoundError(f"no files below {source}")
    have = {relative(f[0], target) for f in listing(spark, target)}
    stale = sorted(have - set(wanted) - {marker})
    for i, (name, path) in enumerate(sorted(wanted.items()), 1):
        copy(spark, path, f"{target.rstrip('/')}/{name}")
        if on_progress and (i in (1, len(wanted)) or i % max(1, every) == 0):
            on_progress({"copied_count": i, "removed_count": len(stale), "total_objects": len(wanted)})
    for name in stale:
        delete(spark, f"{target.rstrip('/')}/{name}")
    return {"copied_count": len(wanted), "removed_count": len(stale), "removed": stale}


def promote(spark: SparkSession, run: str, current: str, run_id: str, details: dict | None = None) -> dict:
    """Make ``current`` what a run is: copied, stale files removed, and then a marker that names the run."""
    done = mirror(spark, run, current)
    said = {"run_id": run_id, "promoted_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), **(details or {})}
    write_text(spark, f"{current.rstrip('/')}/{MARKER}", json.dumps(said, sort_keys=True))
    return {"copied_count": done["copied_count"], "removed_count": done["removed_count"], "marker": f"{current.rstrip('/')}/{MARKER}"}


def marker(spark: SparkSession, current: str) -> dict | None:
    text = read_text(spark, f"{current.rstrip('/')}/{MARKER}")
    return json.loads(text) if text else None


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those that don't exist."""
    return [p for p in paths if not exists(spark, p)]


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of text files; a last one without an end counts."""
    return spark.read.text(path).count()


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet dataset from its files' footers: no column is read."""
    rows: DataFrame = spark.read.parquet(path)
    return rows.agg(F.count("*")).first()[0]
