"""Session factory: adaptive execution, UTC, no settings that fix a size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidepool", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; the cluster's owner sizes partitions and memory."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, below the one that the session names for checkpoints; it goes when the driver's process ends.

    Where none is set, a session in one process gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[[^,]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidepool-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def spread(scan: DataFrame) -> DataFrame:
    """A file scan of few splits dealt out to all cores, for work that costs more than moving its rows.

    Files of one row group can't be split when they are read. A scan that has as many splits as there are cores
    stays as it is, so at scale nothing is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan
