"""Shared-storage tables that cut lineage."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local one is set only on a local master that names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "driftlens-checkpoints"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


@contextlib.contextmanager
def _shuffles_end_with_the_job(spark: SparkSession):
    """Spark removes the shuffle files of the jobs run inside as soon as each ends."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet under the shared folder; return the re-read table and its path.

    The written table survives lost executors, so nothing downstream recomputes the stages before it, and the
    shuffle files behind it go at once. A table that nobody discards goes when the application ends.
    """
    return materialize_parts([df], tag)


def materialize_parts(parts: Sequence[DataFrame], tag: str) -> tuple[DataFrame, str]:
    """``materialize`` for the rows of all ``parts``, written one after another.

    Each part's shuffle files go once it is written, so the disk holds about those of one part at a time.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_dir(spark)}/driftlens/{tag}-{uuid.uuid4().hex}"
    for df in parts:
        with _shuffles_end_with_the_job(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    for path in paths:
        place, files = _file_system(spark, path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, by Hadoop's interface, so any store works."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
