"""Session defaults, and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped_to: set[str] = set()


def build_session(app: str = "driftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; anything in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give executors the package as a zip, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped_to:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="driftlens-"), "driftlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped_to.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; on a local master that names none (tests), a local folder.

    What is checkpointed goes when the application ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "driftlens-checkpoints"))
    place = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
