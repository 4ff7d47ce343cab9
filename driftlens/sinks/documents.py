"""Report documents: single JSON or text objects written through Hadoop's file system, so any store works.

Everything large stays a DataFrame; what is written here is one report, gate or list of test files.
A document is staged beside its target and renamed, so readers never see half of one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import upsert


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the object at ``path`` by ``text`` in UTF-8."""
    jvm, place, fs = _file_system(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(staged, place):
        raise OSError(f"cannot move the finished document to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The object's text, or None where there is none."""
    _, place, fs = _file_system(spark, path)
    if not fs.exists(place):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def canonical(document: Any) -> bytes:
    """Sorted keys and tight separators: equal values give equal bytes, whatever the layout was."""
    return json.dumps(document, sort_keys=True, separators=(",", ":")).encode()


def digest16(raw: bytes) -> str:
    """The first 16 hex digits of the SHA-256, as sign-offs carry it."""
    return hashlib.sha256(raw).hexdigest()[:16]


def write_json(spark: SparkSession, path: str, document: Any) -> None:
    write_text(spark, path, json.dumps(document, indent=2) + "\n")


def read_json(spark: SparkSession, path: str) -> Any:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def includes(final: DataFrame) -> DataFrame:
    """One line (value) for each test class to run, sorted, each class once; null tests go."""
    return final.where("test IS NOT NULL").select(F.concat(F.lit("**/"), "test", F.lit(".java")).alias("value")).distinct().orderBy("value")


def split_selection(suite: DataFrame, selected: DataFrame, mandatory: DataFrame) -> DataFrame:
    """(test, selected, mandatory, final): every test of the suite or the lists and where it stands.

    A mandatory test that is not selected is appended; one that is both overlaps; a test of the suite
    that is in neither list is skipped (final is false). Null tests go.
    """
    marks = [suite.select("test", F.lit(False).alias("s"), F.lit(False).alias("m")), selected.select("test", F.lit(True), F.lit(False)), mandatory.select("test", F.lit(False), F.lit(True))]
    every = marks[0].union(marks[1]).union(marks[2]).where("test IS NOT NULL")
    per = every.groupBy("test").agg(F.bool_or("s").alias("selected"), F.bool_or("m").alias("mandatory"))
    return per.withColumn("final", F.col("selected") | F.col("mandatory"))


def put_option(scorecard: DataFrame | None, options: DataFrame) -> DataFrame:
    """The scorecard with ``options`` put in; a library's version pair is one row however often it is put."""
    keys = ["library", "old_version", "new_version"]
    if scorecard is None:
        return options.dropDuplicates(keys)
    kept = scorecard.join(options.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(options.dropDuplicates(keys), allowMissingColumns=True)


OBLIGATION = "id string, status string, note string"


def close_obligation(spark: SparkSession, path: str, obligation: str, status: str, note: str | None = None, signoff: Any = None, schema: str = "driftlens/deploy-gate/v1") -> dict:
    """Put one obligation's status (and note, if given) into the gate document, which is made where it is missing.

    The entries are a table into which one row is upserted; they keep their order, and a new one comes last.
    """
    gate = read_json(spark, path) or {"schema": schema, "app": "", "project_grade": None}
    entries = gate.get("obligations_downstream") or []
    table = spark.createDataFrame([(e.get("id"), e.get("status"), e.get("note")) for e in entries], OBLIGATION)
    change = spark.createDataFrame([(obligation, status, note)], OBLIGATION)
    merged = {r.id: {"id": r.id, "status": r.status, "note": r.note or ""} for r in upsert(table, change, "id").collect()}
    order = list(dict.fromkeys([*(e.get("id") for e in entries), obligation]))
    gate |= {"obligations_downstream": [merged[i] for i in order if i in merged]} | ({} if signoff is None else {"cab_signoff": signoff})
    write_json(spark, path, gate)
    return gate


def signoff(spark: SparkSession, scorecard: str, mode: str, approver: str, note: str, timestamp: str, run: str | None = None) -> dict:
    """The approval of the scorecard at a path, tied to its bytes; a scorecard without a grade is approved as "-"."""
    read = spark.read.schema("project struct<headline_grade: string>").option("multiLine", True).json(scorecard).select("project.headline_grade").first()
    raw = bytes(spark.read.format("binaryFile").load(scorecard).select("content").first()[0])
    return {
        "approved": True, "approver": approver, "grade": (read and read[0]) or "-", "mode": mode, "note": note, "pipeline_run": run or None,
        "schema": "driftlens/cab-signoff/v1", "scorecard_sha256_16": digest16(raw), "timestamp": timestamp,
    }
