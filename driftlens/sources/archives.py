"""Archives and coverage recordings as DataFrames: binary files in, one nested row an entry out."""

from __future__ import annotations

import hashlib
import io
import itertools
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classfile import parse_class

#: Resources over so many bytes are listed and hashed, but their text is not kept, so nothing is searched in it (a parameter of the readers).
TEXT_LIMIT = 262_144
ROWS_PER_FRAME = 500
KEY = "struct<cls: string, name: string, desc: string>"
ENTRY = f"""path string, entry string, kind string, sha256 string, text string, cls string, access int, parent string,
interfaces array<string>, members array<struct<kind: string, name: string, desc: string, access: int, calls: array<{KEY}>, uses: array<string>>>,
refs array<{KEY}>, class_refs array<string>, strings array<string>, fingerprint string"""


def _entries(path: str, content: bytes, text_limit: int | None):
    blank = dict.fromkeys(("text", "cls", "access", "parent", "interfaces", "members", "refs", "class_refs", "strings", "fingerprint"))
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        yield {"path": path, "entry": None, "sha256": None, **blank, "kind": "broken"}
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            try:
                data = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                yield {"path": path, "entry": info.filename, "sha256": None, **blank, "kind": "broken"}
                continue
            row = {"path": path, "entry": info.filename, "sha256": hashlib.sha256(data).hexdigest(), **blank}
            if info.filename.endswith(".class"):
                try:
                    c = parse_class(data)
                except (ValueError, IndexError, struct.error, TypeError):
                    yield row | {"kind": "unparsed"}
                    continue
                key = lambda k: {"cls": k[0], "name": k[1], "desc": k[2]}
                members = [{"kind": m.kind, "name": m.name, "desc": m.desc, "access": m.access, "calls": [key(x) for x in m.calls], "uses": m.uses} for m in c.members]
                yield row | {"kind": "class", "cls": c.name, "access": c.access, "parent": c.parent, "interfaces": c.interfaces, "members": members, "refs": [key(x) for x in c.refs], "class_refs": c.class_refs, "strings": c.strings, "fingerprint": c.fingerprint}
            else:
                text = None
                if text_limit is None or len(data) <= text_limit:
                    try:
                        text = data.decode("utf-8")
                    except UnicodeDecodeError:
                        text = None
                yield row | {"kind": "resource", "text": text}


def read_archives(spark: SparkSession, path: str, glob: str = "*.jar", text_limit: int | None = TEXT_LIMIT) -> DataFrame:
    """One row for every entry of every archive under ``path``; unparsable classes have kind ``unparsed``, unreadable
    archives and entries kind ``broken``. Resources over ``text_limit`` bytes (None: no limit), or not in UTF-8, have no text."""
    return scan_archives(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), text_limit)


def scan_archives(files: DataFrame, text_limit: int | None = TEXT_LIMIT) -> DataFrame:
    """The same, from a table of (path, content)."""
    fields = ["path", "entry", "kind", "sha256", "text", "cls", "access", "parent", "interfaces", "members", "refs", "class_refs", "strings", "fingerprint"]

    def run(batches):
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = _entries(path, content, text_limit)
                while part := list(itertools.islice(rows, ROWS_PER_FRAME)):
                    yield pd.DataFrame(part, columns=fields).astype({"access": "Int32"})

    return files.select("path", "content").mapInPandas(run, ENTRY)


def api_members(entries: DataFrame) -> DataFrame:
    """path, cls, name, desc and access of the public surface; the class itself has null name and desc."""
    from ..functions.members import PUBLIC, has, is_api

    classes = entries.where((F.col("kind") == "class") & has(F.col("access"), PUBLIC))
    own = classes.select("path", "cls", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("desc"), "access")
    members = classes.select("path", "cls", F.col("access").alias("class_access"), F.explode("members").alias("m"))
    members = members.where(is_api(F.col("class_access"), F.col("m.access"))).select("path", "cls", "m.name", "m.desc", "m.access")
    return own.unionByName(members)


def calls(entries: DataFrame) -> DataFrame:
    """path, caller (struct) and callee (struct): the edges of the call graph."""
    members = entries.where("kind = 'class'").select("path", "cls", F.explode("members").alias("m"))
    return members.select("path", F.struct("cls", "m.name", "m.desc").alias("caller"), F.explode("m.calls").alias("callee"))


def _recording(path: str, content: bytes):
    """(session, class, covered) of a coverage recording: header, session and probe blocks."""
    stream, session = io.BytesIO(content), None

    def text() -> str:
        return stream.read(int.from_bytes(stream.read(2), "big")).decode("utf-8")

    def length() -> int:
        value = shift = 0
        while True:
            byte = stream.read(1)[0]
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while block := stream.read(1):
        if block == b"\x01":
            if stream.read(4)[:2] != b"\xc0\xc0":
                raise ValueError(f"{path}: not a coverage recording")
        elif block == b"\x10":
            session = text()
            stream.read(16)
        elif block == b"\x11":
            stream.read(8)
            name = text()
            n = length()
            packed = int.from_bytes(stream.read(-(-n // 8)), "little")
            yield path, session, name, bool(packed & ((1 << n) - 1))
        else:
            raise ValueError(f"{path}: unknown block {block.hex()}")


def scan_recordings(files: DataFrame) -> DataFrame:
    """path, session, cls and covered, probes of a class combined over all its blocks."""

    def run(batches):
        for frame in batches:
            rows = [r for path, content in zip(frame["path"], frame["content"], strict=True) for r in _recording(path, content)]
            yield pd.DataFrame(rows, columns=["path", "session", "cls", "covered"])

    read = files.select("path", "content").mapInPandas(run, "path string, session string, cls string, covered boolean")
    return read.groupBy("path", "cls").agg(F.max("session").alias("session"), F.bool_or("covered").alias("covered"))
