"""Binary readers on hand-made bytes."""

import io
import struct
import zipfile

from driftlens.operators.diff import snapshot_diff
from driftlens.sources import archives, classfile


def make_class(name="a/B", methods=(), debug=None, pad=0, access=0x21):
    """A class file with the given (name, desc, access, code, calls); ``pad`` shifts every pool index."""
    pool, index = [], {}

    def add(entry):
        if entry not in index:
            index[entry] = len(pool) + 1
            pool.append(entry)
        return index[entry]

    def utf(s):
        return add(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())

    def cls(s):
        return add(b"\x07" + struct.pack(">H", utf(s)))

    def ref(owner, member, desc):
        pair = add(b"\x0c" + struct.pack(">HH", utf(member), utf(desc)))
        return add(b"\x0a" + struct.pack(">HH", cls(owner), pair))

    for i in range(pad):
        utf(f"pad{i}")
    this, parent = cls(name), cls("java/lang/Object")
    body = b""
    for m, desc, acc, calls in methods:
        code = b"".join(b"\xb8" + struct.pack(">H", ref(*c)) for c in calls) + b"\xb1"
        inner = struct.pack(">HHI", 1, 1, len(code)) + code + struct.pack(">H", 0)
        extra = b"" if debug is None else struct.pack(">HIHHH", utf("LineNumberTable"), 6, 1, 0, debug)
        inner += struct.pack(">H", 0 if debug is None else 1) + extra
        body += struct.pack(">HHHH", acc, utf(m), utf(desc), 1) + struct.pack(">HI", utf("Code"), len(inner)) + inner
    tail = struct.pack(">HI H", utf("SourceFile"), 2, utf("B.java")) if debug is not None else b""
    rest = struct.pack(">HHHHH", access, this, parent, 0, 0) + struct.pack(">H", len(methods)) + body + struct.pack(">H", 1 if tail else 0) + tail
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52 + pad, len(pool) + 1) + b"".join(pool) + rest


RUN = ("run", "()V", 1, [("x/Y", "go", "(Ljava/lang/String;)V")])


def test_class_parts_and_noise_free_fingerprint():
    c = classfile.parse_class(make_class(methods=[RUN]))
    assert (c.name, c.parent, c.members[0].calls) == ("a/B", "java/lang/Object", [("x/Y", "go", "(Ljava/lang/String;)V")])
    plain = classfile.fingerprint(make_class(methods=[RUN]))
    assert plain == classfile.fingerprint(make_class(methods=[RUN], debug=7)) == classfile.fingerprint(make_class(methods=[RUN], debug=9, pad=4))
    assert plain != classfile.fingerprint(make_class(methods=[("run", "()V", 1, [("x/Y", "stop", "()V")])]))
    assert len(classfile.fingerprint(b"junk")) == 64


def test_switches_and_wide_keep_the_walk_in_step():
    table = b"\xaa" + b"\0" * 3 + struct.pack(">iii", 0, 1, 2) + b"\0" * 8
    lookup = b"\xab" + b"\0" * (-(len(table) + 1) % 4) + struct.pack(">ii", 0, 1) + b"\0" * 8
    code = table + lookup + b"\xc4\x84\0\1\0\2" + b"\xb8\0\5" + b"\xb1"
    assert [(op, i) for op, _, i in classfile.instructions(code)] == [(0xAA, 0), (0xAB, 0), (0xC4, 0), (0xB8, 5), (0xB1, 0)]


def jar(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_diff_and_calls(spark):
    old = jar({"a/B.class": make_class(methods=[RUN]), "META-INF/services/x": b"one", "bad.class": b"junk"})
    new = jar({"a/B.class": make_class(methods=[RUN, ("more", "()V", 1, [])]), "a/C.class": make_class("a/C"), "bin": b"\xff\xfe"})
    entries = archives.scan_archives(spark.createDataFrame([("old", old), ("new", new)], "path string, content binary")).cache()
    assert sorted((r.path, r.kind, r.entry) for r in entries.collect()) == [("new", "class", "a/B.class"), ("new", "class", "a/C.class"), ("new", "resource", "bin"), ("old", "class", "a/B.class"), ("old", "resource", "META-INF/services/x"), ("old", "unparsed", "bad.class")]
    api = archives.api_members(entries)
    pick = lambda p: api.where(api.path == p).drop("path")
    changes = snapshot_diff(pick("old"), pick("new"), ["cls", "name", "desc"], ["access"]).collect()
    assert sorted((r.cls, r.name or "", r.change) for r in changes) == [("a/B", "more", "added"), ("a/C", "", "added")]
    assert {(r.caller.name, r.callee.cls) for r in archives.calls(entries).collect()} == {("run", "x/Y")}


def recording(blocks):
    out = b"\x01\xc0\xc0\x10\x07\x10" + struct.pack(">H", 2) + b"s1" + b"\0" * 16
    for name, probes in blocks:
        n, size = len(probes), b""
        while True:
            size += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                break
        bits = sum(p << i for i, p in enumerate(probes)).to_bytes(-(-len(probes) // 8), "little")
        out += b"\x11" + b"\0" * 8 + struct.pack(">H", len(name)) + name.encode() + size + bits
    return out


def test_recordings(spark):
    data = recording([("a/B", [0, 0, 1]), ("a/B", [0, 0, 0]), ("a/C", [0] * 300), ("a/D", [0] * 299 + [1]), ("a/E", [])])
    rows = archives.scan_recordings(spark.createDataFrame([("t.exec", data)], "path string, content binary")).collect()
    assert {(r.cls, r.covered) for r in rows} == {("a/B", True), ("a/C", False), ("a/D", True), ("a/E", False)}


def test_broken_archives_and_long_texts_are_told_apart(spark):
    good = jar({"a/B.class": make_class(), "long.txt": b"x" * 300_000})
    rows = archives.scan_archives(spark.createDataFrame([("good", good), ("bad", b"not a zip"), ("cut", good[:-30]), ("empty", b"")], "path string, content binary")).collect()
    assert sorted((r.path, r.kind) for r in rows) == [("bad", "broken"), ("cut", "broken"), ("empty", "broken"), ("good", "class"), ("good", "resource")]
    text = lambda limit: [r.text for r in archives.scan_archives(spark.createDataFrame([("g", good)], "path string, content binary"), limit).where("kind = 'resource'").collect()]
    assert text(archives.TEXT_LIMIT) == [None] and len(text(None)[0]) == 300_000
