"""Vectorised byte kernels over Arrow text columns: words, segment hashes, per-document sums.

Every kernel works on a chunk: the UTF-8 bytes of some whole documents laid end to end, and the
offsets at which the documents begin. No kernel looks at text row by row.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type

CHUNK_BYTES = 1 << 19
SLICE_BYTES = 4 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process up to a chunk's length, built anew for longer texts."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 2), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == CHUNK_BYTES + 2:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over whole texts; a null text counts as empty.

    A chunk holds at most ``limit`` bytes, or one text if that alone is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each document's bytes (empty documents give 0)."""
    total = np.zeros(len(mask) + 1, np.int64 if mask.dtype == bool else np.float64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of ``inside`` bytes; runs never cross documents."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: any segment's hash follows from two of them (see ``segment_hash``)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever the segment stands."""
    shift = powers(BASE_INVERSE, len(prefix))
    value = (prefix[ends] - prefix[starts]) * shift[starts]
    return mix(value ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive values, one for each position at which they fit."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * U64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mix(out)


def fitting(doc: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` consecutive values belong to one document."""
    n = len(doc) - size + 1
    return np.flatnonzero(doc[:n] == doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, each text whole."""
    for lo, hi, _, _ in text_chunks(batch.column(text), limit):
        yield batch.slice(lo, hi - lo)


_held: dict[str, object] = {}


def held(name: str, build: Callable[[], object]):
    """This process's copy of a large table, built once; it stays until a task that does not hold ``name`` starts."""
    if name not in _held:
        _held[name] = build()
    return _held[name]


def foreign(keep: str | None) -> bool:
    """Whether this worker holds another operator's tables."""
    return any(n != keep for n in _held)


def release(keep: str | None = None) -> None:
    """Drop the tables that other operators left in this worker, and give freed memory back to the system."""
    if foreign(keep):
        for name in [n for n in _held if n != keep]:
            del _held[name]
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, holds: str | None = None):
    """The batch function between two releases of memory: Python workers live on and serve one operator after another."""

    def tidied(batches):
        if foreign(holds):
            release(holds)
        try:
            yield from run(batches)
        finally:
            release(holds)

    return tidied


def text_column(kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: T.DataType) -> Callable:
    """A function of a text column, as map_text's kernels: only the text goes to Python and only the result comes back."""

    def run(columns):
        for column in columns:
            parts = [pa.array(kernel(data, offsets)) for _, _, data, offsets in text_chunks(column)]
            yield pa.concat_arrays(parts) if parts else pa.array([], parts_type)

    parts_type = to_arrow_type(kind)
    return F.arrow_udf(tidy(run), kind, ArrowUDFType.SCALAR_ITER)


def map_text(
    df: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    kernel: Callable[[np.ndarray, np.ndarray], list[np.ndarray]],
    text: str = "text",
) -> DataFrame:
    """Append the kernel's per-document columns to the ``keep`` columns, batch by Arrow batch.

    ``kernel(data, offsets)`` returns one array for each of ``fields``.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(text)):  # small batches go back, so neither side buffers much
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), *(x if isinstance(x, pa.Array) else pa.array(x) for x in kernel(data, offsets))], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
