"""Packing by column generation for the cutting-stock problem.

Every document becomes its token ids plus an end id, and is cut by a rule that depends on its length
alone: full sequences, then a remainder cut at a multiple of GRAIN, so that only SEQUENCE / GRAIN +
GRAIN - 1 piece lengths exist. A linear program over packing patterns covers the histogram of piece
lengths; a knapsack dynamic program prices new patterns until none improves it. Rounded-down pattern
counts are issued, the bounded rest is packed first-fit by decreasing length, and pieces are assigned
to pattern slots by their rank within their length.

The driver only ever holds the histogram and the patterns, both bounded by the number of lengths.

Defined results: a null or empty text is one piece, the end id; texts are tokenized whole; repeated
rows are packed each; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from functools import cached_property
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._text import held, slices, tidy
from .bpe import LATIN_ONLY

SEQUENCE = 2048
GRAIN = 64
END_ID = 1
KNOWN_WORDS = 500_000
#: The word tokenizer's own split, for lower-cased texts of Latin characters.
WORD_PATTERN = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


class WordTokenizer:
    """Ids by the tokenizers library, with a bounded table of words it has already encoded."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one text at a time; the cluster is the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # for words that are split and lower-cased already: the same merges without the normalizer and the split
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.plain.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.latin = re.compile(LATIN_ONLY).fullmatch
        self.split = re.compile(WORD_PATTERN).findall
        self.known: dict[str, bytes] = {}

    @cached_property
    def full(self):
        """The file's tokenizer as it is, built only where a text needs it."""
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(self.path)
        full.no_truncation()
        full.no_padding()
        return full

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, split: list[list[str]]) -> None:
        """Encode the words not yet in the table; a full table keeps its older half, where the frequent words are."""
        fresh = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known = dict(islice(self.known.items(), KNOWN_WORDS // 2))
            fresh = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        order = list(fresh)
        for lo in range(0, len(order), 2000):
            part = order[lo : lo + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                buffer, start = ids.tobytes(), 0
                for word, end in zip(part, (cut * 4).tolist(), strict=True):
                    self.known[word] = buffer[start:end]
                    start = end
            else:
                for word in part:
                    self.known[word] = self._library(word).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without the end id."""
        split = [self.split(t.lower()) if "<|" not in t and self.latin(t) else None for t in texts]
        self._learn([words for words in split if words])
        known = self.known.__getitem__
        return [b"".join(map(known, words)) if words is not None else self._library(t).tobytes() for t, words in zip(texts, split, strict=True)]


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer; it goes when a task of another operator starts."""
    return held(path, lambda: WordTokenizer(path))


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    full, rest = divmod(n, SEQUENCE)
    main = rest // GRAIN * GRAIN
    pieces = [(i * SEQUENCE, SEQUENCE) for i in range(full)]
    if main:
        pieces.append((full * SEQUENCE, main))
    if rest > main:
        pieces.append((full * SEQUENCE + main, rest - main))
    return pieces


def pieces(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = documents.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "long")
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            row, out = [], []
            for at, ids in enumerate(tokenizer(path).encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                for start, length in cut(n):
                    row.append(at)
                    out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, columns)], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run, holds=path), schema)


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths that fits."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], values[order]
    usable = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := usable[c]:
            offer = best[c - sizes[:k]] + worth[:k]
            j = int(offer.argmax())
            if offer[j] > best[c]:
                best[c], chosen[c] = offer[j], j
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
            continue
        pattern[order[chosen[c]]] += 1
        c -= int(sizes[chosen[c]])
    return float(best[capacity]), pattern


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int = SEQUENCE, gap: float = 1e-4, rounds: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional counts that cover ``demand``, by revised simplex.

    Stops when no pattern prices out, or when the dual bound proves the count within ``gap``.
    """
    basis = np.diag(capacity // lengths).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0)
        dual = inverse.sum(axis=0)
        value, pattern = best_pattern(lengths, np.maximum(dual, 0), capacity)
        # dual / value is feasible, so no cover uses fewer than dual @ demand / value sequences
        if value <= 1 + 1e-9 or amount.sum() * value <= float(np.maximum(dual, 0) @ demand) * (1 + gap):
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pattern
    inverse = np.linalg.inv(basis)
    return np.rint(basis).astype(np.int64), np.maximum(inverse @ demand, 0)


def first_fit_decreasing(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold the remaining pieces, largest first, one bin at a time."""
    left, out = left.copy(), []
    order = np.argsort(-lengths)
    while left.any():
        room, pattern = capacity, np.zeros(len(lengths), np.int64)
        for j in order:
            if take := min(int(left[j]), room // int(lengths[j])):
                pattern[j], room = take, room - take * int(lengths[j])
                left[j] -= take
        out.append(pattern)
    return out


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, offset) for every slot group."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    columns, amounts = solve_patterns(lengths, demand.astype(float), capacity)
    left, issued = demand.copy(), []
    for j in np.argsort(-amounts):
        pattern = columns[:, j]
        used = pattern > 0
        times = min(int(amounts[j] + 1e-9), int((left[used] // pattern[used]).min()))
        if times > 0:
            issued.append((pattern, times))
            left -= times * pattern
    issued += [(p, 1) for p in first_fit_decreasing(lengths, left, capacity)]
    rank, sequence, out = np.zeros(len(lengths), np.int64), 0, []
    for pattern, times in issued:
        offset = 0
        for j in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[j])
            out.append((int(lengths[j]), int(rank[j]), int(rank[j]) + times * each, each, sequence, offset))
            rank[j] += times * each
            offset += each * int(lengths[j])
        sequence += times
    return out


def pack(documents: DataFrame, path: str) -> DataFrame:
    """Every piece with its sequence and its offset there (see the module text)."""
    spark = documents.sparkSession
    table, _ = materialize(pieces(documents, path), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(histogram) or [(0,) * 6], "slot_length long, lo long, hi long, each long, first_sequence long, slot_offset long")
    # ranks within a length, in two levels, so that no length is ranked by one task
    buckets = int(min(1 << 14, max(1, sum(histogram.values()) // 256)))
    marked = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = marked.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start"))
    ranked = marked.withColumn("inner", inner).join(before.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("inner") - 1 + F.coalesce("before", F.lit(0)))
    step = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - lo) div each")).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
