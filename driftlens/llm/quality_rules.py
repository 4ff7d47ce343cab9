"""Quality rules: exact text rules, then a hashed n-gram logistic regression with fixed thresholds.

The rules count words, symbols, repeated lines and repeated 8-word windows. A document that passes
them is scored by a logistic regression on hashed word unigrams, word pairs and 4-byte character
n-grams (mean weight per n-gram), Platt-calibrated on rows the fit has not seen.

Defined results: a null or empty text has zero words and fails the base rules; texts are read whole;
repeated rows are judged alike; with no labels the model's verdict is "kept"; extra columns pass
through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import labelled_sample
from ._store import discard, materialize
from ._text import LOWER, SPACE, U64, combine, fitting, map_text, mix, per_doc, prefix_hash, runs, segment_hash, text_column, tidy

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
BITS = 11
WIDTH = 1 << BITS
KEEP_AT = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five exact counts of every document in a chunk."""
    n_docs = len(offsets) - 1
    inside = ~SPACE[data]
    starts, ends, doc = runs(inside, offsets)
    prefix = prefix_hash(data)
    hashes = segment_hash(prefix, starts, ends)
    return {
        "n_words": np.bincount(doc, minlength=n_docs),
        "word_chars": per_doc(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": _repeated_lines(data, offsets, prefix, starts),
        "n_repeat_words": _repeated_windows(hashes, doc, n_docs),
    }


def _repeated_lines(data, offsets, prefix, word_starts) -> np.ndarray:
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    # a line ends at its break, or at the end of its document
    end = np.empty_like(begin)
    end[:-1] = np.where(doc[1:] == doc[:-1], begin[1:] - 1, offsets[doc[:-1] + 1])
    end[-1:] = offsets[-1]
    wordy = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end, doc = begin[wordy], end[wordy], doc[wordy]
    keys = segment_hash(prefix, begin, end) ^ mix(doc.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs)


def _repeated_windows(hashes, doc, n_docs) -> np.ndarray:
    at = fitting(doc, WINDOW)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    keys = combine(hashes, WINDOW)[at] ^ mix(doc[at].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(doc) + 1, np.int64)
    change[at[twice]] += 1
    change[at[twice] + WINDOW] -= 1
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def _slots(data, offsets):
    """Hashed n-grams of a chunk: (document, slot) of words, word pairs and character 4-grams."""
    starts, ends, doc = runs(~SPACE[data], offsets)
    words = segment_hash(prefix_hash(LOWER[data]), starts, ends)
    down = U64(64 - BITS)
    pair_at = fitting(doc, 2)
    same = words[pair_at] == words[pair_at + 1]
    pairs = (combine(words, 2)[pair_at] >> down).astype(np.int64)
    pairs[same] = 0  # one slot for "the same word again"
    wide = data.astype(np.uint32)
    grams = np.zeros(0, np.int64)
    gram_at = np.zeros(0, np.int64)
    if len(data) >= 4:
        code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        code *= np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA77)
        grams = code >> np.uint32(32 - BITS)
        own = np.ones(len(code), bool)
        edges = offsets[1:-1]
        for back in range(1, 4):
            own[edges[(edges >= back) & (edges - back < len(code))] - back] = False
        gram_at = np.flatnonzero(own)
        grams = grams[gram_at]
    return (doc, (words >> down).astype(np.int64)), (doc[pair_at], pairs), (gram_at, grams)


@dataclass
class Model:
    """Weights of the three n-gram families, bias and calibration: fixed in size."""

    weights: np.ndarray  # (3, WIDTH)
    slope: float
    bias: float

    def score(self, data, offsets) -> np.ndarray:
        n_docs = len(offsets) - 1
        (d1, s1), (d2, s2), (at, s3) = _slots(data, offsets)
        total = np.zeros(n_docs)
        for doc, slots, w in ((d1, s1, self.weights[0]), (d2, s2, self.weights[1])):
            total += np.bincount(doc, w[slots], minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)
        running = np.zeros(len(s3) + 1)
        np.cumsum(self.weights[2][s3], out=running[1:])
        edge = np.searchsorted(at, offsets)
        total += (running[edge[1:]] - running[edge[:-1]]) / np.maximum(np.diff(edge), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * total + self.bias, -30, 30)))


def _frequencies(data, offsets) -> list[pa.Array]:
    """Each document's relative n-gram frequencies as slots (ascending, of 3 * WIDTH) and their values."""
    n_docs = len(offsets) - 1
    (d1, s1), (d2, s2), (at, s3) = _slots(data, offsets)
    d3 = np.searchsorted(offsets, at, side="right") - 1
    keys, shares = [], []
    for family, (doc, slots) in enumerate(((d1, s1), (d2, s2), (d3, s3.astype(np.int64)))):
        key, n = np.unique(doc * (3 * WIDTH) + family * WIDTH + slots, return_counts=True)
        keys.append(key)
        shares.append(n / np.bincount(doc, minlength=n_docs)[key // (3 * WIDTH)])
    key, share = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(key)
    key, share = key[order], share[order]
    ends = pa.array(np.searchsorted(key, np.arange(n_docs + 1) * (3 * WIDTH)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array((key % (3 * WIDTH)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(share))]


class _Rows:
    """Sparse rows of one Arrow batch of the training sample."""

    def __init__(self, batch: pa.RecordBatch):
        slots = batch.column("slots")
        self.slot, self.share = slots.flatten().to_numpy(), batch.column("shares").flatten().to_numpy()
        self.row = np.repeat(np.arange(batch.num_rows), slots.value_lengths().to_numpy())
        self.n, self.y = batch.num_rows, batch.column("label").to_numpy()

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.slot] * self.share, minlength=self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over rows of value * row."""
        return np.bincount(self.slot, values[self.row] * self.share, minlength=3 * WIDTH)


def _partition_sums(table: DataFrame, of: Callable[[_Rows], np.ndarray], width: int) -> np.ndarray:
    """``of`` summed over all rows: one vector of fixed size comes back from each partition."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_Rows(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    return np.sum([np.zeros(width), *(np.frombuffer(r["sums"]) for r in table.mapInArrow(tidy(run), "sums binary").collect())], axis=0)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps; every call of ``loss`` is one pass over the data, ``steps`` at most."""
    x, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    size = 1.0
    for _ in range(steps - 1):
        way, back = slope.copy(), []
        for s, g in reversed(moves):
            back.append((s @ way) / (s @ g))
            way -= back[-1] * g
        if moves:
            s, g = moves[-1]
            way *= (s @ g) / (g @ g)
        else:
            way /= max(float(np.linalg.norm(way)), 1e-12)
        for (s, g), a in zip(moves, reversed(back), strict=True):
            way += (a - (g @ way) / (s @ g)) * s
        there = x - size * way
        new, new_slope = loss(there)
        if new > value - 1e-4 * size * float(slope @ way):
            size /= 2
            if size < 1e-4:
                break
            continue
        s, g = there - x, new_slope - slope
        if s @ g > 1e-12:
            moves = [*moves[-memory + 1 :], (s, g)]
        small = value - new < 1e-7 * max(abs(value), 1e-12)
        x, value, slope, size = there, new, new_slope, 1.0
        if small:
            break
    return x


def logistic_loss(rows: _Rows, x: np.ndarray, scale: np.ndarray, per_class: np.ndarray) -> np.ndarray:
    """Class-balanced log loss of weights x[:-1] (on scaled features) and bias x[-1], then its gradient."""
    margin = rows.dot(x[:-1] / scale) + x[-1]
    weight = 0.5 / per_class[rows.y.astype(int)]
    error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - rows.y)
    value = (weight * (np.logaddexp(0, margin) - rows.y * margin)).sum()
    return np.concatenate([[value], rows.sums(error) / scale, [error.sum()]])


def train(documents: DataFrame, labels: DataFrame, rows: int = 4_000, penalty: float = 1e-4, steps: int = 16, parts: int = 4) -> Model | None:
    """Fit on at most ``rows`` labelled documents, a row each; None if there are none.

    The sample stays distributed: every step sums loss and gradient by partition, and only those sums, of
    fixed size, reach the driver. Four fifths of the sample fit the weights; the margins of the other fifth
    (at most rows / 5 numbers) fit the calibration.
    """
    spark = documents.sparkSession
    sample = labelled_sample(documents, labels, "quality", rows)
    fields = [T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
    features = map_text(sample, ["doc_id", "label"], fields, _frequencies)
    table, path = materialize(features.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))).repartition(parts, "doc_id"), "rules-sample")
    try:
        fit = table.where("part <> 0").coalesce(parts)
        width = 3 * WIDTH
        moments = _partition_sums(fit, lambda r: np.concatenate([np.bincount(r.slot, r.share**2, minlength=width), np.bincount(r.y.astype(int), minlength=2)]), width + 2)
        per_class = np.maximum(moments[width:], 1)
        if not moments[width:].sum():
            return None
        scale = np.sqrt(moments[:width] / moments[width:].sum()) + 1e-4

        def loss(x):
            shared = spark.sparkContext.broadcast(x)
            total = _partition_sums(fit, lambda r: logistic_loss(r, shared.value, scale, per_class), width + 2)
            shared.destroy()
            return total[0] + penalty / 2 * float(x[:-1] @ x[:-1]), total[1:] + penalty * np.append(x[:-1], 0)

        weights = minimise(loss, np.zeros(width + 1), steps)[:-1] / scale
        return Model(weights.reshape(3, WIDTH), *_calibrate(table, weights))
    finally:
        discard(spark, path)


def _calibrate(table: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """Slope and bias (Platt) of the margins of the rows that the fit has not seen, or of all rows if there are none."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_Rows(batch).dot(weights)), batch.column("label")], names=["margin", "label"])

    unseen = table.where("part = 0").mapInArrow(tidy(run), "margin double, label double").toPandas()
    if unseen["label"].nunique() < 2:
        unseen = table.mapInArrow(tidy(run), "margin double, label double").toPandas()
    margin, y = unseen["margin"].to_numpy(), unseen["label"].to_numpy()
    spread = max(float(margin.std()), 1e-6)

    def loss(x):
        z = margin / spread * x[0] + x[1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        return float((np.logaddexp(0, z) - y * z).mean()) + 5e-5 * x[0] ** 2, np.array([(error * margin).sum() / spread + 1e-4 * x[0], error.sum()])

    slope, bias = minimise(loss, np.zeros(2), 400)
    return float(slope) / spread, float(bias)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("model_score", T.DoubleType()),
]


def judge(data, offsets, model: Model | None) -> list[np.ndarray]:
    """The columns of FIELDS for a chunk."""
    counts = base_counts(data, offsets)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    score = model.score(data, offsets) if model else np.ones(len(failed))
    return [*counts.values(), failed, ~failed & (score >= KEEP_AT), score]


def apply_rules(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and model_score of every document."""
    model = train(documents, labels, **fit)
    return map_text(documents, ["doc_id"], FIELDS, lambda d, o: judge(d, o, model))


def keep_good(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents, with all their columns, that pass the rules and the model."""
    model = train(documents, labels, **fit)
    kept = text_column(lambda d, o: judge(d, o, model)[6], T.BooleanType())
    return documents.where(kept("text"))
