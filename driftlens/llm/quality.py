"""Quality classifier: random Fourier features, partition-summed ridge regression, isotonic calibration.

A document is described by a dozen statistics of its bytes, words and lines. Random Fourier features
of the standardised statistics approximate a Gaussian kernel; ridge weights come from normal equations
that each partition sums for itself; pool-adjacent-violators makes the raw score a probability.

Defined results: a null or empty text has all-zero counts and is scored like any other; texts of any
length are read whole; equal texts get equal scores; an empty label table gives every document 0.5;
extra columns of ``documents`` are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import held_out, labelled_sample
from ._store import discard, materialize
from ._text import SPACE, fitting, map_text, mix, per_doc, prefix_hash, runs, segment_hash, text_column, tidy


def _lut(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


UPPER, DIGIT = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789")
SYMBOL, SHOUT, STOP = _lut("#*$%&|<>{}[]\\^~=_@+/"), _lut("!?"), _lut(".,;:")
N_STATS = 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_STATS) statistics of a chunk."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    at_least = np.maximum(size, 1)
    starts, ends, doc = runs(~SPACE[data], offsets)
    words = np.bincount(doc, minlength=n_docs).astype(float)
    some_words = np.maximum(words, 1)
    hashes = segment_hash(prefix_hash(data), starts, ends)
    pairs = fitting(doc, 2)
    same = np.bincount(doc[pairs[hashes[pairs] == hashes[pairs + 1]]], minlength=n_docs)
    keys = hashes ^ mix(doc.astype(np.uint64))
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount(doc[order[fresh]], minlength=n_docs)
    ends_shout = np.bincount(doc[SHOUT[data[ends - 1]]], minlength=n_docs) if len(ends) else np.zeros(n_docs)
    ends_symbol = np.bincount(doc[SYMBOL[data[ends - 1]]], minlength=n_docs) if len(ends) else np.zeros(n_docs)
    lines = per_doc(data == 10, offsets) + 1.0
    columns = [
        np.log1p(size) / 4,
        np.log1p(words) / 4,
        per_doc(~SPACE[data], offsets) / some_words / 8,
        np.sqrt(per_doc(UPPER[data], offsets) / at_least),
        np.sqrt(per_doc(DIGIT[data], offsets) / at_least),
        np.sqrt(per_doc(SYMBOL[data], offsets) / at_least),
        np.sqrt(per_doc(SHOUT[data], offsets) / at_least),
        np.sqrt(per_doc(STOP[data], offsets) / at_least),
        np.sqrt(ends_shout / some_words),
        np.sqrt(ends_symbol / some_words),
        np.sqrt(same / some_words),
        distinct / some_words / np.sqrt(1 + 20 / some_words),
        np.log1p(words / lines) / 4,
    ]
    return np.column_stack(columns)


@dataclass
class Model:
    """Everything a scoring task needs; its size does not depend on the corpus."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        rff = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([rff, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing levels, shrunk off 0 and 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    knots, levels = [], []
    for s, w, first, last in blocks:
        level = (s + 0.5) / (w + 1)
        knots += [first, last] if last > first else [first]
        levels += [level] * (2 if last > first else 1)
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def train(documents: DataFrame, labels: DataFrame, rows: int = 20_000, dimensions: int = 256, ridge: float = 1e-3, seed: int = 7, parts: int = 8) -> Model | None:
    """Fit on at most ``rows`` labelled documents (None if there are none).

    Four fifths of the sample fit the weights and one fifth the calibration. Only ``parts`` partial
    sums of the normal equations, of fixed size, reach the driver.
    """
    spark = documents.sparkSession
    fields = [T.StructField(f"s{i}", T.DoubleType()) for i in range(N_STATS)]
    sample = labelled_sample(documents, labels, "quality", rows)
    stats = map_text(sample, ["doc_id", "label"], fields, lambda d, o: list(statistics(d, o).T))
    table, path = materialize(stats.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))).repartition(parts, "doc_id"), "quality-sample")
    try:
        names = [f.name for f in fields]
        moments = table.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"d_{c}") for c in names)).first()
        if not moments["n"]:
            return None
        centre = np.array([moments[f"m_{c}"] for c in names])
        scale = np.maximum([moments[f"d_{c}"] for c in names], 1e-3)
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(N_STATS, dimensions)) / np.sqrt(N_STATS)
        phases = rng.uniform(0, 2 * np.pi, dimensions)
        model = Model(centre, scale, directions, phases, np.zeros(dimensions + 1), np.zeros(1), np.full(1, 0.5))
        width = dimensions + 1

        def partial(batches):
            total = np.zeros((width, width + 1))
            for batch in batches:
                frame = batch.to_pandas()
                z = model.features(frame[names].to_numpy())
                total += z.T @ np.column_stack([z, frame["label"].to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        rows_out = table.where("part <> 0").coalesce(parts).mapInArrow(tidy(partial), "sums binary").collect()
        sums = np.sum([np.frombuffer(r["sums"]).reshape(width, width + 1) for r in rows_out], axis=0)
        penalty = np.eye(width) * max(ridge * sums[-1, width - 1], 1e-6)
        penalty[-1, -1] = 1e-9
        model.weights = np.linalg.solve(sums[:, :width] + penalty, sums[:, width])
        kept = table.where("part = 0").toPandas()
        if len(kept):
            model.knots, model.levels = isotonic(model.raw(kept[names].to_numpy()), kept["label"].to_numpy())
        return model
    finally:
        discard(spark, path)


def score(documents: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the calibrated probability that the document is of label 1."""

    def kernel(data, offsets):
        if model is None:
            return [np.full(len(offsets) - 1, 0.5)]
        return [model.score(statistics(data, offsets))]

    return map_text(documents, keep, [T.StructField(name, T.DoubleType())], kernel)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for every document."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels, **fit), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    model = train(documents, labels, **fit)
    if model is None:
        return documents.where(F.lit(0.5) >= threshold)
    score_of = text_column(lambda d, o: model.score(statistics(d, o)), T.DoubleType())
    return documents.where(score_of("text") >= threshold)
