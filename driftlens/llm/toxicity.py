"""Toxicity: all maximal-scoring token segments under Dirichlet-smoothed log-odds, judged by extreme-value theory.

Each token scores its log-odds between toxic and clean training text under an informative Dirichlet
prior (pooled token frequencies). Tokens whose log-odds are significant, in either direction, keep them,
sign included; a token whose sign the sample leaves open, or that the sample lacks, costs a flat
PENALTY. A linear scan finds every maximal segment. Karlin-Altschul statistics give each segment an
expected number of chance occurrences in a text of that length: lambda follows from the clean token
distribution, K is estimated from the upper tail of the best segments of clean texts. The
significant segments' surprise adds up to the document's statistic, calibrated by isotonic regression.
Log-odds are fitted on four fifths of the sample; K and the calibration on the fifth they have not seen.

Parameters that bound the model: ``rows`` labelled documents, and the ``vocabulary`` tokens of the
greatest significance (a warning tells if that bound is met). ``stem`` bytes at the start of a longer word
stand in for a word that has no significant log-odds of its own (0: never).

Defined results: null and empty texts have no segment and score like a text without hits; texts are
read whole; equal texts score equally; with no toxic labels, or no significant token, every score is
0; extra columns are never read.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import held_out, labelled_sample
from ._store import discard, materialize
from ._text import LOWER, map_text, mix, prefix_hash, runs, segment_hash, text_chunks, tidy
from .quality import isotonic

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
PENALTY = 0.35
STEM = 5
VOCABULARY = 1 << 16
PRIOR_SHARE = 0.02  # the prior weighs as much as this share of all training tokens
MIN_Z = 3.5
MIN_COUNT = 5
MAX_EXPECTED = 0.05
UNSEEN = 5  # one document in UNSEEN is kept from the fit of the log-odds


def tokens(data: np.ndarray, offsets: np.ndarray, stem: int = STEM):
    """Start, end and document of each run of letters, and hashes of the word and of its first ``stem`` bytes.

    ASCII letters are lower-cased.
    """
    low = LOWER[data]
    starts, ends, doc = runs(LETTER[low], offsets)
    prefix = prefix_hash(low)
    return starts, ends, doc, segment_hash(prefix, starts, ends), mix(segment_hash(prefix, starts, np.minimum(ends, starts + stem)))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (start, end, score), left to right, in linear time (Ruzzo-Tompa).

    An open segment links to the nearest earlier one that begins at a lower running sum, so a search
    steps over those between; when there is none, all earlier segments are final.
    """
    done: list[tuple] = []
    kept: list[tuple] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, j = i, before, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0:
                done += kept
                kept = [(start, i + 1, low, total, -1)]
                break
            if kept[j][3] >= total:
                kept.append((start, i + 1, low, total, j))
                break
            start, _, low, _, link = kept[j]
            del kept[j:]
            j = link
    return [(a, b, after - low) for a, b, low, after, _ in done + kept]


@dataclass
class Model:
    """Token scores and calibration; at most as many tokens as the vocabulary allows, whatever the corpus."""

    keys: np.ndarray
    odds: np.ndarray
    rate: float  # lambda of the Gumbel tail
    scale: float  # K of the Gumbel tail
    knots: np.ndarray
    levels: np.ndarray
    stem: int = STEM

    def token_scores(self, hashes: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Each token's own log-odds, else its stem's, else the penalty."""
        out = np.full(len(hashes), -PENALTY)
        for values in ((stems, hashes) if self.stem else (hashes,)):
            slot = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
            known = self.keys[slot] == values
            out[known] = self.odds[slot[known]]
        return out

    def segments(self, data: np.ndarray, offsets: np.ndarray):
        """(document, first byte, end byte, score) of every maximal segment, and each document's token count."""
        starts, ends, doc, hashes, stems = tokens(data, offsets, self.stem)
        length = np.bincount(doc, minlength=len(offsets) - 1)
        out: list[tuple] = []
        if not len(self.keys) or not len(doc):
            return out, length
        score = self.token_scores(hashes, stems)
        # tokens of one sign next to each other act as one; runs end with their document
        edge = np.flatnonzero(np.concatenate([[True], (score[1:] > 0) != (score[:-1] > 0)]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
        until = np.append(edge[1:], len(doc))
        sums, owner = np.add.reduceat(score, edge), doc[edge]
        hot = np.unique(owner[sums > 0])
        low, high = np.searchsorted(owner, hot), np.searchsorted(owner, hot, side="right")
        for d, a, b in zip(hot.tolist(), low.tolist(), high.tolist(), strict=True):
            for i, j, s in maximal_segments(sums[a:b].tolist()):
                out.append((d, starts[edge[a + i]] - offsets[d], ends[until[a + j - 1] - 1] - offsets[d], s))
        return out, length

    def expected(self, score, length):
        """How many segments of that score chance gives in a text of that many tokens; a text has at least one place to start."""
        return np.maximum(self.scale * length, 1.0) * np.exp(-self.rate * score)

    def passages(self, data: np.ndarray, offsets: np.ndarray, most: float = MAX_EXPECTED):
        """(document, first byte, end byte, score, expected chance count) of each significant segment."""
        found, length = self.segments(data, offsets)
        return [(d, a, b, s, e) for d, a, b, s in found if (e := self.expected(s, length[d])) <= most]

    def statistic(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Summed surprise -log(expected) of each document's segments that chance gives less than once."""
        out = np.zeros(len(offsets) - 1)
        for d, _, _, _, expected in self.passages(data, offsets, 1.0):
            out[d] += -np.log(max(expected, 1e-300))
        return out

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest segment score (0 without a segment) and the token count of each document."""
        found, length = self.segments(data, offsets)
        top = np.zeros(len(offsets) - 1)
        if found:
            np.maximum.at(top, [f[0] for f in found], [f[3] for f in found])
        return top, length

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(offsets) - 1)
        return np.interp(self.statistic(data, offsets), self.knots, self.levels)


def gumbel_scale(best: np.ndarray, length: np.ndarray, rate: float, tail: float = 0.02) -> float:
    """K from the upper ``tail`` of clean texts' best segments, where significance is decided.

    The maximum-likelihood K of a Poisson number of texts whose best score reaches the tail's lower end u:
    their count is expected to be the sum of K * length * exp(-rate * u). 1 if no text has a segment there.
    """
    use = length > 0
    reach = np.quantile(best[use], 1 - tail) if use.any() else 0.0
    above = best[use] >= reach
    return float(above.sum() / (length[use].sum() * np.exp(-rate * reach))) if reach > 0 else 1.0


def gumbel_rate(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1 under the clean-text token distribution."""
    rest = 1 - share.sum()

    def excess(x):
        return float((share * np.exp(np.minimum(x * odds, 700))).sum() + rest * np.exp(-x * PENALTY)) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def train(documents: DataFrame, labels: DataFrame, rows: int = 20_000, vocabulary: int = VOCABULARY, stem: int = STEM) -> Model:
    """Fit on at most ``rows`` labelled documents, equal texts counted once.

    Token counts are summed by the cluster; at most ``vocabulary`` significant tokens reach the driver.
    """
    spark = documents.sparkSession
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, np.zeros(0), np.zeros(0), stem)
    sample = labelled_sample(documents, labels, "toxic", rows).groupBy("text").agg(F.max("label").alias("label"))
    table, path = materialize(sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(UNSEEN))), "toxicity-sample")
    try:

        def count(batches):
            for batch in batches:
                y = batch.column("label").to_numpy(zero_copy_only=False)
                for lo, hi, data, offsets in text_chunks(batch.column("text")):
                    _, _, doc, hashes, stems = tokens(data, offsets, stem)
                    uniq, where = np.unique(np.concatenate([hashes, stems] if stem else [hashes]), return_inverse=True)
                    toxic = np.bincount(where, np.tile(y[lo:hi][doc] > 0, 2 if stem else 1), minlength=len(uniq)).astype(np.int64)
                    every = np.bincount(where, minlength=len(uniq)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["token", "toxic", "clean"])

        seen = table.where("part <> 0").select("text", "label").mapInArrow(tidy(count), "token long, toxic long, clean long")
        counts, counts_path = materialize(seen.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
        try:
            sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
            n_t, n_c = float(sums["toxic"] or 0), float(sums["clean"] or 0)
            if not n_t or not n_c:
                return none
            weight = PRIOR_SHARE * (n_t + n_c)
            prior = PRIOR_SHARE * (F.col("toxic") + F.col("clean"))
            log_odds = F.log((F.col("toxic") + prior) / (n_t + weight - F.col("toxic") - prior)) - F.log((F.col("clean") + prior) / (n_c + weight - F.col("clean") - prior))
            spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
            significant = (
                counts.where(F.greatest("toxic", "clean") >= MIN_COUNT)
                .select("token", log_odds.alias("odds"), (log_odds / spread).alias("z"), ((F.col("clean") + prior) / (n_c + weight)).alias("share"))
                .where(F.abs("z") >= MIN_Z)
            )
            chosen = significant.orderBy(F.desc(F.abs("z")), "token").limit(vocabulary + 1).toPandas()
        finally:
            discard(spark, counts_path)
        if len(chosen) > vocabulary:
            warnings.warn(f"more than {vocabulary} tokens are significant; those of the greatest significance are kept", stacklevel=2)
            chosen = chosen.head(vocabulary)
        if not (chosen["odds"] > 0).any():
            return none
        keys = chosen["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        odds = chosen["odds"].to_numpy()[order]
        share = chosen["share"].to_numpy()[order] / (2 if stem else 1)  # a word counts under itself and its stem
        model = Model(keys[order], odds, gumbel_rate(odds, share), 1.0, none.knots, none.levels, stem)
        unseen = table.where("part = 0")
        fields = [T.StructField("best", T.DoubleType()), T.StructField("length", T.LongType())]
        clean = map_text(unseen.where("label = 0"), ["label"], fields, lambda d, o: [*model.best(d, o)]).toPandas()
        if len(clean):
            model.scale = gumbel_scale(clean["best"].to_numpy(), clean["length"].to_numpy(), model.rate)
        kept = map_text(unseen, ["label"], [T.StructField("t", T.DoubleType())], lambda d, o: [model.statistic(d, o)]).toPandas()
        model.knots, model.levels = isotonic(kept["t"].to_numpy(), kept["label"].to_numpy())
        return model
    finally:
        discard(spark, path)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for every document."""
    model = train(documents, labels, **fit)
    scored = map_text(documents, ["doc_id"], [T.StructField("score", T.DoubleType())], lambda d, o: [model.score(d, o)])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxic_passages(documents: DataFrame, model: Model) -> DataFrame:
    """One row per significant passage: doc_id, byte span, segment score and expected chance count."""
    schema = documents.select("doc_id").schema.add("start", "long").add("end", "long").add("score", "double").add("expected", "double")

    def run(batches):
        for batch in batches:
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                if found := model.passages(data, offsets):
                    doc, start, end, score, expected = zip(*found, strict=True)
                    ids = batch.column("doc_id").take(pa.array([lo + int(d) for d in doc]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.array(x, k)) for x, k in ((start, np.int64), (end, np.int64), (score, float), (expected, float)))], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run), schema)
