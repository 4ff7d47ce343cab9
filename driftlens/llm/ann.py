"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its PREFIX nearest pivots, in order. A block of about BLOCK_ROWS vectors
posts its rows in inverted files, one for each pivot; a query adds up the lists of its own pivots, which
gives the Spearman footrule distance of every row in the block, and the best share of each block is
ranked again by exact cosine in double precision.

Pivots come from a bounded sample; every usable vector is indexed. Vectors are dealt evenly to blocks,
whatever their ids, and the queries go to every block by a shuffle, so neither vectors nor queries pass
through the driver. A block gives back its best ``k`` of each query.

Defined results: vectors that are null, zero, or that hold a null or non-finite component take no part,
nor do null ids, nor vectors of another dimension than the most frequent one (of equally frequent ones
the largest counts); equal scores go to the smaller id; a query never returns its own id; of a repeated
query id the smallest vector asks; a repeated candidate row is a candidate each time; with fewer
candidates than ``k`` all are returned; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import tidy

PIVOTS = 256
PREFIX = 96
SHARE = 0.12
LEAST = 200
SAMPLE = 4_096
BLOCK_ROWS = 10_000


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that can take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    return table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero)


def common_width(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent dimension (ties to the larger) and its number of vectors; zeros for an empty table."""
    row = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return (row["width"], row["count"]) if row else (0, 0)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Up to ``pivots`` distinct unit vectors from the SAMPLE rows whose ids hash lowest; all are of one dimension."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    return unit(np.array(list(dict.fromkeys(map(tuple, rows)))[:pivots], float))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Block:
    """Inverted files over the permutations of one block of vectors, ordered by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.units = unit(self.vectors)
        self.prefix = min(prefix, len(pivots))
        ranks = permutations(self.vectors, pivots, self.prefix)
        flat = ranks.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        rows, places = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.post = [(rows[a:b], places[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def candidates(self, permutation: np.ndarray) -> np.ndarray:
        """Rows nearest by footrule; equal distances go to smaller ids."""
        n = len(self.ids)
        take = max(LEAST, int(np.ceil(SHARE * n)))
        if take >= n:
            return np.arange(n)
        agree = np.zeros(n, np.int64)
        for place, pivot in enumerate(permutation):
            rows, places = self.post[pivot]
            agree[rows] += self.prefix - np.maximum(places, place)
        return np.argpartition(np.arange(n) - agree * n, take)[:take]

    def nearest(self, query: np.ndarray, query_id: int, permutation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(permutation)
        rows = rows[self.ids[rows] != query_id]
        score = (self.units[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of each row whose id ``every`` divides."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings).withColumn("vec_id", F.col("vec_id").cast("long"))
    width, count = common_width(vectors)
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("embedding") == width)
    shared = spark.sparkContext.broadcast(choose_pivots(vectors))
    blocks = F.lit(-(-count // BLOCK_ROWS)).cast("long")
    # dealt by position, so that no id, however often it repeats, fills a block
    dealt = vectors.select(F.pmod(F.monotonically_increasing_id(), blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "embedding")
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BLOCK_ROWS))
    met = dealt.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "asks")

    def run(batches):
        index: Block | None = None
        at, rows = None, []
        for batch in batches:
            number, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, raw = batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), width)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for part in np.split(np.arange(len(ids)), edges):
                if not len(part):
                    continue
                if number[part[0]] != at:
                    at, index, rows = number[part[0]], None, []
                if not asks[part[0]]:
                    rows.append((ids[part], raw[part]))
                elif rows or index:
                    if index is None:
                        index = Block(*(np.concatenate(x) for x in zip(*rows, strict=True)), shared.value, PREFIX)
                        rows = []
                    yield _answers(index, ids[part], raw[part], shared.value, k)

    found = met.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _answers(index: Block, ids: np.ndarray, raw: np.ndarray, pivots: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, vec_id, score) of the best ``k`` of a block for each query."""
    units, ranks = unit(raw), permutations(raw, pivots, PREFIX)
    best = [index.nearest(u, i, r, k) for u, i, r in zip(units, ids, ranks, strict=True)]
    found, scores = zip(*best, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in found])), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])
