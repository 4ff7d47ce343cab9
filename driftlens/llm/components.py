"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


def connected_components(links: DataFrame, a: str, b: str) -> tuple[DataFrame, str]:
    """(node, root) of every linked node, where root is the smallest node of its component.

    Returns the table and its path. Links and labels stay distributed; each round is written to
    shared storage, so a lost executor costs one round at most.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, path = materialize(start, "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # read twice, but exchanged once: both reads share the exchange of the distinct
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, new_path = materialize(small, "edges")
        discard(spark, path)
        path, state = new_path, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")), path
        before = state


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)
