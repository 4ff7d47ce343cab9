"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells. A document's cell follows from the hash of its id and content; a virtual
node serves the cells behind it. Capacities are the rows divided evenly (counts at most one apart),
and a sweep clockwise fills virtual nodes: own keys first, then keys that overflowed earlier nodes,
which go on clockwise until a shard has room. All capacity is needed, so every shard ends exactly
full: law ``rows``.

Only per-cell counts reach the driver (CELLS numbers, whatever the input); the sweep turns them into
ranges of ranks, broadcast back, so that no shard is numbered by one task.

Defined results: a null text has size 16 and the checksum of no bytes; null ids are placed by their
text; repeated rows take one slot each; ties in rank are broken by hash, id, checksum and size; an
empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 13
CELLS = 1 << CELL_BITS


def ring(shards: int, replicas: int) -> dict[int, list[int]]:
    """The shards whose virtual nodes stand at each cell, in ring order."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{r}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for r in range(replicas))
    out: dict[int, list[int]] = {}
    for position, shard in nodes:
        out.setdefault(position >> (64 - CELL_BITS), []).append(shard)
    return out


def sweep(counts: dict[int, int], shards: int, replicas: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the keys of every cell go."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    nodes, out = ring(shards, replicas), []

    def admit(queue: deque, shard: int) -> None:
        while queue and room[shard]:
            cell, lo, hi = queue.popleft()
            take = min(hi - lo, room[shard])
            out.append((cell, lo, lo + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
            if lo + take < hi:
                queue.appendleft((cell, lo + take, hi))

    own: deque = deque()
    carried: deque = deque()
    for lap in range(3):  # the first lap meets every key; whatever overflows finds room in the next
        for cell in range(CELLS):
            if lap == 0 and counts.get(cell):
                own.append((cell, 0, counts[cell]))
            for shard in nodes.get(cell, ()):
                admit(own, shard)
                carried.extend(own)
                own.clear()
                admit(carried, shard)
        carried.extend(own)
        own.clear()
    return out


def assign(documents: DataFrame, shards: int = 40, replicas: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    ranges = ";".join(",".join(map(str, x)) for x in sweep(counts, shards, replicas))
    part = F.split("one", ",")
    table = (
        spark.range(1)
        .select(F.explode(F.split(F.lit(ranges or "-1,0,0,0,0"), ";")).alias("one"))
        .select(*(part[i].cast(kind).alias(name) for i, (name, kind) in enumerate((("at", "int"), ("lo", "long"), ("hi", "long"), ("shard", "int"), ("first", "long")))))
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")) - 1)
    # at most CELLS + shards ranges: a broadcast of fixed size
    placed = ranked.join(F.broadcast(table), (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
