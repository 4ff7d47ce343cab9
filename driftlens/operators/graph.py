"""Call-graph operators: dispatch, and closures by a distributed frontier loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Frontiers are gathered into one table again after so many rounds, which bounds the plan.
GATHER = 16


def closure(seeds: DataFrame, edges: DataFrame, scope: list[str] | None = None, most_rounds: int = 10_000) -> DataFrame:
    """What is reachable from ``seeds`` along ``edges`` (src, dst), seeds included: the seeds' columns, each row once.

    ``seeds`` has node and any columns that travel with it; edges apply where the ``scope`` columns, which both
    sides have, agree. A round writes only its new rows to shared storage and looks for them in what earlier
    rounds wrote, so cycles end and lost executors lose one round.
    """
    scope = scope or []
    ensure_checkpoint_dir(seeds.sparkSession)
    columns = seeds.columns
    frontier = seeds.distinct().checkpoint()
    stored, since = frontier, 0
    steps = edges.select(*(F.col(c).alias(f"_{c}") for c in scope), F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    on = [F.col(c) == F.col(f"_{c}") for c in scope] + [F.col("node") == F.col("_src")]
    for _ in range(most_rounds):
        step = frontier.join(steps, on).select(*(F.col("_dst").alias("node") if c == "node" else F.col(c) for c in columns)).distinct()
        frontier = step.join(stored, columns, "left_anti").checkpoint()
        if frontier.isEmpty():
            return stored
        stored, since = stored.unionByName(frontier), since + 1
        if since % GATHER == 0:
            stored = stored.checkpoint()
    raise RuntimeError(f"no closure after {most_rounds} rounds")


def ancestors(classes: DataFrame, supers: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, cls, anc, dist): each class's chain of super classes, itself at distance 0; a cyclic chain ends where it returns."""
    scope = scope or []
    ensure_checkpoint_dir(classes.sparkSession)
    chain = level = classes.select(*scope, "cls", F.col("cls").alias("anc"), F.lit(0).alias("dist")).distinct().checkpoint()
    up = supers.select(*(F.col(c).alias(f"_{c}") for c in scope), "child", "parent")
    distance = 0
    while True:
        distance += 1
        on = [F.col(c) == F.col(f"_{c}") for c in scope] + [F.col("anc") == F.col("child")]
        step = level.join(up, on).select(*scope, "cls", F.col("parent").alias("anc"), F.lit(distance).alias("dist")).distinct()
        level = step.join(chain, [*scope, "cls", "anc"], "left_anti").checkpoint()
        if level.isEmpty():
            return chain
        chain = chain.unionByName(level)
        if distance % GATHER == 0:
            chain = chain.checkpoint()


def dispatch(refs: DataFrame, defined: DataFrame, supers: DataFrame, implements: DataFrame, scope: list[str] | None = None, member: list[str] | None = None) -> DataFrame:
    """(scope, cls, member, target): the classes whose definition a call of cls and member may reach.

    Up: the nearest ancestor that defines the member. Down: definitions in all subclasses, in direct
    implementors of the receiver, and in their subclasses. ``member`` names the columns that identify a
    member; hierarchies may be cyclic.
    """
    scope, member = scope or [], member or ["name"]
    refs = refs.select(*scope, "cls", *member).distinct()
    owner = defined.select(*scope, F.col("cls").alias("target"), *member).distinct()
    chain = ancestors(refs.select(*scope, "cls"), supers, scope).withColumnRenamed("anc", "target")
    nearest = refs.join(chain, [*scope, "cls"]).join(owner, [*scope, "target", *member]).groupBy(*scope, "cls", *member).agg(F.min_by("target", F.struct("dist", "target")).alias("target"))
    start = refs.select(*scope, "cls").distinct()
    direct = start.join(implements.select(*scope, F.col("interface").alias("cls"), F.col("cls").alias("node")), [*scope, "cls"])
    heirs = start.select(*scope, "cls", F.col("cls").alias("node")).unionByName(direct.select(*scope, "cls", "node"))
    below = closure(heirs, supers.select(*scope, F.col("parent").alias("src"), F.col("child").alias("dst")), scope)
    down = refs.join(below.where("node <> cls").withColumnRenamed("node", "target"), [*scope, "cls"]).join(owner, [*scope, "target", *member], "left_semi")
    return nearest.select(*scope, "cls", *member, "target").unionByName(down.select(*scope, "cls", *member, "target")).distinct()
