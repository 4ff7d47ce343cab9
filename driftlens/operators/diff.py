"""Snapshot diffs: anti, inner and full outer joins on null-safe keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change (removed, added or modified), by one full outer join.

    Keys are unique in each snapshot; null keys match each other; nulls in values compare as equal.
    """
    a = old.select(*keys, F.struct(*values).alias("v"), F.lit(True).alias("here")).alias("a")
    b = new.select(*keys, F.struct(*values).alias("v"), F.lit(True).alias("here")).alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    change = F.when(F.col("b.here").isNull(), "removed").when(F.col("a.here").isNull(), "added").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "modified")
    picked = [F.when(F.col("a.here").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    return a.join(b, on, "full_outer").select(*picked, change.alias("change")).where("change IS NOT NULL")


def three_way(old: DataFrame, new: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """Keys, old and new value and status (removed, added, changed, same) of every key.

    Null keys match each other; a null value is a value, not a missing key.
    """
    keys = [key] if isinstance(key, str) else key
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("here")).alias("a")
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("here")).alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    status = F.when(F.col("b.here").isNull(), "removed").when(F.col("a.here").isNull(), "added").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    picked = [F.when(F.col("a.here").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    return a.join(b, on, "full_outer").select(*picked, "old_value", "new_value", status.alias("status"))


def content_churn(old: DataFrame, new: DataFrame, key: str, raw: str, fingerprint: str) -> DataFrame:
    """One row: common, raw-changed, really changed and noise counts, and churn in percent."""
    both = old.select(key, F.col(raw).alias("raw_1"), F.col(fingerprint).alias("print_1")).join(new.select(key, F.col(raw).alias("raw_2"), F.col(fingerprint).alias("print_2")), key)
    differs = F.col("raw_1") != F.col("raw_2")
    changed = differs & (F.col("print_1") != F.col("print_2"))
    counts = both.agg(F.count("*").alias("n_common"), F.count_if(differs).alias("n_raw_changed"), F.count_if(changed).alias("n_changed"))
    churn = F.when(F.col("n_common") == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * F.col("n_changed") / F.col("n_common"), 1))
    return counts.select("n_common", "n_changed", (F.col("n_raw_changed") - F.col("n_changed")).alias("n_noise"), churn.alias("churn_pct"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: merges and maps in which later entries overwrite earlier ones."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def priority_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """All of ``first``, and of ``second`` what ``first`` lacks: one row a key, null keys always."""
    extra = second.join(first.select(key), key, "left_anti")
    keyed = last_wins(extra.where(F.col(key).isNotNull()).withColumn("_o", -F.col(order)), [key], ["_o"]).drop("_o")
    return first.unionByName(keyed.select(*first.columns)).unionByName(extra.where(F.col(key).isNull()).select(*first.columns))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` updated by ``changes`` where those hold a value, and new keys appended."""
    values = [c for c in table.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in values))
    return table.join(new, key, "full_outer").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in values))
