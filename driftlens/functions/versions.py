"""Version comparison as Column expressions (loose ordering: text segments sort after numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Build suffixes of remediated releases; both patterns are parameters of the functions below.
SUFFIX = r"[.-](rhlw|redhat)-\d+"


def classify_stream(old: Column, new: Column) -> Column:
    """x if the major segment differs, y if both have a minor and it differs, else z; unknown for nulls."""
    a, b = F.split(old, r"\."), F.split(new, r"\.")
    minor = (F.size(a) > 1) & (F.size(b) > 1) & (F.get(a, F.lit(1)) != F.get(b, F.lit(1)))
    return F.when(old.isNull() | new.isNull(), "unknown").when(F.get(a, F.lit(0)) != F.get(b, F.lit(0)), "x").when(minor, "y").otherwise("z")


def base_version(version: Column, suffix: str = SUFFIX) -> Column:
    """The version without a trailing build suffix."""
    return F.regexp_replace(version, f"{suffix}$", "")


def is_remediated(version: Column, suffix: str = SUFFIX) -> Column:
    """Whether a build suffix stands anywhere in the version."""
    return F.coalesce(version.rlike(suffix), F.lit(False))


def version_key(version: Column) -> Column:
    """An array that compares like the version: (0, number, '') or (1, 0, text) for each segment."""

    def segment(s: Column) -> Column:
        number = s.rlike(r"^\d+$")
        return F.struct(F.when(number, 0).otherwise(1).alias("k"), F.when(number, s.try_cast("decimal(38,0)")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("n"), F.when(number, "").otherwise(s).alias("s"))

    return F.transform(F.split(version, r"[.\-+]"), segment)


def satisfies(target: Column, fixed: Column) -> Column:
    """Whether ``target`` is ``fixed`` or later; false on nulls."""
    return F.coalesce((target == fixed) | (version_key(target) >= version_key(fixed)), F.lit(False))
