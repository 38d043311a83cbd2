"""Field-level differences of two versions of a record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_FIELDS = 4


def as_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Long form (keys, field, value); values are compared as JSON text, null stays null."""
    names = list(fields) if fields is not None else [c for c in df.columns if c not in keys]
    cells = [F.struct(F.lit(n).alias("field"), F.to_json(F.struct(F.col(n).alias("v"))).alias("value")) for n in names]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.field", "c.value")


def field_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Fields that differ, over the union of both field sets; a missing field equals null."""
    empty = F.lit("{}")
    left = as_fields(old, keys, fields).withColumnRenamed("value", "old")
    right = as_fields(new, keys, fields).withColumnRenamed("value", "new")
    return (
        left.join(right, [*keys, "field"], "full")
        .withColumns({"old": F.coalesce("old", empty), "new": F.coalesce("new", empty)})
        .where(F.col("old") != F.col("new"))
    )


def diff_summary(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Number of changed fields per record, the first four names and how many more.

    A record has as many fields as its schema, so its list of names is bounded.
    """
    changed = field_diff(old, new, keys, fields).groupBy(*keys).agg(
        F.array_sort(F.collect_list("field")).alias("names"))
    every = old.select(*keys).union(new.select(*keys)).distinct()
    n = F.coalesce(F.size("names"), F.lit(0))
    return every.join(changed, list(keys), "left").select(
        *keys, n.alias("n_changed"), F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, SHOWN_FIELDS).alias("shown"),
        F.greatest(n - SHOWN_FIELDS, F.lit(0)).alias("more"))
