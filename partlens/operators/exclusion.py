"""Exclusions as intervals: what a run leaves out costs what it names, not what lies below it.

The files of a graph are numbered once, in the order of their paths, so everything below a folder is an
interval of numbers, and so is a single file. A run's rules look up their intervals; one sweep over them
keeps those that lie in no other. Files in scope are the graph's files without the lengths of these
intervals; no run is joined with the files of its graph.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..session import materialize
from .keyed import positions_within

#: Numbers of files in one piece of a sweep over the files that a run owns.
BLOCK = 4096


def numbered(files: DataFrame, graph_keys: Sequence[str]) -> DataFrame:
    """graph keys, path, pos: every file with its number within its graph, in the order of paths."""
    gk = list(graph_keys)
    return positions_within(files.select(*gk, "path").distinct(), gk, ["path"], "pos")


def places(files: DataFrame, graph_keys: Sequence[str]) -> DataFrame:
    """graph keys, place, exact, low, high: the numbers [low, high) of every file and of every folder's files."""
    gk, parts = list(graph_keys), F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.where(F.size(parts) > 1).select(*gk, F.explode(above).alias("place"), "pos").groupBy(*gk, "place").agg(
        F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))
    single = files.select(*gk, F.col("path").alias("place"), F.lit(True).alias("exact"), F.col("pos").alias("low"), (F.col("pos") + 1).alias("high"))
    return single.unionByName(folders.withColumn("exact", F.lit(False)))


def intervals(excluded: DataFrame, known: DataFrame, keys: Sequence[str], graph_keys: Sequence[str]) -> DataFrame:
    """keys, low, high: the disjoint intervals that a run's rules leave out.

    A rule is an exact path, or a folder, with or without slashes at its end. Intervals of rules are nested or disjoint;
    in their order by start, longest first, one that starts before the furthest end so far lies in another.
    """
    keys, gk = list(keys), list(graph_keys)
    rules = excluded.where(F.col("path").isNotNull()).select(*keys, F.col("path").alias("rule"), F.regexp_replace("path", "/+$", "").alias("folder")).distinct()
    asked = F.array(F.struct(F.col("rule").alias("place"), F.lit(True).alias("exact")), F.struct(F.col("folder").alias("place"), F.lit(False).alias("exact")))
    found = rules.select(*keys, F.explode(asked).alias("r")).select(*keys, "r.*").distinct().join(known, [*gk, "place", "exact"])
    before = Window.partitionBy(*keys).orderBy("low", F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.coalesce(F.max("high").over(before), F.lit(-1))
    return found.select(*keys, "low", "high", (F.col("low") >= furthest).alias("outer")).where("outer").drop("outer")


def owned_outside(owner: DataFrame, files: DataFrame, left_out: DataFrame, keys: Sequence[str], graph_keys: Sequence[str]) -> DataFrame:
    """keys, n_owned: files with an owner that no interval holds.

    Numbers are cut into blocks, and so are the intervals, so a sweep never reads more than a block of one run.
    """
    keys, gk = list(keys), list(graph_keys)
    points = owner.where(F.col("unit").isNotNull()).select(*keys, "path").distinct().join(files, [*gk, "path"]).select(
        *keys, F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").alias("at"), F.lit(None).cast("long").alias("high"))
    first, last = F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK)
    pieces = left_out.select(*keys, "low", "high", F.explode(F.sequence(first, last)).alias("block")).select(
        *keys, "block", F.greatest("low", F.col("block") * BLOCK).alias("at"), F.col("high"))
    sweep = Window.partitionBy(*keys, "block").orderBy("at", F.col("high").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = points.unionByName(pieces).withColumn("reach", F.max("high").over(sweep)).where("high IS NULL")
    return reach.where("reach IS NULL OR reach <= at").groupBy(*keys).agg(F.count("*").alias("n_owned"))


def coverage(runs: DataFrame, files: DataFrame, owner: DataFrame, excluded: DataFrame, keys: Sequence[str], graph_keys: Sequence[str]) -> DataFrame:
    """Owned share of the files in scope of every run that has any: keys, coverage, n_in_scope."""
    keys, gk = list(keys), list(graph_keys)
    ordered = numbered(files, gk)
    left_out = materialize(intervals(excluded, places(ordered, gk), keys, gk))
    sizes = ordered.groupBy(*gk).agg(F.count("*").alias("n_files"))
    gone = left_out.groupBy(*keys).agg(F.sum(F.col("high") - F.col("low")).alias("n_gone"))
    counted = runs.select(*keys).distinct().join(sizes, gk).join(gone, keys, "left").join(owned_outside(owner, ordered, left_out, keys, gk), keys, "left")
    n = F.col("n_files") - F.coalesce("n_gone", F.lit(0))
    return counted.select(*keys, ratio(F.coalesce("n_owned", F.lit(0)), n).alias("coverage"), n.alias("n_in_scope")).where("n_in_scope > 0")
