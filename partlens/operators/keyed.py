"""Keyed building blocks: heaviest groups, distributed numbering, last-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, write_table

HEAVY_GROUPS = 1000
_ROW_BITS = 33
#: Bits of a sketch of keys (8 MB), the words of 64 bits in one of its rows, and its rows.
SKETCH_BITS, SKETCH_WORDS = 1 << 26, 512
SKETCH_ROWS = SKETCH_BITS // (64 * SKETCH_WORDS)


def heaviest(counts: DataFrame, keys: Sequence[str], weight: str, limit: int = HEAVY_GROUPS) -> DataFrame:
    """Keys of the ``limit`` heaviest groups.

    The result never has more than ``limit`` rows whatever the input, so it may be
    broadcast; and a group outside it holds less than 1/limit of all rows.
    """
    return counts.orderBy(F.desc(weight), *keys).limit(limit).select(*keys)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """0-based position of every row in a total order, without a one-partition sort.

    Rows are range-partitioned and sorted in place; the id they get there is written
    out once, so the offsets and the rows can never disagree, and one offset per
    partition is added. ``order`` must identify rows for the result to be unique.
    """
    ordered = (
        df.repartitionByRange(*[_as_column(c) for c in order])
        .sortWithinPartitions(*[_as_column(c) for c in order])
        .withColumn("__id", F.monotonically_increasing_id())
    )
    ordered = materialize(ordered)
    partition = F.shiftrightunsigned(F.col("__id"), _ROW_BITS)
    local = F.col("__id") - F.shiftleft(partition, _ROW_BITS)
    sizes = ordered.groupBy(partition.alias("__part")).agg((F.max(local) + 1).alias("n")).collect()
    if len(sizes) <= 1:
        return ordered.withColumn(name, local).drop("__id")
    offsets, running = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in sizes):
        offsets.append((part, running))
        running += n
    lookup = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return (
        ordered.withColumn("__part", partition)
        .join(F.broadcast(lookup), "__part")
        .withColumn(name, local + F.col("__offset"))
        .drop("__id", "__part", "__offset")
    )


def positions_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of every row inside its key, from one distributed numbering."""
    keys = list(keys)
    ranked = number_rows(df, [*keys, *order], name)
    if not keys:
        return ranked
    first = ranked.groupBy(*keys).agg(F.min(name).alias("__first"))
    return ranked.join(first, keys).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64) -> DataFrame:
    """Exactly the first ``k`` rows of every group in ``order``.

    Each group is first cut to ``k`` rows in every one of ``salts`` slices and then
    once more over at most ``salts * k`` survivors, so a group holding a third of
    the table is sorted by many tasks.
    """
    sliced = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    in_slice = Window.partitionBy(*keys, "__salt").orderBy(*order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("__rank", F.row_number().over(in_slice)).where(F.col("__rank") <= k)
        .withColumn("__rank", F.row_number().over(in_group)).where(F.col("__rank") <= k)
        .drop("__salt", "__rank")
    )


def last_wins(df: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """One value per key, the one latest in ``order``; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def may_match(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may occur in ``others``: all that do, and some that share a bit with one that does.

    A filter before a join or grouping on ``keys``, which makes it exact: rows that would meet nothing are not
    shuffled. The sketch has ``SKETCH_BITS`` bits whatever the input, so it is broadcast; when ``others`` has many
    more keys than that it keeps nearly all rows.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(SKETCH_BITS))
    row, word, bit = F.pmod(place, F.lit(SKETCH_ROWS)), F.floor(place / (SKETCH_ROWS * 64)).cast("int"), F.pmod(F.floor(place / SKETCH_ROWS), F.lit(64)).cast("int")
    words = others.groupBy(row.alias("__row"), word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__set"))
    held = words.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("__word", "__set"))).alias("__held"))
    sketch = write_table(held.select("__row", F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda i: F.coalesce(F.col("__held")[i], F.lit(0).cast("long"))).alias("__words")))
    marked = df.withColumn("__row", row).join(F.broadcast(sketch), "__row")
    return marked.where(F.getbit(F.col("__words")[word], bit) == 1).select(*df.columns)


def _as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
