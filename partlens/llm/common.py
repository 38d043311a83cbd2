"""Helpers of the operators over text: bound expressions, checked joins, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: the characters between words in every contract, and their class in a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 100_000

#: Bytes of text that a task turns into arrays at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where a lambda inside ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of columns that both sides have."""
    on = F.lit(True)
    for name in columns:
        on = on & left[name].eqNullSafe(right[name])
    return on


def join_counted(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a written table; it is broadcast only if it has no more than ``rows`` rows, else both sides are shuffled."""
    small = right.count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most about ``limit`` bytes in a binary ``column``."""
    for batch in batches:
        sizes = batch.column(column)
        start, total = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        for row, size in enumerate(lengths):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
