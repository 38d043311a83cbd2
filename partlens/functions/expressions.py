"""Column expressions used by several operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator, denominator) -> Column:
    """Quotient that is null, not an error, on a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def choose2(n) -> Column:
    """Number of unordered pairs among ``n`` items."""
    n = _col(n).cast("double")
    return n * (n - 1) / 2


def mean_of(*columns) -> Column:
    """Mean of the values that are present; null when none is."""
    present = F.filter(F.array(*[_col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return ratio(total, F.size(present))


def round_even(column, places: int) -> Column:
    """Half-even rounding, the convention of stored score records."""
    return F.bround(_col(column), places)


def as_number(column) -> Column:
    """Booleans become 1.0 and 0.0, null stays null."""
    return _col(column).cast("double")


def hash_index(text, modulus=None) -> Column:
    """First 32 bits of an md5 as a non-negative integer, optionally reduced.

    The value is the same in every SQL engine that has md5, so resampling and
    sampling decisions can be checked elsewhere.
    """
    value = F.conv(F.substring(F.md5(_col(text)), 1, 8), 16, 10).cast("long")
    return value if modulus is None else F.pmod(value, _col(modulus).cast("long"))


def normal_cdf(x) -> Column:
    """Standard normal distribution function.

    1/2 + phi(x) * sum x^(2k+1) / (2k+1)!!  has terms of one sign only, so 150
    of them reach double precision for |x| < 9; beyond that the result is 0 or 1.
    """
    x = _col(x).cast("double")
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc, k):
        term = acc["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, add, lambda acc: acc["total"])
    body = F.lit(0.5) + F.exp(-x * x / 2) / F.sqrt(F.lit(2.0) * F.pi()) * series
    return F.when(x <= -9, F.lit(0.0)).when(x >= 9, F.lit(1.0)).otherwise(body)


def parent_dir(path) -> Column:
    """Immediate parent of a relative path, ``.`` for a top-level file."""
    path = _col(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def base_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path) -> Column:
    """Last extension with its dot, empty when there is none."""
    return F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1)


def without_suffix(path) -> Column:
    path = _col(path)
    return F.substring(path, F.lit(1), F.length(path) - F.length(suffix(path)))


def last_segment(name, separator: str = ".") -> Column:
    return F.element_at(F.split(_col(name), "\\" + separator), -1)


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)
