"""Sample-size planning for paired designs."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import normal_cdf, ratio

TARGET_POWER = 0.80
N_GRID = (7, 10, 20, 30, 50, 70, 100)
REPS_GRID = (1, 2, 3, 5)
SEARCH_RANGE = (3, 999)
REPLICATE_Z = 1.645 + 0.84
MAX_REPS = 20


def sd_delta(reps, sd_within, tau) -> Column:
    """Standard deviation of a repository's delta: effect spread plus run noise."""
    reps, sd, tau = _c(reps), _c(sd_within), _c(tau)
    return F.sqrt(tau * tau + 2 * sd * sd / reps)


def power(n, reps, sd_within, tau, delta, alpha: float) -> Column:
    """One-sided power under the normal approximation."""
    z = F.lit(NormalDist().inv_cdf(1 - alpha))
    return 1 - normal_cdf(z - _c(delta) * F.sqrt(_c(n)) / sd_delta(reps, sd_within, tau))


def min_n(reps, sd_within, tau, delta, alpha: float, target: float = TARGET_POWER) -> Column:
    """Smallest number of repositories in 3..999 that reaches the target; null if none.

    power >= target is the same as delta sqrt(N) / sd >= z(1 - alpha) + z(target).
    """
    need = F.lit(NormalDist().inv_cdf(1 - alpha) + NormalDist().inv_cdf(target))
    spread = sd_delta(reps, sd_within, tau)
    ok = F.filter(F.sequence(*[F.lit(v) for v in SEARCH_RANGE]),
                  lambda n: _c(delta) * F.sqrt(n.cast("double")) >= need * spread)
    return F.array_min(ok)


def replicates_needed(within_sd, n_repos: int = 70, delta: float = 0.03) -> Column:
    """Replicates per repository for a detectable delta: 2..20, or 21 when 20 are too few."""
    sd = _c(within_sd)
    ok = F.filter(F.sequence(F.lit(1), F.lit(MAX_REPS)), lambda r: F.lit(delta) >= F.lit(REPLICATE_Z) * sd
                  * F.sqrt(F.lit(2.0) / r) / F.sqrt(F.lit(float(n_repos))))
    return F.when(sd.isNotNull(), F.greatest(F.lit(2), F.coalesce(F.array_min(ok), F.lit(MAX_REPS + 1))))


def within_sd(runs: DataFrame, value: str = "q_gain_dir", repo: str = "repo", keys: Sequence[str] = ()) -> DataFrame:
    """Mean over repositories with two or more runs of the population deviation."""
    per_repo = (
        runs.groupBy(*keys, repo).agg(F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= 2)
    )
    return per_repo.groupBy(*keys).agg(F.avg("sd").alias("sd_within"), F.count(F.lit(1)).alias("n_repos"))


def effect_tau(before: DataFrame, after: DataFrame, sd_within, value: str = "q_gain_dir",
               repo: str = "repo") -> DataFrame:
    """Spread of the true effect: sample variance of the deltas minus run noise, at least 0.

    Null below four common repositories.
    """
    mean = lambda df, n: df.groupBy(repo).agg(F.avg(value).alias(f"m{n}"), F.count(F.lit(1)).alias(f"n{n}"))
    both = mean(before, 1).join(mean(after, 2), repo)
    stats = both.agg(F.var_samp(F.col("m2") - F.col("m1")).alias("var"), F.avg("n1").alias("reps"),
                     F.count(F.lit(1)).alias("n_common"))
    noise = ratio(2 * F.coalesce(_c(sd_within), F.lit(0.0)) * F.coalesce(_c(sd_within), F.lit(0.0)), "reps")
    return stats.select(
        F.when(F.col("n_common") >= 4, F.sqrt(F.greatest(F.col("var") - noise, F.lit(0.0)))).alias("tau"), "n_common")


def power_grid(settings: DataFrame, sd_within="sd_within", tau="tau", delta: float = 0.03, alpha: float = 0.10,
               ns: Sequence[int] = N_GRID, reps: Sequence[int] = REPS_GRID) -> DataFrame:
    """Power of every design on the grid, for each row of ``settings``."""
    grid = F.array(*[F.struct(F.lit(n).alias("n_repos"), F.lit(r).alias("reps")) for n in ns for r in reps])
    out = settings.select("*", F.explode(grid).alias("__g")).select("*", "__g.*").drop("__g")
    return out.withColumn("power", power("n_repos", "reps", sd_within, tau, F.lit(delta), alpha))


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))
