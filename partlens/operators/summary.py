"""Roll-ups of run records: per repository, per stratum, corpus, units, budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_number, ratio

UNIT_OUTCOMES = ("entered_from_outside", "entrypoint_r", "effects_r", "is_singleton")
REPLICATES_PER_REPO = 3


def summarise_runs(runs: DataFrame, keys: Sequence[str] = ("repo",), jaccard: DataFrame | None = None) -> DataFrame:
    """One row per repository: means over its runs, absent values skipped.

    Missing cost and token counts are 0; cached tokens are not part of a run's tokens.
    """
    zero = F.lit(0)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rep")))
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(as_number("valid_nontrivial")).alias("valid"),
        F.avg("q_gain_dir").alias("gain"),
        F.avg("q_cochange_gain").alias("cochange"),
        F.avg("gold_ari").alias("gold"),
        F.avg("coverage").alias("coverage"),
        F.avg("edge_resolution").alias("edge"),
        F.avg("contract_r").alias("contract"),
        F.avg("entrypoint_r").alias("ep_r"),
        F.avg("effects_r").alias("ef_r"),
        F.avg("n_units").alias("units"),
        F.avg(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"),
        F.avg(F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero)).alias("tokens"),
        F.sum(F.col("budget_exhausted").cast("int")).alias("exhausted"),
        F.coalesce(F.bool_or(F.coalesce(F.col("has_claude_md").cast("int"), zero) > 0), F.lit(False)).alias("md"),
        F.coalesce(first("condition"), F.lit("skill")).alias("cond"),
        F.coalesce(first("stratum"), F.lit("unknown")).alias("stratum"),
    )
    if jaccard is None:
        return out.withColumn("jaccard", F.lit(None).cast("double"))
    return out.join(jaccard.select(*keys, "jaccard"), list(keys), "left")


def corpus_means(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of repository means; runs are never pooled."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_repos"),
        F.sum("n").alias("n_runs"),
        F.avg("valid").alias("valid_rate"),
        F.avg("gain").alias("mean_gain"),
        F.avg("jaccard").alias("mean_jaccard"),
        F.avg("cost").alias("mean_cost"),
    )


def stratum_means(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "stratum").agg(
        F.avg("valid").alias("valid"), F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("n"))


def budget(runs: DataFrame, key: str = "repo", tokens: str = "tokens", cost: str = "cost",
           weekly_tokens: float | None = None) -> DataFrame:
    """Token and cost rollup with a total row and the capacity it implies.

    ``is_total`` tells the total row from that of a null key.
    """
    out = runs.rollup(key).agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count(F.lit(1)).alias("runs"),
        F.sum(tokens).cast("double").alias("total_tokens"),
        F.sum(cost).cast("double").alias("total_cost"),
    )
    out = out.select(
        key, "is_total", "runs",
        ratio("total_tokens", "runs").alias("tokens_per_run"),
        ratio("total_cost", "runs").alias("cost_per_run"),
        "total_tokens", "total_cost",
    )
    if weekly_tokens is not None:
        per_week = ratio(F.lit(float(weekly_tokens)), "tokens_per_run")
        out = out.withColumn("runs_per_week", per_week).withColumn("repos_per_week", per_week / REPLICATES_PER_REPO)
    return out


def budget_order(key: str = "repo") -> list[Column]:
    """The order of a budget: repositories by tokens a run, largest first, and the total last."""
    return [F.col("is_total"), F.desc("tokens_per_run"), F.col(key)]


def unit_means(units: DataFrame, keys: Sequence[str] = ("repo",),
               outcomes: Sequence[str] = UNIT_OUTCOMES) -> DataFrame:
    """Number of units and mean of each outcome; units without a value are left out."""
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), *[F.avg(as_number(o)).alias(o) for o in outcomes])


def corpus_unit_means(rows: DataFrame, outcomes: Sequence[str] = UNIT_OUTCOMES) -> DataFrame:
    """Mean of repository means per outcome and how many repositories carry it."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("value")) for o in outcomes
    ])).alias("o")).select("o.*")
    return long.groupBy("outcome").agg(F.avg("value").alias("mean"), F.count("value").alias("n_repos"))
