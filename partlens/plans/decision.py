"""From stored score records to summaries, decisions and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import as_number
from ..functions.labels import BARE_CONDITION, parse_label
from ..operators import agreement, diff, inference, power, summary
from ..session import materialize
from ..sources import runs as R

RK = list(schemas.RUN_KEY)
METRICS = ("q_gain_dir", "coverage", "edge_resolution", "n_units", "q_cochange_gain")
CAMPAIGN_REPOS, CAMPAIGN_RERUNS = 100, 5


def summaries(scores: DataFrame, manifests: DataFrame | None = None, keys: Sequence[str] = ("label", "repo")) -> DataFrame:
    """Repository summaries; partition stability needs the manifests and is null without."""
    jac = None
    if manifests is not None:
        run_of = scores.select(*keys, "rep", "sha").distinct()
        rep = F.concat_ws("/", "sha", "rep").alias("rep")
        parts = R.partitions(manifests).join(scores.select(*RK), RK, "left_semi")
        extra = [k for k in keys if k not in RK]
        if extra:
            raise ValueError(f"summary keys must be run key columns, got {extra}")
        jac = agreement.replicate_jaccard(
            parts.select(*keys, rep, "item", "community"), run_of.select(*keys, rep), list(keys))
    return summary.summarise_runs(scores, keys, jac)


def comparisons(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(f"{b} -> {a}", b, a) for b, a in pairs], "comparison string, before string, after string")


def model_pairs(before: str, after: str, models: Sequence[str]) -> list[tuple[str, str]]:
    """Labels of one change on several models; ``base`` is the bare label."""
    tail = lambda m: "" if m in ("base", "") else f"-{m}"
    return [(before + tail(m), after + tail(m)) for m in models]


def decide(rows: DataFrame, pairs: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Decision per (before, after) pair of labels over repository summaries."""
    wanted = comparisons(rows.sparkSession, pairs)
    return inference.decide(inference.paired(rows, wanted), wanted, **options)


def decide_units(scores: DataFrame, pairs: Sequence[tuple[str, str]], **options) -> DataFrame:
    means = summary.unit_means(R.unit_records(scores), ["label", "repo"])
    return inference.decide_units(inference.unit_deltas(means, comparisons(scores.sparkSession, pairs)), **options)


def rescore_diff(old: DataFrame, new: DataFrame, label: str | None = None) -> DataFrame:
    """What a re-scoring would change, per run; nothing is written."""
    fields = list(schemas.SCORE)
    pick = lambda df: R.select_runs(df, label).select(*RK, *fields)
    return diff.diff_summary(pick(old), pick(new), RK, fields)


def apply_rescore(old: DataFrame, new: DataFrame, path: str, apply: bool = False) -> DataFrame:
    """Dry run unless ``apply``; then the new records are written to ``path``, a new
    folder, so the stored ones stay readable until the caller switches over."""
    report = rescore_diff(old, new)
    if apply:
        new.write.mode("errorifexists").partitionBy("label", "rep").parquet(path)
    return report


# ---- pilot report --------------------------------------------------------------------------


def reliability(scores: DataFrame, parts: DataFrame) -> DataFrame:
    """P1: failures, manifests, exhausted budgets and lint over all runs."""
    has = parts.select(*RK).distinct().withColumn("has", F.lit(True))
    runs = scores.join(has, RK, "left").withColumn("has", F.coalesce("has", F.lit(False)))
    share = lambda c: F.avg(as_number(c))
    out = runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        share((F.coalesce("exit", F.lit(0)) != 0) & ~F.col("has")).alias("harness_fail"),
        share(F.col("has")).alias("manifest"),
        share(F.coalesce("budget_exhausted", F.lit(False))).alias("exhausted"),
        F.count_if(~F.col("has") | (F.coalesce("lint_rounds", F.lit(0)) >= 1)).alias("lint_ok"))
    ok = (
        (F.col("harness_fail") < 0.05) & (F.col("manifest") > 0.9) & (F.col("exhausted") < 0.2)
        & (F.col("lint_ok") == F.col("n_runs"))
    )
    return out.withColumn("passed", ok)


def discrimination(scores: DataFrame) -> DataFrame:
    """P2: ICC(1) of every metric between repositories; the primary one carries the verdict."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS]))
    icc = inference.icc1(scores.select("repo", values.alias("v")).select("repo", "v.*"), "repo", "value", ["metric"])
    grade = F.when(F.col("icc") >= 0.6, "PASS").when(F.col("icc") >= 0.4, "MARGINAL").otherwise("FAIL")
    return icc.withColumn("grade", F.when(F.col("metric") == METRICS[0], grade))


def human_agreement(rows: DataFrame, ranking: DataFrame) -> DataFrame:
    """P3: rank correlation of a human order (best first) with gain and co-change gain.

    The sign is turned so that agreement is positive.
    """
    both = ranking.select("rank", F.col("name").alias("repo")).join(rows.select("repo", "gain", "cochange"), "repo")
    both = materialize(both)
    full = both.where(F.col("cochange").isNotNull())
    gain = inference.spearman(both, "rank", "gain", "rank").select((-F.col("rho")).alias("rho_gain"))
    co = inference.spearman(full, "rank", "cochange", "rank").select((-F.col("rho")).alias("rho_cochange"))
    cross = inference.spearman(full, "gain", "cochange", "rank").select(F.col("rho").alias("rho_gain_cochange"))
    merged = gain.unionByName(co, True).unionByName(cross, True)
    # co-change counts only if every ranked repository has one
    whole = both.agg(F.count_if(F.col("cochange").isNull()) == 0).scalar()
    out = merged.agg(F.max("rho_gain").alias("rho_gain"), *[F.when(whole, F.max(c)).alias(c) for c in ("rho_cochange", "rho_gain_cochange")])
    return out.select("rho_gain", F.coalesce(F.col("rho_gain") >= 0.5, F.lit(False)).alias("passed"), "rho_cochange", "rho_gain_cochange")


def pilot_report(scores: DataFrame, manifests: DataFrame, ranking: DataFrame | None = None,
                 budget: float | None = None, draws: int = inference.AA_DRAWS, stream: str = "hash") -> DataFrame:
    """Rows (check, value, detail, passed); ``passed`` is null for a check that could not run.

    The last row is the overall verdict: every run check passed and the human one ran.
    """
    spark, scores = scores.sparkSession, materialize(scores)
    p1 = reliability(scores, R.partitions(manifests)).select(
        F.lit("P1 reliability").alias("check"), F.col("manifest").alias("value"),
        F.format_string("harness_fail %.2f  exhausted %.2f  lint %d/%d", "harness_fail", "exhausted", "lint_ok", "n_runs").alias("detail"),
        "passed")
    p2 = discrimination(scores).where(F.col("metric") == METRICS[0]).select(
        F.lit("P2 discrimination").alias("check"), F.col("icc").alias("value"), F.col("grade").alias("detail"),
        (F.col("grade") == "PASS").alias("passed"))
    rows = summaries(scores, manifests, ("repo",))
    blank = lambda name, why: spark.createDataFrame(
        [(name, None, why, None)], "check string, value double, detail string, passed boolean")
    if ranking is None:
        p3 = blank("P3 human agreement", "no human ranking")
    else:
        p3 = human_agreement(rows, ranking).select(
            F.lit("P3 human agreement").alias("check"), F.col("rho_gain").alias("value"),
            F.format_string("cochange %s", F.col("rho_cochange")).alias("detail"), "passed")
    rate = lambda alpha, limit: inference.aa_test(scores, alpha=alpha, draws=draws, stream=stream).withColumn(
        "ok", F.col("keep_rate") <= limit + 1e-9)
    p4 = rate(0.10, 0.10).unionByName(rate(0.05, 0.0)).agg(
        F.lit("P4 A/A").alias("check"), F.max("keep_rate").alias("value"),
        F.coalesce(F.when(F.max("n_splits") > 0, F.format_string("%d splits", F.max("n_splits"))), F.lit("needs six replicates")).alias("detail"),
        F.bool_and("ok").alias("passed"))
    need = power.within_sd(scores).select("sd_within", power.replicates_needed("sd_within").alias("need"))
    p5 = need.select(F.lit("P5 replicates").alias("check"), F.col("need").cast("double").alias("value"),
                     F.format_string("sd %.4f", "sd_within").alias("detail"), (F.col("need") <= 5).alias("passed"))
    cost = scores.agg(F.avg(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))
    reps_used = F.coalesce(need.select("need").scalar(), F.lit(3))
    projected = F.col("cost") * CAMPAIGN_REPOS * reps_used * CAMPAIGN_RERUNS
    p8 = cost.select(F.lit("P8 cost").alias("check"), projected.alias("value"),
                     F.format_string("%.2f per run", "cost").alias("detail"),
                     (projected <= budget if budget is not None else F.lit(None).cast("boolean")).alias("passed"))
    table = p1.unionByName(p2).unionByName(p3).unionByName(p4).unionByName(p5).unionByName(p8)
    table = materialize(table)
    graded = F.col("check") != "P8 cost"
    go = table.agg(
        F.lit("GO").alias("check"), F.lit(None).cast("double").alias("value"), F.lit("all run checks, human ranking included").alias("detail"),
        (F.coalesce(F.bool_and(F.when(graded, F.col("passed"))), F.lit(False))
         & (F.count_if((F.col("check") == "P3 human agreement") & F.col("passed").isNotNull()) > 0)).alias("passed"))
    return table.unionByName(go)


def ablation_arms(rows: DataFrame) -> DataFrame:
    """Summaries by arm of an ablation: full text, one section less, or no text at all."""
    parsed = rows.withColumn("p", parse_label("label"))
    arm = F.when(F.col("p.condition") == BARE_CONDITION, "bare").when(
        F.col("p.ablate").isNotNull(), F.concat(F.lit("without "), F.col("p.ablate"))).otherwise("full")
    return parsed.groupBy(F.col("p.base").alias("base"), F.col("p.model").alias("model"), arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n_repos"), F.avg("valid").alias("valid"), F.avg("gain").alias("gain"),
        F.avg("contract").alias("contract"), F.avg("units").alias("units"))
