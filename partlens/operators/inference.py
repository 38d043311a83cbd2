"""Decisions from repeated runs: bootstraps, gates, reliability and rank statistics."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_number, hash_index, ratio
from ..session import materialize
from .keyed import number_rows, positions_within
from .summary import UNIT_OUTCOMES

ALPHA = 0.10
DRAWS = 5000
AA_DRAWS = 3000
MIN_PAIRS = 3
VALIDITY_SLACK = 1.0 / 3
STABILITY_DROP = 0.15
CONTRACT_DROP = 0.05
COST_NOTE_PERCENT = 25
AA_REPLICATES = 6
VARIANCE_EPSILON = 1e-28

def percentile_positions(draws: int, alpha: float) -> tuple[int, int]:
    """0-based positions of the lower and upper bound among sorted draws (truncated)."""
    return int(alpha / 2 * draws), int((1 - alpha / 2) * draws) - 1


def _seeded_picks(sizes: DataFrame, draws: int, repeats: int, seed: int = 0) -> DataFrame:
    """(n, repeat, draw, pick): the choices 0..n-1 of one seeded generator for each size n.

    The generator runs through all repeats without a restart and leaves the task in
    batches; different sizes are different rows and run in different tasks.
    """

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n in (int(v) for batch in batches for v in batch["n"]):
            rng, items, step = random.Random(seed), range(n), max(1, 200_000 // n)
            for repeat in range(repeats):
                for start in range(0, draws, step):
                    block = range(start, min(draws, start + step))
                    yield pd.DataFrame({
                        "n": n,
                        "repeat": repeat,
                        "draw": [d for d in block for _ in items],
                        "pick": [rng.choice(items) for _ in block for _ in items],
                    })

    return sizes.mapInPandas(generate, "n long, repeat int, draw int, pick long")


def bootstrap(deltas: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "delta",
              alpha: float = ALPHA, draws: int = DRAWS, stream: str = "hash",
              repeat: str | None = None, repeats: int = 1) -> DataFrame:
    """Percentile interval of the mean of paired deltas, per key: n, observed, lo, hi.

    Clusters are put in ``order``; a draw picks as many of them, with replacement.
    ``stream`` is ``hash``, which is cut anywhere and which any SQL engine can repeat, or
    ``seeded`` on request: the generator stored results were made with, one sequence that
    one task writes out. With ``repeat`` one seeded generator runs on across the values of that column.
    Picks grow with clusters x draws and are made where the clusters are; the values
    are looked up by position and averaged per draw, combined before the shuffle.
    """
    keys = list(keys)
    if not keys:
        one = bootstrap(deltas.withColumn("__one", F.lit(1)), ["__one"], order, value, alpha, draws, stream)
        return one.drop("__one")
    ranked = positions_within(deltas.select(*keys, *order, value), keys, order)
    info = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("observed"))
    if stream == "seeded":
        seeded = _seeded_picks(info.select("n").distinct(), draws, repeats)
        on = ["n"]
        if repeat is not None:
            seeded, on = seeded.withColumn(repeat, F.col("repeat")), ["n", repeat]
        picks = info.join(seeded, on).select(*keys, "draw", "pick")
    elif stream == "hash":
        slots = ranked.join(info, keys).select(
            *keys, "n", "position", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        picks = slots.select(*keys, "draw", hash_index(
            F.concat_ws(":", F.col("draw"), F.col("position")), F.col("n")).alias("pick"))
    else:
        raise ValueError(f"no stream of draws is called {stream}")
    means = (
        picks.join(ranked.select(*keys, F.col("position").alias("pick"), F.col(value).alias("__v")), [*keys, "pick"])
        .groupBy(*keys, "draw").agg(F.avg("__v").alias("m"))
    )
    lo, hi = percentile_positions(draws, alpha)
    # `draws` values per key, a constant
    bounds = means.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("__m")).select(
        *keys, F.get("__m", F.lit(lo)).alias("lo"), F.get("__m", F.lit(hi)).alias("hi"))
    return info.join(bounds, keys, "left")


def paired(summary: DataFrame, comparisons: DataFrame, label: str = "label", repo: str = "repo",
           values: Sequence[str] = ("valid", "gain", "jaccard", "contract", "cost")) -> DataFrame:
    """One row per comparison and common repository with ``<value>_before`` / ``_after``."""
    side = lambda name: summary.select(
        F.col(label).alias(name), repo, *[F.col(v).alias(f"{v}_{name}") for v in values])
    return comparisons.join(side("before"), "before").join(side("after"), ["after", repo])


def decide(pairs: DataFrame, comparisons: DataFrame, keys: Sequence[str] = ("comparison",), repo: str = "repo",
           alpha: float = ALPHA, draws: int = DRAWS, stream: str = "hash") -> DataFrame:
    """KEEP or REVERT per comparison.

    In this order: at least three common repositories, validity gate, stability gate,
    contract gate, then KEEP exactly when the lower bootstrap bound is above 0. The cost
    change is reported and never gates.
    """
    keys = list(keys)
    both = ("valid", "jaccard", "contract", "cost")
    facts = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_repos"),
        *[F.avg(f"{v}_{s}").alias(f"{v}_{s}") for v in both for s in ("before", "after")],
    )
    deltas = pairs.select(*keys, repo, (F.col("gain_after") - F.col("gain_before")).alias("delta"))
    interval = bootstrap(deltas, keys, [repo], alpha=alpha, draws=draws, stream=stream).drop("n")
    out = comparisons.select(*keys).join(facts, keys, "left").join(interval, keys, "left")
    out = out.withColumn("n_repos", F.coalesce("n_repos", F.lit(0)))
    drop = lambda v: F.col(f"{v}_before") - F.col(f"{v}_after")
    reason = (
        F.when(F.col("n_repos") < MIN_PAIRS, "pairs")
        .when((drop("valid") > 1e-9) & (drop("valid") * F.col("n_repos") > VALIDITY_SLACK), "validity")
        .when(drop("jaccard") > STABILITY_DROP, "stability")
        .when(drop("contract") > CONTRACT_DROP, "contract")
        .otherwise("interval")
    )
    cost_pct = F.coalesce(ratio(-drop("cost") * 100, "cost_before"), F.lit(0.0))
    out = out.withColumn("reason", reason).withColumn("cost_pct", cost_pct)
    keep = (F.col("reason") == "interval") & (F.col("lo") > 0)
    return (
        out.withColumn("verdict", F.when(keep, "KEEP").otherwise("REVERT"))
        .withColumn("line", _decision_line(alpha))
    )


def _decision_line(alpha: float):
    f = F.format_string
    n = F.col("n_repos")
    move = lambda text, v: f(text + " %.2f -> %.2f", F.col(f"{v}_before"), F.col(f"{v}_after"))
    note = F.when(F.col("cost_pct") > COST_NOTE_PERCENT,
                  f" [>+{COST_NOTE_PERCENT}%%: reported, does NOT gate the verdict]").otherwise("")
    return (
        F.when(F.col("reason") == "pairs",
               f(f"REVERT  (only %d repos in common; need >={MIN_PAIRS})", n))
        .when(F.col("reason") == "validity", move("REVERT  validity gate:", "valid"))
        .when(F.col("reason") == "stability", move("REVERT  stability gate: jaccard", "jaccard"))
        .when(F.col("reason") == "contract", move("REVERT  contract gate: recall", "contract"))
        .otherwise(F.concat(
            f(f"%s  delta_gain=%+.4f  {int((1 - alpha) * 100)}%%CI=[%+.4f,%+.4f]  ",
              "verdict", "observed", "lo", "hi"),
            move("validity", "valid"),
            f("  n_repos=%d  cost/run $%.2f->$%.2f (%+.0f%%)", n, "cost_before", "cost_after", "cost_pct"),
            note,
        ))
    )


def decide_transfer(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """KEEP only when every compared model says KEEP."""
    keep = F.col("verdict") == "KEEP"
    return decisions.groupBy(*keys).agg(
        F.count_if(keep).alias("n_keep"), F.count(F.lit(1)).alias("n_models"),
        F.when(F.bool_and(keep), "KEEP").otherwise("REVERT").alias("verdict"),
    )


def unit_deltas(means: DataFrame, comparisons: DataFrame, outcomes: Sequence[str] = UNIT_OUTCOMES,
                label: str = "label", repo: str = "repo") -> DataFrame:
    """Paired deltas of repository means, one row per comparison, outcome and repository."""
    rows = paired(means, comparisons, label, repo, ("n_units", *outcomes))
    long = F.explode(F.array(*[F.struct(
        F.lit(o).alias("outcome"),
        (F.col(f"{o}_after") - F.col(f"{o}_before")).alias("delta"),
    ) for o in outcomes]))
    return (
        rows.select("comparison", repo, F.col("n_units_after"), long.alias("o"))
        .select("comparison", repo, "n_units_after", "o.*").where(F.col("delta").isNotNull())
    )


def decide_units(deltas: DataFrame, alpha: float = ALPHA, draws: int = DRAWS, stream: str = "hash",
                 repo: str = "repo") -> DataFrame:
    """Cluster bootstrap per outcome; the advisory verdict sits on entrypoint recall.

    Repositories are the clusters; an outcome with fewer than three has no row.
    """
    keys = ["comparison", "outcome"]
    units = deltas.groupBy(*keys).agg(F.sum("n_units_after").alias("n_units_after"))
    out = bootstrap(deltas, keys, [repo], alpha=alpha, draws=draws, stream=stream).where(F.col("n") >= MIN_PAIRS)
    return out.join(units, keys).select(
        *keys, F.col("n").alias("n_repos"), "n_units_after", "observed", "lo", "hi",
        F.when(F.col("outcome") == "is_singleton", "lower-better").otherwise("higher-better").alias("direction"),
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"),
        F.when(F.col("outcome") == "entrypoint_r",
               F.when(F.col("lo") > 0, "KEEP").otherwise("REVERT")).alias("verdict"),
    )


def icc1(values: DataFrame, group: str | Sequence[str], value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """One-way random-effects ICC(1) and the variance ratio MSB / MSW.

    Groups with one value are left out and the mean group size is used. The ratio is
    infinite when groups have no inner variance; ICC is null when both terms are 0.
    """
    keys = list(keys)
    group = [group] if isinstance(group, str) else list(group)
    per_group = (
        values.where(F.col(value).isNotNull()).groupBy(*keys, *group)
        # a sum of many equal values over their count need not be the value; its error grows with the group
        .agg(F.count(value).alias("n"), F.when(F.min(value) == F.max(value), F.min(value).cast("double")).otherwise(F.avg(value)).alias("m"),
             F.var_pop(value).alias("v"))
        .where(F.col("n") >= 2)
    )
    per_group = materialize(per_group)
    n, m = F.col("n").cast("double"), F.col("m")
    # means are taken from the least of them, so that equal ones are off by nothing
    with_key = lambda df, facts: df.join(facts, keys) if keys else df.crossJoin(F.broadcast(facts))
    centred = with_key(per_group, per_group.groupBy(*keys).agg(F.min(m).alias("least")))
    centred = with_key(centred, centred.groupBy(*keys).agg((F.sum(n * (m - F.col("least"))) / F.sum(n)).alias("above")))
    centred = centred.withColumn("grand", F.col("least") + F.col("above"))
    off = m - F.col("least") - F.col("above")
    sums = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(n).alias("size"), F.sum(n).alias("total"),
        F.sum(n * off * off).alias("sb"), F.sum(n * F.col("v")).alias("sw"), F.first("grand").alias("grand"),
    )
    # what rounding alone makes of equal values counts as no variance
    noise = VARIANCE_EPSILON * F.col("grand") * F.col("grand")
    real = lambda c: F.when(c <= noise, F.lit(0.0)).otherwise(c)
    msb = real(ratio("sb", F.col("n_groups") - 1))
    msw = real(ratio("sw", F.col("total") - F.col("n_groups")))
    sums = sums.withColumn("msb", msb).withColumn("msw", msw)
    enough = F.col("n_groups") >= 2
    bottom = F.col("msb") + (F.col("size") - 1) * F.col("msw")
    return sums.select(
        *keys, "n_groups",
        F.when(enough, ratio(F.col("msb") - F.col("msw"), bottom)).alias("icc"),
        F.when(enough, F.when(F.col("msw") == 0, F.lit(float("inf"))).otherwise(ratio("msb", "msw"))).alias("var_ratio"),
    )


def spearman(df: DataFrame, first: str, second: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation 1 - 6 sum d^2 / (n (n^2 - 1)); ties take the order of ``tie``."""
    keys = list(keys)
    ranked = positions_within(df.select(*keys, first, second, tie), keys, [first, tie], "__r1")
    ranked = positions_within(ranked, keys, [second, tie], "__r2")
    d = (F.col("__r1") - F.col("__r2")).cast("double")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("d2"))
    n = F.col("n").cast("double")
    return out.select(*keys, "n", F.when(n >= 3, 1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("rho"))


def aa_splits(reps: Sequence[str]) -> list[tuple[str, ...]]:
    """Every three replicates that hold the first one; the rest form the other side."""
    reps = sorted(reps)
    return [s for s in combinations(reps, 3) if s[0] == reps[0]] if len(reps) >= AA_REPLICATES else []


def aa_members(runs: DataFrame, rep: str = "rep") -> DataFrame:
    """The splits of ``aa_splits`` for all replicates in ``runs``: split, rep of each of its three members.

    None below six replicates. A split is a number, and arithmetic gives the pair of positions it stands for, so
    the splits are dealt like any range; replicates are numbered by a distributed sort and looked up by position.
    """
    ids = number_rows(runs.select(F.col(rep).cast("string").alias("rep")).where("rep IS NOT NULL").distinct(), ["rep"], "at")
    n = ids.count()
    others = n - 1
    total = others * (others - 1) // 2 if n >= AA_REPLICATES else 0
    # pairs (i, j) of the replicates after the first, in order: those that start before i come first
    ahead = lambda i: F.floor(i * (2 * others - i - 1) / 2)
    split, width = F.col("split"), 2 * others - 1
    near = F.floor((F.lit(width) - F.sqrt(F.lit(float(width * width)) - 8 * split)) / 2)
    first = near + F.when(ahead(near + 1) <= split, 1).otherwise(0) - F.when(ahead(near) > split, 1).otherwise(0)
    pairs = runs.sparkSession.range(total).withColumnRenamed("id", "split").withColumn("i", first)
    places = F.array(F.lit(0).cast("long"), F.col("i") + 1, split - ahead(F.col("i")) + F.col("i") + 2)
    return pairs.select("split", F.explode(places).alias("at")).join(ids, "at").select("split", "rep")


def aa_test(runs: DataFrame, splits: Sequence[Sequence[str]] | None = None, value: str = "q_gain_dir", repo: str = "repo",
            rep: str = "rep", alpha: float = ALPHA, draws: int = AA_DRAWS, stream: str = "hash") -> DataFrame:
    """Replicates of one label split against each other: rate of (false) KEEPs.

    Runs are added up per repository and replicate first; a split takes three of these sums
    from the repository's total. All splits (those of ``aa_members`` unless given) run in one
    job, and the bootstrap is keyed by the split.
    """
    if splits is None:
        members = aa_members(runs, rep)
    else:
        rows = [(i, str(r)) for i, s in enumerate(splits) for r in s]
        members = runs.sparkSession.createDataFrame(rows, "split int, rep string")
    if stream == "seeded" and splits is None:
        raise ValueError("a seeded generator runs through a given list of splits")
    sums = materialize(runs.groupBy(F.col(repo).alias("__repo"), F.col(rep).cast("string").alias("rep")).agg(
        F.sum(value).alias("s"), F.count(value).alias("c")))
    whole = sums.groupBy("__repo").agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    inside = sums.join(members, "rep").groupBy("split", "__repo").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    delta = ratio(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c")) - ratio("s", "c")
    means = inside.join(whole, "__repo").select("split", F.col("__repo").alias(repo), delta.alias("delta")).where(F.col("delta").isNotNull())
    out = bootstrap(means, ["split"], [repo], alpha=alpha, draws=draws, stream=stream,
                    repeat="split", repeats=len(splits or ()))
    return out.agg(F.avg(as_number(F.col("lo") > 0)).alias("keep_rate"), F.count(F.lit(1)).alias("n_splits"))
