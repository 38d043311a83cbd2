"""Agreement of two partitions, from contingency counts and never from item pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import choose2, ratio


def contingency(first: DataFrame, second: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """Counts of common items per pair of communities."""
    left = first.select(*keys, item, F.col("community").alias("c1"))
    right = second.select(*keys, item, F.col("community").alias("c2"))
    return left.join(right, [*keys, item]).groupBy(*keys, "c1", "c2").agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information per key.

    ARI is null below two common items and 1 when the maximum equals the expectation;
    NMI divides by the mean entropy and is 1 when both entropies are 0.
    Mutual information is H(c1) + H(c2) - H(c1, c2), so cells and margins are one
    union that is aggregated once more.
    """
    keys = list(keys)
    part = lambda name, *cols: (
        table.groupBy(*keys, *cols).agg(F.sum("n").alias("n")).select(*keys, F.lit(name).alias("part"), "n")
    )
    counts = (
        table.select(*keys, F.lit("cell").alias("part"), "n")
        .unionByName(part("first", "c1")).unionByName(part("second", "c2"))
    )
    n_log_n = F.col("n") * F.log("n")
    only = lambda name, value: F.sum(F.when(F.col("part") == name, value).otherwise(F.lit(0.0)))
    sums = counts.groupBy(*keys).agg(
        only("cell", F.col("n").cast("double")).alias("n"),
        only("cell", choose2("n")).alias("s_cell"),
        only("first", choose2("n")).alias("s_1"),
        only("second", choose2("n")).alias("s_2"),
        only("cell", n_log_n).alias("l_cell"),
        only("first", n_log_n).alias("l_1"),
        only("second", n_log_n).alias("l_2"),
    )
    expected = ratio(F.col("s_1") * F.col("s_2"), choose2("n"))
    largest = (F.col("s_1") + F.col("s_2")) / 2
    ari = F.when(F.col("n") < 2, F.lit(None)).when(largest == expected, F.lit(1.0)).otherwise(
        ratio(F.col("s_cell") - expected, largest - expected))
    n, log_n = F.col("n"), F.log("n")
    entropy = lambda l: log_n - F.col(l) / n
    mutual = entropy("l_1") + entropy("l_2") - entropy("l_cell")
    base = (entropy("l_1") + entropy("l_2")) / 2
    nmi = F.when(n == 0, F.lit(None)).when(base < 1e-12, F.lit(1.0)).otherwise(ratio(mutual, base))
    return sums.select(*keys, n.cast("long").alias("n_items"), ari.alias("ari"), nmi.alias("nmi"))


def co_assigned(partition: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of item pairs that share a community."""
    return (
        partition.where(F.col("community").isNotNull())
        .groupBy(*keys, "community").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys).agg(F.sum(choose2("n")).alias("pairs"))
    )


def jaccard(pairs_1, pairs_2, pairs_both) -> Column:
    """Jaccard index of two sets of co-assigned pairs; 1 when neither has a pair."""
    union = pairs_1 + pairs_2 - pairs_both
    return F.when(union == 0, F.lit(1.0)).otherwise(ratio(pairs_both, union))


def pair_jaccard(first: DataFrame, second: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """Jaccard index of co-assigned pairs, in closed form from C(n, 2) of the counts."""
    keys = list(keys)
    both = (
        contingency(first.where(F.col("community").isNotNull()), second.where(F.col("community").isNotNull()), keys, item)
        .groupBy(*keys).agg(F.sum(choose2("n")).alias("p_both"))
    )
    zero = F.lit(0.0)
    return (
        co_assigned(first, keys).withColumnRenamed("pairs", "p1")
        .join(co_assigned(second, keys).withColumnRenamed("pairs", "p2"), keys, "full")
        .join(both, keys, "left")
        .select(*keys, jaccard(F.coalesce("p1", zero), F.coalesce("p2", zero), F.coalesce("p_both", zero)).alias("jaccard"))
    )


def replicate_jaccard(partitions: DataFrame, runs: DataFrame, group: Sequence[str], rep: str = "rep",
                      item: str = "item") -> DataFrame:
    """Mean pairwise Jaccard over the replicates of each group; null with one replicate.

    ``runs`` lists every replicate, so one with an empty partition still counts.
    Replicates with the same partition are found by a fingerprint of (item, smallest
    item of its community) and handled once with their multiplicity, so a crowd of
    copies costs what one copy costs. Distinct partitions are compared through item
    counts, joined on the item.
    """
    group, run = list(group), [*group, rep]
    part = partitions.where(F.col("community").isNotNull()).select(*run, item, "community")
    canon = part.join(
        part.groupBy(*run, "community").agg(F.min(item).alias("__least")), [*run, "community"]
    ).select(*run, item, "__least")
    prints = canon.groupBy(*run).agg(
        F.sum(F.xxhash64(F.col(item), F.col("__least")).cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit("second"), F.col("__least"), F.col(item)).cast("decimal(38,0)")).alias("h2"),
        F.count(F.lit(1)).alias("h3"),
    )
    fingerprint = F.coalesce(F.concat_ws(":", *[F.col(c).cast("string") for c in ("h1", "h2", "h3")]), F.lit(""))
    tagged = runs.select(*run).distinct().join(prints, run, "left").select(*run, fingerprint.alias("fp"))
    variants = tagged.groupBy(*group, "fp").agg(F.count(F.lit(1)).alias("copies"), F.min(rep).alias(rep))
    # one representative run per distinct partition
    content = canon.join(variants.select(*run, "fp"), run).select(*group, "fp", item, "__least")
    sizes = (
        content.groupBy(*group, "fp", "__least").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group, "fp").agg(F.sum(choose2("n")).alias("pairs"))
    )
    info = variants.join(sizes, [*group, "fp"], "left").select(
        *group, "fp", "copies", F.coalesce("pairs", F.lit(0.0)).alias("pairs"))
    side = lambda df, n, *cols: df.select(*group, *[F.col(c).alias(f"{c}{n}") for c in ("fp", *cols)])
    both = (
        content.select(*group, item, F.col("fp").alias("fp1"), F.col("__least").alias("l1"))
        .join(content.select(*group, item, F.col("fp").alias("fp2"), F.col("__least").alias("l2")), [*group, item])
        .where(F.col("fp1") < F.col("fp2"))
        .groupBy(*group, "fp1", "fp2", "l1", "l2").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group, "fp1", "fp2").agg(F.sum(choose2("n")).alias("p_both"))
    )
    between = (
        side(info, 1, "copies", "pairs").join(side(info, 2, "copies", "pairs"), group)
        .where(F.col("fp1") < F.col("fp2"))
        .join(both, [*group, "fp1", "fp2"], "left")
        .select(
            *group,
            (F.col("copies1") * F.col("copies2")).cast("double").alias("weight"),
            jaccard(F.col("pairs1"), F.col("pairs2"), F.coalesce("p_both", F.lit(0.0))).alias("j"),
        )
    )
    within = info.select(*group, choose2("copies").alias("weight"), F.lit(1.0).alias("j"))
    return (
        between.unionByName(within)
        .groupBy(*group)
        .agg(ratio(F.sum(F.col("weight") * F.col("j")), F.sum("weight")).alias("jaccard"))
    )
