"""Graph construction and partition quality on edge tables.

A graph is a table of undirected edges ``keys..., a, b, weight`` with ``a < b``.
``keys`` name the graph (say repository and revision), so any number of graphs is
measured in one job. Every sum is combined on the map side; the two endpoint
look-ups have one row per node on one side, which AQE can split when a hub is hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..session import materialize
from .keyed import HEAVY_GROUPS, top_k

MAX_ITEMS_PER_COMMIT = 20
MAX_COMMITS = 2000
#: Lines whose pairs one task counts.
LINES_PER_TASK = 250_000
#: Hash buckets in which lines are counted to find the commits that may be heavy.
BUCKETS = 1 << 14
#: Newest commits are sent to all tasks only if they were counted and are no more than this.
BROADCAST_COMMITS = 100_000
FLAT_Q_DIR = 0.02
THIN_HEADROOM = 0.10


def undirected(edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst",
               weight: str | None = None) -> DataFrame:
    """Undirected closure: reciprocal links merge to weight 1, or their weights add up."""
    pairs = edges.where(F.col(src) != F.col(dst)).select(
        *keys,
        F.least(src, dst).alias("a"),
        F.greatest(src, dst).alias("b"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"),
    )
    if weight is None:
        return pairs.distinct()
    return pairs.groupBy(*keys, "a", "b").agg(F.sum("weight").alias("weight"))


def newest_commits(commits: DataFrame, keys: Sequence[str], recency: str,
                   limit: int = MAX_COMMITS) -> DataFrame:
    """Lines of the ``limit`` newest commits of each graph.

    These commits are written and counted first: if they are few, the lines are not shuffled to meet them.
    """
    heads = commits.select(*keys, "commit", recency).distinct()
    newest = materialize(top_k(heads, keys, [F.desc(recency), F.col("commit")], limit).select(*keys, "commit"))
    n, low, high = newest.agg(F.count(F.lit(1)), F.min("commit"), F.max("commit")).first()
    small = n <= BROADCAST_COMMITS
    if n:
        commits = commits.where(F.col("commit").between(F.lit(low), F.lit(high)))
    return commits.join(F.broadcast(newest) if small else newest, [*keys, "commit"], "left_semi")


def _without_giants(lines: DataFrame, keys: Sequence[str], max_items: int) -> tuple[DataFrame, int]:
    """Lines without those of at most ``HEAVY_GROUPS`` giant commits, and how many lines there were.

    Commits are counted in hash buckets, which are added up before the shuffle; only the lines of the
    few buckets that are heavy are counted by commit. A commit of more than ``max_items`` lines that
    stays has no more than 1/``HEAVY_GROUPS`` of all lines.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = {r["b"]: r["n"] for r in lines.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    least = max(max_items, total // HEAVY_GROUPS)
    heavy = [b for b, n in sizes.items() if n > least]
    if not heavy:
        return lines, total
    giant = lines.where(bucket.isin(heavy)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least)
    return lines.join(F.broadcast(giant.select(*keys)), list(keys), "left_anti"), total


def cochange_edges(lines: DataFrame, keys: Sequence[str], commit: str = "commit", item: str = "item",
                   max_items: int = MAX_ITEMS_PER_COMMIT) -> DataFrame:
    """Items changed together: weight = number of commits holding both.

    A commit counts when it has 2..max_items lines, counted before duplicates are
    removed. Larger commits carry no edge by definition; the heaviest of them are
    dropped before the shuffle, so one giant commit never travels to one task, and
    lines are counted and gathered in one shuffle. They are dealt to as many tasks as their
    number asks for: pairs are several times as many as lines, so they are not counted in
    partitions joined by the size of the lines.
    """
    commit_keys = [*keys, commit]
    # a line without a commit belongs to none
    lines = lines.select(*commit_keys, F.col(item).alias("__item")).dropna(subset=commit_keys)
    lines, total = _without_giants(lines, commit_keys, max_items)
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(total / LINES_PER_TASK))
    whole = Window.partitionBy(*commit_keys)
    later = F.collect_list("__item").over(whole.orderBy("__item").rowsBetween(1, max_items))
    return (
        lines.repartition(tasks, *commit_keys)
        .groupBy(*commit_keys, "__item").agg(F.count(F.lit(1)).alias("__lines"))
        # commits are counted in rows that can be spilled; only those that stay are paired
        .withColumn("__n", F.sum("__lines").over(whole))
        .where(F.col("__n").between(2, max_items) & F.col("__item").isNotNull())
        .select(*keys, F.col("__item").alias("a"), later.alias("__later"))
        .select(*keys, "a", F.explode("__later").alias("b"))
        .groupBy(*keys, "a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted degree of every node, from one scan of the edges."""
    return (
        edges.select(*keys, F.explode(F.array("a", "b")).alias("node"), "weight")
        .groupBy(*keys, "node")
        .agg(F.sum("weight").alias("degree"))
    )


def modularity(edges: DataFrame, assignment: DataFrame, graph_keys: Sequence[str],
               part_keys: Sequence[str] = ()) -> DataFrame:
    """Newman modularity of every partition in ``assignment`` (``node``, ``community``).

    Q = 2 W_in / 2m - sum_c (deg(c) / 2m)^2. A node without a community adds nothing
    but stays in 2m; a graph without edges has Q = 0. Several partitions of one graph
    (``part_keys``) share the scan of its edges. Linear in edges, never in node pairs.
    """
    gk, pk = list(graph_keys), list(part_keys)
    members = assignment.where(F.col("community").isNotNull()).select(*gk, *pk, "node", "community")
    totals = edges.groupBy(*gk).agg((F.sum("weight") * 2).alias("m2"))
    spread = (
        degrees(edges, gk).join(members, [*gk, "node"])
        .groupBy(*gk, *pk, "community").agg(F.sum("degree").alias("d"))
        .groupBy(*gk, *pk).agg(F.sum(F.col("d") * F.col("d")).alias("square"))
    )
    inside = (
        # the other end meets the same shuffle of members, dealt by node alone
        edges.join(members.withColumnRenamed("node", "a"), [*gk, "a"])
        .join(members.select(*gk, *pk, F.col("node").alias("b"), F.col("community").alias("__near")), [*gk, *pk, "b"])
        .where(F.col("community") == F.col("__near"))
        .groupBy(*gk, *pk).agg(F.sum("weight").alias("w_in"))
    )
    q = 2 * F.coalesce("w_in", F.lit(0.0)) / F.col("m2") - F.coalesce("square", F.lit(0.0)) / (F.col("m2") * F.col("m2"))
    return (
        assignment.select(*gk, *pk).distinct()
        .join(totals, gk, "left")
        .join(spread, [*gk, *pk], "left")
        .join(inside, [*gk, *pk], "left")
        .select(*gk, *pk, F.when(F.coalesce("m2", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(q).alias("q"))
    )


def modularity_of_columns(edges: DataFrame, nodes: DataFrame, graph_keys: Sequence[str],
                          columns: Sequence[str]) -> DataFrame:
    """Modularity of several partitions held as columns of one node table.

    The same measure as ``modularity`` for partitions that share their nodes: an edge is
    looked up once per end, whatever the number of partitions, and never multiplied.
    Rows exist for graphs with edges; a null community adds nothing.
    """
    gk = list(graph_keys)
    end = lambda n: nodes.select(*gk, F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    inside = edges.join(end("a"), [*gk, "a"], "left").join(end("b"), [*gk, "b"], "left").groupBy(*gk).agg(
        (2 * F.sum("weight")).alias("m2"),
        *[F.coalesce(F.sum(F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), F.col("weight"))), F.lit(0.0)).alias(f"in_{c}") for c in columns])
    community = F.explode(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("community")) for c in columns])).alias("p")
    spread = (
        degrees(edges, gk).join(nodes, [*gk, "node"]).select(*gk, "degree", community).where(F.col("p.community").isNotNull())
        .groupBy(*gk, "p.part", "p.community").agg(F.sum("degree").alias("d"))
        .groupBy(*gk).agg(*[
            F.sum(F.when(F.col("part") == c, F.col("d") * F.col("d"))).alias(f"square_{c}") for c in columns])
    )
    q = lambda c: 2 * F.col(f"in_{c}") / F.col("m2") - F.coalesce(f"square_{c}", F.lit(0.0)) / (F.col("m2") * F.col("m2"))
    return inside.join(spread, gk, "left").select(*gk, *[q(c).alias(c) for c in columns])


def gain(q, *baselines) -> Column:
    """Modularity above the better of the baselines."""
    cols = [F.col(b) if isinstance(b, str) else b for b in baselines]
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return (F.col(q) if isinstance(q, str) else q) - best


def hub_share(edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Share of edge endpoints on the top 5 % most connected nodes (at least one node).

    Works on the histogram of degrees. A graph with E edges has at most 2*sqrt(E)
    distinct degrees, so the ordered step stays small even when one graph is huge.
    """
    keys = list(keys)
    histogram = (
        edges.select(*keys, F.explode(F.array(src, dst)).alias("node"))
        .groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("d"))
        .groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    )
    higher = Window.partitionBy(*keys).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) / 20))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.coalesce(F.sum("n").over(higher), F.lit(0))))
    return (
        histogram.withColumn("taken", taken)
        .groupBy(*keys)
        .agg(ratio(F.sum(F.col("taken") * F.col("d")), F.sum(F.col("n") * F.col("d"))).alias("hub_share"))
    )


def headroom(ceiling, q_dir) -> Column:
    """Room a partition can win above the directory baseline."""
    c = F.col(ceiling) if isinstance(ceiling, str) else ceiling
    d = F.col(q_dir) if isinstance(q_dir, str) else q_dir
    return c - F.greatest(F.lit(0.0), d)


def verdict(q_dir, room, flat: float = FLAT_Q_DIR, thin: float = THIN_HEADROOM) -> Column:
    """FLAT is tested before THIN, so a negative baseline is always FLAT."""
    d = F.col(q_dir) if isinstance(q_dir, str) else q_dir
    r = F.col(room) if isinstance(room, str) else room
    return F.when(d < flat, "FLAT").when(r < thin, "THIN").otherwise("MEASURABLE")


def token_links(lines: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links from a text line to every item whose name occurs in it as a word.

    ``lines`` has ``item`` and ``line``; ``names`` has ``item`` and ``name``. Words
    are reduced to distinct (item, word) rows before the join.
    """
    words = (
        lines.select(*keys, F.col("item").alias("src"),
                     F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name"))
        .distinct()
    )
    return (
        words.join(names.select(*keys, F.col("item").alias("dst"), "name"), [*keys, "name"])
        .where(F.col("src") != F.col("dst"))
        .select(*keys, "src", "dst")
        .distinct()
    )
