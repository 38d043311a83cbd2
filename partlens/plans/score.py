"""The score vector of every run, in one job with the run key leading every grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import mean_of, parent_dir, round_even
from ..operators import agreement, community, contracts, exclusion, graph
from ..session import materialize
from ..sources import files as source_files
from ..sources import runs as R
from .code_graph import CodeGraph

GK, RK = list(schemas.GRAPH_KEY), list(schemas.RUN_KEY)


def baselines(edges: DataFrame, files: DataFrame, ceiling: DataFrame | None = None) -> DataFrame:
    """q_one, q_dir and (when communities are given) q_ceiling per graph, in one pass.

    The ceiling also places nodes outside the file list, which the baselines do not.
    """
    nodes = files.select(*GK, F.col("path").alias("node"), F.lit("all").alias("q_one"), parent_dir("path").alias("q_dir"))
    columns = ["q_one", "q_dir"]
    if ceiling is None:
        return graph.modularity_of_columns(edges, nodes, GK, columns).withColumn("q_ceiling", F.lit(0.0))
    nodes = nodes.join(ceiling.select(*GK, "node", F.col("community").alias("q_ceiling")), [*GK, "node"], "full")
    return graph.modularity_of_columns(edges, nodes, GK, [*columns, "q_ceiling"])


def _manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    units = R.units(manifests)
    listed = units.select(*RK, "unit", F.explode("entrypoints.name").alias("name"))
    depends = units.select(*RK, F.explode("depends_on").alias("d")).select(*RK, "d.unit", "d.entrypoint")
    declared = units.select(*RK, "unit", F.explode("effects.kind").alias("kind"))
    excluded = manifests.select(*RK, F.explode("excluded.path").alias("path")).where(F.col("path").isNotNull())
    return {"units": units, "unit_files": R.unit_files(manifests), "listed": listed, "depends": depends,
            "declared": declared, "excluded": excluded}


def score_runs(manifests: DataFrame, results: DataFrame, files: DataFrame, code: CodeGraph,
               lint: DataFrame | None = None, commits: DataFrame | None = None,
               gold: DataFrame | None = None) -> DataFrame:
    """One row per run key with the fields of a score record.

    ``files`` lists (repo, sha, path); ``commits`` (repo, sha, commit, path, age);
    ``gold`` (repo, path, unit). A run without a manifest or result still gets a row.
    """
    manifests = materialize(manifests.select(*RK, *[k for k in schemas.MANIFEST if k != "repo"]))
    m = _manifest_tables(manifests)
    runs = manifests.select(*RK, F.coalesce(F.size("unpartitioned"), F.lit(0)).alias("unpartitioned"))
    out, per_unit = score_tables(runs, m, results, files, code, lint, commits, gold)
    out = out.join(_unit_array(m["units"], per_unit), RK, "left").withColumn(
        "units", F.coalesce("units", F.array().cast(schemas.SCORE["units"])))
    return out.select(*RK, *[F.col(n).cast(kind).alias(n) for n, kind in schemas.SCORE.items()])


def score_tables(runs: DataFrame, m: dict[str, DataFrame], results: DataFrame, files: DataFrame, code: CodeGraph,
                 lint: DataFrame | None = None, commits: DataFrame | None = None,
                 gold: DataFrame | None = None, ceiling: bool = True) -> tuple[DataFrame, DataFrame]:
    """Score records without their unit lists, and the contracts of every unit.

    ``m`` holds the manifests as long tables (units, unit_files, listed, depends, declared,
    excluded), so units of any number and size are spread over the cluster.
    """
    owner = materialize(contracts.owners(m["unit_files"], RK))
    scored = files.where(source_files.is_source("path")).select(*GK, "path").distinct()

    # coverage and validity
    cover = exclusion.coverage(runs, scored, owner, m["excluded"], RK, GK)
    resolved = contracts.edge_resolution(m["depends"], m["listed"], RK)
    counts = m["units"].groupBy(*RK).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg((F.col("n_files") <= 1).cast("double")).alias("singleton_unit_frac"))
    owned = owner.groupBy(*RK).agg(F.count(F.lit(1)).alias("n_owned"))

    # partition quality
    edges = materialize(graph.undirected(code.edges, GK))
    base = baselines(edges, scored, community.louvain(edges, GK) if ceiling else None)
    proposal = owner.select(*RK, F.col("path").alias("node"), F.col("unit").alias("community"))
    q_llm = graph.modularity(edges, proposal, GK, ["label", "rep"]).withColumnRenamed("q", "q_llm")
    out = (
        runs.join(cover, RK, "left").join(resolved, RK, "left").join(counts, RK, "left").join(owned, RK, "left")
        .join(q_llm, RK, "left").join(base, GK, "left")
    )
    zero = ("coverage", "q_llm", "q_one", "q_dir", "q_ceiling")
    out = out.withColumns({
        **{c: F.coalesce(c, F.lit(0.0)) for c in zero},
        "edge_resolution": F.coalesce("edge_resolution", F.lit(1.0)),
        "n_units": F.coalesce("n_units", F.lit(0)), "n_owned": F.coalesce("n_owned", F.lit(0)),
    })

    # co-change and gold agreement, both null where there is nothing to compare with
    out = out.join(_cochange(commits, scored, proposal), RK, "left") if commits is not None else out.withColumns(
        {c: F.lit(None).cast("double") for c in ("q_cochange_llm", "q_cochange_gain")})
    out = out.join(_gold(gold, owner, runs), RK, "left") if gold is not None else out.withColumns(
        {c: F.lit(None).cast("double") for c in ("gold_ari", "gold_nmi")})

    # contracts
    per_unit, summary = _contracts(m, owner, code)
    out = out.join(summary, RK, "left").withColumn("contract_r", mean_of("entrypoint_r", "effects_r"))

    # how the run ended and what it cost
    out = out.join(results.select(*RK, *schemas.RESULT), RK, "left")
    out = out.join(lint.select(*RK, "lint_rounds"), RK, "left") if lint is not None else out.withColumn("lint_rounds", F.lit(0))
    out = out.withColumns({
        "trivial": contracts.is_trivial("n_units", "n_owned"),
        "budget_exhausted": contracts.budget_exhausted("subtype", "terminal_reason"),
        "run_error": contracts.run_error("subtype", "is_error"),
        "q_gain_dir": graph.gain("q_llm", "q_one", "q_dir"),
    })
    # on values that are not rounded yet
    valid = (
        (F.col("coverage") >= contracts.MIN_COVERAGE) & (F.col("edge_resolution") >= contracts.MIN_EDGE_RESOLUTION)
        & ~F.col("trivial") & ~F.col("budget_exhausted")
    )
    return _record(out.withColumn("valid_nontrivial", valid), code.source), per_unit


def _cochange(commits: DataFrame, scored: DataFrame, proposal: DataFrame) -> DataFrame:
    recent = graph.newest_commits(commits.withColumn("__recency", -F.col("age")), GK, "__recency")
    # counted and then read: no more than the newest commits
    lines = materialize(recent.join(scored, [*GK, "path"], "left_semi").withColumnRenamed("path", "item"))
    edges = materialize(graph.cochange_edges(lines, GK))
    base = baselines(edges, scored).drop("q_ceiling")
    q = graph.modularity(edges, proposal, GK, ["label", "rep"]).withColumnRenamed("q", "q_cochange_llm")
    # only graphs with co-change edges carry a value
    return q.join(edges.select(*GK).distinct(), GK, "left_semi").join(base, GK).select(
        *RK, "q_cochange_llm", graph.gain("q_cochange_llm", "q_one", "q_dir").alias("q_cochange_gain"))


def _gold(gold: DataFrame, owner: DataFrame, runs: DataFrame) -> DataFrame:
    first = owner.select(*RK, F.col("path").alias("item"), F.col("unit").alias("community"))
    # without places of listings, the unit's name decides
    last = "pos" if "pos" in gold.columns else "unit"
    truth = contracts.last_wins(gold, ["repo", "path"], "unit", last).select("repo", F.col("path").alias("item"), F.col("unit").alias("community"))
    second = runs.select(*RK).join(truth, "repo")
    found = agreement.agreement(agreement.contingency(first, second, RK), RK)
    return found.select(*RK, F.col("ari").alias("gold_ari"), F.col("nmi").alias("gold_nmi"))


def _contracts(m: dict[str, DataFrame], owner: DataFrame, code: CodeGraph) -> tuple[DataFrame | None, DataFrame]:
    names = m["units"].select(*RK, "unit").distinct()
    values = contracts.contract_values(
        m["unit_files"], owner, m["listed"], m["declared"], code.refs, code.surface, code.effects, RK, GK)
    per_unit = materialize(contracts.unit_contracts(names, values, RK))
    if code.source == "regex-fallback":
        per_unit = per_unit.where(F.lit(False))
    return per_unit, contracts.contract_summary(per_unit, RK).withColumns(
        {c: round_even(c, 4) for c in ("entrypoint_p", "entrypoint_r", "effects_p", "effects_r")})


def _unit_array(units: DataFrame, per_unit: DataFrame) -> DataFrame:
    """Unit records of a run in manifest order; a run has the units its manifest row had."""
    facts = {"n_files": F.col("n_files").cast("int"), "is_singleton": F.col("n_files") <= 1, "name": F.col("unit")}
    counts = ("n_missed_entrypoints", "n_undeclared_effects")
    record = F.struct("unit_pos", F.struct(*[
        (facts.get(k, F.col(k).cast("int") if k in counts else F.col(k))).alias(k) for k in schemas.UNIT_RECORD
    ]).alias("u"))
    return units.join(per_unit, [*RK, "unit"], "left").groupBy(*RK).agg(
        F.transform(F.array_sort(F.collect_list(record)), lambda r: r["u"]).alias("units"))


def _record(out: DataFrame, source: str) -> DataFrame:
    places = {"coverage": 3, "edge_resolution": 3, "singleton_unit_frac": 3}
    renamed = {
        "result_subtype": F.nullif(F.coalesce("subtype", F.lit("")), F.lit("")), "graph_source": F.lit(source),
        "cost_usd": F.coalesce("total_cost_usd", F.lit(0.0)), "turns": F.col("num_turns"),
        "input_tokens": F.col("usage.input_tokens"), "output_tokens": F.col("usage.output_tokens"),
        "lint_rounds": F.coalesce("lint_rounds", F.lit(0)),
    }
    rounded = [c for c in schemas.SCORE if c.startswith(("q_", "gold_")) or c in places or c == "contract_r"]
    fields = []
    for name, kind in schemas.SCORE.items():
        if name == "units":
            continue
        value = renamed.get(name, F.col(name))
        if name in rounded:
            value = round_even(value, places.get(name, 4))
        fields.append(value.cast(kind).alias(name))
    return out.select(*RK, *fields)


def score_directory(spark: SparkSession, root: str, files: DataFrame, code: CodeGraph,
                    commits: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """Score every run below a directory of run records."""
    lint = R.lint_round_counts(R.read_text(spark, root, "lint.log"))
    results = R.read_json(spark, root, "result.json", schemas.RESULT)
    return score_runs(R.read_manifests(spark, root), results, files, code, lint, commits, gold)


def headroom(edges: DataFrame, files: DataFrame) -> DataFrame:
    """How much a partition could win on each graph, before any run is paid for."""
    und = materialize(graph.undirected(edges, GK))
    scored = files.where(source_files.is_source("path")).select(*GK, "path").distinct()
    q = baselines(und, scored, community.louvain(und, GK))
    n = scored.groupBy(*GK).agg(F.count(F.lit(1)).alias("files"))
    hubs = graph.hub_share(edges, GK)
    room = graph.headroom("q_ceiling", "q_dir")
    return n.join(q, GK, "left").join(hubs, GK, "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("q_dir", "q_ceiling", "hub_share")}
    ).select(
        *GK, "files", round_even("q_dir", 4).alias("q_dir"), round_even("q_ceiling", 4).alias("ceiling"),
        round_even(room, 4).alias("headroom"), round_even("hub_share", 3).alias("hub_share"),
        graph.verdict("q_dir", room).alias("verdict"))
