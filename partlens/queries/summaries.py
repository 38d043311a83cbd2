"""Roll-up queries: a nation is a repository, a line number a replicate, a region a stratum."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import summary as S
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from .registry import Tables, query

_RUNS = """
WITH runs AS (
  SELECT n_name AS repo, r_name AS stratum, l_linenumber AS rep, avg(l_discount) AS gain, avg(l_tax) AS tax,
    count(*) AS n_units, sum(l_quantity) AS tokens, sum(l_extendedprice) AS cost,
    avg((l_returnflag = 'R')::INT) > 0.33 AS valid, max(l_quantity) FILTER (l_discount > 0.09 AND l_tax > 0.07) AS opt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
rows_ AS (SELECT repo, count(*) AS n, avg(valid::INT) AS valid, avg(gain) AS gain, avg(tax) AS coverage, avg(opt) AS contract,
  avg(n_units) AS units, avg(cost) AS cost, avg(tokens) AS tokens, min(stratum) AS stratum FROM runs GROUP BY 1)
"""


def run_records(t: Tables) -> DataFrame:
    """One run record per (nation, line number) with the columns the summary reads."""
    lines = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    null = F.lit(None).cast("double")
    return lines.groupBy(F.col("n_name").alias("repo"), F.col("r_name").alias("stratum"),
                         F.col("l_linenumber").alias("rep")).agg(
        F.avg("l_discount").alias("q_gain_dir"), F.avg("l_tax").alias("coverage"),
        F.count(F.lit(1)).alias("n_units"), F.sum("l_quantity").alias("output_tokens"),
        F.sum("l_extendedprice").alias("cost_usd"),
        (F.avg((F.col("l_returnflag") == "R").cast("int")) > 0.33).alias("valid_nontrivial"),
        F.max(F.when((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07), F.col("l_quantity"))).alias("contract_r"),
    ).select("*", *[null.alias(c) for c in ("q_cochange_gain", "gold_ari", "edge_resolution", "entrypoint_r", "effects_r")],
             F.lit(0).alias("input_tokens"), F.lit(False).alias("budget_exhausted"),
             F.lit(None).cast("int").alias("has_claude_md"), F.lit(None).cast("string").alias("condition"))


def full_run_records(t: Tables) -> DataFrame:
    """Run records with the columns that ``run_records`` leaves empty; some runs lack some of them."""
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rep, null = F.col("l_linenumber"), F.lit(None)
    wide = (F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07)
    return lines.groupBy(F.col("n_name").alias("repo"), rep.alias("rep")).agg(
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("q_cochange_gain"), F.max(F.when(F.col("l_quantity") >= 50, F.col("l_tax"))).alias("gold_ari"),
        F.min("l_discount").alias("edge_resolution"), F.max(F.when(wide, F.col("l_tax"))).alias("entrypoint_r"), F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_tax"))).alias("effects_r"),
        (F.max("l_quantity") >= 50).alias("budget_exhausted"), F.count("*").alias("input_tokens"),
    ).withColumns({
        "has_claude_md": F.when(F.col("rep") == 7, 1), "condition": F.when(F.col("rep") >= 3, F.concat(F.lit("c"), F.col("rep"))), "stratum": null.cast("string"),
        **{c: null.cast("double") for c in ("q_gain_dir", "coverage", "contract_r", "cost_usd")}, "n_units": null.cast("int"), "valid_nontrivial": null.cast("boolean"),
        "output_tokens": F.when(F.col("rep") == 1, F.lit(100))})


@query("repo_summary_rest", """
WITH runs AS (SELECT n_name AS repo, l_linenumber AS rep, avg(l_discount) FILTER (l_linestatus = 'O') AS cochange, max(l_tax) FILTER (l_quantity >= 50) AS gold, min(l_discount) AS edge,
    max(l_tax) FILTER (l_discount > 0.09 AND l_tax > 0.07) AS ep, avg(l_tax) FILTER (l_returnflag = 'A') AS ef, max(l_quantity) >= 50 AS out_of, count(*) AS tokens
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT repo, round(avg(cochange), 6) AS cochange, round(avg(gold), 6) AS gold, round(avg(edge), 6) AS edge, round(avg(ep), 6) AS ep_r, round(avg(ef), 6) AS ef_r,
  sum(out_of::INT) AS exhausted, max(rep) = 7 AS md, coalesce('c' || min(rep) FILTER (rep >= 3), 'skill') AS cond, 'unknown' AS stratum, 0.0::DOUBLE AS cost,
  round((sum(tokens) + 100 * count(*) FILTER (rep = 1)) / count(*), 4) AS tokens FROM runs GROUP BY 1""")
def repo_summary_rest(t: Tables) -> DataFrame:
    """The columns of a summary that ``repo_summary`` has no values for, and the defaults of absent ones."""
    out = S.summarise_runs(full_run_records(t))
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("repo", r("cochange", 6), r("gold", 6), r("edge", 6), r("ep_r", 6), r("ef_r", 6), "exhausted", "md", "cond", "stratum", "cost", r("tokens", 4))


@query("repo_summary", _RUNS + """
SELECT repo, n, round(valid, 6) AS valid, round(gain, 6) AS gain, round(coverage, 6) AS coverage, round(contract, 6) AS contract,
  round(units, 4) AS units, round(cost, 2) AS cost, round(tokens, 4) AS tokens, stratum, 'skill' AS cond, false AS md FROM rows_""")
def repo_summary(t: Tables) -> DataFrame:
    out = S.summarise_runs(run_records(t))
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("repo", "n", r("valid", 6), r("gain", 6), r("coverage", 6), r("contract", 6), r("units", 4),
                      r("cost", 2), r("tokens", 4), "stratum", "cond", "md")


@query("corpus_means", _RUNS + """
SELECT count(*) AS n_repos, sum(n)::BIGINT AS n_runs, round(avg(valid), 6) AS valid_rate, round(avg(gain), 6) AS mean_gain,
  round(avg(cost), 2) AS mean_cost FROM rows_""")
def corpus_means(t: Tables) -> DataFrame:
    out = S.corpus_means(S.summarise_runs(run_records(t)))
    return out.select("n_repos", "n_runs", F.round("valid_rate", 6).alias("valid_rate"),
                      F.round("mean_gain", 6).alias("mean_gain"), F.round("mean_cost", 2).alias("mean_cost"))


@query("stratum_means", _RUNS + """
SELECT stratum, round(avg(valid), 6) AS valid, round(avg(gain), 6) AS gain, count(*) AS n FROM rows_ GROUP BY 1""")
def stratum_means(t: Tables) -> DataFrame:
    out = S.stratum_means(S.summarise_runs(run_records(t)))
    return out.select("stratum", F.round("valid", 6).alias("valid"), F.round("gain", 6).alias("gain"), "n")


@query("budget_rollup", """
WITH b AS (SELECT n_name AS repo, count(*) AS runs, sum(l_quantity) AS tk, sum(l_extendedprice) AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name))
SELECT repo, runs, round(tk / runs, 4) AS tokens_per_run, round(c / runs, 4) AS cost_per_run, round(tk, 2) AS total_tokens,
  round(c, 1) AS total_cost, round(1e6 / (tk / runs), 2) AS runs_per_week, round(1e6 / (tk / runs) / 3, 2) AS repos_per_week FROM b""")
def budget_rollup(t: Tables) -> DataFrame:
    lines = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("repo"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("cost"))
    )
    out = S.budget(lines, weekly_tokens=1e6)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("repo", "runs", r("tokens_per_run", 4), r("cost_per_run", 4), r("total_tokens", 2), r("total_cost", 1),
                      r("runs_per_week", 2), r("repos_per_week", 2))


@query("budget_table", """
WITH b AS (SELECT CASE WHEN s_acctbal >= 0 THEN n_name END AS repo, grouping(CASE WHEN s_acctbal >= 0 THEN n_name END) = 1 AS is_total, count(*) AS runs, sum(l_quantity) AS tk
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (CASE WHEN s_acctbal >= 0 THEN n_name END))
SELECT row_number() OVER (ORDER BY is_total, tk / runs DESC, repo NULLS FIRST) - 1 AS position, repo, is_total, runs, round(tk / runs, 4) AS tokens_per_run FROM b""")
def budget_table(t: Tables) -> DataFrame:
    """The budget as a table in order, written and read again with the places of its rows; one repository has no name."""
    lines = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("repo"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("cost"))
    )
    spark = t.lineitem.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/budget-{uuid.uuid4().hex}"
    sinks.write_ordered(S.budget(lines), S.budget_order(), path)
    return sinks.read_ordered(spark, path).select("position", "repo", "is_total", "runs", F.round("tokens_per_run", 4).alias("tokens_per_run"))


_UNITS = """
WITH u AS (SELECT o_orderpriority AS label, n_name AS repo, (o_orderstatus <> 'F') AS entered_from_outside,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS entrypoint_r,
    CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS effects_r, (o_totalprice < 20000) AS is_singleton
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT label, repo, count(*) AS n_units, avg(entered_from_outside::INT) AS entered_from_outside, avg(entrypoint_r) AS entrypoint_r,
  avg(effects_r) AS effects_r, avg(is_singleton::INT) AS is_singleton FROM u GROUP BY ALL)
"""


def unit_records(t: Tables) -> DataFrame:
    """One unit record per order; the customer's nation is the cluster."""
    o = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return o.select(
        F.col("o_orderpriority").alias("label"), F.col("n_name").alias("repo"),
        (F.col("o_orderstatus") != "F").alias("entered_from_outside"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000).alias("entrypoint_r"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("effects_r"),
        (F.col("o_totalprice") < 20000).alias("is_singleton"))


@query("unit_means", _UNITS + """
SELECT label, repo, n_units, round(entered_from_outside, 6) AS entered_from_outside, round(entrypoint_r, 6) AS entrypoint_r,
  round(effects_r, 6) AS effects_r, round(is_singleton, 6) AS is_singleton FROM m""")
def unit_means(t: Tables) -> DataFrame:
    out = S.unit_means(unit_records(t), ["label", "repo"])
    return out.select("label", "repo", "n_units", *[F.round(o, 6).alias(o) for o in S.UNIT_OUTCOMES])


@query("corpus_unit_means", _UNITS + """
, x AS (SELECT repo, avg(entered_from_outside::INT) AS a, avg(entrypoint_r) AS b, avg(effects_r) AS c, avg(is_singleton::INT) AS d FROM u GROUP BY 1)
SELECT outcome, round(avg(v), 6) AS mean, count(v) AS n_repos FROM (
  SELECT 'entered_from_outside' AS outcome, a AS v FROM x UNION ALL SELECT 'entrypoint_r', b FROM x
  UNION ALL SELECT 'effects_r', c FROM x UNION ALL SELECT 'is_singleton', d FROM x) GROUP BY 1""")
def corpus_unit_means(t: Tables) -> DataFrame:
    out = S.corpus_unit_means(S.unit_means(unit_records(t)))
    return out.select("outcome", F.round("mean", 6).alias("mean"), "n_repos")
