"""Decision queries: return flags are versions, brands are repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import power as P
from ..operators import summary as S
from .registry import Tables, query
from .summaries import _UNITS, unit_records

DRAWS = 1000

_SUMMARY = """
WITH s AS (SELECT {model} AS model, l_returnflag AS label, p_brand AS repo, avg((l_tax > 0.02)::INT) AS valid, avg(l_discount) AS gain,
    avg(l_quantity) FILTER (l_linenumber = 1) AS jaccard, avg(l_quantity / 50) AS contract, avg(l_extendedprice) AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cmp AS (SELECT * FROM (VALUES ('A>R', 'A', 'R'), ('R>N', 'R', 'N'), ('N>A', 'N', 'A'), ('A>X', 'A', 'X')) v(comparison, b, a)),
pairs AS (SELECT comparison || '/' || x.model AS comparison, x.model, x.repo, y.gain - x.gain AS delta, x.valid AS vb, y.valid AS va, x.jaccard AS jb,
    y.jaccard AS ja, x.contract AS kb, y.contract AS ka, x.cost AS cb, y.cost AS ca
  FROM cmp JOIN s x ON x.label = b JOIN s y ON y.label = a AND y.repo = x.repo AND y.model = x.model),
pos AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY repo) - 1 AS position, count(*) OVER (PARTITION BY comparison) AS n FROM pairs),
draws AS (SELECT comparison, d.draw, ('0x' || substr(md5(d.draw || ':' || position), 1, 8))::BIGINT % n AS pick
  FROM pos, (SELECT unnest(range({draws})) AS draw) d),
means AS (SELECT draws.comparison, draw, avg(delta) AS m FROM draws JOIN pos ON pos.comparison = draws.comparison AND pos.position = pick GROUP BY ALL),
ranked AS (SELECT comparison, m, row_number() OVER (PARTITION BY comparison ORDER BY m) - 1 AS r FROM means),
ci AS (SELECT comparison, max(m) FILTER (r = {lo}) AS lo, max(m) FILTER (r = {hi}) AS hi FROM ranked GROUP BY 1),
facts AS (SELECT comparison, any_value(model) AS model, count(*) AS n_repos, avg(delta) AS observed, avg(vb) - avg(va) AS dv, avg(jb) - avg(ja) AS dj, avg(kb) - avg(ka) AS dk,
  100 * (avg(ca) - avg(cb)) / avg(cb) AS cost_pct FROM pairs GROUP BY 1),
reasons AS (SELECT *, CASE WHEN n_repos < 3 THEN 'pairs' WHEN dv > 1e-9 AND dv * n_repos > 1.0 / 3 THEN 'validity' WHEN dj > 0.15 THEN 'stability'
  WHEN dk > 0.05 THEN 'contract' ELSE 'interval' END AS reason FROM facts),
decided AS (SELECT *, CASE WHEN reason = 'interval' AND lo > 0 THEN 'KEEP' ELSE 'REVERT' END AS verdict FROM reasons JOIN ci USING (comparison))
"""
_LO, _HI = I.percentile_positions(DRAWS, I.ALPHA)
BY_ALL = _SUMMARY.format(model="'all'", draws=DRAWS, lo=_LO, hi=_HI)
BY_TYPE = _SUMMARY.format(model="p_type", draws=DRAWS, lo=_LO, hi=_HI)


def _summaries(t: Tables, model) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(model.alias("model"), F.col("l_returnflag").alias("label"), F.col("p_brand").alias("repo")).agg(
        F.avg((F.col("l_tax") > 0.02).cast("int")).alias("valid"), F.avg("l_discount").alias("gain"),
        F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("jaccard"),
        F.avg(F.col("l_quantity") / 50).alias("contract"), F.avg("l_extendedprice").alias("cost"))


def _decisions(t: Tables, model) -> DataFrame:
    """Labels carry the model as a suffix; a comparison is a pair of such labels."""
    rows = _summaries(t, model).withColumn("label", F.concat_ws("/", "label", "model"))
    models = rows.select("model").distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b, a in ("AR", "RN", "NA", "AX")]))
    comparisons = models.select("model", pairs.alias("c")).select(
        "model", F.concat(F.col("c.b"), F.lit(">"), F.col("c.a"), F.lit("/"), "model").alias("comparison"),
        F.concat_ws("/", F.col("c.b"), "model").alias("before"), F.concat_ws("/", F.col("c.a"), "model").alias("after"))
    joined = I.paired(rows, comparisons.drop("model"))
    out = I.decide(joined, comparisons, draws=DRAWS, stream="hash")
    return out.join(comparisons.select("comparison", "model"), "comparison")


@query("paired_bootstrap", BY_ALL + """
SELECT comparison, n_repos AS n, round(observed, 8) AS observed, round(lo, 8) AS lo, round(hi, 8) AS hi FROM facts JOIN ci USING (comparison)""")
def paired_bootstrap(t: Tables) -> DataFrame:
    out = _decisions(t, F.lit("all")).where("n_repos > 0")
    return out.select("comparison", F.col("n_repos").alias("n"), *[F.round(c, 8).alias(c) for c in ("observed", "lo", "hi")])


@query("decide", BY_ALL + """
SELECT comparison, n_repos, reason, verdict, round(cost_pct, 4) AS cost_pct FROM decided
UNION ALL SELECT 'A>X/all', 0, 'pairs', 'REVERT', 0.0""")
def decide(t: Tables) -> DataFrame:
    return _decisions(t, F.lit("all")).select("comparison", "n_repos", "reason", "verdict", F.round("cost_pct", 4).alias("cost_pct"))


@query("decide_transfer", BY_TYPE + """
SELECT split_part(comparison, '/', 1) AS change, count(*) FILTER (verdict = 'KEEP') AS n_keep, count(*) AS n_models,
  CASE WHEN bool_and(verdict = 'KEEP') THEN 'KEEP' ELSE 'REVERT' END AS verdict FROM decided GROUP BY 1
UNION ALL SELECT 'A>X', 0, (SELECT count(DISTINCT p_type) FROM lineitem JOIN part ON l_partkey = p_partkey), 'REVERT'""")
def decide_transfer(t: Tables) -> DataFrame:
    """A change must hold for every part type."""
    out = _decisions(t, F.col("p_type")).withColumn("change", F.split("comparison", "/")[0])
    return I.decide_transfer(out, ["change"])


@query("cluster_bootstrap", _UNITS + f"""
, d AS (SELECT outcome, repo, n_units, delta FROM (
    SELECT x.repo, y.n_units, y.entered_from_outside - x.entered_from_outside AS entered_from_outside, y.entrypoint_r - x.entrypoint_r AS entrypoint_r,
      y.effects_r - x.effects_r AS effects_r, y.is_singleton - x.is_singleton AS is_singleton
    FROM m x JOIN m y USING (repo) WHERE x.label = '1-URGENT' AND y.label = '5-LOW')
  UNPIVOT (delta FOR outcome IN (entered_from_outside, entrypoint_r, effects_r, is_singleton))),
pos AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY repo) - 1 AS position, count(*) OVER (PARTITION BY outcome) AS n FROM d),
draws AS (SELECT outcome, g.draw, ('0x' || substr(md5(g.draw || ':' || position), 1, 8))::BIGINT % n AS pick
  FROM pos, (SELECT unnest(range({DRAWS})) AS draw) g),
means AS (SELECT outcome, draw, avg(delta) AS m FROM draws JOIN pos USING (outcome) WHERE position = pick GROUP BY ALL),
ranked AS (SELECT outcome, m, row_number() OVER (PARTITION BY outcome ORDER BY m) - 1 AS r FROM means),
ci AS (SELECT outcome, max(m) FILTER (r = {_LO}) AS lo, max(m) FILTER (r = {_HI}) AS hi FROM ranked GROUP BY 1),
o AS (SELECT outcome, count(*) AS n_repos, sum(n_units)::BIGINT AS n_units_after, avg(delta) AS observed FROM d GROUP BY 1)
SELECT outcome, n_repos, n_units_after, round(observed, 8) AS observed, round(lo, 8) AS lo, round(hi, 8) AS hi, (lo > 0 OR hi < 0) AS excludes_zero,
  CASE WHEN outcome = 'entrypoint_r' THEN CASE WHEN lo > 0 THEN 'KEEP' ELSE 'REVERT' END END AS verdict FROM o JOIN ci USING (outcome)""")
def cluster_bootstrap(t: Tables) -> DataFrame:
    """Unit outcomes of low against urgent orders, resampled by nation."""
    means = S.unit_means(unit_records(t), ["label", "repo"])
    comparisons = means.select("label").where("label = '1-URGENT'").distinct().select(
        F.lit("low").alias("comparison"), F.col("label").alias("before"), F.lit("5-LOW").alias("after"))
    out = I.decide_units(I.unit_deltas(means, comparisons), draws=DRAWS, stream="hash")
    return out.select("outcome", "n_repos", "n_units_after", *[F.round(c, 8).alias(c) for c in ("observed", "lo", "hi")],
                      "excludes_zero", "verdict")


@query("icc1_flat", """
SELECT p_type, count(*) AS n_groups, NULL::DOUBLE AS icc FROM (SELECT p_type, p_brand FROM part GROUP BY ALL HAVING count(*) >= 2) GROUP BY p_type""")
def icc1_flat(t: Tables) -> DataFrame:
    """Equal values that no double holds exactly: there is nothing to tell groups apart by."""
    return I.icc1(t.part.withColumn("v", F.lit(0.1)), "p_brand", "v", ["p_type"]).select("p_type", "n_groups", "icc")


@query("icc1", """
WITH g AS (SELECT p_type, p_brand, count(*)::DOUBLE AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT p_type, count(*) AS k, avg(n) AS size, sum(n) AS t, sum(n*m)/sum(n) AS grand, sum(n*v) AS sw FROM g GROUP BY 1),
b AS (SELECT p_type, sum(n*(m-grand)^2) AS sb FROM g JOIN s USING (p_type) GROUP BY 1),
x AS (SELECT p_type, k, size, sb/(k-1) AS msb, sw/(t-k) AS msw FROM s JOIN b USING (p_type))
SELECT p_type, k AS n_groups, round((msb-msw)/(msb+(size-1)*msw), 6) AS icc, round(msb/msw, 5) AS var_ratio FROM x""")
def icc1(t: Tables) -> DataFrame:
    out = I.icc1(t.part, "p_brand", "p_retailprice", ["p_type"])
    return out.select("p_type", "n_groups", F.round("icc", 6).alias("icc"), F.round("var_ratio", 5).alias("var_ratio"))


@query("spearman", """
WITH c AS (SELECT c_mktsegment, c_custkey, c_acctbal, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS a,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(total), c_custkey) AS b FROM c)
SELECT c_mktsegment, count(*) AS n, round(1 - 6 * sum((a-b)::DOUBLE^2) / (count(*)::DOUBLE * (count(*)::DOUBLE^2 - 1)), 6) AS rho FROM r GROUP BY 1""")
def spearman(t: Tables) -> DataFrame:
    """Account balance against ordered value of every customer, per market segment."""
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    c = t.customer.join(totals, "c_custkey", "left").select(
        "c_mktsegment", "c_custkey", "c_acctbal", F.round(F.coalesce("total", F.lit(0.0))).alias("total"))
    out = I.spearman(c, "c_acctbal", "total", "c_custkey", ["c_mktsegment"])
    return out.select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@query("aa_test", f"""
WITH runs AS (SELECT p_brand AS repo, l_linenumber AS rep, l_discount AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
reps AS (SELECT DISTINCT rep FROM runs),
splits AS (SELECT row_number() OVER (ORDER BY a.rep, b.rep, c.rep) - 1 AS split, a.rep AS a, b.rep AS b, c.rep AS c
  FROM reps a, reps b, reps c WHERE a.rep = (SELECT min(rep) FROM reps) AND a.rep < b.rep AND b.rep < c.rep),
d AS (SELECT split, repo, avg(v) FILTER (rep NOT IN (a, b, c)) - avg(v) FILTER (rep IN (a, b, c)) AS delta FROM runs, splits GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY repo) - 1 AS position, count(*) OVER (PARTITION BY split) AS n FROM d),
draws AS (SELECT split, g.draw, ('0x' || substr(md5(g.draw || ':' || position), 1, 8))::BIGINT % n AS pick
  FROM pos, (SELECT unnest(range({DRAWS})) AS draw) g),
means AS (SELECT split, draw, avg(delta) AS m FROM draws JOIN pos USING (split) WHERE position = pick GROUP BY ALL),
ranked AS (SELECT split, m, row_number() OVER (PARTITION BY split ORDER BY m) - 1 AS r FROM means)
SELECT avg((m > 0)::INT) AS keep_rate, count(*) AS n_splits FROM ranked WHERE r = {_LO}""")
def aa_test(t: Tables) -> DataFrame:
    """Line numbers as replicates of one version: three against the rest."""
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("repo"), F.col("l_linenumber").alias("rep"), F.col("l_discount").alias("q_gain_dir"))
    return I.aa_test(runs, draws=DRAWS)


_SPREAD = """
WITH r AS (SELECT p_brand AS repo, l_returnflag AS f, l_discount AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT avg(sd) AS sd_within, count(*) AS n_repos FROM (SELECT stddev_pop(v) AS sd FROM r WHERE f = 'A' GROUP BY repo HAVING count(*) >= 2)),
d AS (SELECT x.m - y.m AS d, y.n FROM (SELECT repo, avg(v) AS m FROM r WHERE f = 'R' GROUP BY 1) x
  JOIN (SELECT repo, avg(v) AS m, count(*) AS n FROM r WHERE f = 'A' GROUP BY 1) y USING (repo)),
t AS (SELECT sqrt(greatest(var_samp(d) - 2 * (SELECT sd_within FROM w)^2 / avg(n), 0)) AS tau, count(*) AS n_common FROM d)
"""


def _spread(t: Tables) -> DataFrame:
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("repo"), "l_returnflag", F.col("l_discount").alias("q_gain_dir"))
    before, after = runs.where("l_returnflag = 'A'"), runs.where("l_returnflag = 'R'")
    sd = P.within_sd(before)
    tau = P.effect_tau(before, after, sd.select("sd_within").scalar())
    both = sd.unionByName(tau, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("run_spread", _SPREAD + "SELECT round(sd_within, 8) AS sd_within, n_repos, round(tau, 8) AS tau, n_common FROM w, t")
def run_spread(t: Tables) -> DataFrame:
    return _spread(t).select(F.round("sd_within", 8).alias("sd_within"), "n_repos", F.round("tau", 8).alias("tau"), "n_common")


@query("power_plan", _SPREAD + """
, s AS (SELECT *, 1.2815515655446008 + 0.8416212335729143 AS z FROM (SELECT p_type, avg(sd) AS sd_within FROM (
    SELECT p_type, p_brand, stddev_pop(l_discount) AS sd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1))
SELECT p_type, round(sd_within, 8) AS sd_within,
  (SELECT min(n) FROM range(3, 1000) g(n) WHERE 0.02 * sqrt(n) >= z * sqrt(0.02^2 + 2 * sd_within^2 / 3)) AS min_repos,
  greatest(2, coalesce((SELECT min(r) FROM range(1, 21) g(r) WHERE 0.03 >= 2.485 * sd_within * sqrt(2.0 / r) / sqrt(70.0)), 21)) AS replicates FROM s""")
def power_plan(t: Tables) -> DataFrame:
    """Repositories and replicates needed, from the run noise of each part type."""
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_type", F.col("p_brand").alias("repo"), F.col("l_discount").alias("q_gain_dir"))
    sd = P.within_sd(runs, keys=["p_type"])
    return sd.select("p_type", F.round("sd_within", 8).alias("sd_within"),
                     P.min_n(3, "sd_within", 0.02, 0.02, 0.10).alias("min_repos"),
                     P.replicates_needed("sd_within").alias("replicates"))


@query("power_grid", _SPREAD + """
, g AS (SELECT n_repos, reps, 1.2815515655446008 - 0.01 * sqrt(n_repos) / sqrt(0.03^2 + 2 * sd_within^2 / reps) AS x
  FROM (SELECT sd_within FROM w), (SELECT unnest([7, 10, 20, 30, 50, 70, 100]) AS n_repos), (SELECT unnest([1, 2, 3, 5]) AS reps)),
terms AS (SELECT n_repos, reps, x, sum(exp((2*k+1) * ln(abs(x)) - (lgamma(2*k+2) - k*ln(2) - lgamma(k+1)))) AS s
  FROM g, range(0, 100) r(k) GROUP BY ALL)
SELECT n_repos, reps, round(1 - (0.5 + sign(x) * exp(-x*x/2) / sqrt(2*pi()) * s), 6) AS power FROM terms""")
def power_grid(t: Tables) -> DataFrame:
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where("l_returnflag = 'A'").select(
        F.col("p_brand").alias("repo"), F.col("l_discount").alias("q_gain_dir"))
    grid = P.power_grid(P.within_sd(runs).select("sd_within"), tau=0.03, delta=0.01)
    return grid.select("n_repos", "reps", F.round("power", 6).alias("power"))
