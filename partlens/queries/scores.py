"""Whole score records: suppliers are files, part types are units, return flags are runs.

A region is a repository and a nation a directory. Suppliers of one region that appear in
the same order are linked. In a run (a return flag) a supplier belongs to the part type it
ships most under that flag; PROMO suppliers are left unowned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import graph
from ..plans import score
from ..plans.code_graph import CodeGraph
from ..session import materialize, write_table
from .registry import Tables, query

GK, RK = list(schemas.GRAPH_KEY), list(schemas.RUN_KEY)
CAP = 8
#: Orders of one commit in the history that co-change is read from.
COMMIT_ORDERS = 16

_SCORE = """
WITH s AS (SELECT s_suppkey, 'r' || n_regionkey AS repo, 'n' || s_nationkey AS dir, 'n' || s_nationkey || '/s' || s_suppkey || '.py' AS path, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT s.*, l_orderkey, l_returnflag AS rep, p_type, p_brand, l_quantity, l_tax, l_linenumber FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
sized AS (SELECT repo, l_orderkey FROM l GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8),
items AS (SELECT DISTINCT repo, l_orderkey, path FROM l JOIN sized USING (repo, l_orderkey)),
edges AS (SELECT DISTINCT x.repo, x.path AS a, y.path AS b FROM items x JOIN items y ON x.repo = y.repo AND x.l_orderkey = y.l_orderkey AND x.path < y.path),
votes AS (SELECT repo, rep, path, p_type, count(*) AS n FROM l GROUP BY ALL),
best AS (SELECT repo, rep, path, p_type AS unit FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, rep, path ORDER BY n DESC, p_type) AS i FROM votes) WHERE i = 1),
owner AS (SELECT * FROM best WHERE unit <> 'PROMO'),
runs AS (SELECT DISTINCT repo, rep FROM l),
units AS (SELECT repo, rep, unit, count(*) AS n_files FROM owner GROUP BY ALL),
counts AS (SELECT repo, rep, count(*) AS n_units, avg((n_files <= 1)::INT) AS singleton, sum(n_files) AS n_owned FROM units GROUP BY ALL),
cover AS (SELECT r.repo, r.rep, avg((o.path IS NOT NULL)::INT) AS coverage FROM runs r JOIN s ON s.repo = r.repo AND s.dir <> 'n3'
  LEFT JOIN owner o ON o.repo = r.repo AND o.rep = r.rep AND o.path = s.path GROUP BY ALL),
ends AS (SELECT repo, a AS path FROM edges UNION ALL SELECT repo, b FROM edges),
deg AS (SELECT repo, path, count(*)::DOUBLE AS d FROM ends GROUP BY ALL),
m AS (SELECT repo, sum(d) AS m2 FROM deg GROUP BY 1),
qd AS (SELECT repo, (SELECT count(*) FROM edges e JOIN s x ON x.path = e.a JOIN s y ON y.path = e.b WHERE e.repo = m.repo AND x.dir = y.dir) * 2 / m2
  - (SELECT sum(d * d) FROM (SELECT sum(d) AS d FROM deg JOIN s USING (repo, path) WHERE deg.repo = m.repo GROUP BY s.dir)) / (m2 * m2) AS q_dir FROM m),
sq AS (SELECT repo, rep, sum(d * d) AS v FROM (SELECT repo, rep, unit, sum(d) AS d FROM deg JOIN owner USING (repo, path) GROUP BY ALL) GROUP BY ALL),
ins AS (SELECT x.repo, x.rep, count(*) AS w FROM edges e JOIN owner x ON x.repo = e.repo AND x.path = e.a
  JOIN owner y ON y.repo = e.repo AND y.rep = x.rep AND y.path = e.b AND y.unit = x.unit GROUP BY ALL),
q AS (SELECT sq.repo, sq.rep, 2 * coalesce(w, 0) / m2 - v / (m2 * m2) AS q_llm FROM sq JOIN m USING (repo) LEFT JOIN ins USING (repo, rep)),
listed AS (SELECT DISTINCT o.repo, o.rep, o.unit, l.p_brand AS value FROM l JOIN owner o USING (repo, rep, path) WHERE l_quantity >= 47),
dep AS (SELECT o.repo, o.rep, o.unit, l.p_brand AS entrypoint FROM l JOIN owner o USING (repo, rep, path) WHERE l_tax >= 0.08),
res AS (SELECT d.repo, d.rep, avg((k.value IS NOT NULL)::INT) AS edge_resolution FROM dep d LEFT JOIN listed k
  ON k.repo = d.repo AND k.rep = d.rep AND k.unit = d.unit AND k.value = d.entrypoint GROUP BY ALL),
refs AS (SELECT repo, a AS src, b AS dst, 'Brand#' || (1 + length(a || b) + (SELECT count(*) FROM deg x WHERE x.repo = edges.repo) % 7) AS symbol FROM edges),
act AS (SELECT DISTINCT t.repo, t.rep, t.unit, symbol AS value FROM refs JOIN owner t ON t.repo = refs.repo AND t.path = refs.dst
  LEFT JOIN owner x ON x.repo = refs.repo AND x.rep = t.rep AND x.path = refs.src WHERE x.unit IS DISTINCT FROM t.unit),
eff AS (SELECT DISTINCT repo, rep, unit, 'env' AS value FROM owner JOIN s USING (repo, path) WHERE s_acctbal < 0),
v AS (SELECT repo, rep, unit, 'ep' AS k, value, 1 AS c, 0 AS a FROM listed UNION ALL SELECT repo, rep, unit, 'ep', value, 0, 1 FROM act
  UNION ALL SELECT repo, rep, unit, 'ef', 'env', 1, 0 FROM units UNION ALL SELECT repo, rep, unit, 'ef', value, 0, 1 FROM eff),
p AS (SELECT repo, rep, unit, k, value, max(c) AS c, max(a) AS a FROM v GROUP BY ALL),
u AS (SELECT repo, rep, unit, k, sum(c * a) / nullif(sum(a), 0)::DOUBLE AS r, sum(a) - sum(c * a) AS missed FROM p GROUP BY ALL),
con AS (SELECT repo, rep, avg(r) FILTER (k = 'ep') AS ep_r, avg(r) FILTER (k = 'ef') AS ef_r, count(*) FILTER (k = 'ep' AND missed > 0) AS n_missed FROM u GROUP BY ALL)
"""

_VECTOR = """
SELECT repo, rep, coalesce(n_units, 0) AS n_units, round(coalesce(coverage, 0), 3) AS coverage, round(singleton, 3) AS singleton_unit_frac,
  round(coalesce(edge_resolution, 1), 3) AS edge_resolution, round(coalesce(q_llm, 0), 4) AS q_llm, round(coalesce(q_dir, 0), 4) AS q_dir,
  round(coalesce(q_llm, 0) - greatest(0, coalesce(q_dir, 0)), 4) AS q_gain_dir, round(ep_r, 4) AS entrypoint_r, round(ef_r, 4) AS effects_r,
  n_missed AS units_with_missed_entrypoints, coalesce(coverage, 0) >= 0.95 AND coalesce(edge_resolution, 1) >= 0.9
    AND NOT (coalesce(n_units, 0) <= 1 OR n_owned > 3 AND n_units >= 0.8 * n_owned) AS valid_nontrivial
FROM runs LEFT JOIN counts USING (repo, rep) LEFT JOIN cover USING (repo, rep) LEFT JOIN q USING (repo, rep) LEFT JOIN qd USING (repo)
LEFT JOIN res USING (repo, rep) LEFT JOIN con USING (repo, rep)
"""


def _scored(t: Tables, results: bool = False) -> DataFrame:
    """Score records of the runs; with ``results`` also of what is recorded beside the manifests."""
    files = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.lit("s").alias("sha"), "s_suppkey", "s_acctbal",
        F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit(".py")).alias("path"))
    joined = t.lineitem.join(files, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("label", F.lit("v1")).withColumnRenamed("l_returnflag", "rep")
    # joined once: a dozen tables are made of these rows, each of a few of the columns
    lines = write_table(joined.select(*RK, "path", "l_orderkey", "p_type", "p_brand", "l_quantity", "l_tax", "l_linenumber"))
    edges = materialize(graph.cochange_edges(lines, GK, "l_orderkey", "path", CAP).select(
        *GK, F.col("a").alias("src"), F.col("b").alias("dst")))

    owner = materialize(
        lines.groupBy(*RK, "path", "p_type").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*RK, "path").agg(F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type"))).alias("unit"))
        .where("unit <> 'PROMO'"))
    units = owner.groupBy(*RK, "unit").agg(F.count(F.lit(1)).alias("n_files"))
    placed = lines.join(owner, [*RK, "path"])
    n_nodes = edges.select(*GK, F.explode(F.array("src", "dst")).alias("n")).groupBy(*GK).agg(F.count_distinct("n").alias("n"))
    symbol = F.concat(F.lit("Brand#"), 1 + F.length("src") + F.length("dst") + F.col("n") % 7)
    code = CodeGraph(
        edges=edges, refs=edges.join(n_nodes, GK).select(*GK, "src", "dst", symbol.alias("symbol")),
        surface=edges.select(*GK, F.col("src").alias("path"), F.lit("x").alias("symbol")).where("path IS NULL"),
        effects=files.where("s_acctbal < 0").select(*GK, "path", F.lit("env").alias("kind")), source="tables")
    manifest = {
        "units": units, "unit_files": owner.withColumn("pos", F.lit(0)),
        "listed": placed.where("l_quantity >= 47").select(*RK, "unit", F.col("p_brand").alias("name")),
        "depends": placed.where("l_tax >= 0.08").select(*RK, "unit", F.col("p_brand").alias("entrypoint")),
        "declared": units.select(*RK, "unit", F.lit("env").alias("kind")),
        "excluded": lines.select(*RK, F.lit("n3").alias("path")).distinct(),
    }
    if not results:
        runs = lines.select(*RK).distinct().withColumn("unpartitioned", F.lit(0))
        ended = runs.select(*RK, *[F.lit("success" if k == "subtype" else None).cast(kind).alias(k) for k, kind in schemas.RESULT.items()])
        return score.score_tables(runs, manifest, ended, files, code, ceiling=False)[0]
    rep = F.col("rep")
    runs = lines.groupBy(*RK).agg(F.count_if(F.col("l_tax") == 0).alias("unpartitioned"))
    usage = F.struct(F.sum("l_linenumber").alias("input_tokens"), F.count("*").alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_input_tokens"),
                     F.lit(None).cast("long").alias("cache_creation_input_tokens"))
    ended = lines.groupBy(*RK).agg(
        (F.count("*") / 1000).alias("total_cost_usd"), F.count("*").cast("int").alias("num_turns"), F.sum("l_linenumber").alias("duration_ms"), usage.alias("usage")).withColumns({
            "subtype": F.when(rep == "R", "error_max_turns").when(rep == "N", "error_during_execution").otherwise("success"),
            "terminal_reason": F.when((rep == "A") & (F.col("repo") == "r0"), "stopped by budget"),
            "is_error": F.lit(False), "session_id": F.lit(None).cast("string")})
    lint = lines.groupBy(*RK).agg(F.count_distinct("l_linenumber").cast("int").alias("lint_rounds"))
    commits = lines.select(*GK, F.floor(F.col("l_orderkey") / COMMIT_ORDERS).alias("commit"), "path", (-F.floor(F.col("l_orderkey") / COMMIT_ORDERS)).alias("age"))
    number = F.col("s_suppkey")
    listing = F.array(F.struct(F.concat(F.lit("g"), F.col("nation") % 3).alias("unit"), F.lit(0).alias("pos")),
                      F.struct(F.when(number % 5 == 0, F.concat(F.lit("a"), number % 2)).alias("unit"), F.lit(1).alias("pos")))
    gold = files.withColumn("nation", F.substring_index(F.substring("path", 2, 9), "/", 1).cast("int")).select(
        "repo", "path", F.explode(listing).alias("l")).select("repo", "path", "l.*").where("unit IS NOT NULL")
    return score.score_tables(runs, manifest, ended, files, code, lint, commits, gold, ceiling=False)[0]


@query("score_vector", _SCORE + _VECTOR)
def score_vector(t: Tables) -> DataFrame:
    return _scored(t).select("repo", "rep", "n_units", "coverage", "singleton_unit_frac", "edge_resolution", "q_llm", "q_dir",
                             "q_gain_dir", "entrypoint_r", "effects_r", "units_with_missed_entrypoints", "valid_nontrivial")


_FIELDS = f"""
, ran AS (SELECT repo, rep, count(*) AS turns, sum(l_linenumber)::BIGINT AS duration_ms, count(DISTINCT l_linenumber) AS lint_rounds, count(*) FILTER (l_tax = 0) AS unpartitioned,
    rep = 'R' OR (rep = 'A' AND repo = 'r0') AS budget_exhausted, rep <> 'A' AS run_error,
    CASE rep WHEN 'R' THEN 'error_max_turns' WHEN 'N' THEN 'error_during_execution' ELSE 'success' END AS result_subtype
  FROM l GROUP BY repo, rep),
c AS (SELECT repo, path, l_orderkey // {COMMIT_ORDERS} AS commit FROM l),
recent AS (SELECT repo, commit FROM (SELECT repo, commit, row_number() OVER (PARTITION BY repo ORDER BY commit DESC) AS i FROM c GROUP BY repo, commit) WHERE i <= 2000),
csized AS (SELECT repo, commit FROM c JOIN recent USING (repo, commit) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20),
citems AS (SELECT DISTINCT repo, commit, path FROM c JOIN csized USING (repo, commit)),
ce AS (SELECT x.repo, x.path AS a, y.path AS b, count(*)::DOUBLE AS w FROM citems x JOIN citems y ON x.repo = y.repo AND x.commit = y.commit AND x.path < y.path GROUP BY ALL),
cdeg AS (SELECT repo, path, sum(w) AS d FROM (SELECT repo, a AS path, w FROM ce UNION ALL SELECT repo, b, w FROM ce) GROUP BY ALL),
cm AS (SELECT repo, sum(d) AS m2 FROM cdeg GROUP BY 1),
cdir AS (SELECT cm.repo, coalesce(max(i.w), 0) * 2 / max(m2) - max(v.v) / (max(m2) * max(m2)) AS q FROM cm
  LEFT JOIN (SELECT ce.repo, sum(w) AS w FROM ce JOIN s x ON x.path = ce.a JOIN s y ON y.path = ce.b WHERE x.dir = y.dir GROUP BY 1) i USING (repo)
  JOIN (SELECT repo, sum(d * d) AS v FROM (SELECT repo, dir, sum(d) AS d FROM cdeg JOIN s USING (repo, path) GROUP BY ALL) GROUP BY 1) v USING (repo) GROUP BY 1),
cllm AS (SELECT v.repo, v.rep, 2 * coalesce(i.w, 0) / m2 - v.v / (m2 * m2) AS q FROM
  (SELECT repo, rep, sum(d * d) AS v FROM (SELECT repo, rep, unit, sum(d) AS d FROM cdeg JOIN owner USING (repo, path) GROUP BY ALL) GROUP BY ALL) v JOIN cm USING (repo)
  LEFT JOIN (SELECT x.repo, x.rep, sum(w) AS w FROM ce JOIN owner x ON x.repo = ce.repo AND x.path = ce.a JOIN owner y ON y.repo = ce.repo AND y.rep = x.rep AND y.path = ce.b AND y.unit = x.unit
    GROUP BY ALL) i USING (repo, rep)),
g AS (SELECT o.repo, o.rep, o.unit AS c1, CASE WHEN s_suppkey % 5 = 0 THEN 'a' || (s_suppkey % 2) ELSE 'g' || (dir[2:]::INT % 3) END AS c2 FROM owner o JOIN s USING (repo, path)),
cell AS (SELECT repo, rep, c1, c2, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
r1 AS (SELECT repo, rep, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM (SELECT repo, rep, c1, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
r2 AS (SELECT repo, rep, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM (SELECT repo, rep, c2, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
rc AS (SELECT repo, rep, sum(n) AS n, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM cell GROUP BY ALL),
gold AS (SELECT repo, rep, CASE WHEN rc.n < 2 THEN NULL WHEN (r1.s + r2.s) / 2 = r1.s * r2.s / (rc.n * (rc.n - 1) / 2) THEN 1.0
    ELSE (rc.s - r1.s * r2.s / (rc.n * (rc.n - 1) / 2)) / ((r1.s + r2.s) / 2 - r1.s * r2.s / (rc.n * (rc.n - 1) / 2)) END AS ari,
  CASE WHEN (2 * ln(rc.n) - r1.l / rc.n - r2.l / rc.n) / 2 < 1e-12 THEN 1.0
    ELSE (ln(rc.n) - r1.l / rc.n - r2.l / rc.n + rc.l / rc.n) / ((2 * ln(rc.n) - r1.l / rc.n - r2.l / rc.n) / 2) END AS nmi
  FROM rc JOIN r1 USING (repo, rep) JOIN r2 USING (repo, rep)),
pr AS (SELECT repo, rep, avg(r) FILTER (k = 'ep') AS ep_p, avg(r) FILTER (k = 'ef') AS ef_p FROM
  (SELECT repo, rep, unit, k, sum(c * a) / nullif(sum(c), 0)::DOUBLE AS r FROM p GROUP BY ALL) GROUP BY ALL),
und AS (SELECT repo, rep, count(*) FILTER (k = 'ef' AND missed > 0) AS n_undeclared FROM u GROUP BY ALL)
SELECT repo, rep, coalesce(n_units, 0) <= 1 OR n_owned > 3 AND n_units >= 0.8 * n_owned AS trivial, budget_exhausted, run_error, result_subtype, unpartitioned, lint_rounds,
  round(turns / 1000.0, 3) AS cost_usd, turns, duration_ms, duration_ms AS input_tokens, turns AS output_tokens, 0.0::DOUBLE AS q_one, 'tables' AS graph_source,
  round(cllm.q, 4) AS q_cochange_llm, round(cllm.q - greatest(0, cdir.q), 4) AS q_cochange_gain, round(ari, 4) AS gold_ari, round(nmi, 4) AS gold_nmi,
  round(ep_p, 4) AS entrypoint_p, round(ef_p, 4) AS effects_p, n_undeclared AS units_with_undeclared_effects,
  round_even(((coalesce(round(ep_r, 4), 0) + coalesce(round(ef_r, 4), 0)) / nullif((ep_r IS NOT NULL)::INT + (ef_r IS NOT NULL)::INT, 0))::DECIMAL(12, 6), 4)::DOUBLE AS contract_r,
  coalesce(coverage, 0) >= 0.95 AND coalesce(edge_resolution, 1) >= 0.9 AND NOT budget_exhausted
    AND NOT (coalesce(n_units, 0) <= 1 OR n_owned > 3 AND n_units >= 0.8 * n_owned) AS valid_nontrivial
FROM ran LEFT JOIN counts USING (repo, rep) LEFT JOIN cover USING (repo, rep) LEFT JOIN res USING (repo, rep) LEFT JOIN con USING (repo, rep)
LEFT JOIN cllm USING (repo, rep) LEFT JOIN cdir USING (repo) LEFT JOIN gold USING (repo, rep) LEFT JOIN pr USING (repo, rep) LEFT JOIN und USING (repo, rep)
"""


@query("score_fields", _SCORE + _FIELDS)
def score_fields(t: Tables) -> DataFrame:
    """What a record holds beside ``score_vector``: how the run ended, co-change at the full cap, gold agreement, precision, contract."""
    return _scored(t, results=True).select(
        "repo", "rep", "trivial", "budget_exhausted", "run_error", "result_subtype", "unpartitioned", "lint_rounds", F.round("cost_usd", 3).alias("cost_usd"), "turns", "duration_ms",
        "input_tokens", "output_tokens", "q_one", "graph_source", "q_cochange_llm", "q_cochange_gain", "gold_ari", "gold_nmi", "entrypoint_p", "effects_p",
        "units_with_undeclared_effects", "contract_r", "valid_nontrivial")
