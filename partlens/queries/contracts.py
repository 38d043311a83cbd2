"""Coverage and contract queries on structural analogues in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import exclusion
from ..operators.keyed import last_wins as keep_last
from .registry import Tables, query

# ---- coverage: a repository is a top-level domain, a file is a url path -----------------

_PATHS = r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]*\.([a-z]+)/', 1) AS repo,
  regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS path FROM pages),
files AS (SELECT DISTINCT repo, path FROM u),
rules AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS path FROM u WHERE contains(url, '#top') AND contains(url, '//blog')
  UNION SELECT repo, path FROM u WHERE contains(url, '?page') UNION SELECT repo, 'xx/' FROM u),
scope AS (SELECT f.* FROM files f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.repo = f.repo AND
  (f.path = r.path OR starts_with(f.path, rtrim(r.path, '/') || '/'))))
"""


def _pages(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", "url", F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)/", 1).alias("repo"),
        F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "").alias("path"))


def _rules(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Files, and the rules of what is left out."""
    u = _pages(t)
    rules = (
        u.where(F.col("url").contains("#top") & F.col("url").contains("//blog"))
        .select("repo", F.split("path", "/")[0].alias("path"))
        .unionByName(u.where(F.col("url").contains("?page")).select("repo", "path"))
        .unionByName(u.select("repo", F.lit("xx/").alias("path")))
    )
    return u.select("repo", "path").distinct(), rules


@query("exclusion_prefix", _PATHS + "SELECT repo, path FROM scope")
def exclusion_prefix(t: Tables) -> DataFrame:
    return C.in_scope(*_rules(t), ["repo"]).select("repo", "path")


@query("coverage", _PATHS + """
SELECT s.repo, round(avg((o.path IS NOT NULL)::INT), 6) AS coverage, count(*) AS n_in_scope
FROM scope s LEFT JOIN (SELECT DISTINCT repo, path FROM u WHERE starts_with(url, 'https:')) o USING (repo, path) GROUP BY 1""")
def coverage(t: Tables) -> DataFrame:
    files, rules = _rules(t)
    owned = _pages(t).where(F.col("url").startswith("https:")).select(
        "repo", "path", F.split("path", "/")[0].alias("unit"), F.col("page_id").alias("pos"))
    out = exclusion.coverage(files, files, C.owners(owned, ["repo"]), rules, ["repo"], ["repo"])
    return out.select("repo", F.round("coverage", 6).alias("coverage"), "n_in_scope")


# ---- units: (brand, size) groups of parts ------------------------------------------------


@query("singleton_trivial", """
WITH u AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, count(*) AS n_units, sum(n)::BIGINT AS n_owned, round(avg((n <= 1)::INT), 6) AS singleton_frac,
  (count(*) <= 1 OR (sum(n) > 3 AND count(*) >= 0.8 * sum(n))) AS is_trivial FROM u GROUP BY 1""")
def singleton_trivial(t: Tables) -> DataFrame:
    units = t.part.groupBy("p_type", "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    out = units.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_owned"),
        F.round(F.avg((F.col("n") <= 1).cast("int")), 6).alias("singleton_frac"))
    return out.withColumn("is_trivial", C.is_trivial("n_units", "n_owned"))


@query("last_wins", """
SELECT l_orderkey, l_linenumber, arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey)) AS unit
FROM lineitem GROUP BY ALL""")
def last_wins(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_suppkey", "unit").withColumn("tie", F.col("unit"))
    return keep_last(rows, ["l_orderkey", "l_linenumber"], "unit", "l_shipdate", "l_partkey", "tie")


# ---- dependencies and contracts ------------------------------------------------------------


@query("edge_resolution", """
WITH l AS (SELECT o_orderpriority AS run, l_returnflag AS f, p_brand AS unit, p_type AS entrypoint, s_nationkey AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
listed AS (SELECT DISTINCT run, unit || ':' || n AS unit, entrypoint FROM l WHERE f = 'A'),
dep AS (SELECT run, unit || ':' || n AS unit, entrypoint FROM l WHERE f = 'R')
SELECT run, round(avg((listed.unit IS NOT NULL)::INT), 6) AS edge_resolution
FROM dep LEFT JOIN listed USING (run, unit, entrypoint) GROUP BY 1""")
def edge_resolution(t: Tables) -> DataFrame:
    """Types returned per (brand, nation), resolved against the types accepted there."""
    l = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("o_orderpriority").alias("run"), "l_returnflag",
                F.concat_ws(":", "p_brand", "s_nationkey").alias("unit"), F.col("p_type").alias("name"))
    )
    depends = l.where("l_returnflag = 'R'").withColumnRenamed("name", "entrypoint")
    out = C.edge_resolution(depends, l.where("l_returnflag = 'A'"), ["run"])
    return out.select("run", F.round("edge_resolution", 6).alias("edge_resolution"))


_SETS = """
WITH l AS (SELECT l_suppkey, l_returnflag AS f, p_brand || ':' || p_size AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT DISTINCT l_suppkey, value FROM l WHERE f = 'R'), a AS (SELECT DISTINCT l_suppkey, value FROM l WHERE f = 'A')
"""


def _brand_sets(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_suppkey", "l_returnflag", F.concat_ws(":", "p_brand", "p_size").alias("value"))
    units = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"))
    return l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), units


@query("precision_recall", _SETS + """
, m AS (SELECT l_suppkey, count(*) AS n_match FROM c JOIN a USING (l_suppkey, value) GROUP BY 1),
nc AS (SELECT l_suppkey, count(*) AS n_claimed FROM c GROUP BY 1), na AS (SELECT l_suppkey, count(*) AS n_actual FROM a GROUP BY 1),
j AS (SELECT s_suppkey AS l_suppkey, coalesce(n_claimed, 0) AS n_claimed, coalesce(n_actual, 0) AS n_actual, coalesce(n_match, 0) AS n_match
  FROM supplier LEFT JOIN nc ON nc.l_suppkey = s_suppkey LEFT JOIN na ON na.l_suppkey = s_suppkey LEFT JOIN m ON m.l_suppkey = s_suppkey)
SELECT *, n_actual - n_match AS n_missed, n_claimed - n_match AS n_spurious,
  n_match / nullif(n_claimed, 0)::DOUBLE AS precision, n_match / nullif(n_actual, 0)::DOUBLE AS recall FROM j""")
def precision_recall(t: Tables) -> DataFrame:
    return C.precision_recall(*_brand_sets(t), ["l_suppkey"])


@query("contract_differences", _SETS + """
SELECT l_suppkey, 'missed' AS side, value FROM (SELECT * FROM a EXCEPT SELECT * FROM c)
UNION ALL SELECT l_suppkey, 'spurious', value FROM (SELECT * FROM c EXCEPT SELECT * FROM a)""")
def contract_differences(t: Tables) -> DataFrame:
    claimed, actual, _ = _brand_sets(t)
    return C.differences(claimed, actual, ["l_suppkey"])


_REFS = """
WITH refs AS (
  SELECT DISTINCT o_orderpriority AS g, 'c' || o_custkey AS src, 's' || l_suppkey AS dst, p_size::VARCHAR AS symbol
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
files AS (SELECT 's' || s_suppkey AS path, 'n' || s_nationkey AS unit FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_acctbal >= 0),
surface AS (SELECT DISTINCT o_orderpriority AS g, 'c' || o_custkey AS path, o_orderstatus AS symbol FROM orders WHERE o_totalprice > 450000),
actual AS (
  SELECT DISTINCT r.g, t.unit, r.symbol AS value FROM refs r JOIN files t ON t.path = r.dst
  LEFT JOIN files s ON s.path = r.src WHERE s.unit IS DISTINCT FROM t.unit
  UNION SELECT DISTINCT g, unit, symbol FROM surface JOIN files USING (path)),
claimed AS (SELECT DISTINCT o_orderpriority AS g, 'n' || s_nationkey AS unit, p_size::VARCHAR AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 49)
"""


def _entrypoint_inputs(t: Tables) -> dict[str, DataFrame]:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    orders = t.orders.withColumnRenamed("o_orderpriority", "g")
    supplier = lambda c: F.concat(F.lit("s"), F.col(c))
    customer = lambda c: F.concat(F.lit("c"), F.col(c))
    nation = lambda c: F.concat(F.lit("n"), F.col(c))
    files = t.supplier.select(supplier("s_suppkey").alias("path"), nation("s_nationkey").alias("unit")).unionByName(
        t.customer.where("c_acctbal >= 0").select(customer("c_custkey").alias("path"), nation("c_nationkey").alias("unit")))
    # a priority names a graph; the list of them is one value of the orders
    graphs = t.orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("g"))
    unit_files = files.withColumn("g", F.explode(graphs.scalar()))
    # the source of a line is its order's customer: looked up once an order, and equal lines are not gathered first
    sourced = C.with_source_units(orders.select("g", "o_orderkey", customer("o_custkey").alias("src")), unit_files, ["g"])
    return {
        "unit_files": unit_files,
        "refs": lines.join(sourced, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "g", "src", "src_unit", supplier("l_suppkey").alias("dst"), F.col("p_size").cast("string").alias("symbol")),
        "surface": t.orders.where("o_totalprice > 450000").select(
            F.col("o_orderpriority").alias("g"), customer("o_custkey").alias("path"),
            F.col("o_orderstatus").alias("symbol")).distinct(),
        "listed": lines.where("l_quantity >= 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "g", nation("s_nationkey").alias("unit"), F.concat_ws(".", F.lit("size"), "p_size").alias("name")),
    }


@query("true_entrypoints", _REFS + "SELECT g, unit, value FROM actual")
def true_entrypoints(t: Tables) -> DataFrame:
    """Part kinds ordered from a nation's suppliers by customers outside that nation."""
    d = _entrypoint_inputs(t)
    return C.true_entrypoints(d["unit_files"], d["unit_files"], d["refs"], d["surface"], ["g"], ["g"])


@query("unit_contracts", _REFS + """
, eff AS (SELECT DISTINCT o_orderpriority AS g, 'n' || s_nationkey AS unit, l_linestatus || l_returnflag AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount >= 0.1),
decl AS (SELECT DISTINCT o_orderpriority AS g, 'n' || s_nationkey AS unit, l_linestatus || l_returnflag AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_tax >= 0.08 AND l_quantity < 20),
units AS (SELECT DISTINCT o_orderpriority AS g, unit FROM orders, files),
v AS (SELECT g, unit, 'ep' AS k, value, 1 AS c, 0 AS a FROM claimed UNION ALL SELECT g, unit, 'ep', value, 0, 1 FROM actual
  UNION ALL SELECT g, unit, 'ef', value, 1, 0 FROM decl UNION ALL SELECT g, unit, 'ef', value, 0, 1 FROM eff),
p AS (SELECT g, unit, k, value, max(c) AS c, max(a) AS a FROM v GROUP BY ALL),
n AS (SELECT g, unit, k, sum(c) AS c, sum(a) AS a, sum(c * a) AS b FROM p GROUP BY ALL)
SELECT u.g, u.unit, round(e.b / nullif(e.c, 0)::DOUBLE, 6) AS entrypoint_p, round(e.b / nullif(e.a, 0)::DOUBLE, 6) AS entrypoint_r,
  round(f.b / nullif(f.c, 0)::DOUBLE, 6) AS effects_p, round(f.b / nullif(f.a, 0)::DOUBLE, 6) AS effects_r,
  coalesce(e.a - e.b, 0)::BIGINT AS n_missed_entrypoints, coalesce(f.a - f.b, 0)::BIGINT AS n_undeclared_effects
FROM units u LEFT JOIN n e ON e.g = u.g AND e.unit = u.unit AND e.k = 'ep' LEFT JOIN n f ON f.g = u.g AND f.unit = u.unit AND f.k = 'ef'""")
def unit_contracts(t: Tables) -> DataFrame:
    """Precision and recall per nation; an entrypoint is cut to its last dotted segment."""
    d = _entrypoint_inputs(t)
    kinds = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_orderpriority", "g")
    kind = F.concat("l_linestatus", "l_returnflag").alias("kind")
    effects = kinds.where("l_discount >= 0.1").select("g", F.concat(F.lit("s"), "l_suppkey").alias("path"), kind).distinct()
    declared = kinds.where("l_tax >= 0.08 AND l_quantity < 20").join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("g", F.concat(F.lit("n"), "s_nationkey").alias("unit"), kind)
    values = C.contract_values(d["unit_files"], d["unit_files"], d["listed"], declared, d["refs"], d["surface"], effects, ["g"], ["g"])
    out = C.unit_contracts(d["unit_files"].select("g", "unit").distinct(), values, ["g"])
    names = ("entrypoint_p", "entrypoint_r", "effects_p", "effects_r")
    return out.select("g", "unit", *[F.round(n, 6).alias(n) for n in names], "n_missed_entrypoints", "n_undeclared_effects")


@query("run_flags", """
WITH e AS (SELECT event_type, CASE WHEN event_type = 'error' THEN
    CASE WHEN value > 40 THEN 'error_max_turns' WHEN value > 20 THEN 'error_during_execution' ELSE 'success' END ELSE 'success' END AS subtype,
  CASE WHEN value > 90 THEN 'hit max_turns' WHEN value < 1 THEN 'over budget' END AS reason, value FROM events)
SELECT event_type, count(*) FILTER (subtype IN ('error_max_turns', 'error_max_budget_usd') OR coalesce(contains(reason, 'max_turns'), false)
    OR coalesce(contains(reason, 'budget'), false)) AS n_exhausted,
  count(*) FILTER (starts_with(subtype, 'error_') OR value > 100) AS n_error, count(*) AS n FROM e GROUP BY 1""")
def run_flags(t: Tables) -> DataFrame:
    """How runs ended: budget exhausted and run error, from end state only."""
    v = F.col("value")
    e = t.events.select(
        "event_type",
        F.when(F.col("event_type") == "error", F.when(v > 40, "error_max_turns").when(v > 20, "error_during_execution")
               .otherwise("success")).otherwise("success").alias("subtype"),
        F.when(v > 90, "hit max_turns").when(v < 1, "over budget").alias("terminal_reason"), (v > 100).alias("is_error"))
    return e.groupBy("event_type").agg(
        F.count_if(C.budget_exhausted("subtype", "terminal_reason")).alias("n_exhausted"),
        F.count_if(C.run_error("subtype", "is_error")).alias("n_error"), F.count(F.lit(1)).alias("n"))
