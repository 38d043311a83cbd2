"""Agreement of partitions: parts by brand against parts by type, within each size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement as A
from .registry import Tables, query

K = ["p_size"]


def _by(t: Tables, column: str) -> DataFrame:
    return t.part.select("p_size", F.col("p_partkey").alias("item"), F.col(column).alias("community"))


_CELLS = """
WITH cells AS (SELECT p_size, p_brand AS c1, p_type AS c2, count(*)::DOUBLE AS n FROM part GROUP BY ALL),
m1 AS (SELECT p_size, c1, sum(n) AS n FROM cells GROUP BY ALL),
m2 AS (SELECT p_size, c2, sum(n) AS n FROM cells GROUP BY ALL)
"""


@query("contingency", _CELLS + "SELECT p_size, c1, c2, n::BIGINT AS n FROM cells")
def contingency(t: Tables) -> DataFrame:
    return A.contingency(_by(t, "p_brand"), _by(t, "p_type"), K)


@query("ari_nmi", _CELLS + """
, tot AS (SELECT p_size, sum(n) AS n, sum(n*(n-1)/2) AS s FROM cells GROUP BY 1),
s1 AS (SELECT p_size, sum(n*(n-1)/2) AS s FROM m1 GROUP BY 1),
s2 AS (SELECT p_size, sum(n*(n-1)/2) AS s FROM m2 GROUP BY 1),
h1 AS (SELECT p_size, -sum(m1.n/tot.n*ln(m1.n/tot.n)) AS h FROM m1 JOIN tot USING (p_size) GROUP BY 1),
h2 AS (SELECT p_size, -sum(m2.n/tot.n*ln(m2.n/tot.n)) AS h FROM m2 JOIN tot USING (p_size) GROUP BY 1),
mi AS (SELECT cells.p_size, sum(cells.n/tot.n*ln((cells.n/tot.n)/((m1.n/tot.n)*(m2.n/tot.n)))) AS i
  FROM cells JOIN tot USING (p_size) JOIN m1 USING (p_size, c1) JOIN m2 USING (p_size, c2) GROUP BY 1)
SELECT p_size, tot.n::BIGINT AS n_items,
  CASE WHEN tot.n < 2 THEN NULL WHEN (s1.s+s2.s)/2 = s1.s*s2.s/(tot.n*(tot.n-1)/2) THEN 1.0
    ELSE round((tot.s - s1.s*s2.s/(tot.n*(tot.n-1)/2)) / ((s1.s+s2.s)/2 - s1.s*s2.s/(tot.n*(tot.n-1)/2)), 6) END AS ari,
  CASE WHEN (h1.h+h2.h)/2 < 1e-12 THEN 1.0 ELSE round(mi.i / ((h1.h+h2.h)/2), 6) END AS nmi
FROM tot JOIN s1 USING (p_size) JOIN s2 USING (p_size) JOIN h1 USING (p_size) JOIN h2 USING (p_size) JOIN mi USING (p_size)""")
def ari_nmi(t: Tables) -> DataFrame:
    out = A.agreement(A.contingency(_by(t, "p_brand"), _by(t, "p_type"), K), K)
    return out.select(*K, "n_items", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


@query("embedding_agreement", """
WITH v AS (SELECT label AS c1, (embedding[1] >= 0)::INT * 2 + (embedding[2] >= 0)::INT AS c2 FROM embeddings),
cells AS (SELECT c1, c2, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
m1 AS (SELECT c1, sum(n) AS n FROM cells GROUP BY 1), m2 AS (SELECT c2, sum(n) AS n FROM cells GROUP BY 1),
t AS (SELECT (SELECT sum(n) FROM cells) AS n, (SELECT sum(n*(n-1)/2) FROM cells) AS s,
  (SELECT sum(n*(n-1)/2) FROM m1) AS s1, (SELECT sum(n*(n-1)/2) FROM m2) AS s2)
SELECT n::BIGINT AS n_items, round((s - s1*s2/(n*(n-1)/2)) / ((s1+s2)/2 - s1*s2/(n*(n-1)/2)), 6) AS ari FROM t""")
def embedding_agreement(t: Tables) -> DataFrame:
    """Label of an embedding against the quadrant of its first two coordinates."""
    at = lambda i: (F.element_at("embedding", i) >= 0).cast("int")
    first = t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").alias("community"))
    second = t.embeddings.select(F.col("vec_id").alias("item"), (at(1) * 2 + at(2)).alias("community"))
    out = A.agreement(A.contingency(first, second, []), [])
    return out.select("n_items", F.round("ari", 6).alias("ari"))


@query("pair_jaccard", _CELLS + """
SELECT p_size, CASE WHEN x + y - b = 0 THEN 1.0 ELSE round(b / (x + y - b), 6) END AS jaccard FROM
  (SELECT p_size, sum(n*(n-1)/2) AS b FROM cells GROUP BY 1) JOIN
  (SELECT p_size, sum(n*(n-1)/2) AS x FROM m1 GROUP BY 1) USING (p_size) JOIN
  (SELECT p_size, sum(n*(n-1)/2) AS y FROM m2 GROUP BY 1) USING (p_size)""")
def pair_jaccard(t: Tables) -> DataFrame:
    out = A.pair_jaccard(_by(t, "p_brand"), _by(t, "p_type"), K)
    return out.select(*K, F.round("jaccard", 6).alias("jaccard"))


_REPLICATES = """
WITH counts AS (
  SELECT p_brand, l_linenumber AS rep, l_partkey AS item, s_nationkey AS c, count(*) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT p_brand, rep, item, c FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, rep, item ORDER BY k DESC, c) AS r FROM counts) WHERE r = 1),
own AS (SELECT p_brand, rep, sum(n*(n-1)/2) AS s FROM (
  SELECT p_brand, rep, c, count(*)::DOUBLE AS n FROM p GROUP BY ALL) GROUP BY ALL),
both_ AS (SELECT p_brand, r1, r2, sum(n*(n-1)/2) AS b FROM (
  SELECT x.p_brand, x.rep AS r1, y.rep AS r2, x.c AS c1, y.c AS c2, count(*)::DOUBLE AS n
  FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.item = y.item AND x.rep < y.rep GROUP BY ALL) GROUP BY ALL)
"""


@query("replicate_jaccard", _REPLICATES + """
SELECT x.p_brand, round(avg(CASE WHEN x.s + y.s - coalesce(b, 0) = 0 THEN 1.0 ELSE coalesce(b, 0) / (x.s + y.s - coalesce(b, 0)) END), 6) AS jaccard
FROM own x JOIN own y ON x.p_brand = y.p_brand AND x.rep < y.rep
LEFT JOIN both_ ON both_.p_brand = x.p_brand AND r1 = x.rep AND r2 = y.rep GROUP BY 1""")
def replicate_jaccard(t: Tables) -> DataFrame:
    """Stability of 'the nation a part mostly comes from' over seven replicates per brand."""
    lines = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    keys = ["p_brand", "rep", "item"]
    partitions = (
        lines.groupBy("p_brand", F.col("l_linenumber").alias("rep"), F.col("l_partkey").alias("item"),
                      F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("k"))
        .groupBy(*keys).agg(F.max_by("nation", F.struct(F.col("k"), -F.col("nation"))).alias("community"))
    )
    out = A.replicate_jaccard(partitions, partitions.select("p_brand", "rep").distinct(), ["p_brand"])
    return out.select("p_brand", F.round("jaccard", 6).alias("jaccard"))
