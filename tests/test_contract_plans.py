"""How often the rows of the largest table are shuffled on their way to the contracts."""

from pyspark.sql import functions as F

from collecting import rows
from partlens.operators import contracts as C
from partlens.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def exchanges_above(df, table: str) -> list[int]:
    """For every scan of a table, the exchanges between it and the result."""
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        bare = line.lstrip(" :+-")
        depth = len(line) - len(bare)
        above = [(d, x) for d, x in above if d < depth] + [(depth, bare.startswith("Exchange"))]
        if bare.startswith("FileScan") and f"/{table}.parquet" in bare:
            found.append(sum(x for _, x in above))
    return found


def test_references_are_shuffled_once_a_join(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        # by part, order and supplier; then the distinct values
        assert max(exchanges_above(QUERIES["true_entrypoints"](spark, SMALL), "lineitem")) == 4
    finally:
        spark.conf.set(key, before)


def test_sources_can_be_looked_up_before(spark):
    owner = spark.createDataFrame([("g", "a", "x"), ("g", "b", "y")], "g string, path string, unit string")
    refs = spark.createDataFrame([("g", "a", "b", "s1"), ("g", "b", "b", "s2"), ("g", "none", "b", "s3"), ("g", "a", "a", "s4"), ("g", "a", "b", "s1")],
                                 "g string, src string, dst string, symbol string")
    surface = spark.createDataFrame([("g", "a", "p")], "g string, path string, symbol string")
    expected = [("g", "x", "p"), ("g", "y", "s1"), ("g", "y", "s3")]
    for given in (refs, C.with_source_units(refs, owner, ["g"]).where(F.lit(True))):
        assert rows(C.true_entrypoints(owner, owner, given, surface, ["g"], ["g"]), "g", "unit", "value") == expected
