"""Lines of co-change are shuffled once, those of a history not at all."""

from collecting import rows
from pyspark.sql import functions as F

from partlens.operators import graph


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_counted_and_gathered_in_one_shuffle(spark):
    lines = spark.range(4000).selectExpr("id div 2000 AS repo", "id div 4 AS commit", "id % 97 AS item")
    # the lines by commit, the pairs by their ends
    assert exchanges(graph.cochange_edges(lines, ["repo"])) == 2


def test_commits_are_not_gathered_as_objects_before_they_are_counted(spark):
    lines = spark.range(4000).selectExpr("id div 2000 AS repo", "id div 4 AS commit", "id % 97 AS item")
    assert "ObjectHashAggregate" not in graph.cochange_edges(lines, ["repo"])._jdf.queryExecution().executedPlan().toString()


def test_lines_without_an_item_count_and_equal_ones_pair_once(spark):
    lines = [("g", "c", "x"), ("g", "c", "y"), ("g", "c", "x"), ("g", "d", "x"), ("g", "d", None), ("g", "e", "y"), ("g", "e", "x"), ("g", "e", None), ("g", "e", None)]
    df = spark.createDataFrame(lines, "g string, commit string, item string")
    assert rows(graph.cochange_edges(df, ["g"], max_items=4), "a", "b", "weight") == [("x", "y", 2.0)]
    assert rows(graph.cochange_edges(df, ["g"], max_items=3), "a", "b", "weight") == [("x", "y", 1.0)]


def test_giant_commits_of_a_bucket_do_not_take_others_with_them(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKETS", 2)
    lines = [("g", "big", f"f{i}") for i in range(3000)] + [("g", f"c{i}", f"f{j}") for i in range(50) for j in (i, i + 1)]
    got = graph.cochange_edges(spark.createDataFrame(lines, "g string, commit string, item string"), ["g"])
    assert rows(got, "a", "b", "weight") == sorted((*sorted((f"f{i}", f"f{i + 1}")), 1.0) for i in range(50))


def test_lines_do_not_travel_to_few_newest_commits(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        commits = spark.range(4000).selectExpr("id % 3 AS repo", "id div 4 AS commit", "id % 97 AS path", "id div 4 AS recency")
        newest = graph.newest_commits(commits, ["repo"], "recency", 5)
        assert exchanges(newest) == 0
        assert {tuple(r) for r in newest.groupBy("repo").agg(F.min("commit"), F.count_distinct("commit")).collect()} == {(0, 995, 5), (1, 995, 5), (2, 995, 5)}
        assert graph.newest_commits(commits.where("repo > 5"), ["repo"], "recency", 5).count() == 0
    finally:
        spark.conf.set(key, before)
