"""What the code queries write: keys are sketched before they are shuffled, and what is done with is deleted."""

import os
import time

from pyspark.sql import functions as F

from partlens.operators import extract, keyed, resolve
from partlens.queries import code
from partlens.session import write_table


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(name.startswith("shuffle_") and name.endswith(".data") for f in folders for _, _, names in os.walk(f.getPath()) for name in names)


def tables(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {name for name in os.listdir(os.path.dirname(folder)) + os.listdir(folder) if name.startswith("table-")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert len(write_table(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()).collect()) == 10
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_sketch_keeps_all_that_match_and_little_else(spark):
    df = spark.range(20_000).selectExpr("if(id % 100 = 0, null, concat('r', id % 3)) AS repo", "concat('n', id) AS name", "id")
    others = df.where("id % 500 = 7").select("repo", "name")
    kept = {r.id for r in keyed.may_match(df, others, ["repo", "name"]).collect()}
    wanted = {i for i in range(20_000) if i % 500 == 7}
    assert wanted <= kept and len(kept) < len(wanted) + 20
    assert keyed.may_match(df, others.limit(0), ["repo", "name"]).count() == 0
    assert keyed.may_match(df, df, ["repo", "name"]).count() == 20_000


def test_names_that_meet_nothing_are_not_shuffled(spark, monkeypatch):
    """Of 600 files, 300 names and 600 paths, only what is imported or defined elsewhere reaches a shuffle."""
    seen = []
    real = keyed.may_match

    def counting(df, others, keys):
        kept = real(df, others, keys)
        seen.append((df.count(), kept.count()))
        return kept

    monkeypatch.setattr(resolve, "may_match", counting, raising=False)
    texts = [("r", f"use/u{i}.py", f"import lib\ndef run(x):\n    return make(x, {', '.join(f'a{i}_{k}' for k in range(20))})\n") for i in range(600)]
    files = spark.createDataFrame([*texts, ("r", "lib.py", "def make(x):\n    return x\n")], "repo string, path string, text string").selectExpr("*", "'python' AS lang")
    facts = extract.extract_facts(files, ["repo"], resolve.REFERENCE_FACTS).cache()
    links = resolve.links(files, facts, ["repo"])
    assert links.count() == 600 and seen[0][0] > 1200 and seen[0][1] < 10
    refs = resolve.references(facts, links, ["repo"])
    assert {tuple(r) for r in refs.collect()} == {("r", f"use/u{i}.py", "lib.py", "make") for i in range(600)}
    assert seen[1][0] > 13_000 and seen[1][1] < 2_500


def test_references_leave_one_table(spark):
    rows = [("r", "a.py", "ident", "f", None), *[("r", "b.py", "def", "f", "function")] * 9, ("r", "a.py", "ident", "g", None), ("r", None, "def", "g", "function"),
            *[("r", p, "def", "h", "function") for p in ("b.py", "c.py")], ("r", "a.py", "ident", "h", None)]
    facts = spark.createDataFrame(rows, "repo string, path string, fact string, name string, kind string")
    linked = spark.createDataFrame([("r", "a.py", "c.py")], "repo string, src string, dst string")
    write_table(facts)
    before = tables(spark)
    found = resolve.references(facts, linked, ["repo"])
    assert sorted(tuple(r) for r in found.collect()) == [("r", "a.py", "b.py", "f"), ("r", "a.py", "c.py", "h")]
    new = tables(spark) - before
    assert sum(found.inputFiles()[0].count(name) for name in new) == 1


def test_files_of_lines_without_numbers(spark, tmp_path):
    """One null number leaves one in the path, whichever it was; of several texts of a path the largest counts, and nulls do not."""
    lines = [(5, None, 1, 1, 0.01), (None, 5, 1, 1, 0.10), (None, None, 1, 1, None), (7, 1, 2, 1, 0.10), (8, 1, 3, 1, 0.10), (8, 1, 3, 1, 0.01), (9, 1, None, 1, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (1, "A_B"), (2, None), (3, "c")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 4, -1.0), (1, 4, 2.0), (1, None, None)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    from partlens.queries.registry import Tables

    got = {(r.repo, r.path): r.text for r in code.source_files(Tables(spark, str(tmp_path))).collect()}
    use = lambda kind, chance="": f"{chance}import s1\ndef run(x):\n    return make_{kind}_1(x)\n"
    own = "import shutil\n" + "".join(f"def make_{t}_1(x):\n    return x\n" for t in ("a", "a_b", "c"))
    want = {("makers/s1.py", own): 1, ("use/l_5_1_1.py", use("a_b")): 1, ("use/l_1_1.py", use("a_b")): 1, ("use/l_7_1_2_1.py", None): 1, ("use/l_8_1_3_1.py", use("c")): 1}
    assert got == {(repo, path): text for path, text in want for repo in ("nation4", None)}
