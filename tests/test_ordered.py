"""Outputs in order, folders replaced as a whole, and the corpus sink."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from partlens.operators import summary
from partlens.sources import corpus, sinks


def test_order_of_files_and_rows_is_the_order(spark, tmp_path):
    df = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("position_of"))
    sinks.write_ordered(df, [F.desc("k")], str(tmp_path / "t"), parts=5)
    got = sinks.read_ordered(spark, str(tmp_path / "t")).collect()
    assert sorted((r.position, r.k) for r in got) == [(i, 4999 - i) for i in range(5000)]
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) > 1


def test_total_row_is_not_the_row_without_a_name(spark, tmp_path):
    runs = spark.createDataFrame([("a", 5, 1.0), ("a", 7, 1.0), (None, 9, 2.0), ("b", 1, 0.5)], "repo string, tokens long, cost double")
    sinks.write_ordered(summary.budget(runs), summary.budget_order(), str(tmp_path / "t"))
    got = sorted(sinks.read_ordered(spark, str(tmp_path / "t")).collect(), key=lambda r: r.position)
    assert [(r.repo, r.is_total, r.runs, r.tokens_per_run) for r in got] == [(None, False, 1, 9.0), ("a", False, 2, 6.0), ("b", False, 1, 1.0), (None, True, 4, 5.5)]


PICKS = [("o/two", "s2", "famous", "go"), ("o/one", "s1", "famous", "go"), ("o/three", "s3", "lowvis", "c")]
CELLS = [("famous", "go", "q1", 7, ["o/one", "o/two"]), ("lowvis", "c", "q2", 1, ["o/three"]), ("lowvis", "go", "q3", 0, None)]


def written(spark, path, picks, seed=3):
    corpus.write_corpus(
        spark.createDataFrame(picks, "repo string, sha string, stratum string, language string"),
        spark.createDataFrame(CELLS, "stratum string, language string, query string, candidates int, picked array<string>"), path, seed, 40, "2024-01-01T00:00:00Z")
    return [line for part in sorted(Path(path, "corpus").glob("part-*")) for line in part.read_text().splitlines()]


def test_corpus_keeps_what_it_has_read(spark, tmp_path):
    """A second run keeps the lines of the first in their order and adds its own; header and metadata stand once."""
    line = lambda r: corpus.LINE % r
    first = written(spark, str(tmp_path / "c"), PICKS)
    assert first == [corpus.HEADER, line(PICKS[1]), line(PICKS[0]), line(PICKS[2])]
    more = ("o/four", "s4", "famous", "c")
    assert written(spark, str(tmp_path / "c"), [more], seed=4) == [*first, line(more)]
    meta = json.loads("".join(p.read_text() for p in Path(tmp_path, "c", "meta").glob("part-*")))
    assert (meta["snapshot"], meta["seed"], meta["n_requested"]) == ("2024-01-01T00:00:00Z", 4, 40)
    assert meta["cells"] == {"famous/go": {"query": "q1", "candidates": 7, "picked": ["o/one", "o/two"]}, "lowvis/c": {"query": "q2", "candidates": 1, "picked": ["o/three"]},
                             "lowvis/go": {"query": "q3", "candidates": 0, "picked": []}}
    names = sorted(r.repo for r in corpus.read_corpus(spark, str(tmp_path / "c" / "corpus")).collect())
    assert names == ["o/four", "o/one", "o/three", "o/two"]
    assert [p.name for p in Path(tmp_path, "c").iterdir() if not p.name.startswith(".")] in (["corpus", "meta"], ["meta", "corpus"])


def test_folder_is_put_back_when_its_replacement_breaks_off(spark, tmp_path):
    folder = sinks.Folder(spark, str(tmp_path / "f"))
    one = lambda text: lambda stage: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(stage)
    read = lambda: [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert not folder.exists()
    folder.replace(one("first"))

    def fails(stage):
        raise OSError("lost")

    with pytest.raises(OSError):
        folder.replace(fails)
    assert read() == ["first"]
    (tmp_path / "f").rename(tmp_path / "f.replaced")  # between the two renames
    assert folder.exists() and read() == ["first"]
    folder.replace(one("second"))
    assert read() == ["second"] and not (tmp_path / "f.replaced").exists()
