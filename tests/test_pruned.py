"""Readers that test paths before they open anything."""

import io

import pytest
from collecting import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

from partlens.sources import files, pruned, runs


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for repo in ("a", "b", "c d"):
        for label in ("v1", "v2"):
            for rep in ("0", "1", "2"):
                folder = root / "runs" / repo / "s" / label / rep
                folder.mkdir(parents=True)
                (folder / "score.json").write_text('{"coverage": 0.5}' if rep != "2" else "")
    for path, text in (("a/s/x.py", "é = 1"), ("a/s/tests/y.py", "skipped"), ("a/s/docs/deep/z.py", "skipped"), ("a/s/doc/w.go", "kept"), ("a/s/readme.md", "no"),
                       ("b/t/big.py", "x" * 5000), ("b/t/sub/x.rs", "fn a() {}")):
        file = root / "checkouts" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (root / "checkouts" / "b" / "t" / "raw.c").write_bytes(b"int a; \xff\n")
    return root


class Counted(pruned.RunReader):
    opened: list = []

    def content(self, store, path):
        self.opened.append(path)
        return super().content(store, path)


def read_with(reader, filters):
    """What a reader leaves to Spark, and its rows."""
    left = list(reader.pushFilters(filters))
    return left, sorted(row for p in reader.partitions() for row in reader.read(p))


def test_filters_choose_the_files_that_are_opened(tree):
    Counted.opened = []
    reader = Counted({"path": str(tree / "runs"), "file": "score.json"})
    other = GreaterThan(("rep",), "0")
    left, got = read_with(reader, [EqualTo(("label",), "v1"), In(("rep",), ("0", "1")), Not(In(("repo",), ("b",))), other])
    assert left == [other]
    assert [r[:4] for r in got] == [("a", "s", "v1", "0"), ("a", "s", "v1", "1"), ("c d", "s", "v1", "0"), ("c d", "s", "v1", "1")]
    assert len(Counted.opened) == 4


def test_rejected_folders_are_not_listed(tree):
    class Listed(pruned.RunReader):
        seen: list = []

        def folders(self, store, path):
            self.seen.append(path)
            return super().folders(store, path)

    reader = Listed({"path": str(tree / "runs"), "file": "score.json"})
    read_with(reader, [EqualTo(("repo",), "a"), EqualTo(("label",), "v2")])
    assert not [p for p in Listed.seen if "/b" in p.removeprefix(str(tree)) or p.endswith("v1")]


def test_null_comparisons_are_left_to_spark(tree):
    reader = pruned.RunReader({"path": str(tree / "runs"), "file": "score.json"})
    tests = [Not(In(("repo",), ("a", None))), EqualTo(("repo",), None)]
    assert list(reader.pushFilters(tests)) == tests


def test_plans_show_pushed_filters(spark, tree):
    scores = runs.select_runs(runs.read_json(spark, str(tree / "runs"), "score.json", {"coverage": "double"}), "v1", ["0", "2"], ["b"])
    plan = io.StringIO()
    import contextlib

    with contextlib.redirect_stdout(plan):
        scores.explain("formatted")
    pushed = next(line for line in plan.getvalue().splitlines() if line.startswith("PushedFilters"))
    assert "EqualTo(label,v1)" in pushed and "In(rep, [0,2])" in pushed and "Not(EqualTo(repo,b))" in pushed
    assert rows(scores, "repo", "rep", "coverage") == sorted([("a", "0", 0.5), ("a", "2", None), ("c d", "0", 0.5), ("c d", "2", None)], key=repr)


def test_checkouts(spark, tree):
    root = str(tree / "checkouts")
    small = files.read_checkouts(spark, root).where((F.col("length") <= 100) & (F.col("repo") != "none"))
    assert rows(small, "repo", "sha", "path") == [("a", "s", "doc/w.go"), ("a", "s", "x.py"), ("b", "t", "raw.c"), ("b", "t", "sub/x.rs")]
    assert rows(small.where("path = 'x.py'"), "length", "text") == [(6, "é = 1")] and rows(small.where("path = 'raw.c'"), "text") == [("int a; �\n",)]
    reader = pruned.CheckoutReader({"path": root, "suffixes": ".py,.go", "skipped": "tests,docs"})
    assert not list(reader.pushFilters([LessThanOrEqual(("length",), 100)]))
    assert [f[0].removeprefix(root) for p in reader.partitions() for f in p.found] == ["/a/s/x.py", "/a/s/doc/w.go"]


def test_both_readers_agree(spark, tree, monkeypatch):
    root = str(tree / "checkouts")
    mine = rows(files.read_checkouts(spark, root), "repo", "sha", "path", "length", "text"), rows(runs.read_text(spark, str(tree / "runs"), "score.json"))
    monkeypatch.setattr(pruned, "reachable", lambda _: False)
    theirs = rows(files.read_checkouts(spark, root), "repo", "sha", "path", "length", "text"), rows(runs.read_text(spark, str(tree / "runs"), "score.json"))
    # Spark's text reader gives no row for an empty file
    assert mine[0] == theirs[0] and [r for r in mine[1] if r[-1]] == theirs[1] and len(mine[1]) == 18


def test_empty_and_missing_roots(spark, tmp_path):
    assert runs.read_text(spark, str(tmp_path / "none"), "score.json").count() == 0
    assert files.read_checkouts(spark, str(tmp_path)).count() == 0
