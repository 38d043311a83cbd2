"""Exclusions as intervals against the path rules themselves."""

import random

import pytest

from partlens.operators import contracts, exclusion

RK, GK = ["repo", "sha", "label", "rep"], ["repo", "sha"]


def plain_coverage(files, owned, rules):
    """Share and number of files in scope, by the two rules for every file; none when nothing is in scope."""
    scope = {f for f in files if not any(f == r or f.startswith(r.rstrip("/") + "/") for r in rules)}
    return (len(scope & owned) / len(scope), len(scope)) if scope else None


@pytest.mark.parametrize("block", (3, 4096))
def test_coverage_of_random_trees(spark, monkeypatch, block):
    monkeypatch.setattr(exclusion, "BLOCK", block)
    r = random.Random(block)
    names = ["a", "a.b", "ab", "b", "c", "docs", "docs_src"]
    trees = {f"g{i}": {"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(r.choice([1, 5, 60]))} for i in range(4)}
    runs = [(g, "s", label, str(rep)) for g in trees for label in ("x", "y") for rep in range(3)] + [("none", "s", "x", "0")]
    owned, excluded, want = [], [], {}
    for run in runs:
        files = trees.get(run[0], set())
        mine = {f for f in sorted(files) if r.random() < 0.6}
        rules = ["/".join(r.choice(names) for _ in range(r.randint(1, 3))) + r.choice(["", "", "/", "//"]) for _ in range(r.randint(0, 5))]
        rules += [r.choice(sorted(files)) for _ in range(r.randint(0, 2)) if files]
        owned += [(*run, f, "u") for f in mine] + [(*run, "elsewhere", "u")]
        excluded += [(*run, x) for x in rules] + [(*run, None)]
        if (value := plain_coverage(files, mine, rules)) and files:
            want[run] = value
    keys = "repo string, sha string, label string, rep string"
    got = exclusion.coverage(
        spark.createDataFrame(runs, keys), spark.createDataFrame([(g, "s", f) for g, fs in trees.items() for f in fs], "repo string, sha string, path string"),
        spark.createDataFrame(owned, f"{keys}, path string, unit string"), spark.createDataFrame(excluded, f"{keys}, path string"), RK, GK).collect()
    assert len(got) == len(want) and {tuple(x[k] for k in RK): (pytest.approx(x.coverage), x.n_in_scope) for x in got} == want


def test_intervals_follow_the_rules_and_not_the_files(spark):
    """A folder of many files is one interval, whatever else lies in it or is named inside it."""
    files = spark.createDataFrame([("g", "s", f"big/{i // 100}/{i}") for i in range(3000)] + [("g", "s", "big.txt"), ("g", "s", "z")], "repo string, sha string, path string")
    rules = spark.createDataFrame([("g", "s", "l", "0", p) for p in ("big", "big/3/", "big/4/401", "z", "missing")], "repo string, sha string, label string, rep string, path string")
    found = exclusion.intervals(rules, exclusion.places(exclusion.numbered(files, GK), GK), RK, GK).collect()
    assert sorted((x.low, x.high) for x in found) == [(1, 3001), (3001, 3002)]


def test_row_form_agrees(spark):
    files = spark.createDataFrame([("r", p) for p in ("docs", "docs/a", "docs_src/a", "x")], "repo string, path string")
    rules = spark.createDataFrame([("r", "docs/")], "repo string, path string")
    owner = spark.createDataFrame([("r", "x", "u"), ("r", "docs/a", "u")], "repo string, path string, unit string")
    scope = contracts.coverage(contracts.in_scope(files, rules, ["repo"]), owner, ["repo"]).first()
    mine = exclusion.coverage(files, files, owner, rules, ["repo"], ["repo"]).first()
    assert (mine.coverage, mine.n_in_scope) == (scope.coverage, scope.n_in_scope) == (pytest.approx(1 / 3), 3)
