"""The pilot report and its parts against plain statistics."""

import random
from statistics import mean, pstdev

import pytest
from collecting import rows

from partlens import schemas
from partlens.operators import inference as I
from partlens.plans import decision as D

RK = list(schemas.RUN_KEY)
FIELDS = {**dict.fromkeys(RK, "string"), **{k: v for k, v in schemas.SCORE.items() if k not in RK}, "condition": "string", "stratum": "string", "has_claude_md": "int", "exit": "int", "model": "string"}
BASE = {"valid_nontrivial": True, "coverage": 1.0, "edge_resolution": 1.0, "trivial": False, "budget_exhausted": False, "run_error": False, "n_units": 5, "lint_rounds": 1, "exit": 0, "cost_usd": 0.5}


def pilot(spark, gains, reps=6, noise=0.0, without=(), **changes):
    """Scores and manifests of ``reps`` runs a repository; runs in ``without`` have no manifest."""
    r, scores, manifests = random.Random(7), [], []
    for repo, gain in gains.items():
        for rep in range(reps):
            key = (repo, "s", "pilot", str(rep))
            row = {**dict(zip(RK, key)), **BASE, "q_gain_dir": gain + r.uniform(-noise, noise), "q_cochange_gain": gain / 2, **{k: v(repo, rep) for k, v in changes.items()}}
            scores.append(tuple(row.get(k) for k in FIELDS))
            if key not in without:
                manifests.append((*key, [{"name": "u", "files": ["a", "b"]}, {"name": "v", "files": ["c"]}]))
    keys = ", ".join(f"{k} string" for k in RK)
    entry = schemas.MANIFEST["units"]
    made = spark.createDataFrame([(*m[:4],) for m in manifests], keys)
    from pyspark.sql import functions as F

    units = F.from_json(F.lit('[{"name": "u", "files": ["a", "b"]}, {"name": "v", "files": ["c"]}]'), entry)
    return spark.createDataFrame(scores, schemas.ddl(FIELDS)), made.withColumn("units", units), [dict(zip(FIELDS, s)) for s in scores]


def report(spark, scores, manifests, order=None, **options):
    ranking = None if order is None else spark.createDataFrame(list(enumerate(order)), "rank int, name string")
    return {r.check: r for r in D.pilot_report(scores, manifests, ranking, draws=100, **options).collect()}


GAINS = {"a": 0.40, "b": 0.30, "c": 0.20, "d": 0.10}


def test_a_pilot_that_passes(spark):
    scores, manifests, plain = pilot(spark, GAINS, noise=0.002)
    got = report(spark, scores, manifests, "abcd", budget=10_000.0)
    per = {g: [s["q_gain_dir"] for s in plain if s["repo"] == g] for g in GAINS}
    sd = mean(pstdev(v) for v in per.values())
    assert got["P1 reliability"].passed and got["P1 reliability"].value == 1.0
    grand = mean(v for x in per.values() for v in x)
    msb = sum(6 * (mean(v) - grand) ** 2 for v in per.values()) / 3
    msw = sum((x - mean(v)) ** 2 for v in per.values() for x in v) / 20
    assert got["P2 discrimination"].value == pytest.approx((msb - msw) / (msb + 5 * msw)) and got["P2 discrimination"].passed
    assert got["P3 human agreement"].value == 1.0 and got["P3 human agreement"].passed and got["P3 human agreement"].detail == "cochange 1.0"
    need = int(got["P5 replicates"].value)
    z = 2.485
    assert need == next((n for n in range(2, 21) if z * (2 * sd * sd / n / 70) ** 0.5 <= 0.03), need) and got["P5 replicates"].detail == f"sd {sd:.4f}"
    assert got["P8 cost"].value == pytest.approx(0.5 * 100 * need * 5) and got["P8 cost"].passed
    assert got["P4 A/A"].detail == "10 splits"
    assert got["GO"].passed == bool(got["P4 A/A"].passed)


def test_without_a_ranking_it_is_no_go(spark):
    scores, manifests, _ = pilot(spark, GAINS)
    got = report(spark, scores, manifests)
    assert got["P3 human agreement"].passed is None and not got["GO"].passed and got["P8 cost"].passed is None


def test_few_replicates_and_a_wrong_order(spark):
    scores, manifests, _ = pilot(spark, GAINS, reps=3, noise=0.001)
    got = report(spark, scores, manifests, "dcba", budget=1.0)
    assert got["P4 A/A"].detail == "needs six replicates" and got["P3 human agreement"].value == -1.0
    assert not got["P3 human agreement"].passed and not got["P8 cost"].passed and not got["GO"].passed


@pytest.mark.parametrize("changes, harness, manifest, exhausted, lint", [
    ({"exit": lambda repo, rep: int(rep == 0)}, 4 / 24, 20 / 24, 0.0, 24),
    ({"budget_exhausted": lambda repo, rep: rep < 2}, 0.0, 20 / 24, 8 / 24, 24),
    ({"lint_rounds": lambda repo, rep: None if rep == 1 else 2}, 0.0, 20 / 24, 0.0, 20),
])
def test_reliability(spark, changes, harness, manifest, exhausted, lint):
    """The runs with rep 0 have no manifest: they fail the harness only if they ended badly, and need no lint round."""
    scores, manifests, _ = pilot(spark, GAINS, without={(g, "s", "pilot", "0") for g in GAINS}, **changes)
    from partlens.sources import runs as R

    got = D.reliability(scores, R.partitions(manifests)).first()
    assert (got.harness_fail, got.manifest, got.exhausted, got.lint_ok, got.n_runs) == (pytest.approx(harness), pytest.approx(manifest), pytest.approx(exhausted), lint, 24)
    assert not got.passed


def test_human_agreement_needs_every_cochange(spark):
    per = spark.createDataFrame([("a", 0.4, 0.1), ("b", 0.3, 0.3), ("c", 0.1, 0.2), ("x", 9.0, 9.0)], "repo string, gain double, cochange double")
    order = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "unknown")], "rank int, name string")
    got = D.human_agreement(per, order).first()
    assert (got.rho_gain, got.rho_cochange, got.rho_gain_cochange, got.passed) == (1.0, pytest.approx(-0.5), pytest.approx(-0.5), True)
    from pyspark.sql import functions as F

    holed = per.withColumn("cochange", F.when(F.col("repo") != "b", F.col("cochange")))
    got = D.human_agreement(holed, order).first()
    assert (got.rho_gain, got.rho_cochange, got.rho_gain_cochange, got.passed) == (1.0, None, None, True)


def test_ablation_arms(spark):
    from partlens.functions.labels import parse_label

    labels = ["abc", "abc-noskill", "abc-no-Rules"]
    parsed = [tuple(r) for r in spark.createDataFrame([(x,) for x in labels], "label string").select(parse_label("label").alias("p")).select("p.*").collect()]
    data = [(x, 0.5, 0.1 * i, 0.2, 3.0) for i, x in enumerate(labels)]
    got = rows(D.ablation_arms(spark.createDataFrame(data, "label string, valid double, gain double, contract double, units double")), "arm", "n_repos")
    assert sum(n for _, n in got) == 3 and ("full", 1) in got and len(parsed) == 3


def test_applied_rescore_leaves_the_old_records(spark, tmp_path):
    scores, _, _ = pilot(spark, GAINS, reps=1)
    from pyspark.sql import functions as F

    new = scores.withColumn("q_gain_dir", F.when(F.col("repo") == "a", 0.9).otherwise(F.col("q_gain_dir")))
    dry = D.apply_rescore(scores, new, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists() and [r.repo for r in dry.where("n_changed > 0").collect()] == ["a"]
    D.apply_rescore(scores, new, str(tmp_path / "new"), apply=True)
    assert {r.repo: r.q_gain_dir for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {**GAINS, "a": 0.9}


def test_splits_are_of_replicates_not_of_runs(spark):
    assert len(I.aa_splits(["3", "1", "2", "0", "5", "4"])) == 10
