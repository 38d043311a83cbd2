import math
import random
from collections import Counter
from itertools import combinations

import pytest

from partlens.operators import agreement as A


def brute_jaccard(p1, p2):
    s1 = s2 = both = 0
    for a, b in combinations(sorted(set(p1) | set(p2)), 2):
        x = p1.get(a) is not None and p1.get(a) == p1.get(b)
        y = p2.get(a) is not None and p2.get(a) == p2.get(b)
        s1, s2, both = s1 + x, s2 + y, both + (x and y)
    return both / (s1 + s2 - both) if s1 + s2 - both else 1.0


def brute_ari(p1, p2):
    items = sorted(set(p1) & set(p2))
    n = len(items)
    if n < 2:
        return None
    pairs = lambda counts: sum(c * (c - 1) / 2 for c in counts.values())
    ij, i, j = pairs(Counter((p1[x], p2[x]) for x in items)), pairs(Counter(p1[x] for x in items)), pairs(Counter(p2[x] for x in items))
    expected, top = i * j / (n * (n - 1) / 2), (i + j) / 2
    return 1.0 if top == expected else (ij - expected) / (top - expected)


def brute_nmi(p1, p2):
    items = sorted(set(p1) & set(p2))
    n = len(items)
    if not n:
        return None
    a, b, ab = Counter(p1[x] for x in items), Counter(p2[x] for x in items), Counter((p1[x], p2[x]) for x in items)
    h = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    mi = sum(v / n * math.log(v * n / (a[x] * b[y])) for (x, y), v in ab.items())
    base = (h(a) + h(b)) / 2
    return mi / base if base else 1.0


def random_partition(rng):
    return {f"f{i}": rng.choice("abc") for i in range(rng.randint(0, 9)) if rng.random() < 0.8}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    made = [(random_partition(rng), random_partition(rng)) for _ in range(60)]
    same = {"f1": "x", "f2": "x"}
    return made + [(same, same), ({"f1": "a", "f2": "b"}, {"f1": "a", "f2": "b"})]


def table(spark, cases, side):
    data = [(i, f, c) for i, pair in enumerate(cases) for f, c in pair[side].items()]
    return spark.createDataFrame(data, "k long, item string, community string")


def test_ari_and_nmi(spark, cases):
    cells = A.contingency(table(spark, cases, 0), table(spark, cases, 1), ["k"])
    got = {r.k: r for r in A.agreement(cells, ["k"]).collect()}
    for i, (p1, p2) in enumerate(cases):
        if not set(p1) & set(p2):
            assert i not in got
            continue
        assert got[i].ari == (None if brute_ari(p1, p2) is None else pytest.approx(brute_ari(p1, p2)))
        assert got[i].nmi == pytest.approx(brute_nmi(p1, p2), abs=1e-9)


def test_pair_jaccard(spark, cases):
    got = {r.k: r.jaccard for r in A.pair_jaccard(table(spark, cases, 0), table(spark, cases, 1), ["k"]).collect()}
    for i, (p1, p2) in enumerate(cases):
        if p1 or p2:
            assert got[i] == pytest.approx(brute_jaccard(p1, p2)), (p1, p2)


def test_replicate_jaccard_with_copies_and_empty_runs(spark):
    rng, data, runs, want = random.Random(4), [], [], {}
    for repo in range(8):
        base = random_partition(rng)
        # copies, a relabelled copy, an empty run and different ones
        reps = [base, base, {f: c + "'" for f, c in base.items()}, {}, random_partition(rng), random_partition(rng)][: 1 + repo]
        for i, p in enumerate(reps):
            runs.append((repo, str(i)))
            data += [(repo, str(i), f, c) for f, c in p.items()]
        js = [brute_jaccard(a, b) for a, b in combinations(reps, 2)]
        want[repo] = sum(js) / len(js) if js else None
    got = A.replicate_jaccard(spark.createDataFrame(data, "repo long, rep string, item string, community string"),
                              spark.createDataFrame(runs, "repo long, rep string"), ["repo"])
    assert {r.repo: r.jaccard for r in got.collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
