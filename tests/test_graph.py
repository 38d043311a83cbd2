import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from collecting import rows
from pyspark.sql import functions as F

from partlens.operators import community, graph, keyed

K = ["g"]


def brute_modularity(partition, edges):
    und = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        und[a][b] += w
        und[b][a] += w
    m2 = sum(sum(v.values()) for v in und.values())
    deg = {n: sum(v.values()) for n, v in und.items()}
    q = 0.0
    for a in und:
        for b in und:
            if partition.get(a) is not None and partition.get(a) == partition.get(b):
                q += und[a].get(b, 0.0) - deg[a] * deg[b] / m2
    return q / m2 if m2 else 0.0


def random_graph(rng, n, m):
    pairs = Counter()
    for _ in range(m):
        a, b = sorted(rng.sample(range(n), 2))
        pairs[f"n{a:02}", f"n{b:02}"] += 1
    return [(a, b, float(w)) for (a, b), w in pairs.items()]


def test_modularity_equals_pair_sum(spark):
    rng = random.Random(3)
    edges, parts, want = [], [], {}
    for g in range(6):
        e = random_graph(rng, 12, 25)
        edges += [(f"g{g}", *x) for x in e]
        for p in ("p1", "p2"):
            # some nodes have no community and some listed nodes are not in the graph
            part = {f"n{i:02}": rng.choice(["a", "b", "c", None]) for i in range(14)}
            parts += [(f"g{g}", p, n, c) for n, c in part.items()]
            want[f"g{g}", p] = brute_modularity(part, e)
    parts.append(("empty", "p1", "x", "a"))
    want["empty", "p1"] = 0.0
    got = graph.modularity(spark.createDataFrame(edges, "g string, a string, b string, weight double"),
                           spark.createDataFrame(parts, "g string, part string, node string, community string"), K, ["part"])
    assert {(r.g, r.part): r.q for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_partitions_as_columns_give_the_same(spark):
    rng = random.Random(8)
    edges = random_graph(rng, 12, 25)
    table = [(f"n{i:02}", rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"])) for i in range(10)]  # two nodes unlisted
    got = graph.modularity_of_columns(
        spark.createDataFrame([("g", *e) for e in edges], "g string, a string, b string, weight double"),
        spark.createDataFrame([("g", *r) for r in table], "g string, node string, p string, q string"), K, ["p", "q"]).first()
    assert got.p == pytest.approx(brute_modularity({n: p for n, p, _ in table}, edges))
    assert got.q == pytest.approx(brute_modularity({n: q for n, _, q in table}, edges))


def test_cochange_counts_lines_before_duplicates(spark):
    lines = [("g", "c1", p) for p in "aabb"] + [("g", "c2", "a"), ("g", "c2", "a")] + [("g", "c3", p) for p in "abcde"]
    lines += [("g", "c4", "a"), ("g", "c4", "c"), ("g", "c5", "a")]
    got = graph.cochange_edges(spark.createDataFrame(lines, "g string, commit string, item string"), K, max_items=4)
    # c3 is too large, c2 has one distinct file, c5 one line
    assert rows(got) == [("g", "a", "b", 1.0), ("g", "a", "c", 1.0)]


def test_cochange_drops_one_giant_commit(spark):
    lines = [("g", "big", f"f{i}") for i in range(5000)] + [("g", "s", "f1"), ("g", "s", "f2")]
    got = graph.cochange_edges(spark.createDataFrame(lines, "g string, commit string, item string"), K)
    assert rows(got) == [("g", "f1", "f2", 1.0)]


def test_cochange_deals_pairs_by_the_number_of_lines(spark, monkeypatch):
    """No task counts the pairs of more lines than it should, however small the lines are."""
    monkeypatch.setattr(graph, "LINES_PER_TASK", 50)
    lines = spark.range(4000).selectExpr("'g' AS repo", "id div 4 AS commit", "id % 97 AS item")
    found = graph.cochange_edges(lines, ["repo"])
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert ", 80)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.sum("weight")).first()[0] == 6000


def test_hub_share_takes_the_top_twentieth(spark):
    rng = random.Random(5)
    edges = [(a, b) for a, b in combinations(range(60), 2) if rng.random() < 0.1]
    deg = Counter(x for e in edges for x in e)
    ranked = sorted(deg.values(), reverse=True)
    k = max(1, len(ranked) // 20)
    df = spark.createDataFrame([("g", str(a), str(b)) for a, b in edges], "g string, src string, dst string")
    assert graph.hub_share(df, K).first().hub_share == pytest.approx(sum(ranked[:k]) / sum(ranked))


def test_flat_is_tested_before_thin(spark):
    df = spark.createDataFrame([(-0.1, 0.01), (0.05, 0.05), (0.05, 0.5)], "d double, r double")
    assert [r[0] for r in df.select(graph.verdict("d", "r")).collect()] == ["FLAT", "THIN", "MEASURABLE"]


@pytest.fixture(scope="module")
def clustered(spark):
    rng, edges = random.Random(11), set()
    for block in range(3):
        nodes = [f"b{block}_{i}" for i in range(5)]
        edges |= {p for p in combinations(nodes, 2) if rng.random() < 0.9}
    edges |= {("b0_0", "b1_0"), ("b1_1", "b2_1")}
    data = [("x", a, b, 1.0) for a, b in edges] + [("y", a, b, 1.0) for a, b in combinations("abcd", 2)]
    return spark.createDataFrame(data, "g string, a string, b string, weight double")


def test_louvain_both_ways_agree_and_find_blocks(spark, clustered):
    small = community.louvain(clustered, K)
    large = community.louvain(clustered, K, small=0)
    assert rows(small) == rows(large)
    q = {r.g: r.q for r in graph.modularity(clustered, small, K).collect()}
    truth = spark.createDataFrame([("x", f"b{i}_{j}", f"b{i}") for i in range(3) for j in range(5)], "g string, node string, community string")
    assert q["x"] == pytest.approx(graph.modularity(clustered, truth, K).first().q)
    assert q["y"] == pytest.approx(0.0)  # a complete graph has no better partition than one unit


def test_both_ways_agree_next_to_other_graphs(spark):
    rng, edges = random.Random(4), []
    for g in range(4):
        nodes = [f"n{i:02}" for i in range(rng.randint(4, 24))]
        edges += [(f"g{g}", a, b, float(rng.randint(1, 3))) for a, b in combinations(nodes, 2) if rng.random() < 0.15]
    edges += [("chain", f"c{i:03}", f"c{i + 1:03}", 1.0) for i in range(12)]
    df = spark.createDataFrame(edges, "g string, a string, b string, weight double")
    alone = rows(community.louvain(df, K))
    assert alone == rows(community.louvain(df, K, small=0))
    assert rows(community.louvain(df.where("g = 'g3'"), K)) == [r for r in alone if r[0] == "g3"]
    assert rows(community.label_propagation(df, K)) == rows(community.label_propagation(df, K, small=0))


def test_label_propagation_both_ways_agree(clustered):
    assert rows(community.label_propagation(clustered, K)) == rows(community.label_propagation(clustered, K, small=0))


def test_number_rows_is_the_global_order(spark):
    data = [(i * 7919 % 1000, f"k{i % 3}") for i in range(1000)]
    got = keyed.number_rows(spark.createDataFrame(data, "v long, k string").repartition(7), ["v"]).collect()
    assert all(r.position == r.v for r in got)
    within = keyed.positions_within(spark.createDataFrame(data, "v long, k string"), ["k"], ["v"]).collect()
    for k in ("k0", "k1", "k2"):
        vals = sorted(r.v for r in within if r.k == k)
        assert {r.v: r.position for r in within if r.k == k} == {v: i for i, v in enumerate(vals)}


def test_top_k_is_exact(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS k")
    got = rows(keyed.top_k(df, ["k"], [df.id.desc()], 3), "k", "id")
    assert got == [(0, 994), (0, 996), (0, 998), (1, 995), (1, 997), (1, 999)]
