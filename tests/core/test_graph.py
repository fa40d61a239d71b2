import random

import pytest

from loomery.operators import graph, relations

CASES = [
    ([(0, 1)], {0}),
    ([(15, 28)], {15}),
    ([(28, 15)], {28}),
    ([(47, 15)], {47}),
    ([(1, 0), (1, 0)], {1}),
    ([(0, 1), (0, 2)], {0}),
    ([(0, 1), (1, 2)], {0, 1}),
    ([(0, 1), (1, 2), (2, 3)], {0, 2}),
]


@pytest.mark.parametrize(("edges", "want"), CASES)
def test_dominators(edges, want):
    assert set(graph.dominators(edges)) == want


def test_large_components_are_dominated():
    rng = random.Random(1)
    for _ in range(20):
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(80)]
        chosen = set(graph.dominators(edges))
        nodes = {x for e in edges for x in e}
        assert chosen | {v for u, v in edges if u in chosen} == nodes
        assert nodes - {v for u, v in edges if u != v} <= chosen


def test_dominating_set(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (12, 47, 15)], "component bigint, v0 bigint, v1 bigint")
    assert {tuple(r) for r in graph.dominating_set(df).collect()} == {(0, 0), (0, 1), (12, 47)}


def test_many_components_in_few_partitions(spark):
    rng = random.Random(5)
    edges = [(c, 100 * c + rng.randrange(9), 100 * c + rng.randrange(9)) for c in range(200) for _ in range(rng.randint(1, 12))]
    want = {(c, n) for c in {e[0] for e in edges} for n in graph.dominators([e[1:] for e in edges if e[0] == c])}
    for n in (1, 5):
        got = graph.dominating_set(spark.createDataFrame(edges, "component bigint, v0 bigint, v1 bigint").repartition(n))
        assert {tuple(r) for r in got.collect()} == want
    assert graph.dominating_set(spark.createDataFrame([], "component bigint, v0 bigint, v1 bigint")).count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(5, 5), (900, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(r) for r in got.collect()} == {(x, find(x)) for x in list(root)}
    assert got.count() == len(root)
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pairing_is_greedy(spark):
    rng = random.Random(3)
    rows = [(a, b, rng.randrange(1, 9) / 10) for a in range(8) for b in range(8) if rng.random() < 0.6]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s >= 0.3 and a not in left and b not in right:
            left.add(a), right.add(b)
            want.add((a, b, s))
    got = graph.best_pairing(spark.createDataFrame(rows, "a bigint, b bigint, score double"), 0.3)
    assert {tuple(r) for r in got.collect()} == want


def test_relations(spark):
    pairs = spark.createDataFrame([("a", "=", "b"), ("a", "D", "c"), ("d", "W", "e"), ("f", "E", "g"), ("h", "X", "i")], "a string, code string, b string")
    assert {tuple(r) for r in relations.normalised(pairs).collect()} == {("a", "=", "b"), ("c", "C", "a"), ("e", "R", "d"), ("f", "R", "g"), ("g", "R", "f")}
    r = spark.createDataFrame([("a", "R", "b"), ("a", "C", "b"), ("c", "R", "d")], "src string, rel string, dst string")
    assert {tuple(x) for x in relations.collapse(r).collect()} == {("a", "C", "b"), ("c", "R", "d")}
    bad = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c")], r.schema)
    with pytest.raises(Exception, match="cannot compose"):
        relations.compose(bad, bad).collect()
    names = spark.createDataFrame([("a", 1), ("b", 2)], "name string, ordinal bigint")
    assert relations.encode_ends(r.where("src = 'a'"), names, "src", "dst").select("src_ix", "dst_ix").distinct().first() == (1, 2)
    with pytest.raises(Exception, match="unknown name"):
        relations.encode_ends(r, names, "src", "dst").collect()
