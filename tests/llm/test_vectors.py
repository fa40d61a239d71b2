import math

import numpy as np
import pytest

from loomery.llm import embed_dedup, vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def made(seed=0, n=160, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, dim))
    rows = []
    for k in range(n):
        v = base[rng.integers(30)] * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.3])
        rows.append((int(rng.integers(140)) if k > 150 else k, [float(np.float32(x)) for x in v], 1, 1))
    rows += [(500, rows[0][1], 1, 1), (501, rows[0][1], 2, 2), (502, None, 1, 1), (503, [0.0] * dim, 1, 1), (504, [math.nan] + [1.0] * (dim - 1), 1, 1), (505, [math.inf] + [1.0] * (dim - 1), 1, 1)]
    rows += [(506, [None] + [1.0] * (dim - 1), 1, 1), (507, [1.0, 2.0], 1, 1), (508, [2.0, 4.0], 1, 1), (None, rows[0][1], 1, 1), (50, rows[50][1], 3, 3), (509, [], 1, 1)]
    return rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))


@pytest.mark.parametrize(("block", "leaf"), [(4096, 512), (32, 8)])
def test_links_equal_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "LEAF", leaf)
    rows = made()
    ids = [r[0] for r in rows]
    rows = [r for r in rows if r[0] is None or ids.count(r[0]) == 1]
    ok = {r[0]: r[1] for r in rows if r[0] is not None and fine(r[1])}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and cosine(ok[i], ok[j]) >= 0.9} for i in ok}
    comp = {}
    for i in sorted(ok):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    want = sorted(((r[0], len(links.get(r[0], ())), comp.get(r[0], r[0]), r[0] is None or comp.get(r[0], r[0]) == r[0]) for r in rows), key=str)
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_repeated_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.1], 1, 1), (3, [0.0, 1.0], 1, 1)]
    got = {tuple(r) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}
    assert embed_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("shard", "leaf"), [(1000, 256), (40, 4)])
def test_search_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(vptree, "LEAF", leaf)
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    q = df.where("vec_id % 10 = 0")
    got = vptree.nearest(q, vptree.build_index(df, shard_rows=shard), 5).orderBy("query_id", "rank").collect()
    ok = [(r[0], r[1]) for r in rows if r[0] is not None and fine(r[1])]
    seen = set()
    for i, v in ok:
        if i % 10 or i in seen or [j for j, _ in ok].count(i) > 1:
            continue
        seen.add(i)
        best = {}
        for j, w in ok:
            if j != i and len(v) == len(w):
                best[j] = max(best.get(j, -2.0), cosine(v, w))
        want = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        mine = [(r.vec_id, r.score) for r in got if r.query_id == i]
        assert [r["rank"] for r in got if r.query_id == i] == list(range(1, len(want) + 1))
        assert [round(s, 9) for _, s in mine] == [round(s, 9) for _, s in want]
    assert seen


def test_factor_trades_recall(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    index = vptree.build_index(df)
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(df, index, 5).collect()}
    fast = {(r.query_id, r.vec_id) for r in vptree.nearest(df, index, 5, 0.5).collect()}
    assert len(exact & fast) >= 0.5 * len(exact)
    assert vptree.nearest(df.limit(0), index).count() == 0
    assert vptree.nearest(df, vptree.build_index(df.limit(0))).count() == 0


def test_copies_in_both_halves():
    n, dim = 3000, 16
    x = np.zeros((n, dim))
    x[:, 3] = 2.0
    order, nodes, radii = vptree.build(vptree.unit(x))
    # equal rows may come out at such a distance; the smallest ids lie in the far halves
    radii[radii == 0] = 2.1e-8
    ids = np.arange(n)[::-1].copy()
    best, who = vptree.search(x[:2], np.array([n, 1]), x[order], ids, nodes, radii, 5, 1.0)
    assert (best == 1).all() and who.tolist() == [[0, 1, 2, 3, 4], [0, 2, 3, 4, 5]]


def test_extreme_norms(spark):
    rows = [(1, [1e160, 0.0]), (2, [1e160, 1e150]), (3, [-1e-170, 0.0]), (4, [-1e-170, 1e-190]), (5, [0.0, 1.0]), (6, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)}
    best = {r.query_id: (r.vec_id, r.score) for r in vptree.nearest(df, vptree.build_index(df), 1).collect()}
    assert best == {1: (2, 1.0), 2: (1, 1.0), 3: (4, 1.0), 4: (3, 1.0), 5: (6, 1.0), 6: (5, 1.0)}


def test_repeated_query_ids_ask_once(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 3.0]), (0, [1.0, 3.0]), (1, [1.0, 2.9]), (2, [3.0, 1.1]), (0, [1.0, 3.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for n in (1, 4):
        got = vptree.nearest(df.where("vec_id = 0").repartition(n), vptree.build_index(df), 1).collect()
        assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]


def test_tiles_of_queries_meet_all_shards(spark, monkeypatch):
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(3).normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = sorted(map(tuple, vptree.nearest(df, vptree.build_index(df), 3).collect()))
    monkeypatch.setattr(vptree, "TILE_BYTES", 1000)
    monkeypatch.setattr(vptree, "GROUP_BYTES", 1500)
    assert sorted(map(tuple, vptree.nearest(df, vptree.build_index(df, shard_rows=20), 3).collect())) == want


def test_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "LEAF", 16)
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(size=(150, 6)) * s for c, s in ((rng.normal(size=6) * 3, 0.05), (rng.normal(size=6) * 3, 0.4))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id").collect())) == [(k, int(near[k].sum()), int(comp[k])) for k in range(len(x))]
