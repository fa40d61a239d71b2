import math
import random

import numpy as np
import pytest

from loomery.operators import matrix, sampling, stats


def test_p_values_match_tables():
    assert stats.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    t = 2.228139  # 10 degrees of freedom
    assert stats.student_p(t / math.sqrt(10 + t * t), 12) == pytest.approx(0.05, abs=1e-6)
    assert stats.fisher_p(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-5)
    assert stats.fisher_p(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-5)


def test_normality():
    # weights of eleven men, the example of the test's authors
    w, p = stats.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == (pytest.approx(0.78881, abs=1e-4), pytest.approx(0.006704, abs=1e-4))
    rng = np.random.default_rng(4)
    assert np.mean([stats.shapiro(rng.normal(size=30).tolist())[1] < 0.05 for _ in range(400)]) == pytest.approx(0.05, abs=0.035)
    assert stats.shapiro(rng.exponential(size=60).tolist())[1] < 0.01
    assert stats.shapiro([1.0, 1.0, 1.0]) == (1.0, 1.0) and stats.shapiro([1.0, 2.0, 3.0]) == (pytest.approx(1.0), pytest.approx(1.0))
    with pytest.raises(ValueError, match="3 to"):
        stats.shapiro([1.0])


def test_shared_under_shuffles(spark):
    rng = np.random.default_rng(2)
    seen = {(int(rng.integers(9)), int(rng.integers(30))) for _ in range(80)}
    labels = {(r, s): str(rng.integers(3)) for r in range(5) for s in range(8)}
    want = {}
    for r in range(5):
        by = {}
        for s, e in seen:
            if (r, s) in labels:
                by.setdefault(e, set()).add(labels[r, s])
        want[r] = sum(len(c) > 1 for c in by.values())
    got = sampling.shared_under(spark.createDataFrame(sorted(seen), "sample bigint, entity bigint"), spark.createDataFrame([(r, s, c) for (r, s), c in labels.items()], "replicate int, sample bigint, category string"), 5)
    assert {r.replicate: r.shared for r in got.collect()} == want


def test_rarefied_depth(spark):
    df = spark.createDataFrame([(s, e, (s + 1) * e) for s in range(3) for e in range(1, 40)], "sample bigint, entity bigint, n bigint")
    got = sampling.rarefied(df, 800).groupBy("sample").sum("n").collect()
    assert {tuple(r) for r in got} == {(1, 800), (2, 800)}  # sample 0 is too shallow
    assert sampling.rarefied(df, 780).join(df.withColumnRenamed("n", "m"), ["sample", "entity"]).where("n > m").count() == 0
    assert sampling.rarefied(df, 780).where("sample = 0").count() == 39


def test_linkage_and_coordinates(spark):
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], dtype=float)
    assert matrix.average_linkage(d) == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 4.5)]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(25, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    members = {k: [k] for k in range(25)}
    for n, (i, j, h) in enumerate(matrix.average_linkage(d), 25):
        assert h == pytest.approx(np.mean([d[p, q] for p in members[i] for q in members[j]]))
        assert h == pytest.approx(min(np.mean([d[p, q] for p in members[a] for q in members[b]]) for a in members for b in members if a < b))
        members[n] = members.pop(i) + members.pop(j)
    assert sorted(members[48]) == list(range(25))
    rows = [(a, b, abs(a - b) * 1.0) for a in range(5) for b in range(a + 1, 5)]
    names, at, share = matrix.principal_coordinates(spark.createDataFrame(rows, "a bigint, b bigint, d double"), 1)
    assert np.allclose(np.abs(np.diff(at[:, 0])), 1.0) and share[0] == pytest.approx(1.0) and names == list(range(5))


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    mean, axes = matrix.principal_components(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v")
    assert np.allclose(mean, x.mean(axis=0)) and abs(axes[0, 0]) > 0.99


@pytest.mark.parametrize("kind", ["city", "squared"])
def test_pairwise_in_blocks(spark, monkeypatch, kind):
    """Features of few and of many rows, rows without any cell, negative values, nulls; no shuffle holds pairs."""
    rng = random.Random(5)
    n = 230
    cells = [(r, f, rng.choice([-2.5, -1.0, 0.0, 1.0, 3.0])) for r in range(n) for f in range(12) if rng.random() < (0.9 if f < 3 else 0.05)]
    rows = [(r, f"f{f}", v) for r, f, v in cells] + [(r, "f0", 0.0) for r in range(n)] + [(3, None, 9.0), (4, "f1", None), (None, "f1", 1.0)]
    monkeypatch.setattr(matrix, "BLOCK_ROWS", 50)
    d = matrix.pairwise(spark.createDataFrame(rows, "row bigint, feature string, value double"), kind)
    got = {(r.a, r.b): r.d for r in d.collect()}
    x = np.zeros((n, 12))
    for r, f, v in cells:
        x[r, f] = v
    e = x[:, None] - x
    want = (e * e if kind == "squared" else np.abs(e)).sum(2)
    assert len(got) == n * (n - 1) // 2
    assert all(a < b and v == pytest.approx(want[a, b]) for (a, b), v in got.items())
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_accumulation_repeats_no_rows(spark):
    """Against brute force, with repeated rows and a threshold that nothing reaches; nothing is shuffled by permutation and entity."""
    rng = random.Random(3)
    rows = [(s, e) for s in range(9) for e in range(40) if rng.random() < (e + 1) / 60]
    seen = spark.createDataFrame(rows + rows[:30], "sample bigint, entity bigint")
    perms = sampling.permutations(seen, 5)
    steps, has = {(r.perm, r.sample): r.step for r in perms.collect()}, {}
    for s, e in rows:
        has.setdefault(e, set()).add(s)
    count = lambda p, k, t: sum(len(v) >= t and min(steps[p, s] for s in v) <= k for v in has.values())
    n = len({s for s, _ in rows})
    curve, cuts = sampling.accumulation(seen, perms), sampling.accumulation_by_threshold(seen, perms, [6, 1, 99])
    assert {tuple(r) for r in curve.collect()} == {(p, k, count(p, k, 1)) for p in range(5) for k in range(1, n + 1)}
    assert {tuple(r) for r in cuts.collect()} == {(p, k, t, count(p, k, t)) for p in range(5) for k in range(1, n + 1) for t in (1, 6, 99)}
    for d in (curve, cuts):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "perm" in x and "entity" in x]


def test_shared_under_shuffles_pairs_only(spark):
    """Labels by replicate are not shuffled with the rows; a null label is none."""
    seen = spark.createDataFrame([(1, 10), (2, 10), (1, 10), (1, 11), (3, 11), (2, 12)], "sample bigint, entity bigint")
    labels = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, None), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "replicate int, sample bigint, category string")
    got = sampling.shared_under(seen, labels, 2)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (1, 1)]
    assert sum("hashpartitioning(entity" in x for x in plan) == 1 and all("REPARTITION" in x for x in plan if "hashpartitioning(entity" in x)


def test_principal_coordinates_of_many_rows(spark, monkeypatch):
    """Neither the driver's limit nor the way to the vectors changes the result."""
    x = np.random.default_rng(7).standard_normal((60, 3)) * [9, 4, 1]
    d = np.abs(x[:, None] - x).sum(2)
    rows = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(60) for j in range(i + 1, 60)], "a bigint, b bigint, d double")
    names, want, share = matrix.principal_coordinates(rows)
    monkeypatch.setattr(matrix, "MAX_ROWS", 50)
    monkeypatch.setattr(matrix, "SMALL", 10)
    again, got, same = matrix.principal_coordinates(rows)
    assert names == again == list(range(60)) and same == pytest.approx(share)
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_principal_coordinates_of_equal_rows(spark, tmp_path, monkeypatch):
    """Rows that are equal meet the others once: copies of two tables give each row's coordinates again, from as many pairs as one copy has."""
    from loomery import plans

    rng = np.random.default_rng(11)
    lines = [(s, p, float(rng.integers(1, 50))) for s in range(20) for p in range(12) if rng.random() < 0.6] + [(20, 12, 3.0), (21, 12, 3.0), (22, 12, 0.0), (None, 1, 4.0)]
    for k, copies in (("one", 1), ("many", 4)):
        spark.createDataFrame([(c * 100 + s if s is not None else None, c * 100 + p, q) for s, p, q in lines for c in range(copies)], "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        spark.createDataFrame([(c * 100 + p, f"b{p % 5}" if p < 12 else None) for p in range(13) for c in range(copies)], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/{k}/part.parquet")
    x, met = np.zeros((23, 5)), []
    for s, p, q in lines:
        if s is not None and p < 12:
            x[s, p % 5] += q
    full = matrix.principal_coordinates
    monkeypatch.setattr(matrix, "principal_coordinates", lambda d, *a, **b: met.append(d.count()) or full(d, *a, **b))
    for k, copies in (("one", 1), ("many", 4)):
        e = np.tile(x, (copies, 1))
        d = np.abs(e[:, None] - e).sum(2) ** 2
        centred = -0.5 * (d - d.mean(0) - d.mean(1)[:, None] + d.mean())
        values, vectors = np.linalg.eigh(centred)
        got = {(r.row, r.axis): (r.coordinate, r.explained) for r in plans.QUERIES["pcoa"](spark, f"{tmp_path}/{k}").collect()}
        assert len(got) == 3 * len(e)
        for axis in range(3):
            at = np.array([got[c * 100 + s, axis][0] for c in range(copies) for s in range(23)])
            want = vectors[:, -1 - axis] * np.sqrt(values[-1 - axis])
            assert at * np.sign(at @ want) == pytest.approx(want, abs=1e-6)
            assert got[0, axis][1] == pytest.approx(values[-1 - axis] / values[values > 0].sum())
    # the last three rows have no cell that is not zero
    assert met == [21 * 20 // 2] * 2


def test_coordinates_of_few_distinct_rows(spark):
    """As many axes as rows allow, whether they differ or not; without two rows none."""
    kinds = spark.createDataFrame([(1, 2), (5, 3)], "row bigint, n bigint")
    names, at, share = matrix.principal_coordinates(spark.createDataFrame([(1, 5, 2.0)], "a bigint, b bigint, d double"), times=kinds)
    assert names == [1, 5] and share == pytest.approx([1, 0, 0])
    assert np.abs(at) == pytest.approx(np.array([[1.2, 0, 0], [0.8, 0, 0]]), abs=1e-9)
    none = spark.createDataFrame([], "a bigint, b bigint, d double")
    names, at, share = matrix.principal_coordinates(none, times=kinds.limit(1))
    assert (len(names), at.shape, at.any(), share.any()) == (1, (1, 2), False, False)
    assert matrix.principal_coordinates(none)[0] == matrix.principal_coordinates(none, times=kinds.limit(1).withColumn("n", kinds.n - 1))[0] == []
    of, equal = matrix.alike(spark.createDataFrame([(1, "x", 2.0), (2, "x", 2.0), (2, "y", -0.0), (3, "x", None), (4, None, 7.0), (None, "x", 1.0)], "row bigint, feature string, value double"))
    assert sorted(tuple(r) for r in of.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)] and sorted((r.first, r.n) for r in equal.select("first", "n").collect()) == [(1, 2), (3, 2)]
    assert matrix.alike(spark.createDataFrame([(1, None, 2.0), (2, None, 2.0)], "row bigint, feature string, value double"))[0].count() == 0


@pytest.mark.parametrize("n", [61, 64])
def test_principal_coordinates_in_tiles(spark, monkeypatch, n):
    """A matrix that no task holds has the same shares and coordinates; a missing pair is a distance of zero, and rows have weights."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 4)) * [9, 4, 2, 1]
    d = np.abs(x[:, None] - x).sum(2)
    pairs = spark.createDataFrame([(i * 3, j * 3, float(d[i, j])) for i in range(n) for j in range(i + 1, n) if (i, j) != (2, 5)], "a bigint, b bigint, d double").repartition(5)
    times = spark.createDataFrame([(i * 3, 1 + i % 3) for i in range(n)], "row bigint, n int")
    names, want, share = matrix.principal_coordinates(pairs, times=times)
    for k, v in (("TASK_ROWS", n - 1), ("TILE", 16), ("TILED_ROWS", 32), ("TILE_PAIRS", 300)):
        monkeypatch.setattr(matrix, k, v)
    monkeypatch.setattr(np.linalg, "eigvalsh", None)
    again, got, same = matrix.principal_coordinates(pairs, times=times)
    assert names == again and same == pytest.approx(share, rel=1e-12)
    assert got * np.sign((got * want).sum(0)) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize(("n", "b"), [(37, 5), (40, 8), (9, 4), (5, 8)])
def test_values_of_a_band(n, b):
    rng = np.random.default_rng(n)
    size = [min(b, n - k) for k in range(0, n, b)]
    diagonal = [z + z.T for z in (rng.standard_normal((s, s)) for s in size)]
    band = matrix.Band(diagonal, [np.triu(rng.standard_normal((q, p))) for p, q in zip(size, size[1:], strict=False)])
    want = np.linalg.eigvalsh(band @ np.eye(n))
    assert matrix.tridiagonal_values(*band.tridiagonal()) == pytest.approx(want, abs=1e-12)
    v, t, r = matrix.reflections(diagonal[0][:, :3])
    q = np.eye(len(v)) - v @ t @ v.T
    assert q @ np.pad(r, ((0, len(v) - len(r)), (0, 0))) == pytest.approx(diagonal[0][:, :3]) and q.T @ q == pytest.approx(np.eye(len(v)))


def test_within_category_in_blocks(spark, monkeypatch):
    """Every pair of a label once, across blocks; null, broken and shorter vectors have no distance."""
    monkeypatch.setattr(matrix, "VECTOR_ROWS", 8)
    x = np.random.default_rng(2).standard_normal((50, 4))
    rows = [(i, x[i].tolist(), i % 2 if i < 45 else None) for i in range(50)] + [(60, None, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, [1.0, 2.0], 0)]
    d = matrix.within_category(spark.createDataFrame(rows, "id bigint, e array<float>, label int"), "label", "id", "e")
    plan = d._jdf.queryExecution().executedPlan().toString()
    got, x = {(r.label, r.a, r.b): r.d for r in d.collect()}, x.astype(np.float32).astype(float)
    ids = {c: [r[0] for r in rows if r[2] == c] for c in (0, 1)}
    assert set(got) == {(c, a, b) for c, v in ids.items() for a in v for b in v if a < b}
    assert all((v is None) if b >= 60 else v == pytest.approx(np.linalg.norm(x[a] - x[b])) for (_, a, b), v in got.items())
    assert "MapInArrow" in plan


def test_pairwise_of_wide_blocks(spark, monkeypatch):
    """Many rows lie in few blocks, as each block goes to all others; slabs of them meet, and every pair leaves once."""
    monkeypatch.setattr(matrix, "BLOCK_ROWS", 20)
    monkeypatch.setattr(matrix, "MOST_BLOCKS", 3, raising=False)
    rng = random.Random(8)
    x = np.array([[rng.choice([0.0, 0.0, 1.0, 2.5]) for _ in range(6)] for _ in range(190)])
    rows = spark.createDataFrame([(i, f"f{k}", float(v)) for i, r in enumerate(x) for k, v in enumerate(r)], "row bigint, feature string, value double")
    assert matrix.row_blocks(rows)[1] == 3
    got = [(r.a, r.b, r.d) for r in matrix.pairwise(rows).collect()]
    e = ((x[:, None] - x) ** 2).sum(2)
    assert sorted(got) == [(i, j, pytest.approx(e[i, j])) for i in range(190) for j in range(i + 1, 190)]


def test_family_matrix_shuffles_lines_once(spark):
    from loomery.plans import table_queries

    plan = table_queries.family_matrix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [x.split("(")[1].split("#")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "entity" not in x and "feature" not in x] == ["l_partkey"]
    assert sum("Exchange hashpartitioning(" in x for x in plan.splitlines()) == 3


@pytest.mark.parametrize("fits", [True, False])
def test_folds_by_entity(spark, monkeypatch, fits):
    """A null entity, one of many samples, repeated rows and unknown samples; with and without a matrix in each task."""
    rng = random.Random(6)
    for name, value in {"BESIDE": 4, "FOLDED": 7, "TASK_ROWS": 20, **({} if fits else {"BY_SAMPLE_BYTES": 0})}.items():
        monkeypatch.setattr(sampling, name, value, raising=False)
    rows = [(s, 1) for s in range(60)] + [(s, None) for s in (3, 5, 3)] + [(rng.randrange(60), rng.randrange(2, 40)) for _ in range(150)]
    seen = spark.createDataFrame(rows + [(None, 7), (99, 8)], "sample bigint, entity bigint")
    has = {}
    for s, e in rows:
        has.setdefault(e, set()).add(s)
    labels = {(r, s): rng.choice(["a", "b", "c", None]) for r in range(3) for s in range(60)}
    got = sampling.shared_under(seen, spark.createDataFrame([(r, s, c) for (r, s), c in labels.items()], "replicate int, sample bigint, category string"), 3)
    want = {(r, n) for r in range(3) if (n := sum(len({labels[r, s] for s in v} - {None}) > 1 for v in has.values()))}
    assert {tuple(x) for x in got.collect()} == want
    perms = sampling.permutations(spark.createDataFrame([(s,) for s in range(60)], "sample bigint"), 3)
    steps = {(r.perm, r.sample): r.step for r in perms.collect()}
    cuts = sampling.accumulation_by_threshold(seen, perms, [5, 1])
    count = lambda p, k, t: sum(len(v) >= t and min(steps[p, s] for s in v) <= k for v in has.values())
    assert {tuple(r) for r in cuts.collect()} == {(p, k, t, count(p, k, t)) for p in range(3) for k in range(1, 61) for t in (1, 5)}
    empty = sampling.accumulation(seen.where("sample < 0"), perms)
    assert sorted(tuple(r) for r in empty.collect()) == [(p, k, 0) for p in range(3) for k in range(1, 61)]
    if fits:
        # entities are not held as two values for each replicate or one for each permutation
        assert all("keys=[entity" not in x._jdf.queryExecution().executedPlan().toString() for x in (got, cuts))
