"""Every named query that has SQL against that SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from loomery import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    cell = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else round(float(v), 12) if isinstance(v, float) else str(v)
    return sorted(([cell(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def collected(spark, name):
    return [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]


def test_queries_without_sql_are_known():
    assert set(plans.QUERIES) - set(plans.SQL) == {"dominating_set", "catalogue", "alignment_rank", "pair_relations", "alignment_identity", "greedy_pairing", "pcoa", "pca", "sharing_normality", "forest_cv"}


def test_catalogue_dominates(spark, con):
    """Every order is a singleton, chosen, or next to a chosen one, and one that nothing stands for is chosen."""
    edges = plans.QUERIES["component_edges"](spark, SF).collect()
    chosen, every = {r[0] for r in collected(spark, "catalogue")}, {r[0] for r in con.execute("SELECT o_orderkey FROM orders").fetchall()}
    assert {r[1] for r in collected(spark, "dominating_set")} == chosen & {x for e in edges for x in (e.v0, e.v1)}
    assert chosen | {e.v1 for e in edges if e.v0 in chosen} == every
    # an edge points from the smaller key to the larger one, so each component's smallest node has nothing above it
    assert {e.component for e in edges} <= chosen


def test_pairs_by_alignment(spark, con):
    from loomery.operators import alignment

    text = dict(con.execute("SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark").fetchall())
    pairs = [r[:2] for r in collected(spark, "kmer_candidates")]
    ranks = {}
    for q, k, i, s in sorted(collected(spark, "alignment_rank")):
        assert s == alignment.local_score(text[q], text[i])
        ranks.setdefault(q, []).append((k, -s, i))
    assert sorted((q, i) for q, v in ranks.items() for _, _, i in v) == sorted(pairs)
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v) for v in ranks.values())
    codes = {(q, i): alignment.pair_class(text[q], text[i]) for q, i in pairs}
    assert {frozenset((a, b)) for a, _, b in collected(spark, "pair_relations")} == {frozenset(p) for p, c in codes.items() if c != "X"}
    for r in plans.QUERIES["alignment_identity"](spark, SF).collect():
        assert (r.score, r.identity, r.a_start, r.a_end, r.b_start, r.b_end) == alignment.align(text[r.query], text[r.id])


def test_greedy_pairing(spark):
    pairs, left, right, want = [(-s, a, b) for a, b, s in ((r.a, r.b, r.score) for r in plans.table_queries.overlaps(spark, SF).collect()) if s >= 0.05], set(), set(), set()
    for _, a, b in sorted(pairs):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    assert {r[:2] for r in collected(spark, "greedy_pairing")} == want


def test_ordinations(spark, con):
    import numpy as np

    d = con.execute(plans.SQL["city_block"]).fetchall()
    names = sorted({r[0] for r in d} | {r[1] for r in d})
    m = np.zeros((len(names), len(names)))
    for a, b, v in d:
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = v
    centred = -0.5 * (m**2 - (m**2).mean(0) - (m**2).mean(1)[:, None] + (m**2).mean())
    values = np.sort(np.linalg.eigvalsh(centred))[::-1]
    at = {}
    for row, axis, x, share in collected(spark, "pcoa"):
        at.setdefault(axis, {})[row] = x
        assert share == pytest.approx(max(values[axis], 0) / values[values > 0].sum())
    for axis, x in at.items():
        assert sum(v * v for v in x.values()) == pytest.approx(values[axis])
        assert centred @ [x[n] for n in names] == pytest.approx(values[axis] * np.array([x[n] for n in names]), abs=1e-3 * abs(values[0]))
    e = np.array([r[0] for r in con.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], dtype=float)
    got = np.array([r[1:] for r in sorted(collected(spark, "pca"))])
    assert np.sort(np.linalg.svd(e - e.mean(0), compute_uv=False))[::-1][:2] == pytest.approx(np.linalg.norm(got, axis=0))


def test_normality_of_shuffles(spark, con):
    from loomery.operators import stats

    counts = [float(r[1]) for r in con.execute(plans.SQL["shuffled_sharing_null"]).fetchall()]
    assert collected(spark, "sharing_normality") == [(*stats.shapiro(counts), len(counts))]


def test_forest_cv(spark, con):
    got = collected(spark, "forest_cv")
    rows = con.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert sorted(r[0] for r in got) == list(range(10)) and sum(r[1] for r in got) == rows and all(0 <= r[2] <= 1 for r in got)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
