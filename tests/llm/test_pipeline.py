import os

import duckdb
import pytest
import test_line_dedup
import test_minhash
import test_mixing
import test_models

import corpus_pipeline
from loomery.llm import piece_codec, quality_rules
from loomery.llm import queries as Q
from loomery.runtime import table

SF = "/root/testdata/sf0.001"
ODD = [(-1, None, None, None), (-2, "", "en", "src1"), (-3, " \n\t", None, "src2"), (-4, "one\n\ntwo words\none", "xx", None), (None, "a text of a document without an id that says a few plain things.", "en", "src1")]


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with odd rows, repeated rows, and columns that clash with names that operators use."""
    d = table(spark, SF, "documents")
    rows = [tuple(r) for r in d.collect()]
    rows += [(*r, len(r[1] or "")) for r in ODD] + rows[3:6]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", score string, _KEY int, component_id int, epoch string, _removed int, doc int"
    return spark.createDataFrame([(*r, "s", 1, 2, "e", 3, 4) for r in rows], schema)


def stage(spark, k, rows, docs):
    """What a stage keeps, and as it must: a list of rows."""
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, docs.schema), SF)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert all(r[5:] == rows[0][5:] for r in got) and all(r[4] == len(r[1]) for r in got if r[1] is not None)
    return got


def test_stages_equal_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    model = quality_rules.train(docs, table(spark, SF, "labels"))
    kept = stage(spark, 0, rows, docs)
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if test_models.plain_score(model, r[1]) >= quality_rules.CUT)
    # the odd rows go on to the other stages whatever the classifier says of them
    rows = kept + [r for r in rows if (r[0] is None or r[0] < 0) and r not in kept]

    kept = stage(spark, 1, rows, docs)
    assert sorted((str(r[0]), str(r[1])) for r in kept) == sorted((str(i), str(t)) for i, t in test_line_dedup.brute(rows))
    rows = kept

    kept = stage(spark, 2, rows, docs)
    groups = {i: c for i, _, c, _ in test_minhash.brute([r[:2] for r in rows], 80) if i is not None}
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted(set(groups.values()))
    assert [r for r in kept if r[0] is None] == [r for r in rows if r[0] is None] and {r[:2] for r in kept} <= {r[:2] for r in rows}
    rows = kept

    kept = stage(spark, 3, rows, docs)
    domain = lambda s: f"d{int(s[-1]) % 3 if s and s[-1].isdigit() else 0}"
    want = test_mixing.brute(rows, Q.MIX_SHARE, Q.MIX_WEIGHTS, 1, path=lambda r: (domain(r[3]), r[2], r[3]))
    assert sorted(str((r[0], r[1], domain(r[3]), r[2], r[3], 0, len(test_mixing.tokens(r[1])))) for r in kept) == want
    rows = kept

    out = corpus_pipeline.pieces(spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    sp = piece_codec.codec().sp
    assert sorted(str((r.doc_id, r.token_ids)) for r in out) == sorted(str((r[0], None if r[1] is None else sp.encode(r[1]))) for r in rows)
    assert all(r.round_trip for r in out)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        none = f(spark, spark.createDataFrame([], none.schema), SF)
        assert none.count() == 0


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < 200


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(Q.SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    norm = lambda d: sorted(str([None if v != v or v is None else v for v in r]) for r in d[sorted(want.columns)].astype(object).where(d.notna(), None).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)
