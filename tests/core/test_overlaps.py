from loomery.plans import table_queries


def test_whole_sets_overlap(spark, monkeypatch):
    rows = [(1, 10, 3.0), (1, 11, 50.0), (1, 11, 2.0), (2, 10, 4.0), (2, 12, 46.0), (3, 12, 1.0), (4, 99, 50.0)]
    line = spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double")
    monkeypatch.setattr(table_queries, "table", lambda *_: line)
    got = sorted(tuple(r) for r in table_queries.overlaps(spark, "").collect())
    assert got == [(1, 2, 0.5), (2, 3, 1.0)]
    assert sorted(tuple(r) for r in table_queries.greedy_pairing(spark, "").collect()) == [(1, 2, 0.5), (2, 3, 1.0)]


def test_pairs_are_not_shuffled(spark, monkeypatch):
    rows = [(s, p) for s in range(12) for p in range(6) if s % (p + 1) == 0] + [(1, None), (None, 0), (2, None)]
    line = spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint")
    monkeypatch.setattr(table_queries, "table", lambda *_: line)
    d = table_queries.overlaps(spark, "")
    plan = d._jdf.queryExecution().executedPlan().toString().splitlines()
    # the counts by pair need no shuffle of their own
    assert not [x for x in plan if "hashpartitioning(a#" in x and "b#" in x.split("hashpartitioning", 1)[1]]
    has = {s: {p for q, p in rows if q == s and p is not None} for s in range(12)}
    sizes = {s: sum(q == s for q, _ in rows) for s in range(12)}
    want = {(a, b): len(has[a] & has[b]) / min(sizes[a], sizes[b]) for a in has for b in has if a < b and has[a] & has[b]}
    assert {(r.a, r.b): r.score for r in d.collect()} == want


def test_pairs_meet_sizes_without_a_shuffle(spark):
    """Sizes are counted and broadcast, so the pairs of suppliers lie where they were made."""
    from loomery.plans import table_queries

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table_queries.overlaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_rounds_leave_one_table_of_scores(spark, monkeypatch):
    from loomery.operators import graph
    from loomery.runtime import Scratch

    made = []
    monkeypatch.setattr(graph, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    # each round pairs one row only
    rows = [(k, k, 1.0 - k / 100) for k in range(4)] + [(k + 1, k, 1.0 - k / 100 - 0.005) for k in range(4)]
    got = graph.best_pairing(spark.createDataFrame(rows, "a bigint, b bigint, score double"), 0.5)
    assert sorted(r[:2] for r in got.collect()) == [(k, k) for k in range(4)]
    assert sum(p.endswith("scores") for p in made[0].paths) == 1
