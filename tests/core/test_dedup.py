import random

from loomery.operators import dedup
from loomery.plans import sequence_queries


def brute(rows, least):
    kept = {}
    for i, t in rows:
        if i is not None and t is not None and len(t) >= least:
            kept[t] = min(i, kept.get(t, i))
    return sorted((i, "C", j) for t, i in kept.items() for u, j in kept.items() if len(t) < len(u) and t in u)


def test_contained_equals_brute_force(spark):
    rng = random.Random(7)
    long = ["".join(rng.choice("abcdefgh \u00e9\u4e2d") for _ in range(400)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(long)]
    for k in range(60):
        t = rng.choice(long)
        a = rng.randrange(300)
        rows.append((100 + k, t[a : a + rng.randint(25, 100)]))
    # near copies that share their beginnings, cut at different ends, and copies
    rows += [(200 + k, long[0][: 40 + k]) for k in range(30)] + [(300, long[0][:45]), (-4, long[0][:50]), (400, None), (None, long[3][:80])]
    rows += [(500, "x" * 30), (501, "x" * 90), (502, "x" * 29), (503, "y" * 31)]
    got = dedup.contained(spark.createDataFrame(rows, "id bigint, seq string"), 30)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 30)


def test_documents_in_documents(spark, monkeypatch):
    quoted = "a passage of some length that another document quotes in full"
    docs = spark.createDataFrame([(1, quoted), (2, f"as they said: {quoted}, which is true"), (3, "nothing of this is in any of the other documents")], "id bigint, seq string")
    items = spark.createDataFrame([(-1, quoted[:40])], "id bigint, seq string")
    monkeypatch.setattr(sequence_queries, "sequences", lambda *_: docs)
    monkeypatch.setattr(sequence_queries, "probes", lambda *_: items)
    assert sorted(tuple(r) for r in sequence_queries.containment_pairs(spark, "").collect()) == [(-1, "C", 1), (-1, "C", 2), (1, "C", 2)]
    assert sorted(r.id for r in sequence_queries.unexplained(spark, "").collect()) == [2, 3]


def test_places_without_gaps_or_with(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-500, 100_000), 300))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    for slices in (1, 7, 4096):
        assert {r.id: r.batch for r in dedup.batches(df, "id", 64, slices).collect()} == {i: k // 64 for k, i in enumerate(ids)}
    assert dedup.batches(df.limit(0), "id", 64).count() == 0


def test_cut_by_size(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k, "x" * rng.choice([0, 1, 5, 30])) for k in range(200)]
    want, held, piece = {}, {}, {}
    for p, k, t in rows:
        if p not in held:
            held[p], piece[p] = len(t), 0
        elif held[p] + len(t) > 20:
            held[p], piece[p] = len(t), piece[p] + 1
        else:
            held[p] += len(t)
        want[p, k] = piece[p]
    got = dedup.cut_by_size(spark.createDataFrame(rows, "part string, id bigint, seq string").repartition(4), 20)
    assert {(r.part, r.id): r.piece for r in got.collect()} == want
