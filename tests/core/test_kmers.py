from loomery.operators import kmers
from loomery.plans import sequence_queries


def test_every_match_is_ranked(spark, monkeypatch):
    text = "a benchmark passage that leaked into very many documents"
    docs = spark.createDataFrame([(k, text if k < 6 else f"so {text}") for k in range(8)], "id bigint, seq string")
    items = spark.createDataFrame([(-1, text)], "id bigint, seq string")
    monkeypatch.setattr(sequence_queries, "sequences", lambda *_: docs)
    monkeypatch.setattr(sequence_queries, "probes", lambda *_: items)
    got = sequence_queries.alignment_rank(spark, "").orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(k + 1, k) for k in range(8)]
    pairs = items.select("id").withColumnRenamed("id", "query").crossJoin(docs.select("id"))
    assert kmers.ranked(pairs, items, docs, 3).count() == 3
