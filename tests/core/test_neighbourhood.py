from loomery.plans import sequence_queries
from loomery.runtime import table

SF = "/root/testdata/sf0.001"


def test_every_order_hits_pages(spark):
    orders = {r[0] for r in table(spark, SF, "lineitem").select("l_orderkey").distinct().collect()}
    assert {r["query"] for r in sequence_queries.neighbourhood_lca(spark, SF).collect()} == orders
