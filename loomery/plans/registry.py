"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """
WITH c AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL),
s AS (SELECT c.*, p.p_brand, n / p.p_size AS r FROM c JOIN part p ON p_partkey = l_partkey),
t AS (SELECT *, r * sum(n) OVER (PARTITION BY l_suppkey) / sum(r) OVER (PARTITION BY l_suppkey) AS scaled FROM s)
SELECT l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN '-uncharacterized-' ELSE p_brand END AS family, round(sum(scaled), 4) AS scaled FROM t GROUP BY ALL"""
)
def family_rollup_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    from pyspark.sql.window import Window

    c = line.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("n"))
    s = c.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand"), "l_partkey").withColumn("r", F.col("n") / F.col("p_size"))
    w = Window.partitionBy("l_suppkey")
    t = s.withColumn("scaled", F.col("r") * F.sum("n").over(w) / F.sum("r").over(w))
    family = F.when(F.col("l_partkey") % 7 == 0, "-uncharacterized-").otherwise(F.col("p_brand"))
    return t.groupBy("l_suppkey", family.alias("family")).agg(F.round(F.sum("scaled"), 4).alias("scaled"))
