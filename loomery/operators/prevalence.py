"""Prevalence, richness and the sets of categories that entities reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL = "all"


def prevalence(seen: DataFrame) -> DataFrame:
    """Distinct samples by (category, entity), and by entity under category ``all``; seen: sample, category, entity.

    A sample belongs to one category, so the total is the sum of the categories' counts and costs no second pass
    over the rows: only the counts are added up.
    """
    each = seen.select("sample", "category", "entity").distinct().groupBy("category", "entity").agg(F.count("*").alias("n_samples"))
    total = each.groupBy("entity").agg(F.sum("n_samples").alias("n_samples")).select(F.lit(ALL).alias("category"), "entity", "n_samples")
    return each.unionByName(total)


def dense_histogram(counts: DataFrame, value: str = "n_samples") -> DataFrame:
    """Entities by (category, count) from 0 to the overall maximum, zeros filled in. 0 counts no entity."""
    top = counts.agg(F.max(value).alias("top"))
    spine = counts.select("category").distinct().crossJoin(F.broadcast(top)).select("category", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("count"))
    h = counts.groupBy("category", F.col(value).cast("int").alias("count")).agg(F.count("*").alias("entities"))
    return spine.join(h, ["category", "count"], "left").select("category", "count", F.coalesce("entities", F.lit(0)).cast("bigint").alias("entities"))


def cumulative_share(histogram: DataFrame) -> DataFrame:
    """Share of entities at or below each count, and the step from the one before."""
    w = Window.partitionBy("category").orderBy("count")
    run = F.sum("entities").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("entities").over(Window.partitionBy("category"))
    return histogram.withColumn("share", run).withColumn("step", F.col("entities") - F.lag("entities", 1, 0).over(w))


def richness(mapped: DataFrame, by: str = "sample", key: str = "key") -> DataFrame:
    """Distinct keys of each sample: named ones, and with one more when any entity has no key."""
    named = F.count_distinct(key)
    return mapped.groupBy(by).agg(named.alias("named"), (named + F.max(F.col(key).isNull().cast("int"))).alias("with_unmapped"))


def category_sets(reached: DataFrame) -> DataFrame:
    """entity, cats: the sorted set of categories of each entity."""
    return reached.groupBy("entity").agg(F.array_sort(F.collect_set("category")).alias("cats"))


def set_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("cats").agg(F.count("*").alias("n"))


def set_marginals(counted: DataFrame, apart: str) -> DataFrame:
    """By category: entities with it, with it alone, and with another one besides (``apart`` not counting)."""
    c = counted.withColumn("category", F.explode("cats")).withColumn("others", F.size(F.filter("cats", lambda x: x != apart)))
    return c.groupBy("category").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.size("cats") == 1, F.col("n"))), F.lit(0)).alias("only"), F.coalesce(F.sum(F.when(F.col("others") > 1, F.col("n"))), F.lit(0)).alias("multiple")
    )


def set_pairs(counted: DataFrame) -> DataFrame:
    """Entities by unordered pair of categories."""
    p = counted.select("n", F.explode("cats").alias("a"), "cats").select("n", "a", F.explode("cats").alias("b")).where("a < b")
    return p.groupBy("a", "b").agg(F.sum("n").alias("n"))


def shared_share(counted: DataFrame) -> DataFrame:
    """1 - (entities with the category alone / entities with it)."""
    c = counted.withColumn("category", F.explode("cats"))
    return c.groupBy("category").agg((1 - F.coalesce(F.sum(F.when(F.size("cats") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("shared"))


def travellers(sets: DataFrame, apart: str) -> DataFrame:
    """Entities in more than one category, ``apart`` not counting."""
    return sets.where(F.size(F.filter("cats", lambda x: x != apart)) > 1)


def flow(abundance: DataFrame, sets: DataFrame) -> DataFrame:
    """By source category, the relative abundance of entities that target categories hold too; ``unshared`` otherwise.

    abundance: category, entity, value. A source's share with itself is the part of entities that it shares at all.
    """
    total = F.sum("value").over(Window.partitionBy("category"))
    a = abundance.withColumn("share", F.try_divide("value", total)).join(sets, "entity")
    pairs = a.where(F.size("cats") > 1).select(F.col("category").alias("source"), F.explode("cats").alias("target"), "share")
    alone = a.where(F.size("cats") <= 1).select(F.col("category").alias("source"), F.lit("unshared").alias("target"), "share")
    return pairs.unionByName(alone).groupBy("source", "target").agg(F.sum("share").alias("share"))


def raw_flow(sets: DataFrame) -> DataFrame:
    """Entities by ordered pair of categories, plus ``unshared`` and ``total`` columns as rows."""
    s = sets.select("cats", F.explode("cats").alias("source"))
    pairs = s.select("source", F.explode("cats").alias("target")).where("source <> target")
    alone = s.where(F.size("cats") == 1).select("source", F.lit("unshared").alias("target"))
    total = s.select("source", F.lit("total").alias("target"))
    return pairs.unionByName(alone).unionByName(total).groupBy("source", "target").agg(F.count("*").alias("n"))


def rare(counts: DataFrame, at_most: int, value: str = "n_samples") -> DataFrame:
    return counts.where(F.col(value) <= at_most)
