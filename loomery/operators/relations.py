"""Typed relations (src, rel, dst): = identical, C contained in, R represented by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composed(left: Column, right: Column) -> Column:
    """The relation of two steps: the first must be = or C."""
    ok = left.isin("=", "C")
    return F.when(ok & (right == "R"), "R").when(ok & (right == "C"), "C").when(ok & (right == "="), left).otherwise(F.raise_error(F.concat(F.lit("cannot compose "), left, F.lit(" and "), right)))


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two-step relations over left.dst = right.src, each once."""
    r = right.select(F.col("src").alias("_mid"), F.col("rel").alias("_rel"), F.col("dst").alias("_end"))
    return left.join(r, F.col("dst") == F.col("_mid")).select("src", composed(F.col("rel"), F.col("_rel")).alias("rel"), F.col("_end").alias("dst")).distinct()


def collapse(relations: DataFrame) -> DataFrame:
    """One relation for each (src, dst): C beats R. Other repeated codes are an error."""
    g = relations.groupBy("src", "dst").agg(F.min("rel").alias("rel"), F.array_sort(F.collect_set("rel")).alias("_all"))
    bad = (F.size("_all") > 1) & (F.array_join("_all", "") != "CR")
    return g.select("src", F.when(bad, F.raise_error(F.lit("conflicting relations"))).otherwise(F.col("rel")).alias("rel"), "dst")


def unexplained(keys: DataFrame, *relations: DataFrame) -> DataFrame:
    """Keys that no relation starts from."""
    out = keys
    for r in relations:
        out = out.join(r.select(F.col("src").alias(keys.columns[0])), keys.columns[0], "left_anti")
    return out


def filter_ends(relations: DataFrame, keys: DataFrame, either: bool = False) -> DataFrame:
    """Relations whose right end, or with ``either`` any end, is listed."""
    k = keys.columns[0]
    right = relations.join(keys, relations.dst == keys[k], "left_semi")
    return right.unionByName(relations.join(keys, relations.src == keys[k], "left_semi")).distinct() if either else right


def normalised(pairs: DataFrame) -> DataFrame:
    """Classified pairs (a, code, b) as relations: D is C turned round, M and W are R, E is R both ways, X goes."""
    turned = F.col("code").isin("D", "W")
    rel = F.when(F.col("code").isin("M", "W", "E"), "R").when(F.col("code") == "D", "C").otherwise(F.col("code"))
    one = pairs.where("code <> 'X'").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), rel.alias("rel"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("dst"))
    back = pairs.where("code = 'E'").select(F.col("b").alias("src"), F.lit("R").alias("rel"), F.col("a").alias("dst"))
    return one.unionByName(back)


def encode_ends(edges: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """Names to ordinals at both ends; a missing name is an error."""
    out = edges
    for c in (a, b):
        n = names.select(F.col("name").alias(f"_{c}"), F.col("ordinal").alias(f"{c}_ix"))
        out = out.join(n, F.col(c) == F.col(f"_{c}"), "left").withColumn(f"{c}_ix", F.coalesce(f"{c}_ix", F.raise_error(F.concat(F.lit("unknown name "), F.col(c))).cast("bigint"))).drop(f"_{c}")
    return out


def with_component(edges: DataFrame, components: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with their component; ends in different components are an error."""
    x = components.select(F.col("node").alias(a), F.col("component").alias("component"))
    y = components.select(F.col("node").alias(b), F.col("component").alias("_other"))
    j = edges.join(x, a).join(y, b)
    same = F.when(F.col("component") == F.col("_other"), F.col("component")).otherwise(F.raise_error(F.lit("an edge crosses components")).cast("bigint"))
    return j.withColumn("component", same).drop("_other")
