"""Rooted trees: nodes (id, parent, rank) whose root is its own parent or has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.runtime import Scratch

ROOT = "1"


def root_paths(nodes: DataFrame) -> DataFrame:
    """id, path: ids from the root down to each node, found by doubling (rounds: logarithm of the depth)."""
    scratch = Scratch(nodes.sparkSession, "paths")
    up = F.when(F.col("parent").isNull() | (F.col("parent") == F.col("id")), F.lit(None)).otherwise(F.col("parent"))
    cur = scratch.keep(nodes.select("id", up.alias("above"), F.array("id").alias("path")), "paths")
    while cur.where("above is not null").take(1):
        head = cur.select(F.col("id").alias("_i"), F.col("above").alias("_a"), F.col("path").alias("_p"))
        nxt = cur.join(head, F.col("above") == F.col("_i"), "left").select("id", F.col("_a").alias("above"), F.when(F.col("_p").isNull(), F.col("path")).otherwise(F.concat("_p", "path")).alias("path"))
        nxt = scratch.keep(nxt, "paths")
        scratch.drop(cur)
        cur = nxt
    return cur.select("id", "path")


def lca(groups: DataFrame, paths: DataFrame, group: str, node: str = "id") -> DataFrame:
    """The deepest common ancestor of each group's nodes. Unknown ids count as the root.

    All paths start at the root, so the common prefix is the part on which the smallest and the largest path agree.
    """
    p = paths.select(F.col("id").alias(node), "path")
    j = groups.join(p, node, "left").withColumn("path", F.coalesce("path", F.array(F.lit(ROOT))))
    ends = j.groupBy(group).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    same = F.filter(F.arrays_zip(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))).alias("i")), lambda x: F.slice("lo", 1, x["i"]) == F.slice("hi", 1, x["i"]))
    return ends.withColumn("common", F.slice("lo", 1, F.size(same))).select(group, "common", F.coalesce(F.try_element_at("common", F.lit(-1)), F.lit(ROOT)).alias("lca"))


def at_rank(paths: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """id, ancestor: the deepest node of that rank on each path; null where there is none."""
    r = nodes.where(F.col("rank") == rank).select(F.col("id").alias("_a"))
    steps = paths.select("id", F.posexplode("path").alias("at", "_a")).join(r, "_a")
    found = steps.groupBy("id").agg(F.max_by("_a", "at").alias("ancestor"))
    return paths.select("id").join(found, "id", "left")


def descendants(paths: DataFrame, of: str) -> DataFrame:
    return paths.where(F.array_contains("path", of)).select("id")


def preferred_names(names: DataFrame, first_class: str = "scientific name") -> DataFrame:
    """One name for each id: of the preferred class, else the first; ``at`` orders."""
    order = F.struct((F.col("name_class") != first_class).alias("p"), "at", "name")
    return names.groupBy("id").agg(F.min_by("name", order).alias("name"))


def first_hit(hits: DataFrame, query: str, order: list[str], mappable: str | None = None) -> DataFrame:
    """The first hit of each query in order; with ``mappable``, the first whose mapped value is not null."""
    h = hits if mappable is None else hits.where(F.col(mappable).isNotNull())
    return h.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where("_n = 1").drop("_n")


def neighbourhood(hits: DataFrame, thresholds: DataFrame, query: str, evalue: str = "evalue") -> DataFrame:
    """Hits at most as bad as their query's own threshold (query, limit)."""
    return hits.join(thresholds, query).where(F.col(evalue) <= F.col("limit")).drop("limit")


def reconcile(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, label from (entity, species, kingdom_label, predicted).

    A species call wins; else a kingdom label; else the prediction, or its parent where its rank is species;
    what is missing is the root.
    """
    n = nodes.select(F.col("id").alias("predicted"), F.col("parent").alias("_up"), F.col("rank").alias("_rank"))
    guess = F.when(F.col("_rank") == "species", F.col("_up")).otherwise(F.col("predicted"))
    return calls.join(n, "predicted", "left").select("entity", F.coalesce("species", "kingdom_label", guess, F.lit(ROOT)).alias("label"))


def chimera_candidates(hits: DataFrame, query: str, start: str, end: str, overlap: int = 10) -> DataFrame:
    """Queries with two hits that overlap by less than ``overlap``.

    Of all pairs the one of the first end and the last start overlaps least (should one hit hold both, it overlaps any
    other by its own length, which is less still), so two extremes and a count decide.
    """
    ends = hits.groupBy(query).agg(F.min(end).alias("e"), F.max(start).alias("s"), F.count("*").alias("n"))
    return ends.where((F.col("n") >= 2) & (F.col("e") - F.col("s") < overlap)).select(query)
