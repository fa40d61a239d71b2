"""Summaries over annotations, alignments and memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def identity_cascade(hits: DataFrame, cuts: tuple[int, ...] = (90, 92, 95)) -> DataFrame:
    """Distinct queries overall, with a hit other than themselves, and at each identity."""
    other = F.col("qseqid") != F.col("sseqid")
    at = [F.count_distinct(F.when(other & (F.col("pident") >= c), F.col("qseqid"))).alias(f"at_{c}") for c in cuts]
    return hits.agg(F.count_distinct("qseqid").alias("queries"), F.count_distinct(F.when(other, F.col("qseqid"))).alias("with_hit"), *at)


def extract(hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """query, id, part: the part of the target that each hit (query, id, start, end; from 1, both inside) covers."""
    return hits.join(seqs, "id").select("query", "id", F.substring("seq", F.col("start"), F.col("end") - F.col("start") + 1).alias("part"))


def cover_full() -> Column:
    """Whether an alignment (coordinates from 0, both ends inside) covers one of its sequences from end to end."""
    whole = lambda s: (F.col(f"{s}_start") == 0) & (F.col(f"{s}_end") + 1 == F.col(f"{s}_len"))
    return whole("a") | whole("b")


def ends_overlap(margin: int = 5) -> Column:
    """Whether an alignment joins the end of one sequence to the start of the other, neither being covered whole."""
    near = lambda c: F.col(c) <= margin
    far = lambda s: F.col(f"{s}_len") - F.col(f"{s}_end") - 1 <= margin
    return ((far("a") & near("b_start")) | (far("b") & near("a_start"))) & ~cover_full()


def qc_rollup(stats: DataFrame, first: tuple[str, ...] = ("preproc.lno8.pairs.1", "preproc.lno8.singles"), after: str = "preproc.lno8") -> DataFrame:
    """sample, inserts, bases, bases_before from (sample, key, value) rows whose keys are lane:stat.

    A lane's stats are file, numSeqs and numBasepairs. Inserts are sequences of lanes whose file begins as one of
    ``first`` (one end of each pair), bases those of lanes whose file begins as ``after``; all others are bases_before.
    """
    part = lambda k: F.split_part("key", F.lit(":"), F.lit(k))
    of = lambda name, kind="bigint": F.max(F.when(F.col("stat") == name, F.col("value")).cast(kind))
    lanes = stats.select("sample", part(1).alias("lane"), part(2).alias("stat"), "value").groupBy("sample", "lane").agg(of("file", "string").alias("file"), of("numSeqs").alias("n"), of("numBasepairs").alias("b"))
    begins = lambda names: reduce(lambda x, y: x | y, [F.startswith("file", F.lit(n)) for n in names])
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return lanes.groupBy("sample").agg(total("n", begins(first)).alias("inserts"), total("b", begins([after])).alias("bases"), total("b", ~begins([after])).alias("bases_before"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def relative_frequency(members: DataFrame, group: str, key: str) -> DataFrame:
    """Share of groups that hold each key. The number of groups is one row."""
    n = members.agg(F.count_distinct(group).alias("_n"))
    return members.select(group, key).distinct().groupBy(key).agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select(key, (F.col("c") / F.col("_n")).alias("share"))


def credited(own: DataFrame, copies: DataFrame) -> DataFrame:
    """Entities by category: their own, and every other that has a copy. Both tables: entity, category."""
    return own.union(copies).distinct().groupBy("category").agg(F.count("*").alias("n"))


def disagreement(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of (a, b) pairs whose labels differ; a missing label differs from any label but a missing one."""
    x = labels.select(F.col("key").alias("a"), F.col("label").alias("la"))
    y = labels.select(F.col("key").alias("b"), F.col("label").alias("lb"))
    j = pairs.join(x, "a", "left").join(y, "b", "left")
    return j.agg(F.count("*").alias("pairs"), F.avg((~F.col("la").eqNullSafe(F.col("lb"))).cast("int")).alias("differ"))


def membership(members: DataFrame, categories: list[str], often: int) -> DataFrame:
    """entity and a column for each category: 0 absent, 1 present, 2 present at least ``often`` times."""
    n = members.groupBy("entity", "category").agg(F.count("*").alias("n")).withColumn("code", F.when(F.col("n") >= often, 2).otherwise(1))
    return n.groupBy("entity").pivot("category", categories).agg(F.max("code")).na.fill(0)


def origin_tag(members: DataFrame, isolate: str) -> DataFrame:
    """entity, tag, cats: isolate, meta or mixed by whether its categories are, hold not, or hold also the label."""
    s = members.groupBy("entity").agg(F.array_sort(F.collect_set("category")).alias("c"))
    has = F.array_contains("c", isolate)
    rest = F.array_except("c", F.array(F.lit(isolate)))
    return s.select("entity", F.when(has & (F.size("c") == 1), "isolate").when(has, "mixed").otherwise("meta").alias("tag"), F.array_join(rest, ",").alias("cats"))


def imputed(rows: DataFrame, column: str) -> DataFrame:
    """Missing values replaced by the mean of the others."""
    m = rows.agg(F.avg(column).alias("_m"))
    return rows.crossJoin(F.broadcast(m)).withColumn(column, F.coalesce(column, "_m")).drop("_m")


def ratio_rows(rows: DataFrame, group: str, x: str, y: str, least: float, n: int) -> DataFrame:
    """Mean of y / x by group over rows with x of at least ``least``, for groups of at least n such rows."""
    r = rows.where(F.col(x) >= least)
    return r.groupBy(group).agg(F.avg(F.try_divide(y, x)).alias("ratio"), F.count("*").alias("n")).where(F.col("n") >= n)


def renumbered(rows: DataFrame, order: list[Column], prefix: str, slices: Column) -> DataFrame:
    """Adds new_id: ordinals from 0 in an order, as six digits in two groups.

    slices must be a prefix of the order with few values: ordinals are the rows of earlier slices plus the place
    within the slice.
    """
    r = rows.withColumn("_s", slices)
    before = r.groupBy("_s").agg(F.count("*").alias("c")).withColumn("_b", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_s", "_b")
    k = F.row_number().over(Window.partitionBy("_s").orderBy(*order)) - 1
    d = F.lpad((F.col("_k") + F.col("_b")).cast("string"), 6, "0")
    return r.withColumn("_k", k).join(before, "_s").withColumn("new_id", F.concat(F.lit(prefix), F.substring(d, 1, 3), F.lit("_"), F.substring(d, 4, 3))).drop("_s", "_k", "_b")


def renamed_parts(value: Column, names: Column) -> Column:
    """A name through a map; where it has none, its parts between hyphens each through the map, and joined again."""
    whole = F.try_element_at(names, value)
    parts = F.array_join(F.transform(F.split(value, "-"), lambda p: F.coalesce(F.try_element_at(names, p), p)), "-")
    return F.coalesce(whole, parts)
