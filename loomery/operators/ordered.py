"""Operators that depend on an order: runs, neighbours, ranges, trims, balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def md5_order(*parts: Column) -> Column:
    """A reproducible random order: md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def collapse_runs(rows: DataFrame, group: str, order: list[str], key: list[str]) -> DataFrame:
    """The first row of every run of equal keys within a group."""
    w = Window.partitionBy(group).orderBy(*order)
    same = None
    for k in key:
        c = F.lag(k).over(w).eqNullSafe(F.col(k))
        same = c if same is None else same & c
    return rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", same).where("_first or not _same").drop("_first", "_same")


def adjacent(rows: DataFrame, group: str, order: str, value: str, width: int = 2) -> DataFrame:
    """Windows of ``width`` neighbouring values in each group, as columns v0, v1, ..."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows.select(group, F.col(value).alias("v0"), *[F.lead(value, k).over(w).alias(f"v{k}") for k in range(1, width)], F.lead(F.lit(1), width - 1).over(w).alias("_in"))
    return out.where("_in = 1").drop("_in")


def compress_ranges(ids: DataFrame, column: str = "id") -> DataFrame:
    """Runs of consecutive numbered ids with one prefix and width as ``first-last``, single ids as they are."""
    parts = ids.select(F.regexp_extract(column, r"^(.*?)(\d+)$", 1).alias("p"), F.regexp_extract(column, r"^(.*?)(\d+)$", 2).alias("d")).distinct()
    n = parts.withColumn("n", F.col("d").cast("bigint")).withColumn("w", F.length("d"))
    g = n.withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy("p", "w").orderBy("n")))
    r = g.groupBy("p", "w", "_g").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return r.select(F.when(F.col("a") == F.col("b"), F.concat("p", "a")).otherwise(F.concat(F.col("p"), F.col("a"), F.lit("-"), F.col("p"), F.col("b"))).alias("range"))


def expand_ranges(ranges: DataFrame, column: str = "range") -> DataFrame:
    """The ids of each range."""
    pattern = r"^(.*?)(\d+)(?:-\1(\d+))?$"
    p, a, b = (F.regexp_extract(column, pattern, k) for k in (1, 2, 3))
    last = F.when(b == "", a).otherwise(b)
    ids = F.transform(F.sequence(a.cast("bigint"), last.cast("bigint")), lambda n: F.concat(p, F.lpad(n.cast("string"), F.length(a), F.lit("0"))))
    return ranges.where(a != "").select(F.explode(ids).alias("id"))


def trim_extremes(rows: DataFrame, group: str, value: str, part: int = 20) -> DataFrame:
    """Rows between the (n div part)-th smallest and largest value of their group, both inclusive.

    Groups of fewer than ``part`` rows stay whole.
    """
    n = F.count("*").over(Window.partitionBy(group))
    k = F.floor(n / part)
    low = F.row_number().over(Window.partitionBy(group).orderBy(value))
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value)))
    r = rows.withColumn("_k", k).withColumn("_l", low).withColumn("_h", high)
    g = Window.partitionBy(group)
    r = r.withColumn("_lo", F.min(F.when(F.col("_l") > F.col("_k"), F.col(value))).over(g)).withColumn("_hi", F.max(F.when(F.col("_h") > F.col("_k"), F.col(value))).over(g))
    return r.where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_k", "_l", "_h", "_lo", "_hi")


def balanced_sample(rows: DataFrame, size: str, stratum: str, order: Column, strata: int) -> DataFrame:
    """From every size that all strata have, equally many rows of each stratum: as many as the scarcest has."""
    counts = rows.groupBy(size, stratum).agg(F.count("*").alias("n")).groupBy(size).agg(F.min("n").alias("_take"), F.count("*").alias("_s")).where(F.col("_s") == strata).drop("_s")
    r = rows.join(counts, size).withColumn("_n", F.row_number().over(Window.partitionBy(size, stratum).orderBy(order)))
    return r.where("_n <= _take").drop("_n", "_take")


def capped_sample(rows: DataFrame, group: str, order: Column, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def size_classes(rows: DataFrame, group: str, size: str, tie: str, cuts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Adds share (cumulative share of size, largest first) and the number of cuts it lies above."""
    w = Window.partitionBy(group).orderBy(F.desc(size), tie)
    share = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(size).over(Window.partitionBy(group))
    r = rows.withColumn("share", share)
    return r.withColumn("class", sum([(F.col("share") > c).cast("int") for c in cuts[1:]], (F.col("share") > cuts[0]).cast("int")))


def quantile_bins(rows: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """Adds bin: Q1 to Qn between linearly interpolated quantile edges, closed on the right."""
    q = rows.agg(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_edges"))
    r = rows.crossJoin(F.broadcast(q))
    above = F.size(F.filter("_edges", lambda e: F.col(value) > e))
    return r.withColumn("bin", F.concat(F.lit("Q"), (above + 1).cast("string"))).drop("_edges")


def first_wins(*rules: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Priority union: of several (key, value) tables the first that names a key decides."""
    out = None
    for k, r in enumerate(rules):
        x = r.select(key, value, F.lit(k).alias("_p"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy(key).agg(F.min_by(value, F.struct("_p", value)).alias(value), F.min("_p").alias("rule"))
