"""Count profiles: (sample, entity, n) tables, their normalisations and roll-ups.

Profiles stay in long form throughout; a missing (sample, entity) pair means zero. Entities or samples that a mapping
does not name are dropped by the inner joins here, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(rows: DataFrame, sample: str, entity: str, quantity: str, only: Column | None = None) -> DataFrame:
    """Whole counts by (sample, entity); ``only`` keeps the rows of a stricter variant."""
    rows = rows if only is None else rows.where(only)
    return rows.groupBy(F.col(sample).alias("sample"), F.col(entity).alias("entity")).agg(F.sum(quantity).cast("bigint").alias("n"))


def length_scaled(profile: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds scaled: n over the entity's length, rescaled so that each sample keeps its total."""
    w = Window.partitionBy("sample")
    r = profile.join(lengths, "entity").withColumn("_r", F.try_divide("n", "length"))
    return r.withColumn("scaled", F.try_divide(F.col("_r") * F.sum("n").over(w), F.sum("_r").over(w))).drop("_r")


def to_total(profile: DataFrame, value: str, total: float, into: str) -> DataFrame:
    """Each sample brought to a fixed total and rounded half to even."""
    return profile.withColumn(into, F.rint(F.try_divide(F.col(value) * F.lit(total), F.sum(value).over(Window.partitionBy("sample")))))


def relative(profile: DataFrame, value: str = "n", into: str = "rel") -> DataFrame:
    """Share of the sample's total; 0 where the total is 0."""
    t = F.sum(value).over(Window.partitionBy("sample"))
    return profile.withColumn(into, F.when(t == 0, 0.0).otherwise(F.col(value) / t))


def roll_up(profile: DataFrame, mapping: DataFrame, value: str = "n") -> DataFrame:
    """Sum by (sample, key) over an entity -> key table; entities without a key are dropped."""
    return profile.join(mapping, "entity").groupBy("sample", "key").agg(F.sum(value).alias(value))


def roll_up_multi(profile: DataFrame, mapping: DataFrame, separator: str, value: str = "n", trim: bool = True) -> DataFrame:
    """As roll_up over lists in one cell: the full value goes to every token, repeats included."""
    token = F.explode(F.split("key", separator))
    m = mapping.select("entity", token.alias("key"))
    if trim:
        m = m.withColumn("key", F.trim("key"))
    return roll_up(profile, m, value)


def with_residual(profile: DataFrame, mapping: DataFrame, label: str, value: str = "n") -> DataFrame:
    """As roll_up, with a row for what no key names."""
    j = profile.join(mapping, "entity", "left").withColumn("key", F.coalesce("key", F.lit(label)))
    return j.groupBy("sample", "key").agg(F.sum(value).alias(value))


def mean_when_seen(profile: DataFrame, category: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """Mean share of each entity over a category's samples where it is seen.

    strict: the profile of a stricter mode. Its entities alone count; a sample of theirs without the entity in the
    full profile adds 0 but still counts.
    """
    rel = relative(profile)
    if strict is not None:
        rel = strict.select("sample", "entity").join(rel, ["sample", "entity"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    return rel.join(category, "sample").groupBy("category", "entity").agg((F.sum("rel") / F.count_distinct("sample")).alias("mean_rel"))


def dense(profile: DataFrame, entities: list, value: str = "n") -> DataFrame:
    """One column for each of a stated list of entities, null as 0."""
    return profile.groupBy("sample").pivot("entity", entities).agg(F.sum(value)).na.fill(0)


def melt(wide: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, values, name, value)


def max_share_filter(profile: DataFrame, at_least: float) -> DataFrame:
    """Entities whose share reaches a threshold in some sample."""
    r = relative(profile)
    return r.withColumn("top", F.max("rel").over(Window.partitionBy("entity"))).where(F.col("top") >= at_least)


def regrouped(totals: DataFrame, up: dict[str, str]) -> DataFrame:
    """entity, category, share: categories rolled up by a map (others stay), each normalised to one over its entities."""
    pairs = [x for k, v in up.items() for x in (F.lit(k), F.lit(v))]
    to = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.col("category")) if pairs else F.col("category")
    n = totals.withColumn("category", to).groupBy("entity", "category").agg(F.sum("n").alias("n"))
    whole = n.groupBy("category").agg(F.sum("n").alias("t"))
    return n.join(whole, "category").select("entity", "category", F.try_divide("n", "t").alias("share"))
