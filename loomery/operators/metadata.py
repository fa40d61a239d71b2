"""Metadata tables: ragged attributes, lists in cells, overlays, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest_lockstep(rows: DataFrame, keys: list[str], lists: dict[str, tuple[str, str]], separator: str = ";") -> DataFrame:
    """Parallel lists in cells, unnested together. lists: name -> (preferred column, fallback column).

    A row falls back as a whole: when its first preferred list is null or empty.
    """
    first = next(iter(lists.values()))[0]
    empty = F.coalesce(F.col(first), F.lit("")) == ""
    cells = [F.split(F.when(empty, F.col(b)).otherwise(F.col(a)), separator).alias(n) for n, (a, b) in lists.items()]
    z = rows.select(*keys, *cells).select(*keys, F.explode(F.arrays_zip(*lists)).alias("z"))
    return z.select(*keys, *[F.col(f"z.{n}").alias(n) for n in lists])


def coalesced(a: Column, b: Column) -> Column:
    """One of two columns; both set to different values is an error."""
    clash = a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(clash, F.raise_error(F.lit("conflicting values"))).otherwise(F.coalesce(a, b))


def overlay(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both tables; patch's non-null values win."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(p, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def well_filled(rows: DataFrame, keep: list[str], at_least: int) -> DataFrame:
    """Columns with enough values, fullest first (names break ties), after those to keep. Counts all in one pass."""
    rest = [c for c in rows.columns if c not in keep]
    n = rows.agg(*[F.count(c).alias(c) for c in rest]).first()
    return rows.select(*keep, *[c for c in sorted(rest, key=lambda c: (-n[c], c)) if n[c] >= at_least])


def attributes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value rows of a JSON object."""
    return rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("name", "value"))


def without_placeholders(c: Column, words: tuple[str, ...] = ("missing", "none", "not applicable", "None")) -> Column:
    return F.when(~c.isin(*words), c)


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key; rows of a key that differ are an error."""
    rest = [c for c in rows.columns if c != key]
    g = rows.distinct().groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("conflicting rows")).cast(rows.schema[key].dataType)).otherwise(F.col(key))).select(rows.columns)


def renamed(rows: DataFrame, names: DataFrame, column: str, missing: str = "drop") -> DataFrame:
    """column's values through (old, new); what is missing is dropped, kept as it is, or an error."""
    j = rows.join(names.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "inner" if missing == "drop" else "left")
    new = {"drop": F.col("_new"), "keep": F.coalesce("_new", column), "error": F.coalesce("_new", F.raise_error(F.concat(F.lit("unknown "), F.col(column).cast("string"))))}[missing]
    return j.withColumn(column, new).drop("_new")


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_372_800.0) -> Column:
    """Distance in metres, by the arc tangent form, which is exact for near and far points alike."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sqrt(F.pow(F.cos(b) * F.sin(d), 2) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), 2))
    return F.atan2(x, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)) * radius


def coordinate(text: Column) -> Column:
    """Signed degrees from ``12.5 N``, ``12.5``, ``-12.5`` or degrees, minutes and seconds; S and W are negative."""
    dms = r"^\s*(\d+)[°d ]\s*(\d+)['m ]\s*([\d.]+)?[\"s]?\s*([NSEW])?\s*$"
    plain = r"^\s*(-?\d+(?:\.\d+)?)\s*([NSEW])?\s*$"
    num = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("double")
    sign = lambda p, k: F.when(F.regexp_extract(text, p, k).isin("S", "W"), -1.0).otherwise(1.0)
    return F.coalesce(num(plain, 1) * sign(plain, 2), (num(dms, 1) + num(dms, 2) / 60 + F.coalesce(num(dms, 3), F.lit(0.0)) / 3600) * sign(dms, 4))


def hemisphere(degrees: Column, positive: str, negative: str) -> Column:
    return F.concat(F.format_string("%.4f ", F.abs(degrees)), F.when(degrees < 0, negative).otherwise(positive))
