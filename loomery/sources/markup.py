"""XML records as maps of attributes, with Spark's own XML and XPath functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tag_values(xml: Column, record: str, tag: str = "TAG", value: str = "VALUE") -> Column:
    """A map of the tag/value pairs under a record; a repeated tag keeps its last value."""
    pairs = F.arrays_zip(F.xpath(xml, F.lit(f"//{record}/{tag}/text()")).alias("k"), F.xpath(xml, F.lit(f"//{record}[{tag}]/{value}/text()")).alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def link_of(xml: Column, kind: str, record: str = "XREF_LINK", db: str = "DB", ref: str = "ID") -> Column:
    """The id linked for one database; null where there is none."""
    return F.nullif(F.xpath_string(xml, F.lit(f"//{record}[{db}='{kind}']/{ref}")), F.lit(""))


def required(value: Column, what: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.raise_error(F.lit(f"missing {what}")))


def read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of large XML files, split by tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
