"""FASTA files as (header, seq) tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check(spark: SparkSession, path: str) -> None:
    """Raise ValueError where a line is empty or a file does not begin with ``>``."""
    if spark.read.text(path).where("value = ''").take(1):
        raise ValueError(f"unexpected empty line in {path}")
    # only a file's first record keeps its mark when records are split at the marks of the others
    firsts = spark.read.option("lineSep", "\n>").text(path).groupBy(F.input_file_name()).agg(F.bool_or(F.startswith("value", F.lit(">"))).alias("ok"))
    if firsts.where("not ok").take(1):
        raise ValueError(f"unexpected data before the first record in {path}")


def read(spark: SparkSession, path: str, first_word: bool = False, strict: bool = False) -> DataFrame:
    """Records of FASTA files (compressed by suffix as Hadoop reads them); bodies over several lines are put together.

    Records are split where a line starts with ``>``, so a file is read in parallel; carriage returns go. With
    first_word the header ends at the first blank. With strict an empty line or text before the first record is an
    error; else empty lines are skipped and such text stands as a record of its own.
    """
    if strict:
        check(spark, path)
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    rec = F.regexp_replace("value", r"^>", "")
    cut = F.locate("\n", rec)
    head = F.when(cut == 0, rec).otherwise(F.substring(rec, F.lit(1), cut - 1))
    head = F.regexp_replace(head, r"\r$", "")
    body = F.when(cut == 0, F.lit("")).otherwise(F.regexp_replace(F.substring(rec, cut + 1, F.length(rec)), r"\s+", ""))
    return raw.select((F.split_part(head, F.lit(" "), F.lit(1)) if first_word else head).alias("header"), body.alias("seq"))


def lines(records: DataFrame, header: str = "header", seq: str = "seq") -> DataFrame:
    """One text value for each record, its body on a single line."""
    return records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value"))


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    lines(records).write.option("compression", compression).text(path)


def is_single_line(text: DataFrame, order: str = "n", value: str = "value") -> DataFrame:
    """One row, ok: whether headers and bodies alternate in numbered lines (n from 0)."""
    return text.agg(F.coalesce(F.bool_and(F.startswith(value, F.lit(">")) == (F.col(order) % 2 == 0)), F.lit(True)).alias("ok"))


def headers(text: DataFrame, pad: int | None = None, value: str = "value") -> DataFrame:
    """First words of header lines; with ``pad`` brought to a fixed width."""
    h = F.split_part(F.substring(value, 2, 1 << 20), F.lit(" "), F.lit(1))
    return text.where(F.startswith(value, F.lit(">"))).select((F.rpad(h, pad, " ") if pad else h).alias("header"))


def sam_header(records: DataFrame) -> DataFrame:
    return records.select(F.format_string("@SQ\tSN:%s\tLN:%d", F.col("header"), F.length("seq")).alias("value"))


def gc(seq: Column) -> Column:
    """Share of G and C; null for empty sequences."""
    return F.try_divide((F.length(seq) - F.length(F.translate(seq, "GCgc", ""))).cast("double"), F.length(seq).cast("double"))
