"""A k-mer index over sequences and alignment-ranked lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators.alignment import alignment_score

#: Residues that count as one, by class number; fixed values.
CLASSES = ("C", "FY", "W", "ML", "IV", "G", "P", "A", "T", "S", "N", "H", "QE", "D", "R", "K")


def reduced(seq: Column) -> Column:
    """The sequence over the classes' first letters; other characters stay."""
    return F.translate(F.upper(seq), "".join(c for g in CLASSES for c in g), "".join(g[0] for g in CLASSES for _ in g))


def encoded(seq: Column) -> Column:
    """The sequence as class numbers, a hexadecimal digit each; what is in no class counts as class 0."""
    digits = F.translate(F.upper(seq), "".join(c for g in CLASSES for c in g), "".join(f"{k:x}" for k, g in enumerate(CLASSES) for _ in g))
    return F.regexp_replace(digits, "[^0-9a-f]", "0")


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, id for the distinct k-mers of each (id, seq)."""
    starts = F.sequence(F.lit(1), F.length("seq") - (k - 1))
    all_ = F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("seq"), p, F.lit(k))))
    return seqs.where(F.length("seq") >= k).select("id", F.explode(all_).alias("kmer"))


def word_shingles(seqs: DataFrame, k: int) -> DataFrame:
    """shingle, id for the distinct runs of k blank-separated words."""
    s = seqs.select("id", F.split("seq", " ").alias("w")).where(F.size("w") >= k)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda p: F.array_join(F.slice(F.col("w"), p, k), " "))
    return s.select("id", F.explode(F.array_distinct(runs)).alias("kmer"))


def candidates(queries: DataFrame, index: DataFrame, at_least: int) -> DataFrame:
    """query, id, shared: indexed sequences that share enough k-mers."""
    q = queries.select(F.col("id").alias("query"), "kmer")
    return q.join(index, "kmer").groupBy("query", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= at_least)


def ranked(pairs: DataFrame, queries: DataFrame, seqs: DataFrame, top: int | None = None) -> DataFrame:
    """All candidates, or the best ``top`` of each query, by descending alignment score, ties to the smaller id."""
    q = queries.select(F.col("id").alias("query"), F.col("seq").alias("qs"))
    p = pairs.join(q, "query").join(seqs, "id").withColumn("score", alignment_score("qs", "seq"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = p.withColumn("rank", F.row_number().over(w))
    return (out if top is None else out.where(F.col("rank") <= top)).select("query", "rank", "id", "score")
