"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. quality classifier: documents predicted below the cut go.
2. line dedup: later near-duplicate lines go; documents of nothing else go with them.
3. MinHash near-dedup: one document of each group stays (five-word shingles, similarity of 0.8 or more).
4. mixing sources to target weights: each leaf's token prefix stays, the document at its end cut at the budget.
5. SentencePiece encoding: token ids that decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import line_dedup, minhash, mixing, piece_codec, quality_rules
from loomery.llm.queries import MIX_SHARE, MIX_WEIGHTS, mix_levels
from loomery.runtime import Scratch, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.kept(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = unused(docs, "epoch", "n_tokens")
    return mixing.mix(docs, mix_levels(), MIX_SHARE, MIX_WEIGHTS, max_epochs=1, added=tuple(added)).drop(*added)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piece_codec.encode(docs, decoded=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("mixing", mixture), ("sentencepiece", pieces)]

#: The classifier is learned, which SQL cannot express: tests hold each stage against brute force in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = docs
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(done)
    return docs
