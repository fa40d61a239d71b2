"""Exact and containment de-duplication of sequences: (id, seq) tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions.rolling import minimizers
from loomery.runtime import Scratch, checked_broadcast

#: Hashed counters of minimizers, the ranges that they are added up in, and the bits of those asked for.
BUCKETS = 1 << 20
RANGES = 64
BITS = 1 << 26


def exact_duplicates(seqs: DataFrame) -> DataFrame:
    """Adds ``kept_id``: the smallest id of the rows with an equal sequence.

    Groups are formed on a digest; the minimum is a partial aggregate and is joined back, so a group of very many
    copies never has to be sorted in one place.
    """
    keyed = seqs.withColumn("_d", F.sha2("seq", 256))
    first = keyed.groupBy("_d").agg(F.min("id").alias("kept_id"))
    return keyed.join(first, "_d").drop("_d")


def duplicate_relations(seqs: DataFrame) -> DataFrame:
    """``=`` relations from each repeated sequence to the one kept."""
    return exact_duplicates(seqs).where("id <> kept_id").select(F.col("id").alias("src"), F.lit("=").alias("rel"), F.col("kept_id").alias("dst"))


def size_ordered(seqs: DataFrame, min_length: int = 100) -> DataFrame:
    """Sequences of a minimum length by (length, sequence, id)."""
    return seqs.where(F.length("seq") >= min_length).orderBy(F.length("seq"), "seq", "id")


def _slices(rows: DataFrame, order: str, slices: int) -> Column:
    """Numbers of at most ``slices`` equal ranges of a whole-number column, null ones before the first."""
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-(int(hi) - int(lo) + 1) // slices)) if lo is not None else 1
    return F.coalesce(F.floor((F.col(order) - (lo or 0)) / width), F.lit(-1))


def _before(per: DataFrame, value: str) -> DataFrame:
    """What the slices before each hold; there are few slices."""
    order = Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum(value).over(order), F.lit(0))).select("_s", "before")


def blocks_by_size(seqs: DataFrame, limit: int, slices: int = 4096) -> DataFrame:
    """Block numbers over sequences in order of id: a block closes with the sequence that uses it up.

    Closing at multiples of the limit of the running total keeps this a prefix sum, which is taken in two steps (per
    slice of ids, then within) so that no task holds all rows.
    """
    sized = seqs.select("id", F.length("seq").cast("bigint").alias("len"))
    sized = sized.withColumn("_s", _slices(sized, "id", slices))
    before = _before(sized.groupBy("_s").agg(F.sum("len").alias("t")), "t")
    within = F.coalesce(F.sum("len").over(Window.partitionBy("_s").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("_w", within).join(before, "_s").select("id", "len", F.floor((F.col("before") + F.col("_w")) / limit).alias("block"))


def batches(rows: DataFrame, order: str, size: int, slices: int = 4096) -> DataFrame:
    """Numbers of batches of a fixed size by place in the order of a whole-number column, in two steps as above."""
    sliced = rows.withColumn("_s", _slices(rows, order, slices))
    before = _before(sliced.groupBy("_s").agg(F.count("*").alias("c")), "c")
    place = F.row_number().over(Window.partitionBy("_s").orderBy(order)) - 1
    return sliced.withColumn("_p", place).join(before, "_s").withColumn("batch", F.floor((F.col("before") + F.col("_p")) / size)).drop("_s", "_p", "before")


def cut_by_size(seqs: DataFrame, limit: int, part: str = "part", order: str = "id") -> DataFrame:
    """part, id, piece: each part's sequences in order, cut into pieces: one that would not fit in opens the next.

    Where a cut falls depends on all cuts before it, so a part is walked in one pass over its lengths alone; parts are
    what is cut apart (input files), and nothing but a running total is held.
    """

    def run(found):
        last, piece, held = None, 0, 0
        for batch in found:
            out = []
            for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if (p,) != last:
                    last, piece, held = (p,), 0, n
                elif held + n > limit:
                    piece, held = piece + 1, n
                else:
                    held += n
                out.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(out, pa.int64())], ["part", "id", "piece"])

    sized = seqs.select(F.col(part).alias("part"), F.col(order).alias("id"), F.coalesce(F.length("seq"), F.lit(0)).cast("bigint").alias("n"))
    kinds = dict(sized.dtypes)
    return sized.repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, f"part {kinds['part']}, id {kinds['id']}, piece bigint")


def _counter(length: int):
    """How often each of the BUCKETS hashed counters is posted in a task, up to a limit: a dense row for each range."""

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch.column("seq").to_pylist():
                # a text's minimizers differ, their counters may not
                np.add.at(counts, _bucket(minimizers(t.encode(), length)), 1)
        for k, x in enumerate(np.minimum(counts, 65535).astype(np.uint16).reshape(RANGES, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["bucket", "packed"])

    return run


def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            x = np.frombuffer(blob, np.uint16)
            total[k] = total.get(k, np.zeros(len(x), np.uint64)) + x
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["bucket", "packed"])


def _bucket(k: np.ndarray) -> np.ndarray:
    return (k & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bit(k: np.ndarray) -> np.ndarray:
    return (k >> np.uint64(24) & np.uint64(BITS - 1)).astype(np.int64)


def _asker(length: int, rarity):
    """Of each text the minimizer with the lowest counter, unless that is one: then no other text has it."""

    def run(batches):
        for batch in batches:
            x, ks = [], []
            for i, t in zip(batch.column("text").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                k = minimizers(t.encode(), length)
                n = rarity.value[_bucket(k)]
                j = int(n.argmin())
                if n[j] > 1:
                    x.append(i)
                    ks.append(k[j])
            k = np.array(ks, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(k.view(np.int64)), pa.array(_bit(k))], ["x", "k", "bit"])

    return run


def _answerer(length: int, asked):
    """Each text's minimizers whose bit some text asks for."""

    def run(batches):
        for batch in batches:
            y, ks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for i, t in zip(batch.column("text").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                k = minimizers(t.encode(), length)
                at = _bit(k)
                k = k[asked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
                y.append(np.full(len(k), i))
                ks.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)), pa.array(np.concatenate(ks).view(np.int64))], ["y", "k"])

    return run


def contained(seqs: DataFrame, min_length: int) -> DataFrame:
    """``C`` relations (src in dst) among all sequences: each distinct text in every distinct text that holds it.

    Equal texts are collapsed and stand as their smallest id (``duplicate_relations`` names the others). A text that
    holds another one has all its minimizers, so that each text asks under one of its own. Counts in hashed counters
    only choose a rare one: large groups of near copies, which share most of theirs, seldom meet there. A bitmap of
    what is asked for keeps all other postings out of the shuffle. What meets is verified by a search. Counters and
    bitmap have fixed sizes; texts are named by a hash until then.
    """
    spark = seqs.sparkSession
    scratch = Scratch(spark, "contained")
    known = seqs.where(F.col("id").isNotNull() & (F.length("seq") >= min_length)).withColumn("text", F.xxhash64("seq"))
    total = known.select("seq").mapInArrow(_counter(min_length), "bucket int, packed binary").repartition(RANGES, "bucket").mapInArrow(_sum_counts, "bucket int, packed binary").toArrow()
    counts = np.zeros((RANGES, BUCKETS // RANGES), dtype=np.uint32)
    for k, blob in zip(total["bucket"].to_pylist(), total["packed"].to_pylist(), strict=True):
        counts[k] = np.frombuffer(blob, np.uint32)
    rarity = spark.sparkContext.broadcast(counts.reshape(-1))
    asks = scratch.keep(known.select("text", "seq").mapInArrow(_asker(min_length, rarity), "x bigint, k bigint, bit bigint").distinct(), "asks")
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    packed = asks.groupBy(F.shiftright("bit", 15).alias("n")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("b"))
    for n, blob in packed.collect():
        bits[n * 4096 : (n + 1) * 4096] = np.frombuffer(blob, np.uint8)
    asked = spark.sparkContext.broadcast(bits)
    posts = known.select("text", "seq").mapInArrow(_answerer(min_length, asked), "y bigint, k bigint").distinct()
    hits = scratch.keep(posts.join(asks.select("x", "k"), "k").where("x <> y").select("x", "y").distinct(), "hits")
    ends = scratch.keep(hits.select(F.col("x").alias("text")).union(hits.select("y")).distinct(), "ends")
    texts = scratch.keep(known.join(checked_broadcast(ends), "text", "left_semi").groupBy("text", "seq").agg(F.min("id").alias("id")), "texts")
    inner, outer = (texts.select(F.col("text").alias(t), F.col("id").alias(i), F.col("seq").alias(c)) for t, i, c in (("x", "src", "a"), ("y", "dst", "b")))
    return hits.join(inner, "x").join(outer, "y").where((F.length("a") < F.length("b")) & F.contains("b", "a")).select("src", F.lit("C").alias("rel"), "dst")


def by_membership(rows: DataFrame, keys: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (or is not) listed."""
    return rows.join(keys, column, "left_semi" if inside else "left_anti")


