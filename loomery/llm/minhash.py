"""MinHash near-duplicate documents: one permutation, optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct shingles of five lower-cased words (see ``words``). One hash of each shingle
both picks one of ``N_BINS`` bins and ranks the shingle inside it, so a single pass over the sorted hashes yields
all minima; an empty bin borrows from the first non-empty bin of its own random order of bins. Runs of
``rows_per_band`` bins form a band, whose hash is a bucket key.

Equal sets collapse to one representative first, so a group of exact copies costs one row in the buckets. Each
bucket then links its centre with its members (a star, not all pairs). The centre is the member that meets most others
over all its buckets, so in a group of near copies it is the text that they derive from. Links are confirmed on the
full sets, by 128 bits of each shingle: a centre's members are dealt to tasks in blocks of ``SPOKES``, each of which
gets the centre's text once. Where a bucket still holds several components, only pairs across components are
looked at, inside tasks of bounded size: parity bits of the sets, as many as a set's size asks for, bound the overlap
from above, so no pair that reaches the threshold is dropped. Pairs that pass are emitted once, whatever number of
buckets they share, and confirmed on the full sets. So the components are those of all bucketed pairs, while groups
that are linked stop costing anything.

Null and empty texts, and texts without words, have n_shingles 0 and link with nothing. Rows that repeat a
doc_id are one document whose texts are compared separately: each row is returned, with the id's component.
Rows with a null doc_id come back with their n_shingles, a null component and kept true. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm import words
from loomery.operators.graph import connected_components
from loomery.runtime import Scratch, checked_broadcast, released, unused

N_BINS = 192
#: Fewest parity bits of a set; larger sets have at least twice as many as shingles.
PARITY = 1024
#: Rows of one bucket that are compared in one task, and members of one centre that are confirmed in one.
BLOCK = 2048
SPOKES = 128
#: Bytes of parity bits that are compared at once.
_SLAB = 8 << 20
_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
_EDGES = (np.arange(N_BINS, dtype=np.uint64) * np.uint64((1 << 64) // N_BINS)).astype(np.uint64)
_BORROW = np.stack([np.random.default_rng(7919 + i).permutation(N_BINS) for i in range(N_BINS)])


def rows_per_band(percent: int) -> int:
    """The widest band that misses a pair at the threshold with a chance below one in a million."""
    s = percent / 100
    return max(r for r in range(1, N_BINS + 1) if (1 - s**r) ** (N_BINS // r) < 1e-6)


def signature(grams: np.ndarray) -> np.ndarray:
    """N_BINS minima of a non-empty ascending set of hashes."""
    at = np.searchsorted(grams, _EDGES)
    full = at < np.append(at[1:], len(grams))
    out = grams[np.minimum(at, len(grams) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _BORROW[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = N_BINS // rows
    weights = words.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    h = (words.mix(sig[: bands * rows]).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
    return words.mix(h + words.mix(np.arange(1, bands + 1, dtype=np.uint64)))


def _signer(rows: int):
    @released
    def run(batches):
        for batch in batches:
            sets = words.shingle_sets(batch.column("text"))
            keys = [band_keys(signature(g), rows).view(np.int64) if len(g) else None for g, _ in sets]
            a = np.array([words.mix(g).sum(dtype=np.uint64) for g, _ in sets], dtype=np.uint64).view(np.int64)
            b = np.array([words.mix(g).sum(dtype=np.uint64) for _, g in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(g) for g, _ in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _verifier(percent: int):
    """Links between hubs and members, out of rows sorted by hub and block, the hub's own text before its members'."""

    @released
    def run(batches):
        task, hubs = None, []
        for batch in batches:
            hub, block, own = (batch.column(k).to_pylist() for k in ("hub", "block", "own"))
            sets = words.shingle_sets(batch.column("text"))
            member, keep = batch.column("member"), []
            for i, x in enumerate(sets):
                if (hub[i], block[i]) != task:
                    task, hubs = (hub[i], block[i]), []
                if own[i]:
                    hubs.append(x)
                    keep.append(False)
                    continue
                n = [(words.overlap(x, y), len(y[0])) for y in hubs]
                keep.append(any(both and 100 * both >= percent * (len(x[0]) + size - both) for both, size in n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(keep), member.filter(keep)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The written pairs (hub, member) whose full sets reach the threshold, as (a, b).

    A text travels once for each pair on its member's side, and once for each SPOKES of them on the hub's.
    """
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("blocks"))
    member = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), "member")
    rows = member.join(texts, F.col("member") == F.col("rep")).select("hub", "block", F.lit(0).alias("own"), "member", "text")
    own = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = own.join(texts, F.col("hub") == F.col("rep")).select("hub", "block", F.lit(1).alias("own"), F.col("hub").alias("member"), "text")
    dealt = rows.unionByName(own).repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("own"))
    return dealt.mapInArrow(_verifier(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: links join sets with 100 * overlap >= percent * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = rows_per_band(percent)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(docs.mapInArrow(_signer(rows), _SIGNED), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets: the smallest id stands for all of them; min() combines before the shuffle, so hot groups are cheap
    classes = scratch.keep(real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"), F.max("doc_id").alias("top")), "classes")
    members = scratch.keep(real.select("doc_id", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "members")
    # a doc_id whose rows hold different texts may represent several sets: number sets by their hashes, not by id
    sets = classes.select("set_a", "set_b", "rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = sets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.keep(shared, "shared")
    buckets = scratch.keep(sets.join(checked_broadcast(shared), "key").select("key", "band", "rep", "n", "size"), "buckets")
    links = None
    ids = scratch.keep(buckets.select("rep").distinct(), "ids")
    if ids.count():
        # one row for each candidate text, fetched once for all rounds
        texts = docs.join(checked_broadcast(ids.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
        if real.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1):
            texts = texts.distinct()
        texts = scratch.keep(texts, "texts")
        links = _linked(scratch, buckets, texts, percent)
    edges = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if links is not None:
        edges = edges.union(links)
    comp = connected_components(edges, scratch=scratch)
    # both sides are written tables, so the join keeps AQE's freedom to split or broadcast
    comp = scratch.keep(comp, "components")
    scratch.keep_only(signed, comp)
    out = signed.select("doc_id", "n_shingles").join(checked_broadcast(comp.withColumnsRenamed({"node": "doc_id"})), "doc_id", "left")
    cid = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def parity(grams: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by hash, at least twice as many bits as shingles, a power of two."""
    width = PARITY
    while width < 2 * len(grams):
        width *= 2
    at = ((grams >> np.uint64(8)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _sketcher(rows: int):
    """rep, 32 bits of each band's key, parity bits."""

    @released
    def run(batches):
        for batch in batches:
            sets = [g for g, _ in words.shingle_sets(batch.column("text"))]
            frags = [band_keys(signature(g), rows).astype(np.uint32).tobytes() for g in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(frags, pa.binary()), pa.array([parity(g).tobytes() for g in sets], pa.binary())], ["rep", "frags", "parity"])

    return run


def _across(t: dict, percent: int) -> tuple[list[int], list[int]]:
    """Pairs of one task's rows, of different components, that may reach the threshold and meet first in this bucket.

    Sets differ in at least as many shingles as in parity bits, so a pair with too many different bits is below it.
    Wide parities fold to half their width; sets whose sizes may match differ by one folding at most.
    """
    rep, comp, n, side = (np.array(t[k]) for k in ("rep", "component", "n", "side"))
    band = t["band"][0]
    frags = np.frombuffer(b"".join(t["frags"]), np.uint32).reshape(len(rep), -1)
    width = np.array([len(p) for p in t["parity"]])
    one_side = side.min() == side.max()
    out_a, out_b = [], []
    for w in np.unique(width).tolist():
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits = [np.frombuffer(t["parity"][i], np.uint64) for i in own.tolist()]
        bits += [(x := np.frombuffer(t["parity"][i], np.uint64))[: len(x) // 2] ^ x[len(x) // 2 :] for i in wide.tolist()]
        bits, at = np.array(bits), np.concatenate([own, wide])
        step = max(1, _SLAB // (w * len(at)))
        for lo in range(0, len(own), step):
            x, y = np.arange(lo, min(lo + step, len(own)))[:, None], np.arange(len(at))[None, :]
            i, j = at[x], at[y]
            ok = (x < y) & (comp[i] != comp[j]) & (rep[i] != rep[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if not one_side:
                ok &= side[i] != side[j]
            x, y = np.nonzero(ok)
            x = x + lo
            i, j = at[x], at[y]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
            i, j = i[ok], j[ok]
            ok = (frags[i] == frags[j]).argmax(axis=1) == band
            i, j = rep[i[ok]], rep[j[ok]]
            out_a += np.minimum(i, j).tolist()
            out_b += np.maximum(i, j).tolist()
    return out_a, out_b


def _compare(percent: int):
    """Candidate pairs out of rows sorted by task."""
    names = ("rep", "component", "n", "side", "band", "frags", "parity")

    @released
    def run(batches):
        task, held = None, {k: [] for k in names}

        def done():
            a, b = _across(held, percent) if len(held["rep"]) > 1 else ([], [])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            tasks = batch.column("task").to_pylist()
            cols = {k: batch.column(k).to_pylist() for k in names}
            at = 0
            for k in range(1, len(tasks) + 1):
                if k == len(tasks) or tasks[k] != tasks[at]:
                    if tasks[at] != task:
                        yield from done()
                        task, held = tasks[at], {c: [] for c in names}
                    for c in names:
                        held[c] += cols[c][at:k]
                    at = k
        yield from done()

    return run


def _linked(scratch: Scratch, buckets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect whatever bucketed pairs connect."""
    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    popular = scratch.keep(buckets.groupBy("rep").agg(F.sum("size").alias("pop")), "popular")
    met = buckets.join(popular, "rep")
    centres = scratch.keep(met.groupBy("key").agg(F.max(F.struct(F.col("pop"), (-F.col("rep")).alias("minus"), F.col("n"))).alias("c")).select("key", (-F.col("c.minus")).alias("centre"), F.col("c.n").alias("m")), "centres")
    pairs = buckets.join(centres, "key").where("rep <> centre").where(near).select(F.col("centre").alias("hub"), F.col("rep").alias("member")).distinct()
    # two centres may name each other in different buckets: the smaller one is the hub of such a pair
    pairs = pairs.groupBy(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).agg(F.min("hub").alias("hub")).select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
    tested = scratch.keep(pairs, "tested")
    links = scratch.keep(_confirmed(tested.select("hub", "member"), texts, percent), "links")
    comp = scratch.keep(connected_components(links, scratch=scratch), "round")
    open_ = buckets.where("size > 2").join(checked_broadcast(comp.withColumnRenamed("node", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = scratch.keep(open_, "open")
    mixed = open_.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    todo = scratch.keep(open_.join(checked_broadcast(scratch.keep(mixed, "mixed")), "key", "left_semi"), "todo")
    if not todo.take(1):
        return links
    sketches = scratch.keep(texts.join(checked_broadcast(scratch.keep(todo.select("rep").distinct(), "who")), "rep", "left_semi").mapInArrow(_sketcher(rows_per_band(percent)), "rep bigint, frags binary, parity binary"), "sketches")
    rows = _tasks(scratch, todo).join(sketches, "rep")
    found = rows.repartition("task").sortWithinPartitions("task").select("task", "rep", "component", "n", "side", "band", "frags", "parity").mapInArrow(_compare(percent), "a bigint, b bigint")
    found = scratch.keep(found.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("hub"), F.col("b").alias("member")), "found")
    more = scratch.keep(_confirmed(found, texts, percent), "more")
    return links.union(more)


def _tasks(scratch: Scratch, todo: DataFrame) -> DataFrame:
    """Rows of open buckets dealt to tasks of bounded size, so that each pair across components meets in one.

    A bucket of up to BLOCK rows is one task. In a larger one the rows outside its largest component are cut into
    blocks that meet each other and the blocks of the largest component, whose own blocks never meet.
    """
    few = todo.where(F.col("size") <= BLOCK).select(F.struct("key", F.lit(0).alias("x"), F.lit(0).alias("y")).alias("task"), "rep", "component", "n", F.lit(0).alias("side"), "band")
    many = todo.where(F.col("size") > BLOCK)
    if not many.take(1):
        return few
    parts = many.groupBy("key", "component").agg(F.count("*").alias("c"))
    top = parts.groupBy("key").agg(F.max_by("component", "c").alias("top"), F.max("c").alias("inside"), F.sum("c").alias("all"))
    blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / BLOCK).cast("int")
    top = scratch.keep(top.select("key", "top", blocks(F.col("all") - F.col("inside")).alias("outer"), blocks(F.col("inside")).alias("inner")), "largest")
    r = many.join(checked_broadcast(top), "key").withColumn("inside", F.col("component") == F.col("top"))
    r = r.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # blocks of outsiders are numbered from 0, those of the largest component from -1 downwards
    count = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    inside = r.where("inside").withColumn("x", F.explode(count("outer"))).withColumn("y", -1 - F.col("own")).withColumn("side", F.lit(1))
    outside = r.where("not inside")
    with_inner = outside.withColumn("y", F.explode(F.transform(count("inner"), lambda k: -1 - k))).withColumn("x", F.col("own")).withColumn("side", F.lit(0))
    with_outer = outside.withColumn("_o", F.explode(count("outer"))).withColumn("x", F.least("own", "_o")).withColumn("y", F.greatest("own", "_o")).withColumn("side", F.when(F.col("own") == F.col("_o"), 0).otherwise(F.when(F.col("own") < F.col("_o"), 0).otherwise(1)))
    out = few
    for part in (inside, with_inner, with_outer):
        out = out.unionByName(part.select(F.struct("key", "x", "y").alias("task"), "rep", "component", "n", "side", "band"))
    return out


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay, columns unchanged: of each component the row of its smallest id.

    Of several rows with that id the one with the smallest text stays. Rows with a null doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash-keep")
    found = scratch.keep(near_duplicates(docs, percent).where("doc_id is not null"), "found")
    gone = scratch.keep(found.where("not kept").select("doc_id").distinct(), "gone")
    twice = scratch.keep(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    stay = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    if not twice.take(1):
        return stay
    again = stay.join(checked_broadcast(twice), "doc_id", "left_semi").select(docs.columns)
    (row,) = unused(docs, "row")
    first = again.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1).select(docs.columns)
    return stay.join(checked_broadcast(twice), "doc_id", "left_anti").select(docs.columns).unionByName(first)
