"""Near-duplicate vectors by cosine: an epsilon grid order join.

Vectors are scaled to length one, so a cosine of c or more means a distance of at most eps = sqrt(2 - 2c). They are
projected on ``DIMS`` leading principal axes (a distance never grows), put in cells eps wide, and sorted by cell,
axis by axis. The sorted sequence is cut into blocks; two blocks are joined only when their boxes on the axes come
within eps of each other, and inside a joined pair intervals are halved recursively, dropping halves whose boxes are
farther apart, until leaves are compared in full: dot products of the original vectors in double precision.

Blocks that follow each other form groups, and two groups form a tile: a task gets each block of its tile once, holds
one group and streams the other past it, so that a block travels once for each group that it may meet, not for each
block. Vectors with equal components collapse first and count with their multiplicity, so copies cost one row. A tile
returns link counts by vector and a spanning forest of its links, never the links themselves: the forests have the
links' components.

Null vectors, zero vectors, and those with a null or non-finite component or another length than the most common
one link with nothing of another length: each length is joined on its own. Unusable vectors come back with no links,
as their own component. Rows that repeat a vec_id are one vector: each row is returned, n_links counts linked rows
with other vec_ids. A null vec_id takes no part. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.graph import connected_components, smallest_reachable
from loomery.runtime import Scratch, checked_broadcast, released

DIMS = 6
BLOCK = 4096
LEAF = 512
#: Bytes of vectors in a group of blocks at most, about.
GROUP_BYTES = 32 << 20
#: Rows and bytes from which the axes are taken at most; any axes give exact results, they only decide what is skipped.
AXES_SAMPLE = 20_000
AXES_BYTES = 32 << 20


def usable(column: str = "embedding") -> F.Column:
    """Whether a vector takes part: no null, no non-finite component, not zero."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long, usable vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one, where squares could leave the range."""
    most = np.abs(x).max(axis=1, initial=0.0)
    if not len(x) or (most.max() < 1e100 and most.min() > 1e-100):
        return x
    return np.ldexp(x, -np.frexp(most)[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision: sums in order of the components, bounded by -1 and 1."""
    a, b = _scaled(a), _scaled(b)
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        u, v = a[:, k], b[:, k]
        dot += u * v
        x += u * u
        y += v * v
    return np.clip(dot / np.sqrt(x * y), -1.0, 1.0)


def axes_of(rows: np.ndarray) -> np.ndarray:
    """The DIMS leading principal axes of unit rows, as columns."""
    _, vectors = np.linalg.eigh(rows.T @ rows - len(rows) * np.outer(rows.mean(axis=0), rows.mean(axis=0)))
    return vectors[:, ::-1][:, :DIMS]


def _projector(axes: np.ndarray, eps: float):
    @released
    def run(batches):
        for batch in batches:
            p = unit(matrix(batch.column("vec"))) @ axes
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def _blocks(axes: np.ndarray):
    """Rows sorted within a partition, cut into blocks: ids, multiplicities, vectors and the box on the axes.

    Blocks are numbered along the whole sequence, since partitions hold ranges of it.
    """

    def made(parts, seq):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        t = pa.Table.from_batches(parts)
        m = matrix(t["vec"])
        p = unit(m) @ axes
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        columns = [pa.array([part], pa.int32()), pa.array([(part << 24) + seq]), one(t["rep"].to_numpy().astype(np.int64)), one(t["copies"].to_numpy().astype(np.int64)), one(m), pa.array([p.min(axis=0)], pa.list_(pa.float64())), pa.array([p.max(axis=0)], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "ids", "copies", "vectors", "low", "high"])

    @released
    def run(batches):
        held, n, seq = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == BLOCK:
                    yield made(held, seq)
                    held, n, seq = [], 0, seq + 1
        if held:
            yield made(held, seq)

    return run


def _far(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the boxes of two sets of projected rows are provably more than eps apart."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float((gap * gap).sum()) > eps * eps


def _joined(x, y, px, py, low: float, eps: float, self_: bool, i: int = 0, j: int = 0):
    """Index pairs with a dot product of at least low, and the product, leaf by leaf."""
    if not len(x) or not len(y) or _far(px, py, eps):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        dots = x @ y.T
        a, b = np.nonzero(dots >= low)
        if self_ and i == j:
            a, b = a[a < b], b[a < b]
        if len(a):
            yield a + i, b + j, dots[a, b]
        return
    h, k = (len(x) + 1) // 2 if len(x) > LEAF else len(x), (len(y) + 1) // 2 if len(y) > LEAF else len(y)
    for u in ((0, h), (h, len(x))):
        for v in ((0, k), (k, len(y))):
            if self_ and i == j and v[0] < u[0]:
                continue
            same = self_ and i + u[0] == j + v[0]
            yield from _joined(x[u[0] : u[1]], y[v[0] : v[1]], px[u[0] : u[1]], py[v[0] : v[1]], low, eps, same, i + u[0], j + v[0])


def _matcher(axes: np.ndarray, threshold: float, eps: float):
    """Link counts and forests of tiles, out of blocks sorted by tile, the held group's blocks first."""
    # rows scaled to length one carry rounding of a few ulps: what is this close is decided by the plain formula
    slack = 1e-9

    class Block:
        def __init__(self, r):
            self.block, self.ids, self.copies = r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64)
            self.raw = np.frombuffer(r["vectors"], np.float64).reshape(len(self.ids), -1)
            self.unit = unit(self.raw)
            self.axes = self.unit @ axes

    def pair(x: Block, y: Block):
        self_ = x.block == y.block
        shift = 0 if self_ else len(x.ids)
        nodes = x.ids if self_ else np.concatenate([x.ids, y.ids])
        copies = x.copies if self_ else np.concatenate([x.copies, y.copies])
        links, ends = np.zeros(len(nodes)), [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for a, b, dots in _joined(x.unit, y.unit, x.axes, y.axes, threshold - slack, eps + slack, self_):
            close = np.flatnonzero(dots < threshold + slack)
            if len(close):
                ok = np.ones(len(a), dtype=bool)
                ok[close] = cosines(x.raw[a[close]], y.raw[b[close]]) >= threshold
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            links += np.bincount(a, weights=copies[b + shift], minlength=len(nodes)) + np.bincount(b + shift, weights=copies[a], minlength=len(nodes))
            # of a leaf's links only a forest is kept: a dense group has as many links as pairs
            low_a, low_b, n_a = a.min(), b.min(), int(a.max() - a.min()) + 1
            names = np.concatenate([np.arange(low_a, low_a + n_a), np.arange(low_b, b.max() + 1) + shift])
            root = smallest_reachable(len(names), a - low_a, b - low_b + n_a)
            for side, at in zip(ends, (names, names[root]), strict=True):
                side.append(at[root != np.arange(len(names))])
        root = smallest_reachable(len(nodes), *(np.concatenate(side) for side in ends))
        hit = np.flatnonzero(links)
        if not len(hit):
            return
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit].astype(np.int64)), pa.array(nodes[root[hit]])], ["rep", "links", "root"])

    @released
    def run(batches):
        tile, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["x"], r["y"]) != tile:
                    tile, held = (r["x"], r["y"]), []
                block = Block(r)
                if r["own"]:
                    held.append(block)
                for other in held:
                    # in a tile of one group with itself each block meets those held before it and itself
                    yield from pair(other, block) if not r["own"] or r["x"] == r["y"] else ()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    src = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), (usable() & F.col("vec_id").isNotNull()).alias("ok"))
    src = scratch.keep(src.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda v: v + F.lit(0.0)))), "source")
    # equal vectors collapse; the key is a digest of the components (-0.0 + 0.0 is 0.0)
    keyed = src.where("ok").withColumn("key", F.md5(F.array_join(F.transform("vec", lambda v: v.cast("string")), ",")))
    ids = keyed.select("key", "vec_id").distinct()
    classes = scratch.keep(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("vec").alias("vec"), F.count_distinct("vec_id").alias("copies")), "classes")
    members = scratch.keep(ids.join(classes.select("key", "rep", "copies"), "key").select("vec_id", "rep", "copies", "key"), "members")
    # a vec_id that names several vectors stands for several classes: number classes apart from ids
    parts = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]
    found = [_one_length(scratch, classes.where(F.size("vec") == n), threshold, eps) for n in sorted(parts)]
    own = members.select("vec_id", "rep", (F.col("copies") - 1).alias("links"))
    if found:
        union = found[0]
        for f in found[1:]:
            union = union.union(f)
        union = scratch.keep(union, "links")
        counts = union.groupBy("rep").agg(F.sum("links").alias("more"))
        comp = connected_components(union.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(members.select("vec_id", "rep")), scratch=scratch)
        counts, comp = scratch.keep(counts, "counts"), scratch.keep(comp, "components")
        own = own.join(checked_broadcast(counts), "rep", "left").groupBy("vec_id").agg(F.sum(F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"))
        own = own.join(checked_broadcast(comp), own["vec_id"] == comp["node"], "left").select("vec_id", "n_links", "component")
        own = scratch.keep(own, "own")
        scratch.keep_only(src, own)
        out = src.select("vec_id").join(checked_broadcast(own), "vec_id", "left")
    else:
        out = src.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component"))
    cid = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))


def _one_length(scratch: Scratch, classes: DataFrame, threshold: float, eps: float) -> DataFrame:
    """rep, links, root of vectors that all have the same length."""
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, wide = facts["n"], 8 * facts["dim"]
    few = max(2, min(AXES_SAMPLE, AXES_BYTES // wide))
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(min(1.0, few / n) * (1 << 20)) + 1).select("vec").limit(2 * few).toArrow()
    rows = unit(matrix(sample["vec"])) if sample.num_rows else np.zeros((0, 1))
    axes = axes_of(rows) if len(rows) > 1 else np.eye(facts["dim"])[:, :DIMS]
    dims = axes.shape[1]
    placed = classes.select("rep", "copies", "vec").mapInArrow(_projector(axes, eps), "rep bigint, copies bigint, vec array<double>, cells array<int>")
    order = [F.col("cells")[k] for k in range(dims)]
    placed = scratch.keep(placed, "placed")
    # two blocks a range, and ranges that follow each other make a group
    ranges = max(1, -(-n // (2 * BLOCK)))
    blocks = placed.repartitionByRange(ranges, *order, "rep").sortWithinPartitions(*order, "rep").select("rep", "copies", "vec")
    blocks = scratch.keep(blocks.mapInArrow(_blocks(axes), "part int, block bigint, ids binary, copies binary, vectors binary, low array<double>, high array<double>"), "blocks")
    # boxes that may touch share a cell on the first axis, once one side is widened by a cell
    cell = lambda c, by: F.sequence(F.floor(F.col(c)[0] / eps) - by, F.floor(F.col("high" if c == "low" else c)[0] / eps) + by)
    boxes = blocks.select("part", "block", "low", "high")
    x = boxes.select(F.col("part").alias("x"), F.col("block").alias("xblock"), F.col("low").alias("xl"), F.col("high").alias("xh"), F.explode(cell("low", 1)).alias("cell"))
    y = boxes.select(F.col("part").alias("y"), F.col("block").alias("yblock"), F.col("low").alias("yl"), F.col("high").alias("yh"), F.explode(cell("low", 0)).alias("cell"))
    gap = F.aggregate(F.arrays_zip("xl", "xh", "yl", "yh"), F.lit(0.0), lambda s, d: s + F.pow(F.greatest(F.lit(0.0), d["xl"] - d["yh"], d["yl"] - d["xh"]), 2))
    pairs = scratch.keep(x.join(y, "cell").where("xblock <= yblock").where(gap <= (eps + 1e-9) ** 2).groupBy("x", "y").agg(F.count_distinct("xblock", "yblock").alias("n")), "pairs")
    # groups as large as leaves every core some tiles, within their bound of memory
    meets = pairs.agg(F.sum("n")).first()[0] or 0
    cores = max(1, scratch.spark.sparkContext.defaultParallelism)
    side = max(1, min(int((meets / (4 * cores)) ** 0.5) // 2, GROUP_BYTES // (2 * BLOCK * wide)))
    group = lambda c: F.floor(F.col(c) / side).cast("int").alias(c)
    tiles = scratch.keep(pairs.select(group("x"), group("y")).distinct(), "tiles")
    grouped = blocks.withColumn("group", F.floor(F.col("part") / side).cast("int")).select("group", "block", "ids", "copies", "vectors")
    own = tiles.join(grouped, F.col("x") == F.col("group")).withColumn("own", F.lit(1))
    met = tiles.where("x <> y").join(grouped, F.col("y") == F.col("group")).withColumn("own", F.lit(0))
    both = own.unionByName(met).select("x", "y", "own", "block", "ids", "copies", "vectors")
    return both.repartition("x", "y").sortWithinPartitions("x", "y", F.desc("own"), "block").mapInArrow(_matcher(axes, threshold, eps), "rep bigint, links bigint, root bigint")
