"""Nearest neighbours by cosine: vantage-point trees, one for each shard, searched for blocks of queries.

Vectors are scaled to length one, where the Euclidean distance is a metric that orders as the cosine does. Rows are
dealt to shards by a hash; each shard's tree halves its rows by the median distance to a vantage point. A search
descends to the nearer half first and enters the other half only if the triangle inequality allows a distance below
the query's k-th best so far times ``factor``: with factor 1 the search is exact, smaller factors skip more.
Leaves, and vantage points on the way, are scored by the stated measure on the original vectors in double precision.
The index (every usable row) is a written table that later searches can reuse. Queries are cut into tiles and shards
into groups; a task holds a tile and streams a group's shards past it, so a shard travels once for each tile and a tile
once for each group, and a tile yields at most k rows a query from each shard.

Null vectors, zero vectors and those with a null or non-finite component take no part, neither do null vec_ids.
Vectors of another length than the query are no candidates. Equal scores go to the smaller vec_id. Rows that repeat
a vec_id are candidates each, but none is a candidate for its own id, and a result names an id once, by its best row.
Of several vectors of one query id the first in order of components asks. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.embed_dedup import cosines, matrix, unit, usable
from loomery.runtime import Scratch, checked_broadcast

SHARD = 8192
LEAF = 256
#: Bytes of a tile of queries and of a group of shards, about.
TILE_BYTES = 16 << 20
GROUP_BYTES = 32 << 20
_INDEX = "shard int, dim int, ids binary, vectors binary, nodes binary, radii binary"


def build(x: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, nodes (first row, last row + 1, near child, far child; children -1 at leaves) and radii over unit rows.

    A node's first row is its vantage point; the near half follows it, then the far half.
    """
    order, nodes, radii = np.arange(len(x)), [], []
    rng = np.random.default_rng(seed)
    stack = [(0, len(x), -1, 0)]
    while stack:
        lo, hi, parent, slot = stack.pop()
        me = len(nodes)
        nodes.append([lo, hi, -1, -1])
        radii.append(0.0)
        if parent >= 0:
            nodes[parent][2 + slot] = me
        if hi - lo <= LEAF:
            continue
        pick = lo + int(rng.integers(hi - lo))
        order[[lo, pick]] = order[[pick, lo]]
        rest = order[lo + 1 : hi]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[order[lo]])))
        by = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = rest[by]
        mid = lo + 1 + len(rest) // 2
        radii[me] = float(d[by[len(rest) // 2]])
        stack += [(mid, hi, me, 1), (lo + 1, mid, me, 0)]
    return order, np.array(nodes, dtype=np.int64), np.array(radii)


def _packed(row: pa.RecordBatch, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ids and of vectors of a batch of one row, as arrays."""
    flat = row.column(vectors).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    who = row.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return who, flat.reshape(len(who), -1)


def _indexer(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            ids, x = _packed(row, "ids", "vecs")
            by = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[by], x[by]
            order, nodes, radii = build(unit(x))
            one = lambda v: pa.array([v.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([row.column("shard"), row.column("dim"), one(ids[order]), one(x[order]), one(nodes), one(radii)], ["shard", "dim", "ids", "vectors", "nodes", "radii"])


#: Room for the error of distances: where 2 - 2 * dot nearly cancels, its root is off by some 1e-8.
SLACK = 1e-6


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, radii: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (-1: none) of each query's k best rows of one shard, best first."""
    uq, ux = unit(q), unit(x)
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, dtype=np.int64)
    slack = 1e-9

    def score(act: np.ndarray, lo: int, hi: int) -> None:
        # unit rows say which rows can enter the best k; these are scored by the measure itself
        dots = uq[act] @ ux[lo:hi].T
        cand = dots >= best[act, -1:] - slack
        cand &= q_ids[act][:, None] != ids[None, lo:hi]
        if hi - lo > 4 * k:
            # no more than the k best of this leaf and their ties can enter
            cut = np.partition(np.where(cand, dots, -np.inf), -k, axis=1)[:, -k]
            cand &= dots >= cut[:, None] - slack
        a, b = np.nonzero(cand)
        if not len(a):
            return
        rows, cols = act[a], b + lo
        s = cosines(q[rows], x[cols])
        for i in np.unique(a):
            mine = a == i if len(a) < 64 else slice(np.searchsorted(a, i), np.searchsorted(a, i, side="right"))
            r = act[i]
            s_all, i_all = np.concatenate([best[r], s[mine]]), np.concatenate([who[r], ids[cols[mine]]])
            by = np.lexsort((i_all, -s_all))
            # an id counts once, by its best row
            _, first = np.unique(i_all[by], return_index=True)
            by = by[np.sort(first)]
            by = by[i_all[by] >= 0] if (i_all < 0).any() and (ids >= 0).all() else by
            by = by[:k]
            best[r], who[r] = -np.inf, -1
            best[r, : len(by)], who[r, : len(by)] = s_all[by], i_all[by]

    def walk(node: int, act: np.ndarray) -> None:
        lo, hi, near, far = nodes[node]
        if near < 0 and far < 0:
            score(act, lo, hi)
            return
        score(act, lo, lo + 1)
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (uq[act] @ ux[lo])))
        inside = d < radii[node]
        for first in (True, False):
            # nearer half first for every query, then the other half where the bound leaves room
            for child, mask in ((near, inside if first else ~inside), (far, ~inside if first else inside)):
                go = mask
                if not first:
                    bound = np.abs(d - radii[node])
                    worst = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(best[act, -1], -1.0)))
                    go = mask & (bound <= worst * factor + SLACK)
                if child >= 0 and go.any():
                    walk(int(child), act[go])

    if len(x):
        walk(0, np.arange(len(q)))
    return best, who


def _searcher(k: int, factor: float):
    """The best rows of each shard for the tile before it, out of rows sorted by tile, the tile's own row first."""

    def run(batches):
        q_ids, q = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("q_ids")[0].is_valid:
                    q_ids, q = _packed(row, "q_ids", "q_vecs")
                    continue
                r = row.select(["ids", "vectors", "nodes", "radii"]).to_pylist()[0]
                ids, nodes, radii = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nodes"], np.int64).reshape(-1, 4), np.frombuffer(r["radii"], np.float64)
                best, who = search(q, q_ids, np.frombuffer(r["vectors"], np.float64).reshape(len(ids), -1), ids, nodes, radii, k, factor)
                a, b = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(who[a, b]), pa.array(best[a, b])], ["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, scratch: Scratch | None = None, shard_rows: int = SHARD) -> DataFrame:
    """A written table with one row for each shard; every usable row of (vec_id, embedding) is in it."""
    scratch = scratch or Scratch(vectors.sparkSession, "vptree")
    rows = scratch.keep(_usable(vectors), "rows")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    # a shard holds shard_rows rows on average whatever the input's size; repeated rows are one
    packed = dealt.distinct().groupBy("shard", "dim").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("vec").alias("vecs"))
    return scratch.keep(packed.mapInArrow(_indexer, _INDEX), "index")


def _usable(vectors: DataFrame) -> DataFrame:
    x = vectors.where(usable() & F.col("vec_id").isNotNull())
    return x.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).withColumn("dim", F.size("vec"))


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of the index other than its own id."""
    scratch = Scratch(queries.sparkSession, "nearest")
    # of several vectors of one query id the first in order of components asks
    q = scratch.keep(_usable(queries).groupBy("vec_id", "dim").agg(F.min("vec").alias("vec")).groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("q")).select("vec_id", "q.*"), "queries")
    bytes_ = q.agg(F.sum(F.col("dim").cast("bigint") * 8)).first()[0] or 0
    tiles = max(1, -(-bytes_ // TILE_BYTES))
    packed = q.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).groupBy("tile", "dim").agg(F.collect_list("vec_id").alias("q_ids"), F.collect_list("vec").alias("q_vecs"))
    packed = scratch.keep(packed, "tiles")
    # groups as large as leaves every core some, within their bound
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    sizes = index.agg(F.count("*").alias("shards"), F.sum(F.octet_length("vectors").cast("bigint")).alias("bytes")).first()
    groups = max(1, min(sizes["shards"] or 1, max(-(-(sizes["bytes"] or 0) // GROUP_BYTES), -(-2 * cores // tiles))))
    # every tile meets every shard of its length once: the stated query set against all rows
    asked = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("tile", "group", "dim", F.lit(-1).alias("shard"), "q_ids", "q_vecs", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "nodes", "radii")])
    met = index.join(checked_broadcast(packed.select("tile", "dim")), "dim").select("tile", F.pmod("shard", F.lit(groups)).alias("group"), "dim", "shard", F.lit(None).cast("array<bigint>").alias("q_ids"), F.lit(None).cast("array<array<double>>").alias("q_vecs"), "ids", "vectors", "nodes", "radii")
    dealt = asked.unionByName(met).repartition("tile", "group", "dim").sortWithinPartitions("tile", "group", "dim", "shard")
    found = dealt.mapInArrow(_searcher(k, factor), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
