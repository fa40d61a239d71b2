"""Graph operators over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.runtime import Scratch, checked_broadcast

#: Edges, counted first, that a single task may solve; beyond, all rounds are distributed.
LOCAL_EDGES = 1_000_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over undirected links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _solve(batches):
    t = pa.Table.from_batches(list(batches), pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    ends = np.concatenate([t["hi"].to_numpy(), t["lo"].to_numpy()])
    names, at = np.unique(ends, return_inverse=True)
    root = smallest_reachable(len(names), at[: t.num_rows], at[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Up to LOCAL_EDGES edges (they are counted first) are solved in one task of bounded memory. Beyond, the large-star
    and small-star steps alternate until the edges are stars around each smallest node, in a number of rounds
    logarithmic in practice. Minima are partial aggregates written before they are joined, so that both sides of each
    join come from plain exchanges and AQE can split a node with very many edges.
    Self loops, repeated edges and edges with a null end yield nothing; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    x, y = F.col(a), F.col(b)
    cur = scratch.keep(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    seen = _fingerprint(cur)
    if seen[0] <= LOCAL_EDGES and dict(cur.dtypes) == {"hi": "bigint", "lo": "bigint"}:
        return cur.coalesce(1).mapInArrow(_solve, "node bigint, component bigint")
    while seen[0]:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large = scratch.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        least = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = scratch.keep(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        scratch.drop(cur, low, large, least)
        cur, now = nxt, _fingerprint(nxt)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def singletons(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes of no component but their own."""
    return nodes.join(components.select(F.col("node").alias(nodes.columns[0])), nodes.columns[0], "left_anti")


def dominators(edges: list[tuple[int, int]], small: int = 10) -> list[int]:
    """A greedy dominating set of one component; an edge (u, v) lets u stand for v.

    Vertices are numbered by first appearance in the sorted edges, sources before pure targets. Up to ``small``
    vertices the one that covers most uncovered vertices is taken again and again, the first among equals. Beyond,
    vertices that nothing stands for come first, then again those that cover most, found lazily from a heap.
    """
    import heapq

    edges = sorted(set(edges))
    if len(edges) == 1:
        return [edges[0][0]]
    order: dict[int, int] = {}
    for u, _ in edges:
        order.setdefault(u, len(order))
    for _, v in edges:
        order.setdefault(v, len(order))
    names = list(order)
    covers: list[set[int]] = [{i} for i in range(len(names))]
    pointed = [False] * len(names)
    for u, v in edges:
        covers[order[u]].add(order[v])
        pointed[order[v]] |= u != v
    left, taken = set(range(len(names))), []

    def take(i: int) -> None:
        taken.append(i)
        left.difference_update(covers[i])

    if len(names) > small:
        for i in range(len(names)):
            if not pointed[i]:
                take(i)
        heap = [(-len(covers[i] & left), i) for i in range(len(names))]
        heapq.heapify(heap)
        while left:
            gain, i = heapq.heappop(heap)
            now = len(covers[i] & left)
            if now == -gain:
                take(i)
            elif now:
                heapq.heappush(heap, (-now, i))
    else:
        while left:
            take(max(range(len(names)), key=lambda i: (len(covers[i] & left), -i)))
    return [names[i] for i in taken]


def dominating_set(edges: DataFrame) -> DataFrame:
    """component, node: a greedy dominating set of each component of (component, v0, v1), v0 standing for v1.

    Greedy choice looks at a whole component at a time. Components follow each other in sorted partitions, many to a
    batch, so small ones cost no call of their own; a component's edges are what a task must hold.
    """

    def run(batches):
        last, held = None, []

        def done():
            return pa.array(np.full(len(chosen := dominators(held)), last)), pa.array(chosen, pa.int64())

        for batch in batches:
            out, component = [], batch.column("component").to_numpy()
            v0, v1 = batch.column("v0").to_pylist(), batch.column("v1").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(component)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if last is not None and component[a] != last:
                        out.append(done())
                        held = []
                    last = int(component[a])
                    held += zip(v0[a:b], v1[a:b], strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*out, strict=True)], ["component", "node"])
        if held:
            yield pa.RecordBatch.from_arrays([*done()], ["component", "node"])

    return edges.select("component", "v0", "v1").distinct().repartition("component").sortWithinPartitions("component").mapInArrow(run, "component bigint, node bigint")


def best_pairing(scores: DataFrame, at_least: float) -> DataFrame:
    """One-to-one pairs (a, b) by descending score, none below a threshold: rounds of mutual best choices.

    Each round pairs those that are each other's best among what is left, which is what a greedy walk down the
    sorted scores takes; ties go to the smaller a, then b.
    """
    scratch = Scratch(scores.sparkSession, "pairing")
    left = scratch.keep(scores.where(F.col("score") >= at_least).select("a", "b", "score"), "scores")
    out = None
    while left.take(1):
        key = F.struct((-F.col("score")).alias("s"), "a", "b")
        x = left.groupBy("a").agg(F.min(key).alias("k"))
        y = left.groupBy("b").agg(F.min(key).alias("k"))
        both = scratch.keep(x.join(y.withColumnRenamed("b", "_b"), "k").select("k.a", "k.b", (-F.col("k.s")).alias("score")), "round")
        out = both if out is None else out.unionByName(both)
        # what a round leaves replaces what it began with
        before, left = left, scratch.keep(left.join(checked_broadcast(both.select("a")), "a", "left_anti").join(checked_broadcast(both.select("b")), "b", "left_anti").select("a", "b", "score"), "scores")
        scratch.drop(before)
    return out if out is not None else left
