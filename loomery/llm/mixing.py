"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

Each node's budget goes to its children in proportion to their weights, bounded by what a child holds: tokens times
``max_epochs``. What a full child cannot take is dealt among its siblings, again by weight; only when all siblings
are full does the shortage reach the parent, whose own siblings take it. Since a parent's capacity is the sum of what
its children may take, water-filling from the root down does exactly this. It is done level by level on tables of
nodes: a child is full where its capacity over its weight lies under its parent's water level, which a window over
the distinct ratios of the children finds. Leaves' shares are rounded to whole tokens along one fixed order of leaves,
so that each is less than one token off and all of them add up to the budget.

A leaf then takes a prefix of tokens from its seeded epochs: epoch e holds all its documents in an order of their own
(md5 of seed, epoch, doc_id and the text's md5). Whole epochs that fit are taken whole; of the next one documents
are taken in order, and the one in which the budget ends is cut after the last token that fits, so a leaf takes its
budget to the token. To keep a hot leaf out of a single task the prefix is found in two steps: sums by leading hash
digits (16 ** ``SLICE_DIGITS`` slices to a leaf) name the slice in which the budget ends, and only that one is sorted.

Tokens are runs of characters other than space and \\t \\n \\v \\f \\r. Null domain, lang or source is a value of its
own. Null and empty texts hold no tokens and are taken with what surrounds them in the order; a leaf without any token
is taken whole, once. Nodes of weight zero take nothing. Weights default to 1; nodes without a stated weight use that.
Rows equal in doc_id and text share a place in the order; where the budget ends among them, the other columns decide.
Columns of the input pass through, but ``epoch`` and ``n_tokens`` are replaced, and text and n_chars are those taken.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.runtime import Scratch, checked_broadcast, unused

SLICE_DIGITS = 3
TOKEN = r"[^\x20\x09-\x0D]+"
#: Shares of a token are counted in these parts when leaves' budgets are rounded.
_PARTS = 1_000_000_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{TOKEN}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch; key: what ``document_key`` gives."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), key))


def document_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _path(levels: list[Column]) -> Column:
    """A leaf's path as one string, every value with its length before it."""
    one = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(c.cast("string")) for c in levels])


def _weight(names: list[str], weights: Mapping[tuple, float]) -> Column:
    """The stated weight of the node that the columns name, else 1."""
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(names):
            here = F.lit(True)
            for n, value in zip(names, path, strict=True):
                here = here & F.col(n).eqNullSafe(F.lit(value))
            out = F.when(here, F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, names: list[str], share: float, weights: Mapping[tuple, float], max_epochs: int, scratch: Scratch) -> DataFrame:
    """leaf, tokens, take (whole tokens) of the written table (leaf, names..., tokens)."""
    alive = F.lit(True)
    for k in range(1, len(names) + 1):
        alive = alive & (_weight(names[:k], weights) > 0)
    low = leaves.select("leaf", "tokens", F.lit(0).alias("root"), *names, alive.alias("alive"), F.when(alive, F.col("tokens") * max_epochs).otherwise(0).cast("bigint").alias("cap"))
    low = scratch.keep(low, "leaves")
    totals = low.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).first()
    budget = min(math.floor(share * (totals["tokens"] or 0) + 1e-9), totals["cap"] or 0)
    above = low.limit(1).select("root", F.lit(float(budget)).alias("budget"))
    for k in range(1, len(names) + 1):
        parent, own = ["root", *names[: k - 1]], ["root", *names[:k]]
        kids = low.where("cap > 0").groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(names[:k], weights))
        kids = scratch.keep(_null_safe_join(kids, above, parent).withColumn("r", F.col("cap") / F.col("w")), f"level{k}")
        # children of one ratio fill at one water level: a window holds distinct ratios, of which there are few
        ratios = kids.groupBy(*parent, "r").agg(F.sum("cap").alias("cap"), F.sum(F.col("w").cast("decimal(24,9)")).alias("w"), F.first("budget").alias("budget"))
        order = Window.partitionBy(*parent).orderBy("r")
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        level = ratios.withColumn("level", (F.col("budget") - before) / rest.cast("double")).where("r > level").groupBy(*parent).agg(F.min_by("level", "r").alias("level"))
        got = _null_safe_join(kids, level, parent, "left")
        above = scratch.keep(got.select(*own, F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("budget")), f"budgets{k}")
    exact = _null_safe_join(low, above, ["root", *names], "left").select("leaf", "tokens", "alive", "cap", F.coalesce("budget", F.lit(0.0)).alias("budget"), F.md5("leaf").alias("at"))
    exact = exact.withColumn("whole", F.floor("budget")).withColumn("part", F.floor((F.col("budget") - F.col("whole")) * _PARTS)).withColumn("slice", F.substring("at", 1, 2))
    exact = scratch.keep(exact, "exact")
    # rounded along the order of leaves: sums of 256 slices first, then within each
    slices = exact.groupBy("slice").agg(F.sum("part").alias("part")).withColumn("before", F.coalesce(F.sum("part").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.col("before") + F.sum("part").over(Window.partitionBy("slice").orderBy("at", "leaf").rowsBetween(Window.unboundedPreceding, 0))
    out = exact.join(F.broadcast(slices.select("slice", "before")), "slice").withColumn("upto", upto + _PARTS // 2)
    take = F.expr(f"least(cap, whole + (upto div {_PARTS}) - ((upto - part) div {_PARTS}))")
    return out.select("leaf", "tokens", "alive", take.cast("bigint").alias("take"))


def mix(docs: DataFrame, levels: Mapping[str, Column], share: float, weights: Mapping[tuple, float], max_epochs: int = 1, seed: int = 7, added: tuple[str, str] = ("epoch", "n_tokens")) -> DataFrame:
    """docs' rows as often as they are taken, with ``epoch`` (from 0) and ``n_tokens`` (those taken), or other names.

    levels: names and expressions of the tree's levels, root first. share: budget as a part of all tokens.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = [f"level{i}" for i in range(len(levels))]
    leaf, held, key = unused(docs, "leaf", "held", "key")
    values = list(levels.values())
    marked = docs.withColumns({leaf: _path(values), held: n_tokens(F.col("text")), key: document_key(F.col("doc_id"), F.col("text"))})
    facts = scratch.keep(marked.select(F.col(leaf).alias("leaf"), *[v.cast("string").alias(n) for n, v in zip(names, values, strict=True)], F.col(held).alias("tokens"), F.col(key).alias("key")), "facts")
    leaves = scratch.keep(facts.groupBy("leaf", *names).agg(F.sum("tokens").alias("tokens")), "sums")
    budgets = leaf_budgets(leaves, names, share, weights, max_epochs, scratch)
    whole = F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(F.col("alive").cast("bigint"))
    plan = budgets.withColumn("whole", whole).select("leaf", F.col("whole").cast("int").alias("whole"), F.when(F.col("tokens") > 0, F.col("take") - F.col("whole") * F.col("tokens")).otherwise(0).alias("rest"))
    plan = scratch.keep(plan.where("whole > 0 or rest > 0"), "plan")

    placed = facts.join(checked_broadcast(plan.where("rest > 0")), "leaf").select("leaf", "rest", "tokens", place(seed, F.col("whole"), F.col("key")).alias("place"))
    placed = scratch.keep(placed.withColumn("slice", F.substring("place", 1, SLICE_DIGITS)), "placed")
    sums = placed.groupBy("leaf", "slice").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    last = scratch.keep(sums.withColumn("upto", upto).where("upto >= rest and upto - t < rest").select("leaf", "slice", (F.col("upto") - F.col("t")).alias("before")), "last")
    # rows of one place count together, so a window holds distinct places of one slice of a leaf
    places = placed.join(checked_broadcast(last), ["leaf", "slice"]).groupBy("leaf", "place").agg(F.sum("tokens").alias("t"), F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("t").over(Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ends = places.withColumn("upto", upto).where("upto >= rest and upto - t < rest").select("leaf", F.col("place").alias("stop"), (F.col("rest") - F.col("upto") + F.col("t")).alias("need"), "copies")
    plan = scratch.keep(plan.join(ends, "leaf", "left"), "ends")
    twice = bool(plan.where("copies > 1").take(1))
    scratch.keep_only(plan)

    w, stop, need, copies, at, cut, nth, taken = unused(marked, "whole", "stop", "need", "copies", "at", "cut", "nth", "taken")
    plan = plan.select(F.col("leaf").alias(leaf), F.col("whole").alias(w), F.col("stop").alias(stop), F.col("need").alias(need), F.col("copies").alias(copies))
    out = marked.join(checked_broadcast(plan), leaf).withColumn(at, place(seed, F.col(w), F.col(key))).where((F.col(w) > 0) | (F.col(at) <= F.col(stop)))
    # tokens of the partial epoch's copy: null where there is none
    edge = F.col(at) == F.col(stop)
    part = F.when(F.col(at) < F.col(stop), F.col(held)).when(edge, F.least(held, need))
    if twice:
        border = out.where(edge & (F.col(copies) > 1)).withColumn(nth, F.row_number().over(Window.partitionBy(leaf).orderBy(F.to_json(F.struct(*docs.columns)))))
        left = F.col(need) - (F.col(nth) - 1) * F.col(held)
        border = border.withColumn(cut, F.when(left > 0, F.least(F.col(held), left))).drop(nth)
        out = out.where(~F.coalesce(edge & (F.col(copies) > 1), F.lit(False))).withColumn(cut, part).unionByName(border)
    else:
        out = out.withColumn(cut, part)
    full = F.when(F.col(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(w) - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.col(held).alias("n")))).otherwise(F.array().cast("array<struct<epoch:int,n:bigint>>"))
    more = F.when(F.col(cut).isNotNull(), F.array(F.struct(F.col(w).alias("epoch"), F.col(cut).alias("n")))).otherwise(F.array().cast("array<struct<epoch:int,n:bigint>>"))
    out = out.withColumn(taken, F.explode(F.concat(full, more)))
    shorter = F.col(taken)["n"] < F.col(held)
    text = F.when(shorter, first_tokens(F.col("text"), F.col(taken)["n"])).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(shorter, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c.lower() not in added:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns, F.col(taken)["epoch"].alias(added[0]), F.col(taken)["n"].alias(added[1]))


def _null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({n: f"_r{n}" for n in names})
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_r{n}"))
    return left.join(right, cond, how).drop(*[f"_r{n}" for n in names])
