import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomery.llm import mixing
from loomery.runtime import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, epoch string, n_chars int, _leaf int, _TAKEN string"
LEVELS = lambda: {"lang": F.col("lang"), "source": F.col("source")}
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")


def budgets(spark, leaves, budget, weights, epochs=1):
    """Leaves' whole tokens by the operator; leaves: path to tokens."""
    n = len(next(iter(leaves)))
    names = [f"level{k}" for k in range(n)]
    df = spark.createDataFrame([("/".join(map(str, p)), *p, t) for p, t in leaves.items()], ", ".join(["leaf string", *[f"{x} string" for x in names], "tokens bigint"]))
    got = mixing.leaf_budgets(df, names, budget / sum(leaves.values()), weights, epochs, Scratch(spark, "test"))
    paths = {"/".join(map(str, p)): p for p in leaves}
    return {paths[r.leaf]: r["take"] for r in got.collect()}


def test_fill(spark):
    fill = lambda b, w, c: list(budgets(spark, {(str(k),): x for k, x in enumerate(c)}, b, {(str(k),): float(x) for k, x in enumerate(w)}).values())
    assert sorted(fill(10, [1, 1], [100, 100])) == [5, 5]
    assert sorted(fill(10, [1, 1], [2, 100])) == [2, 8]
    assert sorted(fill(10, [3, 1, 0], [4, 100, 100])) == [0, 4, 6]
    assert sorted(fill(10, [1, 1], [2, 3])) == [2, 3]


def test_siblings_before_ancestors(spark):
    leaves = {("a", "x"): 5, ("a", "y"): 100, ("b", "z"): 100}
    got = budgets(spark, leaves, 60, {})
    assert got == {("a", "x"): 5, ("a", "y"): 25, ("b", "z"): 30}  # x's shortage goes to y, not to b
    got = budgets(spark, {**leaves, ("a", "y"): 5}, 60, {})
    assert got == {("a", "x"): 5, ("a", "y"): 5, ("b", "z"): 50}


def test_many_leaves_add_up(spark):
    rng = random.Random(8)
    leaves = {(rng.choice("abc"), f"s{k}"): rng.randint(0, 50) for k in range(3000)}
    weights = {("a",): 0.3, ("b",): 2.5, ("c", "s5"): 0.0}
    got = budgets(spark, leaves, 20_000, weights)
    assert sum(got.values()) == 20_000 * sum(leaves.values()) // sum(leaves.values())
    want = shares(leaves, 20_000, weights, 1)
    for p, t in got.items():
        assert t <= leaves[p] and abs(t - want[p]) < 1


def shares(leaves, budget, weights, epochs):
    """Exact shares by raising the water level of each node's children step by step."""
    out = {}

    def cap(prefix, paths):
        if float(weights.get(prefix, 1.0)) <= 0 and prefix:
            return 0
        if len(prefix) == len(paths[0]):
            return leaves[prefix] * epochs
        return sum(cap(k, [p for p in paths if p[: len(k)] == k]) for k in {p[: len(prefix) + 1] for p in paths})

    def down(prefix, paths, amount):
        if len(prefix) == len(paths[0]):
            out[prefix] = amount
            return
        kids = {}
        for p in paths:
            kids.setdefault(p[: len(prefix) + 1], []).append(p)
        caps = {k: Fraction(cap(k, v)) for k, v in kids.items()}
        w = {k: Fraction(weights.get(k, 1.0)) for k in kids}
        got, left = dict.fromkeys(kids, Fraction(0)), min(amount, sum(caps.values()))
        while left:
            able = [k for k in kids if w[k] > 0 and got[k] < caps[k]]
            rise = min(min((caps[k] - got[k]) / w[k] for k in able), left / sum(w[k] for k in able))
            for k in able:
                got[k] += rise * w[k]
            left -= rise * sum(w[k] for k in able)
        for k, v in kids.items():
            down(k, v, got[k])

    down((), list(leaves), Fraction(budget))
    return out


def brute(rows, share, weights, epochs, seed=7, path=lambda r: (r[2], r[3])):
    """(doc_id, text, path, epoch, tokens) of what is taken, as strings in order."""
    leaves = {}
    for r in rows:
        leaves[path(r)] = leaves.get(path(r), 0) + len(tokens(r[1]))
    alive = {p: all(weights.get(p[: k + 1], 1.0) > 0 for k in range(len(p))) for p in leaves}
    room = sum(t * epochs for p, t in leaves.items() if alive[p])
    exact = shares(leaves, min(math.floor(share * sum(leaves.values()) + 1e-9), room), weights, epochs)
    name = lambda p: "".join("-" if x is None else f"{len(x)}:{x}" for x in p)
    out, sum_ = [], Fraction(1, 2)
    for p in sorted(leaves, key=lambda p: (md5(name(p)), name(p))):
        take = math.floor(sum_ + exact[p]) - math.floor(sum_)
        sum_ += exact[p]
        own = [r for r in rows if path(r) == p]
        if not leaves[p]:
            out += [(r[0], r[1], *p, 0, 0) for r in own if alive[p]]
            continue
        for e in range(epochs):
            key = lambda r, e=e: (md5(f"{seed}/{e}/" + md5(("" if r[0] is None else str(r[0])) + "/" + md5(r[1] or ""))), str(r[5:]))
            for r in sorted(own, key=key):
                n = min(take, len(tokens(r[1])))
                if take <= 0:
                    break
                text = r[1] if n == len(tokens(r[1])) else re.match(rf"(?:[\x20\x09-\x0d]*[^\x20\x09-\x0d]+){{{n}}}", r[1])[0]
                out.append((r[0], text, *p, e, n))
                take -= n
    return sorted(map(str, out))


def check(spark, rows, share, weights, epochs):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), LEVELS(), share, weights, epochs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_leaf", "_TAKEN", "epoch", "n_tokens"]
    got = got.collect()
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None and r.n_tokens < 30)
    assert sorted(str((r.doc_id, r.text, r.lang, r.source, r.epoch, r.n_tokens)) for r in got) == brute(rows, share, weights, epochs)
    return got


def row(i, text, lang, source):
    return (i, text, lang, source, "e", len(text or ""), 1, "x")


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (1.4, 3), (0.0, 1), (1.0, 1), (5.0, 2)])
def test_equals_brute_force(spark, share, epochs):
    rng = random.Random(2)
    gap = lambda: rng.choice([" ", "\n", " \t", " x "])
    rows = [row(k, "".join(gap() * (j > 0) + f"w{j}" for j in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3"])) for k in range(400)]
    rows += [row(1000, None, "en", "s1"), row(None, "a b", "en", "s1"), (*rows[5][:4], "f", *rows[5][5:]), row(7, "", "xx", "s9"), row(8, None, "xx", "s9")]
    check(spark, rows, share, {("en",): 3.0, ("fr", "s1"): 0.0}, epochs)


@pytest.mark.parametrize("seed", range(3))
def test_document_longer_than_its_budget(spark, seed):
    rows = [row(k, " ".join(f"w{j}" for j in range(10 if k else 1000)), "en", "s1") for k in range(60)]
    rng = random.Random(seed)
    rng.shuffle(rows)
    got = check(spark, rows, 795 / 1590, {}, 1)
    assert sum(r.n_tokens for r in got) == 795


def test_equal_rows_at_the_border(spark):
    rows = [row(1, "a b c d e", "en", "s1") for _ in range(40)]
    got = check(spark, rows, 0.51, {}, 1)
    assert sorted(r.n_tokens for r in got) == [2] + [5] * 20


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), {"lang": F.col("lang")}, 0.5, {}).count() == 0
