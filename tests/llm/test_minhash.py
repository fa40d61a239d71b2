import random
import re

import pytest

from loomery.llm import minhash


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def family(rng, n, words, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randint(0, most)):
            w[k] = f"x{rng.randrange(9000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(percent)
    texts = family(rng, 60, 150, 9) + family(rng, 30, 900, 40) + family(rng, 20, 12, 1) + [" ".join(f"q{rng.randrange(40)}" for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += rng.sample(texts, 30) + [None, "", " \n", "one", "ONE", "a b c d", "a  b\tc d"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[5]), (7, texts[7]), (None, texts[0])]
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, component_id int"), percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, percent)


def test_empty_and_keep_one(spark):
    schema = "doc_id bigint, text string, lang string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (3, "", "z"), (None, "a b c d e f g", "n"), (1, "a b c d e f g", "x"), (4, None, None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f g", "x"), (3, "", "z"), (4, None, None), (None, "a b c d e f g", "n")], key=str)


def test_chance_of_a_miss_is_small():
    for percent in (80, 85):
        r = minhash.rows_per_band(percent)
        assert (1 - (percent / 100) ** r) ** (minhash.N_BINS // r) < 1e-6


def thue_morse(flip):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024))


def test_structured_words_do_not_collide(spark):
    long = "x" * 300
    rows = [(1, thue_morse(0)), (2, thue_morse(1)), (3, f"{thue_morse(0)} b c d e f"), (4, f"{thue_morse(1)} b c d e f"), (5, long + "a"), (6, long + "b"), (7, long.upper() + "A")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 85)


def test_giant_star_and_large_sets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPOKES", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:100], f"x{k}", *base[101:]])) for k in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(family(rng, 12, 3000, 70))] + [(2000 + k, t) for k, t in enumerate(family(rng, 12, 3000, 130))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 85)


def test_parity_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 500, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        p, q = minhash.parity(x), minhash.parity(y)
        assert len(p) * 64 >= 2 * len(x) and len(p) == len(q)
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))
