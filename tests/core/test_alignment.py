import numpy as np
import pytest

from loomery.operators import alignment as A


def slow(a, b):
    """Best score of all alignments with affine gaps, cell by cell."""
    low = -(10**9)
    h, e, f = ([[v] * (len(b) + 1) for _ in range(len(a) + 1)] for v in (0, low, low))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] - 5, e[i][j - 1] - 2)
            f[i][j] = max(h[i - 1][j] - 5, f[i - 1][j] - 2)
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -3), e[i][j], f[i][j])
    return max(map(max, h))


def pairs(n=80):
    rng = np.random.default_rng(1)
    for _ in range(n):
        a = "".join(rng.choice(list("ACGT"), rng.integers(0, 30)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choice(list("ACGT"), rng.integers(0, 12)))
        yield (a, b) if rng.random() < 0.5 else (b, a[rng.integers(0, 5) :])


def test_local_score():
    for a, b in pairs():
        assert A.local_score(a, b) == slow(a, b)


def test_coordinates_and_identity():
    for a, b in pairs():
        got = A.align(a, b)
        if not slow(a, b):
            assert got is None
            continue
        score, identity, i0, i1, j0, j1 = got
        # the named parts alone reach the score, and nothing of them can go
        assert score == slow(a, b) == slow(a[i0 : i1 + 1], b[j0 : j1 + 1])
        assert a[i0] == b[j0] and a[i1] == b[j1] and 0 < identity <= 1
    assert A.align("xxACGTACGTyy", "zACGTACGT") == (16, 1.0, 2, 9, 1, 8)
    score, identity, *ends = A.align("AAAACCCCGGGGTTTT", "AAAACCCCAGGGGTTTT")
    assert (score, ends) == (32 - 5, [0, 15, 0, 16]) and identity == pytest.approx(16 / 17)


def test_pair_classes():
    base = "ACGTTGCAAGCTTAGCATCGATCGGATCTA"
    assert A.pair_class(base, base) == "="
    assert (A.pair_class(base[:20], base), A.pair_class(base, base[:20])) == ("C", "D")
    other = base[:15] + ("A" if base[15] != "A" else "C") + base[16:]
    assert A.pair_class(base * 3, base + other + base) == "E"
    assert (A.pair_class(other + base * 2 + "T" * 30, base * 3), A.pair_class(base * 3, other + base * 2 + "T" * 30)) == ("W", "M")
    assert A.pair_class("A" * 20, "C" * 20) == "X"


def test_as_columns(spark):
    df = spark.createDataFrame([("ACGTACGT", "xACGTACGT"), ("AAAA", "CCCC"), (None, "A")], "a string, b string")
    got = df.select(A.aligned("a", "b").alias("x"), A.classified("a", "b").alias("code"), A.alignment_score("a", "b").alias("s")).collect()
    assert [r.code for r in got] == ["C", "X", "C"] and [r.s for r in got] == [16, 0, 0]
    assert tuple(got[0].x) == (16, 1.0, 0, 7, 1, 8) and got[1].x.score is None
