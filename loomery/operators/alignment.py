"""Local alignment with affine gaps: scores, identity and coordinates, and the classes of pairs that follow from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

#: Scores of equal and unequal letters, and costs of a gap's first and further letters; fixed values.
MATCH, MISMATCH, GAP_OPEN, GAP_MORE = 2, -3, 5, 2
#: Score a letter from which on a sequence counts as matched at 95 %: 0.95 * 2 + 0.05 * -3; fixed value.
MATCHED = 1.75
ALIGNMENT = StructType().add("score", IntegerType()).add("identity", DoubleType()).add("a_start", IntegerType()).add("a_end", IntegerType()).add("b_start", IntegerType()).add("b_end", IntegerType())


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _rows(x: np.ndarray, y: np.ndarray):
    """The score table row by row: (best ending here, ending in a gap of y, ending in a gap of x), letters of y across.

    A gap along a row is a running maximum, because opening one out of another never pays.
    """
    n = len(y)
    above, down, slope = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, -(1 << 40), dtype=np.int64), np.arange(n + 1) * GAP_MORE
    for c in x:
        down = np.maximum(above - GAP_OPEN, down - GAP_MORE)
        new = np.maximum(down, 0)
        new[1:] = np.maximum(new[1:], above[:-1] + np.where(y == c, MATCH, MISMATCH))
        new[0] = 0
        along = np.full(n + 1, -(1 << 40), dtype=np.int64)
        along[1:] = np.maximum.accumulate(new + slope)[:-1] - GAP_OPEN - slope[:-1]
        above = np.maximum(new, along)
        yield above, down, along


def local_score(a: str, b: str) -> int:
    """The best local alignment's score."""
    x, y = _codes(a), _codes(b)
    return max((int(row.max()) for row, _, _ in _rows(x, y)), default=0) if len(y) else 0


def _end(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Score and the first cell, by row, that reaches it (letters from 0; -1 where nothing aligns)."""
    best = (0, -1, -1)
    if len(y):
        for i, (row, _, _) in enumerate(_rows(x, y)):
            if row.max() > best[0]:
                best = (int(row.max()), i, int(row.argmax()) - 1)
    return best


def align(a: str, b: str) -> tuple[int, float, int, int, int, int] | None:
    """Score, identity and first and last letters (from 0, both inside) of a best local alignment; None if there is none.

    Identity is the share of the alignment's columns, gaps included, that hold equal letters.
    """
    x, y = _codes(a), _codes(b)
    score, i, j = _end(x, y)
    if not score:
        return None
    # the reversed parts reach the same score where the alignment begins; then the table of that rectangle is kept
    back = _end(x[: i + 1][::-1], y[: j + 1][::-1])
    i0, j0 = i - back[1], j - back[2]
    x, y = x[i0 : i + 1], y[j0 : j + 1]
    table = list(_rows(x, y))
    r, c, kind, same, columns = len(x), len(y), 0, 0, 0
    while r and c:
        best, down, along = (t[c] for t in table[r - 1])
        if kind == 0 and best == 0:
            break
        if kind == 0:
            before = table[r - 2][0][c - 1] if r > 1 else 0
            if best == before + (MATCH if x[r - 1] == y[c - 1] else MISMATCH):
                same += int(x[r - 1] == y[c - 1])
                columns, r, c = columns + 1, r - 1, c - 1
            else:
                kind = 1 if best == down else 2
        elif kind == 1:
            kind = 0 if r < 2 or down == table[r - 2][0][c] - GAP_OPEN else 1
            columns, r = columns + 1, r - 1
        else:
            kind = 0 if along == table[r - 1][0][c - 1] - GAP_OPEN else 2
            columns, c = columns + 1, c - 1
    return score, same / max(1, columns), i0, i, j0, j


def pair_class(a: str, b: str) -> str:
    """= equal, C a in b, D b in a, E matched over the longer one, M matched over a, W matched over b, X none of these."""
    if len(b) > len(a):
        longer, shorter, codes = b, a, "CM"
    else:
        longer, shorter, codes = a, b, "DW"
    if shorter in longer:
        return "=" if len(a) == len(b) else codes[0]
    score = local_score(shorter, longer)
    if score < MATCHED * len(shorter):
        return "X"
    return "E" if score >= MATCHED * len(longer) else codes[1]


@F.pandas_udf(IntegerType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([local_score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(ALIGNMENT)
def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Alignments of pairs; all null where nothing aligns."""
    rows = [align(x or "", y or "") or (None,) * 6 for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=ALIGNMENT.names).astype({n: "float64" if n == "identity" else "Int32" for n in ALIGNMENT.names})


@F.pandas_udf(StringType())
def classified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pair_class(x or "", y or "") for x, y in zip(a, b, strict=True)])
