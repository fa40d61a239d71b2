"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions over the whole text. On a sample of labelled rows, bounded by
``max_train_rows``, small regression trees are boosted with logistic loss; every path from a root to a node becomes a
conjunctive rule, rules and winsorised statistics get weights by lasso logistic regression (coordinate-wise soft
thresholding of a proximal gradient), and what keeps a weight is compiled into one column expression.

Labels are matched by doc_id; rows with a null label do not teach, nor do documents whose labels disagree. Without a label of each class the score is the
label share of the sample (0.5 without labels). Null and empty texts have all statistics zero and are scored by the
same rules. Labels, lang, source and doc_id are never inputs of a score. Repeated rows are scored each; other columns
pass through ``score`` unless named score or predicted, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.runtime import Scratch, unused

MAX_TRAIN_ROWS = 8_000
CUT = 0.7
#: Held-out rows never teach: those whose crc32 of doc_id as text leaves this remainder modulo 4.
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def statistics(text: Column, of: str) -> dict[str, Column]:
    """Named statistics of a text; the raw counts they share are in a struct of ``counts``."""
    c = {k: F.col(f"{of}.{k}") for k in counts(text)}
    chars, words, lines = F.greatest(c["chars"], F.lit(1)), F.greatest(c["words"], F.lit(1)), F.greatest(c["lines"], F.lit(1))
    return {
        "chars": F.log1p(c["chars"]), "words": F.log1p(c["words"]), "word_len": c["chars"] / words, "line_len": F.log1p(c["chars"] / lines),
        "odd": c["odd"] / chars, "odd_per_word": c["odd"] / words, "upper": c["upper"] / chars, "digits": c["digits"] / chars,
        "pipes": c["pipes"] / words, "shouts": c["shouts"] / words, "stops": c["stops"] / words, "lines": c["lines"] / words,
        "unique_words": c["unique_words"] / words, "unique_lines": c["unique_lines"] / lines, "tags": c["tags"] / words,
    }


def counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words = F.split(t, r"\s+")
    lines = F.split(t, "\n")
    return {
        "chars": F.length(t).cast("double"), "words": F.when(t == "", 0.0).otherwise(F.size(words).cast("double")), "lines": F.size(lines).cast("double"),
        "odd": n(r"[#$%&*^~@=+<>{}\[\]\\/|_]"), "upper": n(r"\p{Lu}"), "digits": n(r"[0-9]"), "pipes": n(r" \| "), "shouts": n(r"!"), "stops": n(r"[.,;:?]"),
        "unique_words": F.size(F.array_distinct(words)).cast("double"), "unique_lines": F.size(F.array_distinct(lines)).cast("double"), "tags": n(r"</?[a-zA-Z]"),
    }


NAMES = ("chars", "words", "word_len", "line_len", "odd", "odd_per_word", "upper", "digits", "pipes", "shouts", "stops", "lines", "unique_words", "unique_lines", "tags")


def with_statistics(df: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    # the one-row explode keeps the optimiser from copying the counts into a filter on what is derived from them,
    # where every rule would scan the text again
    (of,) = unused(df, "counts")
    counted = df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in counts(F.col(text)).items()]))).alias(of))
    return counted.withColumn(into, F.struct(*[v.alias(k) for k, v in statistics(F.col(text), of).items()])).drop(of)


@dataclass(frozen=True)
class Rule:
    """All of the conditions hold: statistic, whether above, threshold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def over(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, cut in self.conditions:
            out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    #: statistic, weight, low, high, mean, deviation
    linear: list[tuple[int, float, float, float, float, float]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.over(x)
        for k, w, lo, hi, m, s in self.linear:
            z += w * (np.clip(x[:, k], lo, hi) - m) / s
        return z

    def column(self, stats: str = "_stats") -> Column:
        """The ensemble as one column expression over a struct of statistics."""
        at = [F.col(f"{stats}.{n}") for n in NAMES]
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            cond = None
            for k, above, cut in rule.conditions:
                c = at[k] > F.lit(float(cut)) if above else at[k] <= F.lit(float(cut))
                cond = c if cond is None else cond & c
            z = z + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        for k, w, lo, hi, m, s in self.linear:
            z = z + (F.least(F.greatest(at[k], F.lit(float(lo))), F.lit(float(hi))) - F.lit(float(m))) * F.lit(float(w / s))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x, g, h, cuts, rows, depth, path, out, min_rows=20):
    """Grow one tree on gradients; every node below the root adds its path to out. Returns leaf steps by row."""
    step = np.zeros(len(x))
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    step[rows] = value
    if path:
        out.append(Rule(tuple(sorted(path))))
    if depth == 0 or len(rows) < 2 * min_rows:
        return step
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    for k, edges in enumerate(cuts):
        if not len(edges):
            continue
        b = np.searchsorted(edges, x[rows, k])  # bin i: edges[i-1] < x <= edges[i]
        gs, hs, ns = (np.bincount(b, weights=w, minlength=len(edges) + 1)[:-1].cumsum() for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - base
        gain[(ns < min_rows) | (len(rows) - ns < min_rows)] = -1
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (k, float(edges[i])))
    if best[1] is None:
        return step
    k, cut = best[1]
    low = x[rows, k] <= cut
    for side, part in ((False, rows[low]), (True, rows[~low])):
        step[part] = _tree(x, g, h, cuts, part, depth - 1, [*path, (k, side, cut)], out, min_rows)[part]
    return step


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, seed: int = 5) -> Ensemble:
    """Fit on rows of statistics and 0/1 labels."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    cuts = [c[:-1] if len(c) and c[-1] >= x[:, k].max() else c for k, c in enumerate(cuts)]
    f, rules = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(50, len(y) // 2) if len(y) > 100 else len(y), replace=False))
        found: list[Rule] = []
        step = _tree(x, p - y, p * (1 - p), cuts, rows, depth, [], found)
        f += rate * step
        rules += found
    rules = list(dict.fromkeys(rules))
    cols, seen = [], set()
    for r in rules:
        c = r.over(x)
        if 5 <= c.sum() <= len(y) - 5 and (k := c.tobytes()) not in seen:
            seen.add(k)
            cols.append((r, c))
    lin = []
    for k in range(x.shape[1]):
        lo, hi = np.quantile(x[:, k], [0.025, 0.975])
        c = np.clip(x[:, k], lo, hi)
        if c.std() > 1e-9:
            lin.append((k, float(lo), float(hi), float(c.mean()), float(c.std())))
    a = np.column_stack([*[c.astype(float) for _, c in cols], *[0.4 * (np.clip(x[:, k], lo, hi) - m) / s for k, lo, hi, m, s in lin]]) if cols or lin else np.zeros((len(y), 0))
    mean = a.mean(axis=0)
    scale = np.maximum(a.std(axis=0), 1e-9)
    z = (a - mean) / scale
    w, b = _lasso(z, y, penalty)
    w = w / scale
    bias = b - float((w * mean).sum())
    n = len(cols)
    out = Ensemble(bias)
    out.rules = [(r, float(v)) for (r, _), v in zip(cols, w[:n], strict=True) if v]
    out.linear = [(k, float(0.4 * v), lo, hi, m, s) for (k, lo, hi, m, s), v in zip(lin, w[n:], strict=True) if v]
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty; the intercept is free."""
    n, d = z.shape
    if not d:
        return np.zeros(0), float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(d)
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-30
    lip = 0.25 * (float(np.linalg.norm(z @ v) ** 2) / n + 1.0) * 1.05
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ pw + pb)))
        nw = pw - z.T @ (p - y) / n / lip
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - penalty / lip)
        nb = pb - float((p - y).mean()) / lip
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, label: str = "quality") -> Ensemble:
    """Learn from rows outside the held-out part; at most about max_train_rows of them, chosen by a hash of doc_id."""
    scratch = Scratch(docs.sparkSession, "quality")
    mine = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("double").alias("y"))
    n = mine.count()
    part = max(1, -(-n // max_train_rows))
    chosen = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
    # documents whose labels disagree do not teach
    chosen = scratch.keep(chosen.where("y = most").drop("most"), "chosen")
    # bounded by max_train_rows, so it can be broadcast; the texts are read once, and only the statistics travel
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "y", "_stats.*")
    t = rows.toArrow().sort_by([("doc_id", "ascending"), *[(k, "ascending") for k in NAMES]])
    scratch.keep_only()
    x = np.column_stack([t[k].to_numpy().astype(float) for k in NAMES]) if t.num_rows else np.zeros((0, len(NAMES)))
    return fit(x, t["y"].to_numpy().astype(float) if t.num_rows else np.zeros(0))


def score(docs: DataFrame, model: Ensemble, cut: float = CUT) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= cut)."""
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("score", "predicted")])
    (stats,) = unused(docs, "stats")
    out = with_statistics(docs, into=stats).withColumn("score", model.column(stats)).drop(stats)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def kept(docs: DataFrame, model: Ensemble, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least cut, columns unchanged."""
    stats, score_ = unused(docs, "stats", "score")
    return with_statistics(docs, into=stats).withColumn(score_, model.column(stats)).where(F.col(score_) >= cut).drop(stats, score_)
