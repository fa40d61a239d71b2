"""Statistical tests and fits. Spark aggregates; closed-form p-values are computed from the aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(value: str, by: str | None = None) -> Column:
    """Ranks from 1 where equal values share the mean of their places."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    first = F.rank().over(w.orderBy(value))
    return first + (F.count("*").over((Window.partitionBy(by, value) if by else Window.partitionBy(value))) - 1) / 2.0


def with_average_rank(rows: DataFrame, value: str, into: str) -> DataFrame:
    """average_rank over a whole table: places come from counts by value, so only distinct values are sorted."""
    per = rows.groupBy(value).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per.withColumn(into, before + (F.col("_c") + 1) / 2.0).drop("_c")
    return rows.join(ranks, value)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    r = with_average_rank(with_average_rank(rows.select(x, y), x, "_rx"), y, "_ry")
    return r.agg(F.corr("_rx", "_ry").alias("rho"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, and the degrees of freedom."""
    r = with_average_rank(rows.select(group, value), value, "_r")
    per = r.groupBy(group).agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    all_ = per.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n"), (F.count("*") - 1).alias("df")).crossJoin(ties)
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return all_.select(h.alias("h"), "df")


def mann_whitney(rows: DataFrame, first: Column, value: str) -> DataFrame:
    """U of the rows marked first, and the z of the normal approximation with tie correction, without continuity."""
    r = with_average_rank(rows.select(first.alias("_f"), value), value, "_r")
    s = r.agg(F.sum(F.when(F.col("_f"), F.col("_r"))).alias("s"), F.sum(F.col("_f").cast("int")).alias("n1"), F.sum((~F.col("_f")).cast("int")).alias("n2"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = s.crossJoin(ties).withColumn("u", F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0).withColumn("n", F.col("n1") + F.col("n2"))
    var = F.col("n1") * F.col("n2") / 12.0 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    return s.select("u", ((F.col("u") - F.col("n1") * F.col("n2") / 2.0) / F.sqrt(var)).alias("z"))


def contingency(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """The four cells of a 2 x 2 table and its odds ratio."""
    cell = lambda x, y: F.sum(((a == x) & (b == y)).cast("bigint"))
    t = rows.agg(cell(True, True).alias("tt"), cell(True, False).alias("tf"), cell(False, True).alias("ft"), cell(False, False).alias("ff"))
    return t.withColumn("odds", F.try_divide(F.col("tt") * F.col("ff"), F.col("tf") * F.col("ft")))


def log_log_fit(rows: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    r = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(*([by] if by else []), F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    g = r.groupBy(by) if by else r.groupBy()
    return g.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"))


def fisher_p(tt: int, tf: int, ft: int, ff: int) -> float:
    """Two-sided exact p-value: tables with the same margins that are no likelier than this one."""
    lf = lambda k: math.lgamma(k + 1)
    r1, r2, c1, n = tt + tf, ft + ff, tt + ft, tt + tf + ft + ff
    base = lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n)
    p = lambda k: math.exp(base - lf(k) - lf(r1 - k) - lf(c1 - k) - lf(r2 - c1 + k))
    here = p(tt) * (1 + 1e-7)
    return min(1.0, math.fsum(q for k in range(max(0, c1 - r2), min(r1, c1) + 1) if (q := p(k)) <= here))


def normal_p(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_p(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution: a series below the mean, a continued fraction above."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return 1 - total * scale
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if an * d + b else 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, by the t distribution's incomplete beta function."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else math.nan
    df = n - 2
    x = 1 - r * r  # df / (df + t^2)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


#: Values that a normality test takes at most; Royston's approximation was fitted up to there.
SHAPIRO_MOST = 5_000


def shapiro(values: list[float]) -> tuple[float, float]:
    """Shapiro-Wilk W and its p-value by Royston's approximation (1995); 3 to SHAPIRO_MOST values.

    Coefficients are those of the published polynomials, fixed values.
    """
    from statistics import NormalDist

    x, n = sorted(values), len(values)
    if not 3 <= n <= SHAPIRO_MOST:
        raise ValueError(f"a normality test takes 3 to {SHAPIRO_MOST} values")
    mean = math.fsum(x) / n
    spread = math.fsum((v - mean) ** 2 for v in x)
    if not spread:
        return 1.0, 1.0
    normal, poly = NormalDist(), lambda at, *c: sum(v * at**k for k, v in enumerate(c))
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = math.fsum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = poly(u, m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
        if n > 5:
            next_ = poly(u, m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
            a = [-last, -next_, *(v / math.sqrt(phi) for v in m[2:-2]), next_, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    w = min(1.0, math.fsum(p * v for p, v in zip(a, x, strict=True)) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        gamma = poly(n, -2.273, 0.459)
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y, mu, sigma = -math.log(gamma - math.log(1 - w)), poly(n, 0.5440, -0.39978, 0.025054, -0.0006714), math.exp(poly(n, 1.3822, -0.77857, 0.062767, -0.0020322))
    else:
        k = math.log(n)
        y, mu, sigma = math.log(1 - w), poly(k, -1.5861, -0.31082, -0.083751, 0.0038915), math.exp(poly(k, -0.4803, -0.082676, 0.0030302))
    return w, 1 - normal.cdf((y - mu) / sigma)


def forest_cv(rows: DataFrame, features: str, label: str, key: str, folds: int = 10, trees: int = 100, seed: int = 1) -> DataFrame:
    """fold, n, accuracy of a random forest; folds are by a hash of the key. features is an array column."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    r = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    out = None
    for k in range(folds):
        m = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed).fit(r.where(F.col("fold") != k))
        s = m.transform(r.where(F.col("fold") == k)).agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"))
        out = s if out is None else out.unionByName(s)
    return out
