"""Rank statistics, correlation and tests of group differences; p-values from closed forms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.prefix import prefix_sum

# ---- tails


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_tail(x: float, df: int) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d or tiny
            c = 1 + an / c or tiny
            d = 1 / d
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


# ---- ranks


def average_ranks(df: DataFrame, value: str, within: list[str], out: str) -> DataFrame:
    """``df`` with average ranks of ``value`` within groups; null and NaN values get none.

    Ranks are taken over the counts of distinct values, so ties are ranked once; running counts come from a range sort
    (``prefix_sum``), so the distinct values of a group spread over many tasks.
    """
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    freq = some.groupBy(*within, value).agg(F.count("*").alias("__k"))
    ranks = prefix_sum(freq, within, [value], "__k", "__upto")
    ranks = ranks.withColumn(out, F.col("__upto") - F.col("__k") + (F.col("__k") + 1) / 2).drop("__k", "__upto")
    return df.join(ranks, [*within, value], "left")


def spearman_matrix(long: DataFrame, key: str, metric: str, value: str) -> DataFrame:
    """(metric_a, metric_b, n, rho) of every pair of metrics, a < b, over keys that have both.

    Each metric is ranked once over all its values, then pairs are correlated where both are present (ranks are not
    taken again per pair). Fewer than three keys or no variance give null. Metrics are few, keys may be many:
    the keys' ranks are pivoted into one row and all products are summed in one pass.
    """
    names = sorted(r[0] for r in long.select(metric).distinct().collect())
    ranked = average_ranks(long, value, [metric], "__r")
    wide = ranked.groupBy(key).pivot(metric, names).agg(F.max("__r"))
    sums: list[Column] = []
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        both = x.isNotNull() & y.isNotNull()
        sums.append(F.struct(
            F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.count_if(both).alias("n"), F.sum(F.when(both, x)).alias("sx"), F.sum(F.when(both, y)).alias("sy"),
            F.sum(F.when(both, x * x)).alias("xx"), F.sum(F.when(both, y * y)).alias("yy"), F.sum(F.when(both, x * y)).alias("xy"),
        ).alias(f"p{i}"))
    one = wide.agg(*sums).select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    vx, vy = F.col("xx") * F.col("n") - F.col("sx") ** 2, F.col("yy") * F.col("n") - F.col("sy") ** 2
    rho = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), (F.col("xy") * F.col("n") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0)))
    return one.select("metric_a", "metric_b", "n", rho.alias("rho"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, df, n, p_value): Kruskal-Wallis with tie correction; one group, or no variance, gives nulls."""
    some = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    r = _ranked(some, group, value)
    g = r.groupBy(group).agg(F.sum("__r").alias("rs"), F.count("*").alias("n")).collect()
    ties = some.groupBy(value).agg(F.count("*").alias("k")).agg(F.sum(F.col("k").cast("double") ** 3 - F.col("k"))).first()[0] or 0.0
    n = sum(x["n"] for x in g)
    spark = df.sparkSession
    fix = 1 - ties / (n**3 - n) if n > 1 else 0.0
    if len(g) < 2 or fix <= 0:
        return spark.createDataFrame([(None, len(g) - 1, n, None)], "h double, df int, n long, p_value double")
    h = (12 / (n * (n + 1)) * sum(x["rs"] ** 2 / x["n"] for x in g) - 3 * (n + 1)) / fix
    return spark.createDataFrame([(h, len(g) - 1, n, chi_square_tail(h, len(g) - 1))], "h double, df int, n long, p_value double")


def _ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    return average_ranks(df.select(group, value, F.lit(0).alias("__all")), value, ["__all"], "__r")


def effect(r: float) -> str:
    """Size of an effect: small below 0.3, large from 0.5."""
    return "small" if r < 0.3 else "medium" if r < 0.5 else "large"


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str, continuity: bool = True, tied: bool = True) -> DataFrame:
    """(u1, n1, n2, z, p_value, r, effect) of two groups, two-sided; effect size r = |z| / sqrt(n1 + n2). With ``continuity`` half a unit is
    taken off, with ``tied`` the variance is corrected for ties."""
    some = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    r = _ranked(some, group, value).groupBy(group).agg(F.sum("__r").alias("rs"), F.count("*").alias("n")).collect()
    ties = some.groupBy(value).agg(F.count("*").alias("k")).agg(F.sum(F.col("k").cast("double") ** 3 - F.col("k"))).first()[0] or 0.0
    by = {x[0]: x for x in r}
    schema = "u1 double, n1 long, n2 long, z double, p_value double, r double, effect string"
    if a not in by or b not in by:
        return df.sparkSession.createDataFrame([], schema)
    n1, n2 = by[a]["n"], by[b]["n"]
    n = n1 + n2
    u = by[a]["rs"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - (ties / (n * (n - 1)) if tied else 0.0))
    gap = abs(u - n1 * n2 / 2)
    z = max(0.0, gap - 0.5 * continuity) / math.sqrt(var) if var > 0 else 0.0
    return df.sparkSession.createDataFrame([(u, n1, n2, z, min(1.0, normal_tail(z)), z / math.sqrt(n), effect(z / math.sqrt(n)))], schema)


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """(w, n, z, p_value, r) of paired values: ranks of |x - y| without zeros, W the smaller rank sum; n counts zeros too."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.col(x) - F.col(y)).alias("d"))
    n_all = d.count()
    nz = d.where("d <> 0").select(F.abs("d").alias("a"), F.signum("d").alias("s"), F.lit(0).alias("__all"))
    got = average_ranks(nz, "a", ["__all"], "__r").agg(F.sum(F.when(F.col("s") > 0, F.col("__r")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("s") < 0, F.col("__r")).otherwise(0.0)).alias("m"), F.count("*").alias("n")).first()
    n, w = got["n"], min(got["p"] or 0.0, got["m"] or 0.0)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24) if n else 0.0
    z = (w - n * (n + 1) / 4) / sd if sd else 0.0
    return df.sparkSession.createDataFrame([(w, n_all, z, normal_tail(z), abs(z) / math.sqrt(n_all) if n_all else 0.0)], "w double, n long, z double, p_value double, r double")


def t_test(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(t, df, p_value) of two groups under equal variances."""
    s = {r[0]: r for r in df.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
    if a not in s or b not in s or s[a]["n"] + s[b]["n"] < 3:
        return df.sparkSession.createDataFrame([], "t double, df long, p_value double")
    n1, n2 = s[a]["n"], s[b]["n"]
    pooled = ((n1 - 1) * (s[a]["v"] or 0) + (n2 - 1) * (s[b]["v"] or 0)) / (n1 + n2 - 2)
    t = (s[a]["m"] - s[b]["m"]) / math.sqrt(pooled * (1 / n1 + 1 / n2)) if pooled > 0 else 0.0
    return df.sparkSession.createDataFrame([(t, n1 + n2 - 2, t_tail(t, n1 + n2 - 2))], "t double, df long, p_value double")


def scott_knott(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(group, mean, n, cluster): groups in order of their means, split where the F test of two sides is most significant.

    Sides are split again while the best split has p < alpha. Spark reduces each group to count, sum and sum of squares;
    the recursion works on these few rows.
    """
    rows = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).where("n > 0").collect()
    rows = sorted(rows, key=lambda r: (-r["s"] / r["n"], str(r[0])))
    out: dict = {}

    def f_of(part: list) -> float:
        n, s, q = (sum(r[k] for r in part) for k in ("n", "s", "q"))
        return n, s, q - s * s / n

    def split(part: list) -> None:
        best = None
        for i in range(1, len(part)):
            (n1, s1, w1), (n2, s2, w2) = f_of(part[:i]), f_of(part[i:])
            n, within = n1 + n2, w1 + w2
            between = s1 * s1 / n1 + s2 * s2 / n2 - (s1 + s2) ** 2 / n
            if n > 2 and within > 0:
                f = between / (within / (n - 2))
                if best is None or f > best[0]:
                    best = (f, i, n - 2)
        if best and f_tail(best[0], 1, best[2]) < alpha:
            split(part[: best[1]])
            split(part[best[1] :])
        else:
            label = len(set(out.values())) + 1
            out.update({r[0]: label for r in part})

    if rows:
        split(rows)
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame([(r[0], r["s"] / r["n"], r["n"], out[r[0]]) for r in rows], f"{group} {kind}, mean double, n long, cluster int")


def inflation_factors(corr: np.ndarray, ridge: float = 1e-6, least: float = 1e-12) -> np.ndarray:
    """Variance inflation factors, the diagonal of the inverse of a small correlation matrix; missing cells count as 0.

    Gauss-Jordan elimination with the largest entry of a column as its pivot; where that is next to zero, ``ridge`` is put on the diagonal, and
    where it stays so the matrix is singular.
    """
    m = np.nan_to_num(np.array(corr, dtype=float), nan=0.0)
    n = len(m)
    np.fill_diagonal(m, 1.0)
    work = np.hstack([m, np.eye(n)])
    for c in range(n):
        for again in (False, True):
            best = c + int(np.argmax(np.abs(work[c:, c])))
            if abs(work[best, c]) >= least:
                break
            if again:
                raise ValueError("singular even with a ridge")
            work[np.arange(n), np.arange(n)] += ridge
        work[[c, best]] = work[[best, c]]
        work[c] /= work[c, c]
        rest = np.arange(n) != c
        work[rest] -= np.outer(work[rest, c], work[c])
    return np.diag(work[:, n:])


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster labels of a small distance matrix: average linkage, merged while the nearest two are within ``cut``."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = min(((float(np.mean(distance[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    label = [0] * len(distance)
    for k, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g))), 1):
        for i in g:
            label[i] = k
    return label
