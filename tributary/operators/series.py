"""Time series per project and stage: assembly, interpolation, scaling, clusters and smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import materialise


def core_ratio_series(commits: DataFrame, project: str, stage: str, ts: str, churn: str, is_core: str) -> DataFrame:
    """(project, stage, values): the monthly share of core churn in order of time; months without any are left out, and so are series of one point."""
    m = commits.groupBy(project, stage, F.trunc(ts, "month").alias("m")).agg(F.sum(churn).alias("all"), F.sum(F.when(F.col(is_core), F.col(churn)).otherwise(0.0)).alias("core"))
    m = m.where("all <> 0 AND core <> 0").withColumn("r", F.col("core") / F.col("all"))
    s = m.groupBy(project, stage).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "r"))), lambda x: x["r"]).alias("values"))
    return s.where(F.size("values") > 1)


def resampled(values: Column, length: Column) -> Column:
    """An array by linear interpolation on ``length`` equally spaced points."""
    n = F.size(values)
    step = lambda i: i * (n - 1) / F.greatest(length - 1, F.lit(1))

    def at(i: Column) -> Column:
        k = F.least(F.floor(step(i)).cast("int"), n - 2)
        lo, hi = F.get(values, k), F.get(values, k + 1)
        return lo + (hi - lo) * (step(i) - k)

    return F.transform(F.sequence(F.lit(0), length - 1), at)


def interpolate_to_longest(df: DataFrame, values: str) -> DataFrame:
    """All series of a table on as many points as the longest has; an empty table stays empty."""
    longest = df.agg(F.max(F.size(values))).first()[0]
    return df if not longest else df.withColumn(values, resampled(F.col(values), F.lit(int(longest))))


def scale_positions(df: DataFrame, values: str) -> DataFrame:
    """Each position of the series scaled to 0..1 over all series; positions without spread become 0."""
    lim = df.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lim = lim.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), (x["hi"] - x["lo"]).alias("d"))).alias("__lim"))
    one = df.withColumn("__lim", lim.scalar())  # one value, as long as a series
    scaled = F.transform(F.arrays_zip(F.col(values).alias("v"), F.col("__lim").alias("l")), lambda x: F.when(x["l"]["d"] > 0, (x["v"] - x["l"]["lo"]) / F.nullif(x["l"]["d"], F.lit(0.0))).otherwise(0.0))
    return one.withColumn(values, scaled).drop("__lim")


SERIES_BLOCK = 2000  #: series whose distances a task holds as one dense table


def fit_kmeans(vectors: DataFrame, k: int, starts: int):
    """The k-means model with the least inertia of ``starts`` seeded starts; ``k`` is at least 2."""
    from pyspark.ml.clustering import KMeans

    return min((KMeans(k=k, seed=42 + s, maxIter=40).fit(vectors) for s in range(starts)), key=lambda m: m.summary.trainingCost)


def vectors_of(df: DataFrame, key: str, values: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = materialise(df.select(F.col(key).alias("key"), values), "series", n=F.count(F.lit(1)))
    out = rows.withColumn("features", array_to_vector(values))
    out.measured = rows.measured
    return out


def elbow(df: DataFrame, key: str, values: str, most: int = 10, starts: int = 10) -> DataFrame:
    """(k, inertia) for k from 1 to ``most``, or to the number of series: sums of squared distances to the nearest centroid."""
    x = vectors_of(df, key, values)
    mean = x.select(F.posexplode(values).alias("i", "v")).groupBy("i").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s")).first()[0]
    top = min(most, x.measured["n"])
    out = [(1, float(mean or 0.0))] * (top > 0) + [(k, float(fit_kmeans(x, k, starts).summary.trainingCost)) for k in range(2, top + 1)]
    return df.sparkSession.createDataFrame(out, "k int, inertia double")


def cluster_distances(df: DataFrame, key: str, values: str, cluster: str) -> DataFrame:
    """(key, cluster, other, total, n): for every series the sum of its Euclidean distances to all series of each cluster, itself among them.

    Series are dealt into blocks, and each two blocks meet in one task as dense tables; sums leave it, never pairs.
    """
    kind, m = df.schema[key].dataType.simpleString(), max(1, -(-df.count() // SERIES_BLOCK))
    b = df.select(F.col(key).alias("k"), F.col(values).alias("v"), F.col(cluster).alias("c"), F.pmod(F.hash(key), F.lit(m)).alias("b"))
    one = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("mine", F.lit(True))
    two = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("k", "v", "c", F.col("o").alias("b"), F.col("b").alias("o"), F.lit(False).alias("mine"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = g[g["mine"]], g[~g["mine"]]
        if not len(rows) or not len(cols):
            return pd.DataFrame({"key": [], "cluster": [], "other": [], "total": [], "n": []})
        y, c = np.stack(cols["v"].to_numpy()), cols["c"].to_numpy()
        labels, at = np.unique(c, return_inverse=True)
        out = []
        for k, v, own in zip(rows["k"], rows["v"], rows["c"]):
            d = np.bincount(at, np.sqrt(((y - np.asarray(v)) ** 2).sum(1)), len(labels))
            out += [(k, own, o, t, n) for o, t, n in zip(labels, d, np.bincount(at, minlength=len(labels)))]
        return pd.DataFrame(out, columns=["key", "cluster", "other", "total", "n"])

    parts = one.unionByName(two).groupBy("b", "o").applyInPandas(run, f"key {kind}, cluster int, other int, total double, n long")
    return parts.groupBy("key", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(distances: DataFrame) -> DataFrame:
    """(key, cluster, own_total, silhouette) from :func:`cluster_distances`; a series alone in its cluster, or without another cluster, has 0."""
    own = F.col("cluster") == F.col("other")
    g = distances.groupBy("key", "cluster").agg(F.max(F.when(own, F.col("total"))).alias("own_total"), F.max(F.when(own, F.col("n"))).alias("own_n"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    a = F.col("own_total") / F.nullif(F.col("own_n") - 1, F.lit(0))
    return g.select("key", "cluster", "own_total", F.coalesce((F.col("b") - a) / F.nullif(F.greatest(a, F.col("b")), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def cluster_series(df: DataFrame, key: str, values: str, k: int | None, starts: int = 10, most: int = 9) -> DataFrame:
    """(key, cluster, pattern, medoid, silhouette) by k-means, the best of ``starts`` seeded starts.

    Without ``k`` the number of clusters from 2 to ``most`` with the best mean silhouette is taken, the smaller of equals. Clusters are numbered by the mean
    of their centroids, so labels can be compared between runs; the pattern names the smoothed centroid. The medoid is the
    member with the least sum of distances to its cluster, of equals the smallest key. With fewer series than clusters k is lowered; fewer than two series give none.
    """
    kind = df.schema[key].dataType.simpleString()
    x = vectors_of(df, key, values)
    if x.measured["n"] < 2:
        return df.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, pattern string, medoid boolean, silhouette double")
    best = None
    for n in [min(k, x.measured["n"])] if k else range(2, min(most, x.measured["n"]) + 1):
        model = fit_kmeans(x, n, starts)
        centers = sorted(model.clusterCenters(), key=lambda c: (float(np.mean(c)), tuple(c)))
        c = np.stack(centers)

        def run(batches: Iterator[pd.DataFrame], c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = np.stack([np.asarray(t, dtype=float) for t in b[values]]) if len(b) else np.zeros((0, c.shape[1]))
                yield b.assign(cluster=((v[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1).astype("int32"))

        placed = materialise(x.select("key", values).mapInPandas(run, f"key {kind}, {values} array<double>, cluster int"), "clusters")
        s = materialise(silhouettes(cluster_distances(placed, "key", values, "cluster")), "silhouettes")
        score = s.agg(F.avg("silhouette")).first()[0]
        if best is None or score > best[0]:
            best = (score, s, centers)
    _, s, centers = best
    near = s.groupBy("cluster").agg(F.min_by("key", F.struct(F.round("own_total", 9), "key")).alias("__m"))
    label = F.element_at(F.array(*[F.lit(pattern(c)) for c in centers]), F.col("cluster") + 1)
    return s.join(F.broadcast(near), "cluster").select(F.col("key").alias(key), "cluster", label.alias("pattern"), (F.col("key") == F.col("__m")).alias("medoid"), "silhouette")


# Bounds of the patterns a centroid is named by.
LOW, HIGH, MIDDLE, SLOPE, CALM = 0.3, 0.6, 0.4, 0.2, 0.01


def pattern(centroid: np.ndarray) -> str:
    """Low, Increasing, High Constant or Declining, from a centroid smoothed over three points with zeros beyond its ends.

    The slope is the mean of the last quarter, rounded up, less that of the first, rounded down; calm centroids are named by level before slope.
    """
    c = np.convolve(centroid, np.ones(3) / 3, mode="same") if len(centroid) > 2 else np.asarray(centroid, dtype=float)
    head, tail = c[: len(c) // 4], c[-(-(-len(c) // 4)) :]
    slope = tail.mean() - head.mean() if len(head) else 0.0
    mean, calm = c.mean(), c.var() < CALM
    sure = (("Low", mean < LOW and calm), ("Increasing", slope > SLOPE), ("High Constant", mean > HIGH and calm), ("Declining", slope < -SLOPE))
    weak = (("Low", mean < MIDDLE), ("Increasing", slope > 0), ("High Constant", mean > HIGH), ("Declining", True))
    return next(name for name, holds in sure + weak if holds)


def smoothing_weights(window: int, degree: int) -> np.ndarray:
    """Weights of the neighbours in a least-squares polynomial taken at the window's middle."""
    h = window // 2
    return np.linalg.pinv(np.vander(np.arange(-h, h + 1), degree + 1, increasing=True))[0]


def savitzky_golay(df: DataFrame, index: str, value: str, period: int, window: int, degree: int) -> DataFrame:
    """(index, smooth): least-squares polynomials over a window on a ring of ``period`` points, taken at the window's middle.

    The fit is a fixed weighted sum of neighbours, so every point sends its value to the ``window`` points around it.
    """
    h, weights = window // 2, smoothing_weights(window, degree)
    w = F.array(*[F.struct(F.lit(int(o)).alias("o"), F.lit(float(x)).alias("w")) for o, x in zip(range(-h, h + 1), weights)])
    e = df.select(F.col(index).alias("i"), F.col(value).alias("v"), F.explode(w).alias("x"))
    first = 1
    target = F.pmod(F.col("i") - F.col("x.o") - first, F.lit(period)) + first
    return e.groupBy(target.alias(index)).agg(F.round(F.sum(F.col("v") * F.col("x.w")), 6).alias("smooth"))
