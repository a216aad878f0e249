"""Per-key results where a handful of keys hold most rows: value-frequency compression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.prefix import prefix_sum
from tributary.session import materialise


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs under each key.

    Rows combine on the map side and are spread over tasks by key *and* value, so no task holds a hot
    key. Null keys and null values are values like any other; NaN equals NaN.
    """
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def distinct_and_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_distinct, mode, mode_n), exact, of the non-null values; ``n_rows`` counts all rows.

    Of values that are equally frequent the smallest is the mode. A key with only null values has
    ``n_distinct`` 0 and a null mode. An empty table gives no rows.
    """
    c = compress(df, key, value)
    some = F.col("value").isNotNull()
    best = F.min(F.when(some, F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))))
    return c.groupBy("key").agg(
        F.sum("n").alias("n_rows"), F.count_if(some).alias("n_distinct"), best.getField("v").alias("mode"), (-best.getField("m")).alias("mode_n")
    )


def weighted_percentiles(df: DataFrame, key: str, value: str, points: list[float]) -> DataFrame:
    """(key, p<percent>...) exact percentiles by nearest rank of the values that are neither null nor NaN.

    Works on the compressed (key, value, n) rows; running counts come from range-sorted prefix sums,
    so neither a hot key nor its many distinct values meet in one task. The percentile q of N values is
    the smallest value with at least ceil(q N) values up to it (at least 1).
    """
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    c = materialise(compress(some, key, value), "compressed")
    run = prefix_sum(c, ["key"], ["value"], "n", "upto")
    total = c.groupBy(F.col("key").alias("__k")).agg(F.sum("n").alias("__total"))
    run = run.join(F.broadcast(total) if total.limit(100_001).count() <= 100_000 else total, F.col("key").eqNullSafe(F.col("__k")))
    aggs = []
    for q in points:
        need = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("__total")))
        aggs.append(F.min(F.when(F.col("upto") >= need, F.col("value"))).alias(f"p{round(q * 100)}"))
    return run.groupBy("key").agg(*aggs)


def key_report(df: DataFrame, key: str, category: str, number: str, points: list[float] = (0.5, 0.9)) -> DataFrame:
    """One row per key: rows, sum of ``number`` (null and NaN left out), distinct and most frequent
    ``category``, percentiles of ``number``. Every key with a row is present; a null key is a key."""
    d = distinct_and_mode(df, key, category)
    s = compress(df, key, number).groupBy("key").agg(
        F.sum(F.when(~F.isnan(F.col("value").cast("double")), F.col("value") * F.col("n"))).alias("total"),
        F.count_if(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).alias("distinct_numbers"),
    )
    p = weighted_percentiles(df, key, number, list(points))
    s, p = s.withColumnRenamed("key", "__k1"), p.withColumnRenamed("key", "__k2")
    out = d.join(s, F.col("key").eqNullSafe(F.col("__k1")), "left").join(p, F.col("key").eqNullSafe(F.col("__k2")), "left").drop("__k1", "__k2")
    return out


def heavy_keys(df: DataFrame, key: str, category: str, share: float) -> DataFrame:
    """(key, n_rows, n_distinct) of the keys with at least ``share`` of all rows."""
    d = materialise(distinct_and_mode(df, key, category), "keyload")
    total = d.agg(F.sum("n_rows")).first()[0] or 0
    return d.where(F.col("n_rows") >= F.lit(share * total)).select("key", "n_rows", "n_distinct")
