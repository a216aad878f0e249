"""Irregular readings on a regular grid, with low-rank estimates for the gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tributary.functions.prefix import prefix_sum
from tributary.session import materialise, shared_dir

DAY = 86_400_000_000  #: microseconds


def dense_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): consecutive integers from 0 for the distinct non-null values, in their order."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0))
    return prefix_sum(d, ["__all"], [col], "__one", "__upto").select(col, (F.col("__upto") - 1).cast(IntegerType()).alias(out))


def monthly_cells(df: DataFrame, source: str, micros: Column, value: str) -> DataFrame:
    """(source, month, n, total): rows and sum of ``value`` per source and UTC month.

    ``month`` counts months since year 0, January of year 0 being 0, by the UTC day of the instant, whatever zone
    the session is set to. Null and NaN values add nothing but their row counts; rows
    without an instant or source are left out. Combines before the shuffle, so hot sources do no harm.
    """
    day = F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY))) / F.lit(DAY)).cast("int"))
    v = F.col(value).cast("double")
    rows = df.where(F.col(source).isNotNull() & micros.isNotNull())
    return rows.groupBy(F.col(source).alias("source"), (F.year(day) * 12 + F.month(day) - 1).alias("month")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.isnan(v), v)), F.lit(0.0)).alias("total")
    )


def month_text(month: Column) -> Column:
    """``yyyy-MM`` of a month counted as in :func:`monthly_cells`."""
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"))


def regular_grid(cells: DataFrame, rank: int = 3, rounds: int = 8, reg: float = 0.05, least_cells: int = 3) -> DataFrame:
    """(source, month, n, total, estimate, state): every month from a source's first to its last reading.

    ``state`` is ``observed`` (``total`` exact, ``estimate`` null), ``filled`` (no reading; ``estimate`` from the
    factorisation) or ``unsupported`` (no reading, and source or month has fewer than ``least_cells``
    observed cells, so no estimate is made). Estimates come from alternating least squares of the given
    ``rank`` on log(1 + total), regularised by ``reg``; negative estimates become 0, and factors are fitted on
    observed cells only. A source with one reading gives one row. No cells, no rows; where every total is negative no estimate is made.
    """
    spark = cells.sparkSession
    c = materialise(cells, "cells")
    span = c.groupBy("source").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = span.select("source", F.explode(F.sequence("lo", "hi")).alias("month"))
    full = materialise(grid.join(c, ["source", "month"], "left"), "grid")
    by_source = c.groupBy("source").agg(F.count("*").alias("source_cells"))
    by_month = c.groupBy("month").agg(F.count("*").alias("month_cells"))
    gaps = full.where(F.col("n").isNull()).select("source", "month")
    gaps = gaps.join(by_source, "source").join(by_month, "month", "left")
    gaps = gaps.withColumn("supported", (F.col("source_cells") >= least_cells) & (F.coalesce("month_cells", F.lit(0)) >= least_cells))
    seen = full.where(F.col("n").isNotNull()).select("source", "month", "n", "total", F.lit(None).cast("double").alias("estimate"), F.lit("observed").alias("state"))
    ids = materialise(dense_ids(c, "source", "sid"), "ids")
    train = c.where("total >= 0").join(ids, "source").select("sid", "month", F.log1p("total").cast("float").alias("y"))
    asked = materialise(gaps.join(ids, "source"), "gaps")
    if train.isEmpty():  # no cell to fit on
        nothing = asked.select("source", "month", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("estimate"), F.lit("unsupported").alias("state"))
        return seen.unionByName(nothing)
    from pyspark.ml.recommendation import ALS

    shared_dir(spark)
    model = ALS(rank=rank, maxIter=rounds, regParam=reg, userCol="sid", itemCol="month", ratingCol="y", seed=7, coldStartStrategy="nan", checkpointInterval=4).fit(train)
    guess = model.transform(asked)
    usable = F.col("supported") & F.col("prediction").isNotNull() & ~F.isnan("prediction")
    est = F.when(usable, F.greatest(F.lit(0.0), F.expm1(F.col("prediction").cast("double"))))
    filled = guess.select(
        "source", "month", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("total"),
        est.alias("estimate"), F.when(usable, "filled").otherwise("unsupported").alias("state"),
    )
    return seen.unionByName(filled)
