"""Prefix sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import materialise


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group up to and including this one.

    ``order`` must make rows of a group distinct, else ties fall in any order. The rows are
    range-sorted over group and order, so a group that holds a third of all rows spreads over many
    tasks; each task sums its own stretch, and the totals of the stretches before it are added (one
    row per task and group it holds, tiny). Null groups form a group of their own; null values count
    as zero. An empty table gives an empty table.
    """
    part, local, total, base = "__part", "__local", "__total", "__base"
    ordered = df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn(part, F.spark_partition_id())
    ordered = materialise(ordered, "prefix")
    w = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce(F.col(value), F.lit(0))
    # the stretches are the files' own rows, so the window shuffles by (task, group), never by the whole group
    rows = ordered.withColumn(local, F.sum(v).over(w))
    stretch = ordered.groupBy(part, *group).agg(F.sum(v).alias(total))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = stretch.withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    b = bases.select(F.col(part).alias("__bp"), *[F.col(g).alias(f"__b_{g}") for g in group], base)
    on = [F.col(part) == F.col("__bp")] + [F.col(g).eqNullSafe(F.col(f"__b_{g}")) for g in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(b, cond).withColumn(out, F.col(local) + F.col(base)).select(*df.columns, out)
