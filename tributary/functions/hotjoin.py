"""Equi-joins onto one row per key where a few keys hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import materialise

#: A key is hot when it holds at least one row in HOT_PARTS of the many side; at most HOT_PARTS keys can.
HOT_PARTS = 2000


def join_hot(many: DataFrame, one: DataFrame, key: str, weight: str, total: int, heaviest: int | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``; ``weight`` = the key's rows in ``many``).

    Keys with at least ``total / HOT_PARTS`` rows are joined by broadcast: their number cannot exceed
    ``HOT_PARTS``, so the broadcast is bounded whatever the data. The other keys are joined by a shuffle
    in which no key holds more than one row in ``HOT_PARTS``, or 100 rows. ``heaviest``, where known, is the
    largest weight: when no key is hot, a plain join does. Rows with a null key match nothing.
    """
    limit = max(100, -(-total // HOT_PARTS))
    if heaviest is not None and heaviest < limit:
        return many.join(one.drop(weight), key)
    hot = F.broadcast(one.where(F.col(weight) >= limit).drop(weight))
    cold = one.where(F.col(weight) < limit).drop(weight)
    flags = F.broadcast(one.where(F.col(weight) >= limit).select(key))
    left_hot = many.join(hot, key)
    left_cold = many.join(flags, key, "left_anti").join(cold, key)
    return left_hot.unionByName(left_cold)


def join_hot_left(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Left join of ``many`` to ``one`` (unique on ``key``) where a few keys hold most rows of ``many``: the weights are counted first.

    Rows with a null key match nothing and are kept; they do not meet in one task.
    """
    weights = materialise(many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__weight")), "weights", n=F.sum("__weight"), top=F.max("__weight"))
    full = weights.join(one, key, "left")
    found = join_hot(many.where(F.col(key).isNotNull()), full, key, "__weight", weights.measured["n"] or 0, weights.measured["top"] or 0)
    return found.unionByName(many.where(F.col(key).isNull()), allowMissingColumns=True)
