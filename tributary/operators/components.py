"""Connected components of edge tables: large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot
from tributary.session import discard, materialise


def star_edges(members: DataFrame, value: str, vertex: str) -> DataFrame:
    """(a, b): every vertex that shares a value linked to the smallest vertex with that value.

    Links all holders of a value with one edge each instead of all pairs. The minimum combines on the
    map side; values that hold a large share of the rows are split off (``join_hot``). Null values and
    null vertices link nothing.
    """
    m = members.where(F.col(value).isNotNull() & F.col(vertex).isNotNull()).select(F.col(value).alias("v"), F.col(vertex).alias("a")).distinct()
    m = materialise(m, "members", n=F.count(F.lit(1)))
    least = m.groupBy("v").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    least = materialise(least, "least", top=F.max("n"))
    return join_hot(m, least, "v", "n", m.measured["n"], least.measured["top"] or 0).where("a <> b").select("a", "b")


def star(down: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v), u > v: a vertex hands the least of its neighbours to the larger ones or, in a small
    star, to the smaller ones and itself."""
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    around = materialise(around, "around", n=F.count(F.lit(1)))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).withColumn("m", F.least("u", "m"))
    least = materialise(least, "least", top=F.max("deg"))
    told = join_hot(around, least, "u", "deg", around.measured["n"], least.measured["top"] or 0)
    told = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = materialise(told.where("u > v").distinct(), "star", n=F.count(F.lit(1)), sign=F.bit_xor(F.xxhash64("u", "v")))
    discard(around)
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex reachable from each vertex that has an edge.

    Large and small stars take turns until the edges are stars around the smallest vertices. Edges may repeat, point either
    way or loop; a vertex with only a loop is its own component; null ends are ignored; no edges, no rows. Every round is a
    table in the shared folder, so a lost executor costs only its own tasks. Raises if ``max_rounds`` do not suffice.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    loops = e.where("u = v").select("u").distinct()
    down = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = materialise(down, "down", n=F.count(F.lit(1)), sign=F.bit_xor(F.xxhash64("u", "v")))
    for _ in range(max_rounds):
        wide = star(down, True)
        nxt = star(wide, False)
        discard(wide)
        same = nxt.measured == down.measured
        discard(down)
        down = nxt
        if same:
            break
    else:
        raise RuntimeError(f"not converged after {max_rounds} rounds")
    known = down.select("u", F.col("v").alias("c"))
    known = known.unionByName(known.select(F.col("c").alias("u"), "c").distinct())
    alone = loops.join(known.select("u"), "u", "left_anti").select("u", F.col("u").alias("c"))
    return known.unionByName(alone).select(F.col("u").alias("vertex"), F.col("c").alias("component"))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges with the smallest one it is linked to; of these only such as are linked to no other are given with themselves."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(names))
    while (least[a] != least[b]).any():
        m = np.minimum(least[a], least[b])
        for x in (least[a], least[b]):
            np.minimum.at(least, x, m)
        while (least != least[least]).any():
            least = least[least]
    size = np.bincount(least, minlength=len(names))
    keep = (least != np.arange(len(names))) | (size == 1)
    return names[keep], names[least[keep]]


def thinned(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Fewer edges with the same components: those of each batch as stars, so that of many edges among few vertices one a vertex is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in batches:
            if len(e):
                u, v = stars(e[a].to_numpy(), e[b].to_numpy())
                yield pd.DataFrame({a: u, b: v})

    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return e.mapInPandas(run, e.schema)


def groups_of_shared_values(members: DataFrame, value: str, vertex: str) -> DataFrame:
    """(vertex, component) of the vertices linked, directly or through others, by shared values."""
    return connected_components(star_edges(members, value, vertex))
