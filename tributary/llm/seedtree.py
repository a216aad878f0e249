"""Pairwise matches consolidated into groups: connected components by seed-tree pruning, over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot
from tributary.operators.components import star_edges
from tributary.session import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex reachable from each vertex that has an edge.

    Each round every vertex points its neighbourhood at the neighbourhood's minimum; a vertex that is
    nobody's minimum is pruned and hung below its own minimum in the propagation forest, so the graph
    shrinks to its seeds in a logarithmic number of rounds. Seed identifiers then flow down the forest,
    one level of pruning at a time, latest first. Edges may repeat, point either way or loop; a vertex with
    only a loop is its own component; null ends are ignored; no edges, no rows. Every round is written to the
    shared folder, so a lost executor costs only its own tasks. Raises if ``max_rounds`` do not suffice.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = e.where("u <> v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    count = F.count(F.lit(1))
    graph = materialise(both.distinct(), "graph", n=count)
    loops = e.where("u = v").select("u").distinct()
    levels: list[DataFrame] = []  # (u, parent, deg) of the vertices pruned in each round
    vertices = None
    n = graph.measured["n"]
    for _ in range(max_rounds):
        if n == 0:
            break
        # minimum of the closed neighbourhood, combined before the shuffle
        least = graph.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).withColumn("m", F.least("u", "m"))
        least = materialise(least, "least", top=F.max("deg"))
        vertices = vertices or least
        arcs = join_hot(graph, least, "u", "deg", n, least.measured["top"]).select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m")).distinct()
        arcs = materialise(arcs, "arcs", n=count)
        down = arcs.groupBy("u").agg(F.min("m").alias("p"), F.count("*").alias("deg"), F.max(F.col("m") == F.col("u")).alias("kept"))
        down = materialise(down, "down", top=F.max("deg"), pruned=F.count_if(~F.col("kept")))
        # vertices with a single arc link nothing further
        many = down.where("deg > 1").select("u", "p", "deg")
        links = join_hot(arcs, many, "u", "deg", arcs.measured["n"], down.measured["top"]).where("m <> p").select(F.col("m").alias("u"), F.col("p").alias("v"))
        nxt = materialise(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph", n=count)
        levels.append((down.where("not kept").select("u", F.col("p").alias("parent")), down.measured["pruned"]))
        for used in (graph, arcs):
            discard(used)
        graph, n = nxt, nxt.measured["n"]
    if n:
        raise RuntimeError(f"not converged after {max_rounds} rounds")
    if vertices is None:
        return loops.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    # whoever never dropped out is a seed
    gone = levels[0][0].select("u")
    for level, _ in levels[1:]:
        gone = gone.unionByName(level.select("u"))
    known = materialise(vertices.select("u").join(gone, "u", "left_anti").select("u", F.col("u").alias("c")), "known")
    for level, size in reversed(levels):
        # a parent has its identifier before its children: it stayed longer, or is a seed
        counted = materialise(level.groupBy("parent").agg(F.count("*").alias("deg")), "parents", top=F.max("deg"))
        ask = known.join(counted.withColumnRenamed("parent", "u"), "u").select(F.col("u").alias("parent"), "c", "deg")
        placed = join_hot(level, ask, "parent", "deg", size, counted.measured["top"] or 0).select("u", "c")
        known = materialise(known.unionByName(placed), "known")
    alone = loops.join(known.select("u"), "u", "left_anti").select("u", F.col("u").alias("c"))
    return known.unionByName(alone).select(F.col("u").alias("vertex"), F.col("c").alias("component"))


def groups_of_shared_values(members: DataFrame, value: str, vertex: str) -> DataFrame:
    """(vertex, component) of the vertices linked, directly or through others, by shared values."""
    return connected_components(star_edges(members, value, vertex))
