import random

from tributary.operators.components import connected_components, groups_of_shared_values


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    rows = connected_components(df).collect()
    assert len(rows) == len({r["vertex"] for r in rows})
    return {r["vertex"]: r["component"] for r in rows}


def test_random_graphs_chain_and_star(spark):
    rng = random.Random(4)
    graph = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    chain = [(1000 + i, 1001 + i) for i in range(300)]
    star = [(5000, 5001 + i) for i in range(2000)]
    edges = graph + chain + star + graph[:20]
    rng.shuffle(edges)
    assert run(spark, edges) == brute(edges)


def test_loops_nulls_and_no_edges(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (None, 4), (3, 2)], "a long, b long")
    assert {(r["vertex"], r["component"]) for r in connected_components(df).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_values_with_a_hot_value(spark):
    rows = [(i, "hot") for i in range(1000, 2000)] + [(i, f"v{i // 2}") for i in range(1000)] + [(5000, None), (7, "hot")]
    got = {r["vertex"]: r["component"] for r in groups_of_shared_values(spark.createDataFrame(rows, "id long, v string"), "v", "id").collect()}
    assert got[1500] == got[7] == got[6] == 6 and got[1] == 0 and 5000 not in got


def test_thinned_edges_have_the_same_components(spark):
    import random

    from tributary.operators.components import thinned

    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(900, 901 + k) for k in range(50)] + [(901 + i, 901 + j) for i in range(50) for j in range(i)] + [(7000, 7000), (8000, None), (None, 8001)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = thinned(df, "a", "b")
    assert few.where("a >= 900 AND a < 1000").count() <= 4 * 51
    assert {tuple(x) for x in connected_components(few).collect()} == {tuple(x) for x in connected_components(df).collect()}
