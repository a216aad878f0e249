import random

from tributary.llm.seedtree import connected_components, groups_of_shared_values


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


def test_groups_of_packed_lists_match_brute_force(spark, tmp_path):
    from tributary.llm.queries import p3_found

    rng = random.Random(8)
    people = [(f"Ann Lee{i}", f"u{i}@x.org") for i in range(40)]
    rows = []
    for r in range(120):
        names = [rng.choice(people)[0] for _ in range(rng.choice([0, 1, 1, 2]))] + ["Single"] * (r % 5 == 0)
        mails = [rng.choice(people)[1].upper() if rng.random() < 0.5 else rng.choice(people)[1] for _ in range(rng.choice([0, 0, 1, 2]))] + ["nobody"] * (r % 7 == 0)
        rows.append((r, names, mails))
    packed = [(r, "; ".join(n) or None, "; ".join(m), len(n), len(m)) for r, n, m in rows]
    spark.createDataFrame(packed, "record_id long, names string, emails string, num_names int, num_emails int").write.parquet(f"{tmp_path}/contributors_all_projects.parquet")
    holders = {}
    for r, n, m in rows:
        for v in {("n", x.lower()) for x in n if " " in x} | {("e", x.lower()) for x in m if "@" in x}:
            holders.setdefault(v, []).append(r)
    want = brute([(h[0], x) for h in holders.values() for x in h[1:]])
    got = [tuple(x) for x in p3_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want
