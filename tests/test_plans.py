"""Operators of the survey against brute force on small fixtures."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot_left
from tributary.operators import codemetrics, lifecycle, series, statistics
from tributary.sources import files, sinks
from tributary.streaming import activity


def test_average_ranks_spread_and_tie(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.choice([1.0, 2.0, 2.5, 7.0, None, float("nan")])) for i in range(400)]
    got = {x["i"]: x["r"] for x in statistics.average_ranks(spark.createDataFrame(rows, "i int, g string, v double"), "v", ["g"], "r").collect()}
    for i, g, v in rows:
        mine = sorted(x for _, h, x in rows if h == g and x is not None and x == x)
        want = None if v is None or v != v else (mine.index(v) + 1 + mine.index(v) + mine.count(v)) / 2
        assert got[i] == want
    assert len(got) == len(rows)


def test_left_join_with_a_hot_key_keeps_every_row(spark):
    many = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(900)], "i int, k string")
    one = spark.createDataFrame([("hot", 1), ("k6", 2)], "k string, v int")
    got = {r["i"]: r["v"] for r in join_hot_left(many, one, "k").collect()}
    assert len(got) == 900 and all(got[i] == (1 if i % 3 else 2 if i == 6 else None) for i in range(900))
    assert join_hot_left(many.limit(0), one, "k").count() == 0


def test_stage_windows_match_brute_force(spark):
    r = random.Random(7)
    year, width, now = 365 * 86400, 0.25, 12.0 * 365 * 86400
    people = []
    for p in range(12):
        for a in range(r.randrange(1, 25)):
            f = r.randrange(0, 9 * year)
            people.append((f"p{p}", a, f, min(int(now), f + r.choice([0, 1000, year // 2, 5 * year]))))
    people += [("edge", 1, 0, 10 * year), ("edge", 2, int(width * year), int(2 * width * year))]
    df = spark.createDataFrame(people, "project string, author int, f long, l long")
    life = df.groupBy("project").agg(F.min("f").alias("start"), F.max("l").alias("end"))
    stages = [("early", 0.0, 1.5), ("late", 1.5, 4.1)]
    spans = lifecycle.stage_spans(life, stages, width)
    got = {(x["project"], x["stage"], x["w"]): x for x in lifecycle.stage_windows(df, spans, "project", "f", "l", width, now).collect()}
    want = {}
    for p in {x[0] for x in people}:
        mine = [x for x in people if x[0] == p]
        s, e = min(x[2] for x in mine), max(x[3] for x in mine)
        for name, a, z in stages:
            if s + z * year > e:
                continue
            for w in range(int((z - a) * 365 // (width * 365))):
                lo, hi = s + a * year + w * width * year, s + a * year + (w + 1) * width * year
                near = now - 150 * 86400
                want[p, name, w] = (sum(lo < x[2] < hi for x in mine), sum(lo < x[3] < hi and x[3] < near for x in mine), sum(x[2] < hi and (now if x[3] > near else x[3]) > lo for x in mine))
    assert set(got) == set(want) and len(want) > 40
    for k, (j, left, act) in want.items():
        g = got[k]
        assert (g["joins"], g["leaves"], g["active"]) == (j, left, act) and g["join_rate"] == j / max(act, 1) and g["ratio"] == j / max(left, 1)


def test_core_contributors_of_a_hot_project(spark):
    rows = [("p", f"u{i}", 100 - i, False) for i in range(60)] + [("q", "ci[bot]", 20, True), ("q", "u1", 50, False), ("q", "u2", 18, False), ("q", "u3", 12, False)]
    df = spark.createDataFrame(rows, "p string, c string, n long, bot boolean")
    got = {(r["p"], r["c"]) for r in lifecycle.core_contributors(df, "p", "c", "n", F.col("bot")).collect()}
    assert {c for p, c in got if p == "q"} == {"u1", "u2", "u3"} and not [c for p, c in got if p == "p"]  # nobody of p has a twentieth


def test_clusters_silhouettes_and_medoids_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(series, "SERIES_BLOCK", 7)
    r = np.random.default_rng(3)
    data = [(int(i), (r.normal(size=6) * 0.1 + (i % 3)).tolist()) for i in range(30)]
    got = series.cluster_series(spark.createDataFrame(data, "k int, v array<double>"), "k", "v", 3, starts=2).collect()
    label = {x["k"]: x["cluster"] for x in got}
    assert all(label[i] == i % 3 for i in range(30))
    dist = {(a, b): math.dist(x, y) for a, x in data for b, y in data}
    for x in got:
        own = [b for b in label if label[b] == label[x["k"]]]
        a = sum(dist[x["k"], b] for b in own) / (len(own) - 1)
        b = min(np.mean([dist[x["k"], o] for o in label if label[o] == c]) for c in set(label.values()) - {label[x["k"]]})
        assert abs(x["silhouette"] - (b - a) / max(a, b)) < 1e-6
        total = {k: sum(dist[k, o] for o in own) for k in own}
        assert x["medoid"] == (x["k"] == min(total, key=lambda k: (round(total[k], 9), k)))
    auto = series.cluster_series(spark.createDataFrame(data, "k int, v array<double>"), "k", "v", None, starts=1, most=4)
    assert auto.select("cluster").distinct().count() == 3
    bend = {x["k"]: x["inertia"] for x in series.elbow(spark.createDataFrame(data, "k int, v array<double>"), "k", "v", 4, 1).collect()}
    mean = np.mean([v for _, v in data], axis=0)
    assert abs(bend[1] - sum(((np.array(v) - mean) ** 2).sum() for _, v in data)) < 1e-6 and bend[1] > bend[2] > bend[3]
    assert series.cluster_series(spark.createDataFrame([(1, [0.0])], "k int, v array<double>"), "k", "v", 3).count() == 0


def test_patterns_by_level_slope_and_calm():
    flat = lambda x: np.full(12, float(x))
    assert series.pattern(flat(0.1)) == "Low" and series.pattern(np.linspace(0, 1, 12)) == "Increasing" and series.pattern(np.linspace(1, 0, 12)) == "Declining"
    assert series.pattern(np.concatenate([[0.9] * 2, flat(0.8), [0.9] * 2])) == "High Constant"


def test_inflation_factors_and_singular_matrices():
    m = np.array([[1.0, 0.5, np.nan], [0.5, 1.0, 0.2], [np.nan, 0.2, 1.0]])
    assert np.allclose(statistics.inflation_factors(m), np.diag(np.linalg.inv(np.nan_to_num(m))))
    twins = statistics.inflation_factors(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert np.isfinite(twins).all() and twins.max() > 1e4


def test_comment_characters_of_all_styles():
    c = codemetrics.comment_characters
    assert c(["x = 1\n", "  # note\n"], "hash") == [-1, 9]
    assert c(["a /* b\n", "c\n", "*/ d\n", "e\n"], "slash_star") == [5, 2, 5, -1]
    assert c(["--[[ a\n", "b ]]\n", "-- c\n", "x --[[ y\n"], "lua") == [7, 5, 5, -1]
    assert c(["<!-- a -->\n", "b\n"], "html") == [11, 2] and c(["<!-- a -->\n", "b\n"], "html", fixed=True) == [11, -1]
    assert c([";x\n"], "semicolon") == [3] and c(["%x\n"], "percent") == [3] and c(["# a"], "none") == [-1]
    assert codemetrics.ENDINGS["py"] == "hash" and codemetrics.ENDINGS["m"] == "percent" and codemetrics.ENDINGS["ipynb"] == "none"


def test_source_tree_with_broken_bytes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"# caf\xe9\nx = 1\n")
    (tmp_path / "src" / "b.js").write_bytes("﻿// ü\r\nvar y;".encode())
    (tmp_path / "README").write_bytes(b"")
    f = files.read_sources(spark, str(tmp_path))
    m = {r["path"].rsplit("/", 1)[1]: r for r in codemetrics.file_metrics(f.drop("size"), "path", "text").collect()}
    assert (m["a.py"]["lines"], m["a.py"]["comment_lines"], m["a.py"]["comment_chars"], m["a.py"]["code_chars"]) == (2, 1, 6, 6)
    assert (m["b.js"]["lines"], m["b.js"]["comment_lines"], m["b.js"]["chars"]) == (2, 1, 11) and "README" not in m  # empty files have no row
    total = codemetrics.repository_metrics(codemetrics.file_metrics(f.drop("size").withColumn("repo", F.lit("r")), "path", "text"), "repo").first()
    assert total["lines"] == 4 and total["code_to_comment_lines"] == 1.0


def test_delimited_round_trip_of_awkward_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " a "), (4, 'q "x", y'), (5, "two\nlines"), (6, "tab\tü")]
    df = spark.createDataFrame(rows, "i int, t string")
    sinks.write_delimited(df, f"{tmp_path}/t")
    assert sorted(tuple(r) for r in files.read_delimited(spark, f"{tmp_path}/t", df.schema).collect()) == rows
    assert files.read_folders(spark, [f"{tmp_path}/none"], "i int, t string").count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    start = datetime(2024, 1, 10)
    schema = "ts timestamp, user_id long"
    for k, rows in enumerate(([(start, 1), (start + timedelta(days=5), 2)], [(start + timedelta(days=5, hours=1), 4)], [(start - timedelta(days=3), 3), (start + timedelta(days=6), 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s = activity.windowed_activity(stream, "ts", "user_id", "1 day", "1 day", "1 day")
    t = activity.run_to_table(s, f"{tmp_path}/out", "append", f"{tmp_path}/check")
    assert t.late_rows == 1 and t.agg(F.sum("events")).first()[0] == 1


@pytest.mark.parametrize("rows", [[], [("p", 1), ("p", 1)]])
def test_lifespan_bounds_of_few_projects(spark, rows):
    got = lifecycle.lifespan_bounds(spark.createDataFrame([(f"{p}{i}", d) for i, (p, d) in enumerate(rows)], "p string, d long"), "p", "d").collect()
    assert sum(r["n"] for r in got) == len(rows)


def test_found_queries_on_a_fixture(spark, tmp_path):
    """p2, p4 and p7 over small tables: zones, null churn, a project of one commit, texts without an instant."""
    from tributary.plans import core_problems as cp

    r = random.Random(3)
    start, rows, instants = datetime(2018, 1, 1), [], {}
    for i in range(300):
        p = "big" if i % 3 else "mid" if i % 2 else f"p{i % 40}"
        t = start + timedelta(days=r.randrange(0, 1400), hours=r.randrange(24))
        form = i % 4
        text = [t.strftime("%Y-%m-%d %H:%M:%S +0000"), t.strftime("%d.%m.%Y %H:%M:%S"), (t + timedelta(hours=5, minutes=30)).strftime("%Y-%m-%dT%H:%M:%S+05:30"), "n/a"][form]
        if form != 3:
            instants[i] = (p, t)
        rows.append((i, p, text, None if i % 7 == 0 else float("nan") if i % 11 == 0 else 1.0 * i, "c"))
    spark.createDataFrame(rows, "row_id long, project string, commit_date string, churn double, contributor string").write.parquet(f"{tmp_path}/df_all_commits_with_stats.parquet")
    spark.createDataFrame([(p, "OSS", "UTC") for p in {x[1] for x in rows}], "repo string, category string, home_zone string").write.parquet(f"{tmp_path}/project_list.parquet")
    d, zero = str(tmp_path), datetime(1970, 1, 1)
    assert {tuple(x) for x in cp.p4_found(spark, d).collect()} == {(i, (t - zero) // timedelta(microseconds=1)) for i, (_, t) in instants.items()}
    months: dict = {}
    for p, t in instants.values():
        months.setdefault(p, set()).add(t.year * 12 + t.month - 1)
    want = {(p, f"{m // 12:04d}-{m % 12 + 1:02d}") for p, have in months.items() for m in range(min(have), max(have)) if m not in have}
    got = [tuple(x) for x in cp.p7_found(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {x[0] for x in cp.p2_found(spark, d).collect()} == {p for p in {x[1] for x in rows} if sum(x[1] == p for x in rows) >= 12}
