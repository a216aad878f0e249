"""Whole results where earlier forms of the operators left rows out."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import functions as F

from tributary.operators import similarity
from tributary.plans import exchange, texts


def test_author_pairs_of_large_projects(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_PART", 7)
    rows = [("big", i, f"N{i % 40} F{i % 97}", f"u{i % 211}@x") for i in range(620)] + [("small", 1000 + i, f"A B{i}", f"v{i}@x") for i in range(30)]
    a = spark.createDataFrame(rows, "project string, k long, author_name string, author_email string")
    got = [(r["k1"], r["k2"]) for r in similarity.blocked_author_pairs(a, "project", "k", "author_name", "author_email").collect()]
    tokens = {k: {*n.lower().split(), e.split("@")[0]} for _, k, n, e in rows}
    want = {(x[1], y[1]) for x, y in combinations(rows, 2) if x[0] == y[0] and tokens[x[1]] & tokens[y[1]]}
    assert len(got) == len(set(got)) and set(got) == want
    guarded = similarity.blocked_author_pairs(a, "project", "k", "author_name", "author_email", most=500).collect()
    assert {(r["k1"], r["k2"]) for r in guarded} == {p for p in want if p[0] >= 1000}


def test_skipped_projects_say_so(spark):
    a = spark.createDataFrame([("big", i) for i in range(5)] + [("small", 10), ("small", 11)], "project string, k long")
    edges = spark.createDataFrame([(0, 1), (10, 11)], "k1 long, k2 long")
    whole = {r["project"]: (r["distinct_pairs"], r["merged"], r["reduction"], r["skipped"]) for r in texts.merged_counts(a, edges).collect()}
    assert whole == {"big": (5, 4, 1, False), "small": (2, 1, 1, False)}
    cut = {r["project"]: (r["merged"], r["reduction"], r["skipped"]) for r in texts.merged_counts(a, edges.where(F.col("k1") > 5), most=3).collect()}
    assert cut == {"big": (None, None, True), "small": (1, 1, False)}


def test_comment_lines_of_all_scripts(spark, tmp_path):
    docs = [(1, "# a\nb"), (2, "# é\n\u3000# 漢字\nх = 1\n\u00a0#"), (3, "“quoted”"), (4, ""), (5, None), (6, "\t#x\r\n##\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["lines"], r["comment_lines"]) for r in exchange.x14_comment_lines(spark, str(tmp_path)).collect()}
    assert got == {k: (len(t.split("\n")), sum(x.strip().startswith("#") for x in t.split("\n"))) for k, t in docs if t}


def test_threshold_merge_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PROFILE_BLOCK", 20)
    monkeypatch.setattr(similarity, "PROFILE_WORDS", 16)
    r = random.Random(4)
    people = [(p, k, r.choice(["Ann Berg", "Anne Bergh", "Otto Lund", "Xiu Wyk", "bergann"]), f"m{k}@x" if k % 5 else f"none{k}") for k, p in enumerate(["a"] * 90 + ["b"] * 30)]
    commits = [(p, f" {n}", m, " ".join(r.choice("Fix the cache LAYER in a slow_parser 42 again docs".split()) for _ in range(r.randrange(1, 9)))) for p, _, n, m in people for _ in range(r.randrange(0, 4))]
    a = spark.createDataFrame(people, "project string, k long, author_name string, author_email string")
    c = spark.createDataFrame(commits, "project string, author_name string, author_email string, message string")
    bows = {k: Counter(w for q, _, e, t in commits if (q, e) == (p, m) for w in re.findall("[a-z0-9_]+", t.lower())) for p, k, _, m in people}
    norm = {k: math.sqrt(sum(v * v for v in b.values())) for k, b in bows.items()}
    want = set()
    for x, y in combinations(people, 2):
        u, v = bows[x[1]], bows[y[1]]
        if x[0] == y[0] and u and v and sum(u[w] * v[w] for w in u) / (norm[x[1]] * norm[y[1]]) > 0.8 and similarity.winkler(x[2].lower(), y[2].lower()) > 0.5:
            want.add((x[1], y[1]))
    edges = texts.merge_edges(a, c)
    got = [(e["k1"], e["k2"]) for e in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    groups = texts.multi_email_groups(a, edges).collect()
    assert groups and all(g["num_emails"] == len(set(g["emails"])) > 1 and all("@" in e for e in g["emails"]) for g in groups)


def test_departures_of_events_beyond_five_weeks(spark, tmp_path):
    start = datetime(2023, 12, 20)
    rows = [(i, start + timedelta(days=d), u) for i, (d, u) in enumerate([(0, 1), (1, 2), (20, 3), (48, 4), (49, 5), (90, 6), (120, 7), (121, 7)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"] for r in exchange.stream_departures(spark, str(tmp_path)).collect()}
    assert {1, 2, 3, 4, 5, 6} <= got
