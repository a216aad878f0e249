import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tributary.functions.prefix import prefix_sum
from tributary.operators import grid, keyload


def test_key_report_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([1.0, 2.0, 3.5, float("nan"), None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, c string, v double")
    got = {r["key"]: r for r in keyload.key_report(df, "k", "c", "v", [0.5, 0.9]).collect()}
    for k in ("hot", "a", "b", None):
        mine = [r for r in rows if r[0] == k]
        vals = sorted(r[2] for r in mine if r[2] is not None and r[2] == r[2])
        cats = [r[1] for r in mine if r[1]]
        g = got[k]
        assert g["n_rows"] == len(mine) and g["n_distinct"] == len(set(cats))
        assert g["mode_n"] == max(cats.count(c) for c in set(cats)) and cats.count(g["mode"]) == g["mode_n"]
        assert abs(g["total"] - sum(vals)) < 1e-6 and g["p50"] == vals[-(-len(vals) // 2) - 1] and g["p90"] == vals[-(-len(vals) * 9 // 10) - 1]


def test_key_report_of_nothing(spark):
    df = spark.createDataFrame([], "k string, c string, v double")
    assert keyload.key_report(df, "k", "c", "v").count() == 0 and keyload.heavy_keys(df, "k", "c", 0.1).count() == 0
    one = spark.createDataFrame([("a", None, None)] * 3, "k string, c string, v double")
    r = keyload.key_report(one, "k", "c", "v").first()
    assert (r["n_rows"], r["n_distinct"], r["mode"], r["p50"]) == (3, 0, None, None)


def test_prefix_sum_over_groups_with_ties_and_nulls(spark):
    rows = [("g" if i % 3 else None, i // 2, i, i % 5 if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int")
    got = {r["i"]: r["s"] for r in prefix_sum(df, ["g"], ["o", "i"], "v", "s").collect()}
    run = {"g": 0, None: 0}
    for g, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        run[g] += v or 0
        assert got[i] == run[g]
    assert prefix_sum(df.limit(0), ["g"], ["o", "i"], "v", "s").count() == 0


def test_grid_marks_gaps_and_keeps_cells(spark):
    rows = [(s, m, 1, 10.0 * (1 + k) * (1 + m % 3)) for k, s in enumerate("abcd") for m in range(24000, 24024) if (m + k) % 5]
    rows += [("lone", 24005, 2, 7.0), ("gap", 24000, 1, 1.0), ("gap", 24020, 1, 1.0)]
    got = grid.regular_grid(spark.createDataFrame(rows, "source string, month int, n long, total double"), rank=2).collect()
    by = {(r["source"], r["month"]): r for r in got}
    assert len(by) == len(got)
    for s, m, _, t in rows:
        assert by[s, m]["state"] == "observed" and by[s, m]["total"] == t and by[s, m]["estimate"] is None
    filled = [r for r in got if r["source"] in "abcd" and r["state"] != "observed"]
    assert filled and all(r["state"] == "filled" and r["estimate"] >= 0 for r in filled)
    assert all(r["state"] == "unsupported" for r in got if r["source"] == "gap" and r["n"] is None)
    err = [abs(r["estimate"] - 10.0 * (1 + "abcd".index(r["source"])) * (1 + r["month"] % 3)) / (10.0 * (1 + "abcd".index(r["source"])) * (1 + r["month"] % 3)) for r in filled]
    assert sorted(err)[len(err) // 2] < 0.35
    assert grid.regular_grid(spark.createDataFrame([], "source string, month int, n long, total double")).count() == 0


def test_monthly_cells_ignore_missing(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 86_400_000_000, float("nan")), ("p", None, 5.0), (None, 0, 5.0)], "s string, u long, v double")
    r = grid.monthly_cells(df, "s", F.col("u"), "v").collect()
    assert [(x["source"], x["month"], x["n"], x["total"]) for x in r] == [("p", 1970 * 12, 2, 1.0)]


def test_missing_months_are_utc_months_whatever_the_session_zone(spark):
    rng = random.Random(4)
    start = datetime(1969, 11, 20, tzinfo=timezone.utc)
    rows = [(p, start + timedelta(days=rng.random() * 900)) for p in ("a", "b", "c") for _ in range(12)]
    rows += [("edge", datetime(2019, 12, 31, 23, 59, 59, 999_999, tzinfo=timezone.utc)), ("edge", datetime(2020, 2, 1, tzinfo=timezone.utc)), ("edge", datetime(2021, 1, 1, 0, 30, tzinfo=timezone.utc))]
    expect = set()
    for p in {r[0] for r in rows}:
        have = {t.year * 12 + t.month - 1 for q, t in rows if q == p}
        expect |= {(p, f"{m // 12:04d}-{m % 12 + 1:02d}") for m in range(min(have), max(have)) if m not in have}
    assert ("edge", "2020-01") in expect and ("edge", "2020-12") in expect and ("edge", "2021-01") not in expect
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    data = [(p, (t - zero) // timedelta(microseconds=1), 1.0) for p, t in rows]
    try:
        for zone in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            cells = grid.monthly_cells(spark.createDataFrame(data, "s string, u long, v double"), "s", F.col("u"), "v")
            g = grid.regular_grid(cells).where("state <> 'observed'").select("source", grid.month_text(F.col("month")).alias("m"))
            got = [tuple(r) for r in g.collect()]
            assert len(got) == len(set(got)) and set(got) == expect
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
