import math

import numpy as np
from pyspark.sql import functions as F

from tributary.operators import codemetrics, lifecycle, series, similarity, statistics
from tributary.sources import files


def test_join_leave_fixture(spark):
    rows = [("p", a, 2020 * 12 + m) for a, m in (("a", 1), ("b", 2), ("a", 3), ("c", 4), ("a", 6))]
    r = lifecycle.join_leave_by_month(spark.createDataFrame(rows, "p string, a string, m int"), "p", "a", "m").first()
    assert abs(r["avg_join_rate"] - 0.875) < 1e-12 and abs(r["avg_leave_rate"] - 0.5) < 1e-12


def test_core_contributors_fixture(spark):
    rows = [("p", "u1", 50), ("p", "ci[bot]", 20), ("p", "u2", 18), ("p", "u3", 12)]
    df = spark.createDataFrame(rows, "p string, u string, c int")
    bot = F.contains("u", F.lit("[bot]"))
    assert {r["u"] for r in lifecycle.core_contributors(df, "p", "u", "c", bot).collect()} == {"u1", "u2", "u3"}
    df = spark.createDataFrame(rows[:3] + [("p", "u3", 4)], "p string, u string, c int")
    assert {r["u"] for r in lifecycle.core_contributors(df, "p", "u", "c", bot).collect()} == {"u1", "u2"}


def test_stage_fixture(spark):
    rows = [("a", "2000-02-29"), ("a", "2006-02-20"), ("b", "2000-02-29"), ("b", "2007-02-27"), ("b", "2007-02-28"), ("b", "2009-08-01"), ("c", "2000-02-29"), ("c", "2008-01-01"), ("c", "2011-01-01"), ("c", "2013-05-01")]
    df = spark.createDataFrame(rows, "p string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {(r["p"], r["t"]): r["stage"] for r in lifecycle.stages(df, "p", "ts").collect()}
    assert ("a", "2000-02-29") not in got and got["b", "2007-02-27"] == "early" and ("b", "2007-02-28") not in got
    assert got["c", "2008-01-01"] == "middle" and got["c", "2011-01-01"] == "late" and ("c", "2013-05-01") not in got


def test_jaro_winkler_vectors():
    assert abs(similarity.jaro("martha", "marhta") - 0.9444444) < 1e-6 and abs(similarity.winkler("martha", "marhta") - 0.9611111) < 1e-6
    assert abs(similarity.jaro("abcd", "axyzabq") - 0.4642857) < 1e-6 and abs(similarity.winkler("abcd", "axyzabq") - 0.5178571) < 1e-6
    assert similarity.jaro("", "") == 1 and similarity.jaro("", "a") == 0


def test_kruskal_and_mann_whitney(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in (("a", (1, 2, 3)), ("b", (4, 5, 6)), ("c", (7, 8, 9))) for v in vs], "g string, v double")
    r = statistics.kruskal_wallis(df, "g", "v").first()
    assert abs(r["h"] - 7.2) < 1e-9 and abs(r["p_value"] - math.exp(-3.6)) < 1e-9
    assert statistics.mann_whitney(df, "g", "v", "a", "b").first()["u1"] == 0
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert statistics.mann_whitney(tied, "g", "v", "a", "b").first()["u1"] == 1.5
    assert statistics.kruskal_wallis(df.where("g = 'a'"), "g", "v").first()["h"] is None
    assert statistics.mann_whitney(df.limit(0), "g", "v", "a", "b").count() == 0


def test_tails_against_table_values():
    assert abs(statistics.chi_square_tail(3.841459, 1) - 0.05) < 1e-6 and abs(statistics.chi_square_tail(11.0705, 5) - 0.05) < 1e-5
    assert abs(statistics.t_tail(2.228139, 10) - 0.05) < 1e-6 and abs(statistics.f_tail(4.964603, 1, 10) - 0.05) < 1e-6


def test_spearman_ranks_whole_columns(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 2.0), ("d", "x", 4.0), ("a", "y", 10.0), ("b", "y", 20.0), ("c", "y", 30.0), ("d", "y", None)]
    r = statistics.spearman_matrix(spark.createDataFrame(rows, "k string, m string, v double"), "k", "m", "v").first()
    assert r["n"] == 3 and abs(r["rho"] - 0.8660254) < 1e-6


def test_scott_knott_and_linkage(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, m in (("a", 0), ("b", 0), ("c", 5)) for v in rng.normal(m, 1, 60)]
    got = {r["g"]: r["cluster"] for r in statistics.scott_knott(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["a"] == got["b"] != got["c"]
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert statistics.average_linkage(d, 0.3) == [1, 1, 2]
    assert np.allclose(statistics.inflation_factors(np.array([[1, 0.5], [0.5, 1]])), 4 / 3)


def test_interpolation(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0, 2.0, 3.0, 4.0])], "k int, v array<double>")
    got = {r["k"]: r["v"] for r in series.interpolate_to_longest(df, "v").collect()}
    assert got[1] == [0, 0.25, 0.5, 0.75, 1] and got[2] == [0, 1, 2, 3, 4]
    assert series.interpolate_to_longest(df.limit(0), "v").count() == 0


def test_savitzky_golay_keeps_a_constant_and_averages(spark):
    df = spark.range(1, 41).selectExpr("cast(id as int) d", "5.0D v")
    got = series.savitzky_golay(df, "d", "v", 40, 7, 2).collect()
    assert len(got) == 40 and all(abs(r["smooth"] - 5) < 1e-6 for r in got)


def test_comment_scanner():
    lines = ["int a;", "// x", "/* y */", "int b;", "*/"]
    assert codemetrics.classify(lines, "slash_star") == [False, True, True, True, True]
    assert codemetrics.classify(lines, "slash_star", fixed=True) == [False, True, True, False, False]
    assert codemetrics.classify(["# a", "b", ""], "hash") == [True, False, False]


def test_framed_log_and_pipe_log(spark):
    v = "\x1eabc\x1fAnn | B\x1fa@x\x1f2020-01-01 00:00:00 +0100\x1fmsg\n3\t1\tsrc/a.py\n-\t-\tb.bin\n"
    r = files.parse_framed_log(spark.createDataFrame([(v,)], "value string")).first()
    assert (r["commit"], r["total_additions"], r["total_deletions"], r["num_files"], r["timezone"]) == ("abc", 3, 1, 2, "+0100")
    assert r["additions_by_file"] == {"src/a.py": 3, "b.bin": 0}
    lines = spark.createDataFrame([("a|b|c|d|e|f",), ("a|b",), (None,)], "value string")
    assert [x["message"] for x in files.parse_pipe_log(lines).collect()] == ["e|f"]
