"""Correlations, joining and leaving, and series of the survey."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import components, lifecycle, series, statistics
from tributary.session import materialise, read
from tributary.sources.views import METRICS, Registry, categories, commits, contributor_file, part_metrics

query = Registry()


def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    return part_metrics(spark, d).unpivot(["project"], list(METRICS), "metric", "value")


RANKS_SQL = """(SELECT project, metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM
    (SELECT * FROM (SELECT project, """ + ", ".join(METRICS) + """ FROM {M}) UNPIVOT (value FOR metric IN (""" + ", ".join(METRICS) + """))) )"""
SPEARMAN_SQL = f"SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM {RANKS_SQL} a JOIN {RANKS_SQL} b ON a.project = b.project AND a.metric < b.metric GROUP BY 1, 2"


def spearman(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.spearman_matrix(long_metrics(spark, d), "project", "metric", "value")
    return s.select("metric_a", "metric_b", "n", F.round("rho", 6).alias("rho"))


@query(SPEARMAN_SQL)
def t01_w02_spearman(spark: SparkSession, d: str) -> DataFrame:
    return spearman(spark, d)


def wide_sql(columns: str) -> str:
    """Average ranks of the metrics of {M} joined to those of orders, by project and metric."""
    return f"""(SELECT project, metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM (SELECT * FROM (SELECT m.project, {columns}, o.price, o.urgent FROM {{M}} m
      LEFT JOIN (SELECT l_suppkey AS project, sum(o_totalprice) AS price, count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) o ON o.project = m.project) UNPIVOT (value FOR metric IN ({columns}, price, urgent))))"""


WIDE = "commits, authors, code_chars"


@query(f"SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM {wide_sql(WIDE)} a JOIN {wide_sql(WIDE)} b ON a.project = b.project AND a.metric < b.metric GROUP BY 1, 2")
def t02_spearman_of_joined_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two sources joined by project; a column without data takes no part."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    j = read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("project")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    more = j.groupBy("project").agg(F.sum("o_totalprice").alias("price"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))
    m = part_metrics(spark, d).select("project", "commits", "authors", "code_chars").join(more, "project", "left").withColumn("blank", F.lit(None).cast("double"))
    m = materialise(m, "joined")
    names = [c for c in m.columns if c != "project"]
    filled = m.agg(*[F.count(c).alias(c) for c in names]).first()
    long = m.unpivot(["project"], [c for c in names if filled[c]], "metric", "value").where("value IS NOT NULL")
    return statistics.spearman_matrix(long, "project", "metric", "value").select("metric_a", "metric_b", "n", F.round("rho", 6).alias("rho"))


@query("""WITH b AS (SELECT project, commits AS x, code_chars AS y FROM {M} WHERE commits IS NOT NULL AND code_chars IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS c FROM b)
    SELECT count(*) AS n, round(corr(a, c), 6) AS rho FROM r""")
def t03_spearman_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Ranks taken after rows with a missing value are left out."""
    m = part_metrics(spark, d).where("commits IS NOT NULL AND code_chars IS NOT NULL").select("project", "commits", "code_chars")
    s = statistics.spearman_matrix(m.unpivot(["project"], ["commits", "code_chars"], "metric", "value"), "project", "metric", "value")
    return s.select("n", F.round("rho", 6).alias("rho"))


@query(f"SELECT metric_a, metric_b, rho FROM ({SPEARMAN_SQL}) ORDER BY abs(rho) DESC, metric_a DESC, metric_b DESC LIMIT 10")
def o04_top_correlations(spark: SparkSession, d: str) -> DataFrame:
    return spearman(spark, d).where("rho IS NOT NULL").orderBy(F.desc(F.abs("rho")), F.desc("metric_a"), F.desc("metric_b")).limit(10).select("metric_a", "metric_b", "rho")


def matrix(spark: SparkSession, d: str) -> tuple[list[str], np.ndarray]:
    """The small matrix of metric correlations (as many rows as metrics)."""
    names = sorted(METRICS)
    m = np.eye(len(names))
    for r in spearman(spark, d).collect():
        i, j = names.index(r["metric_a"]), names.index(r["metric_b"])
        m[i, j] = m[j, i] = np.nan if r["rho"] is None else r["rho"]
    return names, m


@query()
def t04_inflation(spark: SparkSession, d: str) -> DataFrame:
    names, m = matrix(spark, d)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, statistics.inflation_factors(m))], "metric string, vif double")


@query()
def g08_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    names, m = matrix(spark, d)
    labels = statistics.average_linkage(1 - np.abs(np.nan_to_num(m)), 0.3)
    return spark.createDataFrame(list(zip(names, labels)), "metric string, cluster int")


@query("""WITH s AS (SELECT category, count(*)::DOUBLE AS n, avg(mean_churn) AS m, var_samp(mean_churn) AS v FROM {M} GROUP BY 1), a AS (FROM s WHERE category = 'OSS'), b AS (FROM s WHERE category = 'OSS4SG')
    SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 5) AS t, (a.n + b.n - 2)::BIGINT AS df FROM a, b""")
def t11_t_test(spark: SparkSession, d: str) -> DataFrame:
    return statistics.t_test(part_metrics(spark, d), "category", "mean_churn", "OSS", "OSS4SG").select(F.round("t", 5).alias("t"), "df")


@query()
def t14_scott_knott(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("source IS NOT NULL").select("source", F.log1p("n_chars").alias("size"))
    return statistics.scott_knott(docs, "source", "size")


# ---- joining and leaving


RATES_SQL = """WITH RECURSIVE_ AS (SELECT 1), a AS MATERIALIZED (SELECT DISTINCT project, author, (year(ts) * 12 + month(ts))::INT AS m FROM {C} WHERE {F}), sp AS (SELECT project, min(m) + 2 AS lo, max(m) AS hi FROM a GROUP BY 1),
    w AS MATERIALIZED (SELECT DISTINCT a.project, author, unnest([m, m + 1, m + 2]) AS w FROM a), cur AS (SELECT w.* FROM w JOIN sp USING (project) WHERE w BETWEEN lo AND hi), old AS (SELECT w.project, author, w + 3 AS w FROM w JOIN sp USING (project) WHERE w >= lo AND w + 3 <= hi),
    f AS (SELECT coalesce(c.project, o.project) AS project, coalesce(c.w, o.w) AS w, c.author IS NOT NULL AS c, o.author IS NOT NULL AS o FROM cur c FULL JOIN old o ON c.project = o.project AND c.w = o.w AND c.author = o.author),
    n AS (SELECT project, w, count(*) FILTER (c)::DOUBLE AS na, count(*) FILTER (o)::DOUBLE AS np, count(*) FILTER (c AND NOT o) AS j, count(*) FILTER (o AND NOT c) AS l FROM f GROUP BY 1, 2),
    rates AS (SELECT project, avg(CASE WHEN na > 0 THEN j / na END) AS avg_join_rate, avg(CASE WHEN np > 0 THEN l / np END) AS avg_leave_rate FROM n GROUP BY project) """


def rates(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).select("project", "author", (F.year("ts") * 12 + F.month("ts")).alias("m"))
    return lifecycle.join_leave_by_month(c, "project", "author", "m")


@query(RATES_SQL.replace("{F}", "true") + "SELECT project, category, round(avg_join_rate, 6) AS avg_join_rate, round(avg_leave_rate, 6) AS avg_leave_rate, printf('%.4f', avg_join_rate) AS join_text FROM rates JOIN (SELECT DISTINCT project, category FROM {C}) USING (project)")
def l01_k07_join_leave(spark: SparkSession, d: str) -> DataFrame:
    """Average join and leave rate per project over three-month windows sliding by one month."""
    r = rates(spark, d).join(categories(spark, d), "project")
    return r.select("project", "category", F.round("avg_join_rate", 6).alias("avg_join_rate"), F.round("avg_leave_rate", 6).alias("avg_leave_rate"), F.format_string("%.4f", "avg_join_rate").alias("join_text"))


@query("""WITH c AS (SELECT project, author, year(first_ts) * 12 + month(first_ts) AS a, year(last_ts) * 12 + month(last_ts) AS z, last_ts FROM {CF}), sp AS (SELECT project, min(a) AS lo, max(z) AS hi, max(last_ts) AS newest FROM c GROUP BY 1),
    w AS (SELECT project, unnest(generate_series(lo + 2, hi)) AS w FROM sp), n AS (SELECT w.project, w.w, count(*)::DOUBLE AS act, count(*) FILTER (c.a BETWEEN w.w - 2 AND w.w) AS j, count(*) FILTER (c.z BETWEEN w.w - 2 AND w.w AND c.last_ts < sp.newest - INTERVAL 150 DAY) AS l
      FROM w JOIN sp USING (project) JOIN c ON c.project = w.project AND c.a <= w.w AND c.z >= w.w - 2 GROUP BY 1, 2) SELECT project, round(avg(j / act), 6) AS join_rate, round(avg(l / act), 6) AS leave_rate, count(*) AS windows FROM n GROUP BY project""")
def l02_rates_from_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    """Join and leave rates from first and last dates with a buffer of 150 days before the project's newest date; activity as counts of starts and ends, no range join."""
    m = lambda c: F.year(c) * 12 + F.month(c)
    c = contributor_file(spark, d).select("project", m("first_ts").alias("a"), m("last_ts").alias("z"), "last_ts")
    span = c.groupBy("project").agg(F.min("a").alias("lo"), F.max("z").alias("hi"), F.max("last_ts").alias("newest"))
    ev = c.join(span, "project").select("project", "lo", "hi", F.explode(F.array(
        F.struct(F.col("a").alias("m"), F.lit(1).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("gone")),
        F.struct(F.col("z").alias("m"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(F.col("last_ts") < F.col("newest") - F.expr("INTERVAL 150 DAYS"), 1).otherwise(0).alias("gone")),
    )).alias("e"))
    per = ev.groupBy("project", F.col("e.m").alias("m")).agg(F.sum("e.start").alias("s"), F.sum("e.end").alias("e"), F.sum("e.gone").alias("g"))
    axis = span.select("project", F.explode(F.sequence("lo", "hi")).alias("m"), "lo")
    x = axis.join(per, ["project", "m"], "left").na.fill(0, ["s", "e", "g"])
    w = Window.partitionBy("project").orderBy("m")
    upto, last3 = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    x = x.withColumns({"started": F.sum("s").over(upto), "ended": F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -3)), F.lit(0)), "j": F.sum("s").over(last3), "l": F.sum("g").over(last3)})
    x = x.withColumn("act", F.col("started") - F.col("ended")).where((F.col("m") >= F.col("lo") + 2) & (F.col("act") > 0))
    return x.groupBy("project").agg(F.round(F.avg(F.col("j") / F.col("act")), 6).alias("join_rate"), F.round(F.avg(F.col("l") / F.col("act")), 6).alias("leave_rate"), F.count("*").alias("windows"))


@query("""WITH p AS (SELECT s_suppkey, (s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)) AS x, (s_suppkey % 101) / 101.0 AS y FROM supplier), g AS (SELECT i, j FROM generate_series(0, 20) a(i), generate_series(0, 20) b(j)),
    k AS (SELECT i, j, sum(exp(-((x - i / 20.0) ** 2 + (y - j / 20.0) ** 2) / (2 * 0.01))) / (2 * pi() * 0.01 * count(*)) AS density FROM p, g GROUP BY 1, 2) SELECT i, j, round(CASE WHEN density < 0.05 * (SELECT max(density) FROM k) THEN 0 ELSE density END, 5) AS density FROM k""")
def t17_density_grid(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian density of points on a 21 x 21 grid with bandwidth 0.1; cells below 5 % of the peak are 0.

    Every point is spread over the fixed number of grid cells and summed there with map-side combining.
    """
    s = read(spark, d, "supplier")
    s = s.withColumns({"lo": s.agg(F.min("s_acctbal")).scalar(), "hi": s.agg(F.max("s_acctbal")).scalar(), "n": s.agg(F.count("*")).scalar()})
    p = s.select(((F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"), ((F.col("s_suppkey") % 101) / 101.0).alias("y"), "n")
    axis = F.sequence(F.lit(0), F.lit(20))
    g = p.select("x", "y", "n", F.explode(axis).alias("i")).select("x", "y", "n", "i", F.explode(axis).alias("j"))
    kernel = F.exp(-((F.col("x") - F.col("i") / 20.0) ** 2 + (F.col("y") - F.col("j") / 20.0) ** 2) / (2 * 0.01))
    k = materialise(g.groupBy("i", "j").agg((F.sum(kernel) / (F.lit(2 * np.pi * 0.01) * F.max("n"))).alias("density")), "density")
    return k.withColumn("top", k.agg(F.max("density")).scalar()).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round(F.when(F.col("density") < 0.05 * F.col("top"), 0.0).otherwise(F.col("density")), 5).alias("density"))


# ---- stages, series, clusters


@query("""WITH l AS (SELECT project, min(ts) AS a, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.0 AS y FROM {C} GROUP BY 1 HAVING y >= 3) SELECT project, stage, count(*) AS n, sum(churn) AS churn FROM (SELECT c.project, churn, CASE WHEN ts < a + INTERVAL 3 YEAR THEN 'early'
    WHEN y >= 5 AND ts < a + INTERVAL 5 YEAR THEN 'middle' WHEN y >= 6 AND ts >= a + INTERVAL 5 YEAR AND ts < a + INTERVAL 6 YEAR THEN 'late' END AS stage FROM {C} c JOIN l USING (project)) WHERE stage IS NOT NULL GROUP BY 1, 2""")
def c01_stage_labels(spark: SparkSession, d: str) -> DataFrame:
    c = lifecycle.stages(commits(spark, d), "project", "ts", (3, 5, 6))
    return c.groupBy("project", "stage").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"))


def stage_series(spark: SparkSession, d: str) -> DataFrame:
    c = lifecycle.stages(commits(spark, d), "project", "ts", (3, 5, 6))
    return series.core_ratio_series(c, "project", "stage", "ts", "churn", "is_core")


STAGED_SQL = """WITH l AS (SELECT project, min(ts) AS a, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.0 AS y FROM {C} GROUP BY 1 HAVING y >= 3), st AS (SELECT * FROM (SELECT c.project, ts, churn, is_core, CASE WHEN ts < a + INTERVAL 3 YEAR THEN 'early'
    WHEN y >= 5 AND ts < a + INTERVAL 5 YEAR THEN 'middle' WHEN y >= 6 AND ts >= a + INTERVAL 5 YEAR AND ts < a + INTERVAL 6 YEAR THEN 'late' END AS stage FROM {C} c JOIN l USING (project)) WHERE stage IS NOT NULL),
    mo AS (SELECT project, stage, date_trunc('month', ts) AS m, sum(CASE WHEN is_core THEN churn ELSE 0.0 END) / sum(churn) AS r FROM st GROUP BY 1, 2, 3 HAVING sum(churn) <> 0 AND r <> 0),
    se AS (SELECT project, stage, list(r ORDER BY m) AS v, count(*) AS n FROM mo GROUP BY 1, 2 HAVING count(*) > 1), lo AS (SELECT max(n) AS k FROM se) """


@query(STAGED_SQL + """SELECT project, stage, list_transform(range(k), lambda i: round(v[least(floor(i * (n - 1) / greatest(k - 1, 1))::BIGINT, n - 2) + 1] + (v[least(floor(i * (n - 1) / greatest(k - 1, 1))::BIGINT, n - 2) + 2] - v[least(floor(i * (n - 1) / greatest(k - 1, 1))::BIGINT, n - 2) + 1])
    * (i * (n - 1) / greatest(k - 1, 1) - least(floor(i * (n - 1) / greatest(k - 1, 1))::BIGINT, n - 2)), 5)) AS values FROM se, lo""")
def c02_r07_interpolated_series(spark: SparkSession, d: str) -> DataFrame:
    s = series.interpolate_to_longest(stage_series(spark, d), "values")
    return s.select("project", "stage", F.transform("values", lambda x: F.round(x, 5)).alias("values"))


SMOOTH = [float(x) for x in series.smoothing_weights(31, 2)]


@query(f"""WITH c AS (SELECT least(dayofyear(ts), 365)::INT AS day, count(*)::DOUBLE AS n FROM {{C}} GROUP BY 1), a AS (SELECT g AS day, coalesce(n, 0) AS n FROM range(1, 366) t(g) LEFT JOIN c ON c.day = g), w AS (SELECT unnest({SMOOTH}) AS w, unnest(range(-15, 16)) AS o)
    SELECT ((a.day - o - 1 + 365) % 365 + 1)::INT AS day, round(sum(n * w), 6) AS smooth FROM a, w GROUP BY 1""")
def w08_savitzky_golay(spark: SparkSession, d: str) -> DataFrame:
    """Daily commit counts over the year, smoothed by circular quadratic fits of 31 days."""
    c = commits(spark, d).groupBy(F.least(F.dayofyear("ts"), F.lit(365)).alias("day")).agg(F.count("*").cast("double").alias("n"))
    axis = spark.range(1, 366).select(F.col("id").cast("int").alias("day"))
    c = axis.join(c, "day", "left").select("day", F.coalesce("n", F.lit(0.0)).alias("n"))
    return series.savitzky_golay(c, "day", "n", 365, 31, 2)


@query("""WITH n AS (SELECT project, category, count(*) AS k FROM {CF} GROUP BY 1, 2), b AS (SELECT project, category, (k // 20)::BIGINT AS bin FROM n), need AS (SELECT bin, count(*) AS want FROM b WHERE category = 'OSS4SG' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY project) AS i FROM b WHERE category = 'OSS') SELECT r.project, r.bin FROM r JOIN need USING (bin) WHERE i <= want""")
def g06_matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """Controls from the first category, as many per size bin as the second category has there."""
    b = contributor_file(spark, d).groupBy("project", "category").agg(F.count("*").alias("k")).select("project", "category", F.floor(F.col("k") / 20).alias("bin"))
    need = b.where("category = 'OSS4SG'").groupBy("bin").agg(F.count("*").alias("want"))
    r = b.where("category = 'OSS'").withColumn("i", F.row_number().over(Window.partitionBy("bin").orderBy("project")))
    return r.join(need, "bin").where("i <= want").select("project", "bin")


@query("SELECT c.project, c.category, round(m, 6) AS mean_active FROM (SELECT DISTINCT project, category FROM {C}) c JOIN (SELECT category, avg(n) AS m FROM (SELECT category, date_trunc('month', ts), count(DISTINCT author) AS n FROM {C} GROUP BY 1, 2) GROUP BY 1) a USING (category)")
def l10_attached_means(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d)
    m = c.groupBy("category", F.trunc("ts", "month").alias("m")).agg(F.countDistinct("author").alias("n")).groupBy("category").agg(F.round(F.avg("n"), 6).alias("mean_active"))
    return c.select("project", "category").distinct().join(F.broadcast(m), "category").select("project", "category", "mean_active")


QUERIES, SQL = query.queries, query.sql
