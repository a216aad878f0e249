"""Group tests, rates and quadrants of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import lifecycle, statistics
from tributary.plans.analysis import RATES_SQL, rates
from tributary.plans.relational import METHODS_SQL, method_counts
from tributary.session import materialise, read
from tributary.sources.views import Registry, categories, commits, pairs, part_metrics

query = Registry()


def tail_sql(z: str) -> str:
    """SQL of the two-sided tail of the standard normal, right to seven digits (a published rational approximation)."""
    x, t = f"(abs({z}) / sqrt(2))", f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x}))"


def rank_sql(source: str) -> str:
    """CTEs v (g, x), r with average ranks, s with rank sums by group, t with the tie term, n with the number of values."""
    return f"""v AS ({source}), r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v), s AS (SELECT g, sum(r) AS rs, count(*)::DOUBLE AS n FROM r GROUP BY g),
    t AS (SELECT coalesce(sum(k * k * k - k), 0)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS k FROM v GROUP BY x)), n AS (SELECT sum(n)::DOUBLE AS n FROM s)"""


H_SQL = "(12 / (n.n * (n.n + 1)) * (SELECT sum(rs * rs / n) FROM s) - 3 * (n.n + 1)) / (1 - ties / (n.n * n.n * n.n - n.n))"
KRUSKAL_SQL = f"SELECT round(h, 6) AS h, n, round(exp(-h / 2), 6) AS p_value FROM (SELECT {H_SQL} AS h, n.n::BIGINT AS n FROM n, t)"


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    return statistics.kruskal_wallis(df, group, value).select(F.round("h", 6).alias("h"), "n", F.round("p_value", 6).alias("p_value"))


@query(f"WITH {rank_sql(f'SELECT method AS g, n AS x FROM {METHODS_SQL}')} {KRUSKAL_SQL}")
def t05_kruskal(spark: SparkSession, d: str) -> DataFrame:
    """Contributors per project under three ways of counting them."""
    return kruskal(method_counts(spark, d), "method", "n")


BASES = (("raw", "author_email"), ("lower", "email_norm"), ("name", "author_name"))
BASES_SQL = " UNION ALL ".join(f"SELECT '{b}' AS g, count(DISTINCT project) AS x FROM {{P}} WHERE {k} <> '' GROUP BY {k}" for b, k in BASES)


@query(f"WITH {rank_sql(BASES_SQL)} {KRUSKAL_SQL}")
def t06_kruskal_of_contributors(spark: SparkSession, d: str) -> DataFrame:
    """In how many projects a contributor works, contributors being told apart by address, normalised address or name."""
    p, out = pairs(spark, d), None
    for basis, k in BASES:
        x = p.where(F.col(k) != "").groupBy(k).agg(F.countDistinct("project").alias("x")).select(F.lit(basis).alias("g"), "x")
        out = x if out is None else out.unionByName(x)
    return kruskal(out, "g", "x")


ALIGNMENTS = ("zero_filled", "dropped", "common", "logarithm")
GRID_SQL = f"(SELECT project, m.method, n FROM (SELECT DISTINCT project FROM {METHODS_SQL}) CROSS JOIN (SELECT DISTINCT method FROM {METHODS_SQL}) m LEFT JOIN {METHODS_SQL} c USING (project, method))"


def alignment_sql() -> str:
    few = f"SELECT method AS g, ROW_X AS x FROM {METHODS_SQL} WHERE project IN (SELECT project FROM {METHODS_SQL} GROUP BY 1 HAVING count(DISTINCT method) = 3)"
    sources = {"zero_filled": f"SELECT method AS g, coalesce(n, 0) AS x FROM {GRID_SQL}", "dropped": f"SELECT method AS g, n AS x FROM {METHODS_SQL} WHERE n > 0", "common": few.replace("ROW_X", "n"), "logarithm": few.replace("ROW_X", "ln(1 + n)")}
    return " UNION ALL ".join(f"SELECT '{a}' AS alignment, * FROM (WITH {rank_sql(sources[a])} {KRUSKAL_SQL})" for a in ALIGNMENTS)


@query(alignment_sql())
def t07_kruskal_by_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The same test with absent counts as zero, left out, on common projects only, and on logarithms."""
    m = materialise(method_counts(spark, d), "methods")
    filled = m.groupBy("project").pivot("method", ["distinct", "email", "merged"]).agg(F.sum("n")).na.fill(0).unpivot(["project"], ["distinct", "email", "merged"], "method", "n")
    common = m.join(m.groupBy("project").agg(F.countDistinct("method").alias("k")).where("k = 3").select("project"), "project", "left_semi")
    out = None
    for name, df in zip(ALIGNMENTS, (filled, m.where("n > 0"), common, common.withColumn("n", F.log1p("n")))):
        x = kruskal(df, "method", "n").select(F.lit(name).alias("alignment"), "h", "n", "p_value")
        out = x if out is None else out.unionByName(x)
    return out


def two_sql(value: str, continuity: bool, tied: bool) -> str:
    var = "n1 * n2 / 12 * (n1 + n2 + 1" + (" - ties / ((n1 + n2) * (n1 + n2 - 1))" if tied else "") + ")"
    return f"""WITH {rank_sql(f'SELECT category AS g, {value} AS x FROM {{M}}')}, q AS (SELECT (SELECT rs FROM s WHERE g = 'OSS') AS rs, (SELECT n FROM s WHERE g = 'OSS') AS n1, (SELECT n FROM s WHERE g = 'OSS4SG') AS n2, ties FROM t),
    z AS (SELECT rs - n1 * (n1 + 1) / 2 AS u, n1, n2, greatest(0, abs(rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - {0.5 if continuity else 0}) / sqrt({var}) AS z FROM q)
    SELECT round(u, 6) AS u1, n1::BIGINT AS n1, n2::BIGINT AS n2, round(z, 6) AS z, round({tail_sql('z')}, 5) AS p_value, round(z / sqrt(n1 + n2), 6) AS r, CASE WHEN z / sqrt(n1 + n2) < 0.3 THEN 'small' WHEN z / sqrt(n1 + n2) < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM z"""


def two_groups(spark: SparkSession, d: str, value: str, continuity: bool, tied: bool) -> DataFrame:
    m = statistics.mann_whitney(part_metrics(spark, d), "category", value, "OSS", "OSS4SG", continuity, tied)
    return m.select(F.round("u1", 6).alias("u1"), "n1", "n2", F.round("z", 6).alias("z"), F.round("p_value", 5).alias("p_value"), F.round("r", 6).alias("r"), "effect")


@query(two_sql("additions", True, True))
def t08_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return two_groups(spark, d, "additions", True, True)


@query(two_sql("authors", False, False))
def t09_mann_whitney_effect(spark: SparkSession, d: str) -> DataFrame:
    """Without continuity and with the variance of untied values."""
    return two_groups(spark, d, "authors", False, False)


QUARTERS_SQL = """q AS (SELECT category, year(ts) * 4 + quarter(ts) AS q, avg(churn) AS m FROM {C} GROUP BY 1, 2), d AS (SELECT a.m - b.m AS d FROM q a JOIN q b ON a.q = b.q AND a.category = 'OSS' AND b.category = 'OSS4SG'),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0), w AS (SELECT least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, (SELECT count(*) FROM d) AS n, count(*)::DOUBLE AS k FROM r),
    z AS (SELECT w, n, (w - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24) AS z FROM w)"""


@query(f"WITH {QUARTERS_SQL} SELECT w, n, round(z, 6) AS z, round({tail_sql('z')}, 5) AS p_value, round(abs(z) / sqrt(n), 6) AS r FROM z")
def t10_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    q = commits(spark, d).groupBy((F.year("ts") * 4 + F.quarter("ts")).alias("q")).pivot("category", ["OSS", "OSS4SG"]).agg(F.avg("churn"))
    return statistics.wilcoxon(q, "OSS", "OSS4SG").select("w", "n", F.round("z", 6).alias("z"), F.round("p_value", 5).alias("p_value"), F.round("r", 6).alias("r"))


FOUR_SQL = f"(SELECT method AS g, n::DOUBLE AS x FROM {METHODS_SQL} UNION ALL SELECT 'documents', count(*)::DOUBLE FROM documents GROUP BY project)"


@query(f"""WITH v AS MATERIALIZED (SELECT * FROM {FOUR_SQL}), gs AS (SELECT DISTINCT g FROM v), pr AS (SELECT a.g AS a, b.g AS b FROM gs a JOIN gs b ON a.g < b.g),
    u AS (SELECT pr.a, pr.b, v.g, x, rank() OVER (PARTITION BY pr.a, pr.b ORDER BY x) + (count(*) OVER (PARTITION BY pr.a, pr.b, x) - 1) / 2.0 AS r FROM pr JOIN v ON v.g IN (pr.a, pr.b)),
    s AS (SELECT a, b, sum(r) FILTER (g = a) AS rs, count(*) FILTER (g = a)::DOUBLE AS n1, count(*) FILTER (g = b)::DOUBLE AS n2 FROM u GROUP BY a, b), t AS (SELECT a, b, sum(k * k * k - k) AS ties FROM (SELECT a, b, count(*)::DOUBLE AS k FROM u GROUP BY a, b, x) GROUP BY a, b),
    z AS (SELECT s.a, s.b, greatest(0, abs(rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s JOIN t USING (a, b)), p AS (SELECT a, b, least(1, {tail_sql('z')}) AS p FROM z)
    SELECT a, b, round(p, 5) AS p_value, round(0.05 / count(*) OVER (), 6) AS level, p < 0.05 / count(*) OVER () AS significant FROM p""")
def t12_pairwise_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """All six pairs of four groups, each at the level 0.05 over the number of pairs."""
    docs = read(spark, d, "documents").groupBy("project").agg(F.count("*").alias("n"))
    x = materialise(method_counts(spark, d).select("method", "n").unionByName(docs.select(F.lit("documents").alias("method"), "n")).withColumn("n", F.col("n").cast("double")), "four")
    names = sorted(r[0] for r in x.select("method").distinct().collect())
    two = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = [(a, b, float(statistics.mann_whitney(x, "method", "n", a, b).first()["p_value"])) for a, b in two]
    out = spark.createDataFrame(rows, "a string, b string, p double")
    level = 0.05 / len(two)
    return out.select("a", "b", F.round("p", 5).alias("p_value"), F.round(F.lit(level), 6).alias("level"), (F.col("p") < level).alias("significant"))


@query("""WITH g AS (SELECT source, avg(n_chars) AS m FROM documents WHERE source IS NOT NULL GROUP BY 1), s AS (SELECT stddev_samp(n_chars) AS sd FROM documents WHERE source IS NOT NULL)
    SELECT source, round(m, 6) AS mean, (1 + sum(CASE WHEN p - m > 0.5 * sd THEN 1 ELSE 0 END) OVER (ORDER BY m DESC))::BIGINT AS cluster FROM (SELECT source, m, lag(m) OVER (ORDER BY m DESC) AS p FROM g), s""")
def t15_w09_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups in order of their means; a gap of more than half the overall deviation opens a cluster."""
    docs = read(spark, d, "documents").where("source IS NOT NULL")
    g, sd = docs.groupBy("source").agg(F.avg("n_chars").alias("m")), docs.agg(F.stddev_samp("n_chars"))
    w = Window.orderBy(F.desc("m"))  # one row per source
    g = g.withColumn("sd", sd.scalar()).withColumn("p", F.lag("m").over(w))
    return g.select("source", F.round("m", 6).alias("mean"), (1 + F.sum(F.when(F.col("p") - F.col("m") > 0.5 * F.col("sd"), 1).otherwise(0)).over(w)).alias("cluster"))


@query("""WITH v AS (SELECT category AS g, mean_churn AS x FROM {M}), s AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM v GROUP BY g), a AS (SELECT avg(x) AS m, count(*)::DOUBLE AS n FROM v)
    SELECT round(sum(s.n * (s.m - a.m) * (s.m - a.m)) / (count(*) - 1) / (sum((s.n - 1) * s.v) / (max(a.n) - count(*))), 5) AS f, (count(*) - 1)::BIGINT AS d1, (max(a.n) - count(*))::BIGINT AS d2 FROM s, a""")
def t13_f_test(spark: SparkSession, d: str) -> DataFrame:
    """The F statistic of the groups' means, from counts, sums and sums of squares."""
    g = part_metrics(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.sum("mean_churn").alias("s"), F.sum(F.col("mean_churn") * F.col("mean_churn")).alias("q"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("q").alias("q"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return t.select(F.round(between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k"))), 5).alias("f"), (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


# ---- rates and quadrants

CATEGORY_SQL = RATES_SQL.replace("{F}", "true") + ", x AS (SELECT r.*, category FROM rates r JOIN (SELECT DISTINCT project, category FROM {C}) USING (project))"
QUADRANT_SQL = "CASE WHEN avg_leave_rate < ml AND avg_join_rate >= mj THEN 'Attractive' WHEN avg_leave_rate < ml THEN 'Stable' WHEN avg_join_rate >= mj THEN 'Unstable' ELSE 'Unattractive' END"
SHARES_SQL = """SELECT {K} category, quadrant, n, round(100.0 * n / sum(n) OVER (PARTITION BY {K} category), 6) AS pct, round(100.0 * coalesce(sum(n) FILTER (quadrant IN ('Attractive', 'Stable')) OVER (PARTITION BY {K} category), 0) / sum(n) OVER (PARTITION BY {K} category), 6) AS sticky_pct,
    round(100.0 * coalesce(sum(n) FILTER (quadrant IN ('Attractive', 'Unstable')) OVER (PARTITION BY {K} category), 0) / sum(n) OVER (PARTITION BY {K} category), 6) AS magnetic_pct FROM (SELECT {K} category, quadrant, count(*) AS n FROM q GROUP BY ALL)"""


def with_category(spark: SparkSession, d: str) -> DataFrame:
    return materialise(rates(spark, d).join(categories(spark, d), "project"), "rates")


def shares(r: DataFrame, *by: str) -> DataFrame:
    """Quadrants of the rows with mj and ml, their percentage by category, and the sticky and magnetic ones together."""
    q = r.withColumn("quadrant", lifecycle.quadrant(F.col("avg_join_rate"), F.col("avg_leave_rate"), F.col("mj"), F.col("ml"))).groupBy(*by, "category", "quadrant").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "category")  # four rows
    pct = lambda c: F.round(100.0 * F.sum(c).over(w) / F.sum("n").over(w), 6)
    among = lambda *names: F.when(F.col("quadrant").isin(*names), F.col("n")).otherwise(0)
    return q.select(*by, "category", "quadrant", "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6).alias("pct"), pct(among("Attractive", "Stable")).alias("sticky_pct"), pct(among("Attractive", "Unstable")).alias("magnetic_pct"))


@query(CATEGORY_SQL + "SELECT project, round(avg_join_rate / nullif(avg_join_rate + avg_leave_rate, 0), 6) AS join_ratio, round((avg_join_rate - avg_leave_rate) / nullif(avg_join_rate + avg_leave_rate, 0), 6) AS retention FROM x")
def t16_join_ratio_and_retention(spark: SparkSession, d: str) -> DataFrame:
    j, lv = F.col("avg_join_rate"), F.col("avg_leave_rate")
    return rates(spark, d).select("project", F.round(F.try_divide(j, j + lv), 6).alias("join_ratio"), F.round(F.try_divide(j - lv, j + lv), 6).alias("retention"))


@query(CATEGORY_SQL + f", k AS (SELECT *, row_number() OVER (ORDER BY avg_join_rate) - 1 AS i, row_number() OVER (ORDER BY avg_leave_rate) - 1 AS l, count(*) OVER () AS n FROM x), m AS (SELECT max(avg_join_rate) FILTER (i = n // 2) AS mj, max(avg_leave_rate) FILTER (l = n // 2) AS ml FROM k), q AS (SELECT category, {QUADRANT_SQL} AS quadrant FROM x, m) " + SHARES_SQL.replace("{K}", ""))
def t18_quadrants(spark: SparkSession, d: str) -> DataFrame:
    """Quadrants by upper medians: the value in the middle, or the upper one of two."""
    r = with_category(spark, d)
    upper = lambda c: F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})")
    return shares(r.withColumns({"mj": r.agg(upper("avg_join_rate")).scalar(), "ml": r.agg(upper("avg_leave_rate")).scalar()}))


# Medians of join and leave rate the plots are drawn against.
JOIN_MEDIAN, LEAVE_MEDIAN = 0.182, 0.164


@query(CATEGORY_SQL + f", m AS (SELECT {JOIN_MEDIAN} AS mj, {LEAVE_MEDIAN} AS ml), q AS (SELECT category, {QUADRANT_SQL} AS quadrant FROM x, m) " + SHARES_SQL.replace("{K}", ""))
def t19_quadrants_of_fixed_medians(spark: SparkSession, d: str) -> DataFrame:
    return shares(with_category(spark, d).withColumns({"mj": F.lit(JOIN_MEDIAN), "ml": F.lit(LEAVE_MEDIAN)}))


STAGE_RATES = [("early", "ts < TIMESTAMP '1994-06-01'"), ("middle", "ts >= TIMESTAMP '1994-06-01' AND ts < TIMESTAMP '1996-06-01'"), ("late", "ts >= TIMESTAMP '1996-06-01'")]
STAGE_SQL = " UNION ALL ".join(f"SELECT '{s}' AS stage, * FROM ({CATEGORY_SQL.replace('{C} WHERE true', '{C} WHERE ' + f)} SELECT * FROM x)" for s, f in STAGE_RATES)


@query(f"WITH y AS ({STAGE_SQL}), m AS (SELECT stage, median(avg_join_rate) AS mj, median(avg_leave_rate) AS ml FROM y GROUP BY stage), q AS (SELECT y.stage, category, {QUADRANT_SQL} AS quadrant FROM y JOIN m ON m.stage = y.stage) " + SHARES_SQL.replace("{K}", "stage,"))
def t20_quadrants_of_stage_medians(spark: SparkSession, d: str) -> DataFrame:
    """Quadrants of three stages, each against the medians of its own rates."""
    c, cat, out = commits(spark, d), categories(spark, d), None
    for stage, where in STAGE_RATES:
        s = c.where(where.replace("TIMESTAMP", "TIMESTAMP_NTZ")).select("project", "author", (F.year("ts") * 12 + F.month("ts")).alias("m"))
        r = lifecycle.join_leave_by_month(s, "project", "author", "m").join(cat, "project").withColumn("stage", F.lit(stage))
        out = r if out is None else out.unionByName(r)
    out = materialise(out, "stages")
    m = out.groupBy("stage").agg(F.median("avg_join_rate").alias("mj"), F.median("avg_leave_rate").alias("ml"))
    return shares(out.join(F.broadcast(m), "stage"), "stage")  # three rows


QUERIES, SQL = query.queries, query.sql
