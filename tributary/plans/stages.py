"""Lifecycle stages of the survey (L3-L9, L11, A31): windows of stages and of lifespan groups, over customers as projects and suppliers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import lifecycle
from tributary.session import materialise, read
from tributary.sources.views import Registry

query = Registry()

WIDTH, NARROW = 0.25, 0.05  #: years of a window; the narrow one for the short stages between lifespan groups
AS_OF = "1998-10-01"
AS_OF_S = 907_200_000  #: the same in seconds
STAGES = ["early", "middle", "late"]


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer and supplier: project, category, author, the seconds of first and last order."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    cat = F.when(F.col("c_nationkey") % 2 == 0, "OSS").otherwise("OSS4SG")
    return j.groupBy(F.col("o_custkey").alias("project"), cat.alias("category"), F.col("l_suppkey").alias("author")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def lives(people: DataFrame) -> DataFrame:
    """(project, category, start, end, days)."""
    g = people.groupBy("project", "category").agg(F.min("first").alias("start"), F.max("last").alias("end"))
    return g.withColumn("days", F.floor((F.col("end") - F.col("start")) / 86400))


BASE_SQL = """WITH pa AS MATERIALIZED (SELECT o_custkey AS project, CASE WHEN c_nationkey % 2 = 0 THEN 'OSS' ELSE 'OSS4SG' END AS category, l_suppkey AS author, epoch(min(o_orderdate)) AS f, epoch(max(o_orderdate)) AS l
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    life AS MATERIALIZED (SELECT project, category, min(f) AS a, max(l) AS z, floor((max(l) - min(f)) / 86400) AS days FROM pa GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (ORDER BY days, project) - 1 AS i, count(*) OVER () AS n FROM life), gr AS MATERIALIZED (SELECT *, least(i // greatest(n // 4, 1), 3)::BIGINT + 1 AS grp FROM rk),
    lg AS MATERIALIZED (SELECT grp, count(*) AS n, min(days)::BIGINT AS lo, max(days)::BIGINT AS hi, round((max(days) / 365 + coalesce(lead(min(days)) OVER (ORDER BY grp), max(days)) / 365) / 2, 3) AS bound FROM gr GROUP BY grp),
    qs AS (SELECT max(bound) FILTER (grp = 1) AS q1, max(bound) FILTER (grp = 2) AS q2, max(bound) FILTER (grp = 3) AS q3 FROM lg) """


def windows_sql(spans: str, width: float) -> str:
    """``BASE_SQL`` with w: joins, leaves, active and rates of every window; ``spans`` selects project, category, grp, stage, from, to (years)."""
    size, near = f"({width} * 365 * 86400)", f"({AS_OF_S} - 150 * 86400)"
    return BASE_SQL + f""", sp AS (SELECT project, category, grp, stage, a + y0 * 365 * 86400 AS o, floor((y1 - y0) * 365 / ({width} * 365))::INT AS k FROM ({spans}) WHERE a + y1 * 365 * 86400 <= z),
    ax AS MATERIALIZED (SELECT *, unnest(range(k)) AS w FROM sp), ev AS (SELECT ax.project, ax.stage, ax.w, count(*) FILTER (f > o + w * {size} AND f < o + (w + 1) * {size}) AS joins, count(*) FILTER (l > o + w * {size} AND l < o + (w + 1) * {size} AND l < {near}) AS leaves,
      count(*) FILTER (f < o + (w + 1) * {size} AND CASE WHEN l > {near} THEN {AS_OF_S} ELSE l END > o + w * {size}) AS active FROM ax JOIN pa USING (project) GROUP BY 1, 2, 3),
    w AS MATERIALIZED (SELECT ax.*, joins, leaves, active, joins / greatest(active, 1) AS join_rate, leaves / greatest(active, 1) AS leave_rate, joins / greatest(leaves, 1) AS ratio, joins - leaves AS difference FROM ax JOIN ev USING (project, stage, w)) """


SLICES_SQL = "SELECT g.project, g.category, grp, a, z, unnest(['early', 'middle', 'late']) AS stage, unnest([0, q1, q2]) AS y0, unnest([q1, q2, q3]) AS y1 FROM gr g, qs"


def bounds(people_life: DataFrame) -> tuple[DataFrame, list[float]]:
    """The lifespan groups of the projects, and the three bounds between them (four rows)."""
    g = materialise(lifecycle.lifespan_bounds(people_life, "project", "days"), "bounds")
    q = {r["grp"]: r["bound"] for r in g.collect()}
    return g, [q.get(i, 0.0) for i in (1, 2, 3)]


def in_groups(life: DataFrame, groups: DataFrame) -> DataFrame:
    """``life`` with the lifespan group of every project; projects of equal life on a bound are parted as the ranks are."""
    one = life.withColumns({"__one": F.lit(1), "__all": F.lit(0)})
    r = lifecycle.prefix_sum(one, ["__all"], ["days", "project"], "__one", "__upto")
    n = groups.agg(F.sum("n")).scalar()
    return r.withColumn("grp", (F.least(F.floor((F.col("__upto") - 1) / F.greatest(F.floor(n / 4), F.lit(1))), F.lit(3)) + 1).cast("long")).drop("__one", "__all", "__upto")


def sliced(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Windows of the stages [0, q1), [q1, q2), [q2, q3) between the lifespan bounds; ``kind`` says of which projects."""
    people = materialise(accounts(spark, d), "accounts")
    life = materialise(lives(people), "lives")
    groups, (q1, q2, q3) = bounds(life)
    stages = [("early", 0.0, q1), ("middle", q1, q2), ("late", q2, q3)]
    if kind == "all stages":
        life, out = materialise(in_groups(life, groups), "groups"), None
        for grp, end in ((2, q1), (3, q2), (4, q3)):
            x = lifecycle.stage_spans(life.where(F.col("grp") == grp), [("all", 0.0, end)], NARROW)
            out = x if out is None else out.unionByName(x)
        spans = out
    else:
        spans = lifecycle.stage_spans(materialise(in_groups(life, groups), "groups"), stages, NARROW)
    return lifecycle.stage_windows(people, spans, "project", "first", "last", NARROW, AS_OF_S)


MEANS_SQL = "count(DISTINCT project) AS repos, count(*) AS windows, round(avg(join_rate), 6) AS join_rate, round(avg(leave_rate), 6) AS leave_rate, round(avg(active), 6) AS active"


def means(w: DataFrame, *by: str) -> DataFrame:
    r = lambda c: F.round(F.avg(c), 6).alias(c)
    return w.groupBy(*by).agg(F.countDistinct("project").alias("repos"), F.count("*").alias("windows"), r("join_rate"), r("leave_rate"), r("active"))


FIRST_SQL = windows_sql("SELECT project, category, 0 AS grp, a, z, 'early' AS stage, 0.0 AS y0, 4.0 AS y1 FROM life", WIDTH)


def first_years(spark: SparkSession, d: str) -> DataFrame:
    people = materialise(accounts(spark, d), "accounts")
    spans = lifecycle.stage_spans(lives(people), [("early", 0.0, 4.0)], WIDTH)
    return lifecycle.stage_windows(people, spans, "project", "first", "last", WIDTH, AS_OF_S)


@query(FIRST_SQL + "SELECT project, category, count(*) AS windows, round(avg(join_rate), 10) AS join_rate, round(avg(leave_rate), 10) AS leave_rate, round(avg(active), 10) AS active, round(avg(ratio), 10) AS ratio, sum(difference)::BIGINT AS difference FROM w GROUP BY 1, 2")
def l03_stage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Means over the windows of 91.25 days in the first four years of every project that lived through them."""
    w, r = first_years(spark, d), lambda c: F.round(F.avg(c), 10).alias(c)
    return w.groupBy("project", "category").agg(F.count("*").alias("windows"), r("join_rate"), r("leave_rate"), r("active"), r("ratio"), F.sum("difference").alias("difference"))


@query(BASE_SQL + "SELECT * FROM lg")
def l04_lifespan_groups(spark: SparkSession, d: str) -> DataFrame:
    return bounds(lives(accounts(spark, d)))[0]


@query(windows_sql(SLICES_SQL, NARROW) + f"SELECT stage, category, {MEANS_SQL} FROM w GROUP BY 1, 2")
def l05_stage_slices(spark: SparkSession, d: str) -> DataFrame:
    return means(sliced(spark, d, "slices"), "stage", "category")


@query(windows_sql("SELECT project, category, grp, a, z, 'all' AS stage, 0.0 AS y0, CASE grp WHEN 2 THEN q1 WHEN 3 THEN q2 ELSE q3 END AS y1 FROM gr, qs WHERE grp > 1", NARROW) + f"SELECT grp, category, {MEANS_SQL} FROM w GROUP BY 1, 2")
def l06_all_stages_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Lifespan groups 2, 3 and 4 from their start to the first, second and third bound."""
    return means(sliced(spark, d, "all stages"), "grp", "category")


@query(windows_sql(SLICES_SQL, NARROW) + f"SELECT grp, stage, category, {MEANS_SQL} FROM w GROUP BY 1, 2, 3")
def l07_stages_by_group(spark: SparkSession, d: str) -> DataFrame:
    return means(sliced(spark, d, "slices"), "grp", "stage", "category")


SHIFT_SQL = "sz AS (SELECT project, stage, max(w) + 1 AS k FROM w GROUP BY 1, 2), wd AS (SELECT project, max(k) FILTER (stage = 'early') AS e, max(k) FILTER (stage = 'middle') AS m, max(k) FILTER (stage = 'late') AS t FROM sz GROUP BY 1 HAVING count(*) = 3)"


@query(windows_sql(SLICES_SQL, NARROW) + f", {SHIFT_SQL} SELECT project, stage, (w + CASE stage WHEN 'early' THEN 0 WHEN 'middle' THEN e ELSE e + m END)::BIGINT AS place, joins, leaves FROM w JOIN wd USING (project)")
def l08_combined_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages laid end to end, each shifted by all windows before it; projects that miss a stage are left out."""
    w = lifecycle.shifted(materialise(sliced(spark, d, "slices"), "windows"), ["project"], STAGES)
    return w.select("project", "stage", F.col("place").cast("long").alias("place"), "joins", "leaves")


@query(FIRST_SQL + "SELECT w::BIGINT AS w, round(avg(join_rate) FILTER (category = 'OSS4SG'), 6) AS sg, round(avg(join_rate) FILTER (category = 'OSS'), 6) AS not_sg FROM w GROUP BY 1")
def l09_a31_lines(spark: SparkSession, d: str) -> DataFrame:
    p = first_years(spark, d).groupBy("w").pivot("category", ["OSS4SG", "OSS"]).agg(F.round(F.avg("join_rate"), 6))
    return p.select(F.col("w").cast("long").alias("w"), F.col("OSS4SG").alias("sg"), F.col("OSS").alias("not_sg"))


@query(windows_sql(SLICES_SQL, NARROW) + """, al AS (SELECT stage, category, count(DISTINCT project) AS repos FROM w GROUP BY 1, 2), mx AS (SELECT max(w) FILTER (stage = 'early') + 1 AS e, max(w) FILTER (stage = 'middle') + 1 AS m FROM w)
    SELECT stage, category, (w + CASE stage WHEN 'early' THEN 0 WHEN 'middle' THEN e ELSE e + m END)::BIGINT AS place, round(sum(join_rate) / max(repos), 6) AS join_rate, round(sum(leave_rate) / max(repos), 6) AS leave_rate FROM w JOIN al USING (stage, category), mx GROUP BY 1, 2, 3""")
def l11_stage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Join and leave rates of the three stages on one axis; sums over a window are divided by all projects of the stage."""
    w = materialise(sliced(spark, d, "slices"), "windows")
    g = w.groupBy("stage", "category", "w").agg(F.sum("join_rate").alias("j"), F.sum("leave_rate").alias("l"))
    repos = w.groupBy("stage", "category").agg(F.countDistinct("project").alias("repos"))
    g = lifecycle.shifted(g.withColumn("__all", F.lit(0)), ["__all"], STAGES)
    g = g.join(F.broadcast(repos), ["stage", "category"])  # a row per stage and category
    return g.select("stage", "category", F.col("place").cast("long").alias("place"), F.round(F.col("j") / F.col("repos"), 6).alias("join_rate"), F.round(F.col("l") / F.col("repos"), 6).alias("leave_rate"))


QUERIES, SQL = query.queries, query.sql
