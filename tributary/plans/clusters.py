"""Clusters of series and of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import components, lifecycle, series
from tributary.plans.analysis import SPEARMAN_SQL, spearman, stage_series
from tributary.session import materialise
from tributary.sources.views import METRICS, Registry, commits

query = Registry()


def early(spark: SparkSession, d: str) -> DataFrame:
    """The early series of core churn on one length, each position scaled over all series."""
    return series.scale_positions(series.interpolate_to_longest(stage_series(spark, d).where("stage = 'early'"), "values"), "values")


@query()
def c03_c04_c07_c08_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Four clusters of the early series, with named patterns, medoids and silhouettes."""
    return series.cluster_series(early(spark, d), "project", "values", 4)


@query()
def c04_clusters_by_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """As many clusters, from two to four, as have the best silhouette."""
    k = series.cluster_series(early(spark, d), "project", "values", None, starts=2, most=4)
    return k.groupBy("cluster", "pattern").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query()
def c05_silhouette_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes of one cluster each and, as cluster null, of all."""
    k = series.cluster_series(early(spark, d), "project", "values", 4, starts=3)
    return k.rollup("cluster").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query()
def c06_elbow(spark: SparkSession, d: str) -> DataFrame:
    return series.elbow(early(spark, d), "project", "values", starts=2)


def experiment(c: DataFrame) -> DataFrame:
    """(project, cluster, pattern) of the early series of a table of commits, in three clusters."""
    s = series.core_ratio_series(lifecycle.stages(c, "project", "ts", (3, 5, 6)), "project", "stage", "ts", "churn", "is_core").where("stage = 'early'")
    k = series.cluster_series(series.scale_positions(series.interpolate_to_longest(s, "values"), "values"), "project", "values", 3, starts=3)
    return k.select("project", "cluster", "pattern")


@query()
def c09_c10_compare_experiments(spark: SparkSession, d: str) -> DataFrame:
    """The same clustering of two inputs, commits as they are and commits whose core is taken from each project's busiest quarter of authors, compared
    per project; labels are aligned by the order of the centroids."""
    c = materialise(commits(spark, d), "commits")
    n = c.groupBy("project", "author").agg(F.count("*").alias("k"))
    least = n.groupBy("project").agg(F.percentile("k", 0.75).alias("least"))
    core = n.join(least, "project").where("k >= least").select("project", "author", F.lit(True).alias("core"))
    other = c.join(core, ["project", "author"], "left").withColumn("is_core", F.coalesce("core", F.lit(False))).drop("core")
    a = experiment(c).withColumnsRenamed({"cluster": "a", "pattern": "pattern_a"})
    b = experiment(other).withColumnsRenamed({"cluster": "b", "pattern": "pattern_b"})
    j = a.join(b, "project", "full").select("project", F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b"), "pattern_a", "pattern_b")
    return j.withColumn("same", F.col("a") == F.col("b"))


CLUSTER_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT metric_a AS a, metric_b AS b FROM ({SPEARMAN_SQL}) WHERE abs(rho) >= 0.7), s AS (FROM e UNION SELECT b, a FROM e), r(v, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.v),
    k AS (SELECT m AS metric, coalesce((SELECT min(c) FROM r WHERE v = m), m) AS cluster FROM (SELECT unnest([{', '.join(f"'{m}'" for m in METRICS)}]) AS m)) """


@query(CLUSTER_SQL + "SELECT * FROM k WHERE cluster IN (SELECT cluster FROM k GROUP BY 1 HAVING count(*) > 1)")
def g07_metric_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = spearman(spark, d).where(F.abs("rho") >= 0.7)
    return components.connected_components(e, "metric_a", "metric_b").select(F.col("vertex").alias("metric"), F.col("component").alias("cluster"))


def metric_order(spark: SparkSession, d: str, rho: DataFrame) -> DataFrame:
    """(metric, cluster, size, place): metrics in order of the size of their cluster, its members and their name; a metric alone is a cluster."""
    cc = components.connected_components(rho.where(F.abs("rho") >= 0.7), "metric_a", "metric_b")
    m = spark.createDataFrame([(x,) for x in METRICS], "metric string")
    k = m.join(cc, m.metric == cc.vertex, "left").select("metric", F.coalesce("component", "metric").alias("cluster"))
    w = Window.orderBy(F.desc("size"), "cluster", "metric")  # one row per metric
    return k.withColumn("size", F.count("*").over(Window.partitionBy("cluster"))).withColumn("place", F.row_number().over(w))


ORDER_SQL = CLUSTER_SQL + ", o AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM k), p AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster, metric)::INT AS place FROM o) "


@query(ORDER_SQL + f"""SELECT a.place AS i, b.place AS j, x.metric_a, x.metric_b, x.rho FROM (SELECT metric_a, metric_b, rho FROM ({SPEARMAN_SQL}) UNION ALL SELECT metric_b, metric_a, rho FROM ({SPEARMAN_SQL}) UNION ALL SELECT metric, metric, 1.0 FROM k) x
    JOIN p a ON a.metric = x.metric_a JOIN p b ON b.metric = x.metric_b""")
def g09_reordered_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the correlation matrix with rows and columns in order of the clusters."""
    rho = materialise(spearman(spark, d).select("metric_a", "metric_b", "rho"), "rho")
    o = materialise(metric_order(spark, d, rho), "order")
    cells = rho.unionByName(rho.select(F.col("metric_b").alias("metric_a"), F.col("metric_a").alias("metric_b"), "rho")).unionByName(o.select(F.col("metric").alias("metric_a"), F.col("metric").alias("metric_b"), F.lit(1.0).alias("rho")))
    i, j = o.select(F.col("metric").alias("metric_a"), F.col("place").alias("i")), o.select(F.col("metric").alias("metric_b"), F.col("place").alias("j"))
    return cells.join(F.broadcast(i), "metric_a").join(F.broadcast(j), "metric_b").select("i", "j", "metric_a", "metric_b", "rho")  # one row per metric


@query(ORDER_SQL + "SELECT row_number() OVER (ORDER BY count(*) DESC, string_agg(metric, ', ' ORDER BY metric)) AS rank, count(*) AS size, string_agg(metric, ', ' ORDER BY metric) AS members FROM p GROUP BY cluster")
def o08_clusters_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by size, of equal ones by their members."""
    o = metric_order(spark, d, spearman(spark, d))
    g = o.groupBy("cluster").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("metric")), ", ").alias("members"))
    return g.select(F.row_number().over(Window.orderBy(F.desc("size"), "members")).cast("long").alias("rank"), "size", "members")


QUERIES, SQL = query.queries, query.sql
