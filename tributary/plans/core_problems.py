"""Queries p2, p4, p5 and p7 over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import grid, keyload, packed, timestamps
from tributary.session import read

COMMITS, GROUPS, BASELINE = "df_all_commits_with_stats", "contributors_all_projects", "contributors_email_baseline_all_projects"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    commits = read(spark, d, COMMITS).select("project", "contributor")
    return keyload.heavy_keys(commits, "project", "contributor", 0.04).select(F.col("key").alias("project"))


def p2_project_report(spark: SparkSession, d: str) -> DataFrame:
    commits = read(spark, d, COMMITS).select("project", "contributor", "churn")
    r = keyload.key_report(commits, "project", "contributor", "churn", [0.5, 0.9])
    return r.select(
        F.col("key").alias("project"), "n_rows", F.col("n_distinct").alias("contributors"), F.col("mode").alias("top_contributor"),
        F.col("mode_n").alias("top_rows"), F.round("total", 6).alias("churn_total"), "distinct_numbers", "p50", "p90",
    )


def with_home_zone(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Commits with the time zone of their project's server (the project list is a fixed table)."""
    zones = read(spark, d, "project_list").select(F.col("repo").alias("project"), "home_zone")
    commits = read(spark, d, COMMITS).select("project", "commit_date", *columns)
    small = zones.limit(100_001).count() <= 100_000
    return commits.join(F.broadcast(zones) if small else zones, "project", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = with_home_zone(spark, d, "row_id").select("row_id", "commit_date", "home_zone")
    found = timestamps.normalise_instants(rows, "commit_date", "home_zone")
    return found.where(F.col("utc_micros").isNotNull()).select("row_id", "utc_micros")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, field in ((GROUPS, "names"), (GROUPS, "emails"), (BASELINE, "names")):
        x = packed.explode_packed(read(spark, d, table).select("record_id", field, f"num_{field}"), "record_id", field, f"num_{field}")
        x = x.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.col("key").alias("record_id"), "pos", "item_value")
        out = x if out is None else out.unionByName(x)
    return out


def churn_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = with_home_zone(spark, d, "churn")
    found = timestamps.normalise_instants(rows, "commit_date", "home_zone")
    return grid.regular_grid(grid.monthly_cells(found, "project", F.col("utc_micros"), "churn"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    g = churn_grid(spark, d)
    return g.where("state <> 'observed'").select(F.col("source").alias("project"), grid.month_text(F.col("month")).alias("missing_month"))


def p7_series(spark: SparkSession, d: str) -> DataFrame:
    g = churn_grid(spark, d)
    return g.select(F.col("source").alias("project"), grid.month_text(F.col("month")).alias("month"), "n", "total", "estimate", "state")


QUERIES = {f.__name__: f for f in (p2_found, p2_project_report, p4_found, p5_found, p7_found, p7_series)}

SQL = {
    "p2_found": "SELECT project FROM df_all_commits_with_stats GROUP BY project HAVING count(*) >= 0.04 * (SELECT count(*) FROM df_all_commits_with_stats)",
    "p2_project_report": """
        WITH v AS (SELECT project, churn FROM df_all_commits_with_stats WHERE churn IS NOT NULL AND NOT isnan(churn)),
        r AS (SELECT project, churn, row_number() OVER (PARTITION BY project ORDER BY churn) AS i, count(*) OVER (PARTITION BY project) AS n FROM v),
        p AS (SELECT project, min(churn) FILTER (WHERE i >= greatest(1, ceil(0.5 * n))) AS p50, min(churn) FILTER (WHERE i >= greatest(1, ceil(0.9 * n))) AS p90,
              sum(churn) AS churn_total, count(DISTINCT churn) AS distinct_numbers FROM r GROUP BY project),
        c AS (SELECT project, contributor, count(*) AS n FROM df_all_commits_with_stats GROUP BY ALL),
        m AS (SELECT project, contributor, n, row_number() OVER (PARTITION BY project ORDER BY n DESC, contributor) AS i FROM c WHERE contributor IS NOT NULL),
        t AS (SELECT project, sum(n)::BIGINT AS n_rows, count(contributor) AS contributors FROM c GROUP BY project)
        SELECT t.project, n_rows, contributors, m.contributor AS top_contributor, m.n AS top_rows, round(churn_total, 6) AS churn_total, coalesce(distinct_numbers, 0) AS distinct_numbers, p50, p90
        FROM t LEFT JOIN m ON m.project = t.project AND m.i = 1 LEFT JOIN p ON p.project = t.project""",
}
