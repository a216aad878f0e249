"""The driver's tables as domain tables, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import read

BLANKS = r"(?U)^\s+|\s+$"


def stripped(c):
    """A text without Unicode blanks at its ends."""
    return F.regexp_replace(c, BLANKS, "")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as commits: project, category, author, ts, additions, deletions, churn, is_core."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_returnflag")
    order = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    supplier = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = line.join(order, line.l_orderkey == order.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return j.select(
        F.col("l_suppkey").alias("project"), F.when(F.col("s_nationkey") % 2 == 0, "OSS").otherwise("OSS4SG").alias("category"),
        F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").alias("additions"),
        F.col("l_linenumber").cast("double").alias("deletions"), (F.col("l_quantity") + F.col("l_linenumber")).alias("churn"),
        (F.col("l_returnflag") == "R").alias("is_core"),
    )


def categories(spark: SparkSession, d: str) -> DataFrame:
    """(project, category) of all suppliers, without a look at their order lines."""
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.when(F.col("s_nationkey") % 2 == 0, "OSS").otherwise("OSS4SG").alias("category"))


COMMITS_SQL = """(SELECT l_suppkey AS project, CASE WHEN s_nationkey % 2 = 0 THEN 'OSS' ELSE 'OSS4SG' END AS category, o_custkey AS author, o_orderdate AS ts,
    l_quantity AS additions, l_linenumber::DOUBLE AS deletions, l_quantity + l_linenumber AS churn, l_returnflag = 'R' AS is_core
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def contributor_file(spark: SparkSession, d: str) -> DataFrame:
    """One row per project and author: category, contributions, first and last contribution."""
    c = commits(spark, d)
    return c.groupBy("project", "category", "author").agg(F.count("*").alias("contributions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


CONTRIBUTORS_SQL = f"(SELECT project, category, author, count(*) AS contributions, min(ts) AS first_ts, max(ts) AS last_ts FROM {COMMITS_SQL} GROUP BY ALL)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """name_email_pairs with upper-case categories and normalised name and address."""
    p = read(spark, d, "name_email_pairs")
    mail = F.lower(stripped(F.coalesce("author_email", F.lit(""))))
    return p.select(
        "row_id", "project", F.upper("category").alias("category"), F.coalesce("author_name", F.lit("")).alias("author_name"), F.coalesce("author_email", F.lit("")).alias("author_email"),
        F.lower(stripped(F.coalesce("author_name", F.lit("")))).alias("name_norm"), F.when(F.contains(mail, F.lit("@")), mail).otherwise("").alias("email_norm"),
    )


PAIRS_SQL = r"""(SELECT row_id, project, upper(category) AS category, coalesce(author_name, '') AS author_name, coalesce(author_email, '') AS author_email,
    lower(regexp_replace(coalesce(author_name, ''), '^\s+|\s+$', '', 'g')) AS name_norm,
    CASE WHEN contains(coalesce(author_email, ''), '@') THEN lower(regexp_replace(coalesce(author_email, ''), '^\s+|\s+$', '', 'g')) ELSE '' END AS email_norm FROM name_email_pairs)"""


def part_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Project metrics: one row per supplier with numbers drawn from its order lines; some missing."""
    c = commits(spark, d)
    g = c.groupBy("project", "category").agg(
        F.count("*").cast("double").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.countDistinct("author").cast("double").alias("authors"), F.countDistinct(F.trunc("ts", "month")).cast("double").alias("months"), F.avg("churn").alias("mean_churn"),
    )
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("code_chars"))
    return g.join(s, "project")


METRICS_SQL = f"""(SELECT g.*, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS code_chars FROM (SELECT project, category, count(*)::DOUBLE AS commits, sum(additions) AS additions,
    sum(deletions) AS deletions, count(DISTINCT author)::DOUBLE AS authors, count(DISTINCT date_trunc('month', ts))::DOUBLE AS months, avg(churn) AS mean_churn
    FROM {COMMITS_SQL} GROUP BY project, category) g JOIN supplier ON s_suppkey = project)"""
METRICS = ("commits", "additions", "deletions", "authors", "months", "mean_churn", "code_chars")


class Registry:
    """Queries and the SQL they are compared with, by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            name = f"ref_{f.__name__}"
            self.queries[name] = f
            if sql:
                self.sql[name] = sql.replace("{C}", COMMITS_SQL).replace("{CF}", CONTRIBUTORS_SQL).replace("{P}", PAIRS_SQL).replace("{M}", METRICS_SQL)
            return f

        return add
