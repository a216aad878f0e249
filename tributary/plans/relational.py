"""Projections, filters, joins, aggregations, windows, sorts and set operations of the survey (P, J, A, W, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot_left
from tributary.functions.prefix import prefix_sum
from tributary.session import read
from tributary.sources.views import Registry, commits, contributor_file, pairs, part_metrics, stripped

query = Registry()
AS_OF = "1999-06-01"
CM = "df_all_commits_with_stats"


def cm(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, CM).withColumn("category", F.upper("category"))


# ---- projections and filters


@query(r"""SELECT row_id, author_email, CASE WHEN contains(e, '@') THEN e ELSE '' END AS email_norm, n AS name_norm, regexp_replace(n, '\s+', ' ', 'g') AS name_squeezed,
    len(list_filter(string_split_regex(n, '\s+'), lambda t: t <> '')) >= 2 AND NOT contains(n, '_') AS eligible,
    len(list_filter(string_split_regex(n, '\s+'), lambda t: t <> '')) >= 2 AND contains(e, '@') AND len(list_filter(string_split_regex(n, '\s+'), lambda t: t <> '' AND NOT contains(split_part(e, '@', 1), t))) = 0 AS local_has_name
    FROM (SELECT row_id, author_email, lower(regexp_replace(coalesce(author_email, ''), '^\s+|\s+$', '', 'g')) AS e, lower(regexp_replace(coalesce(author_name, ''), '^\s+|\s+$', '', 'g')) AS n FROM name_email_pairs)""")
def p01_p08_identity_text(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "name_email_pairs")
    e, n = F.lower(stripped(F.coalesce("author_email", F.lit("")))), F.lower(stripped(F.coalesce("author_name", F.lit(""))))
    p = p.select("row_id", "author_email", e.alias("e"), n.alias("n")).withColumn("t", F.filter(F.split("n", r"\s+"), lambda t: t != ""))
    local = F.substring_index("e", "@", 1)
    return p.select(
        "row_id", "author_email", F.when(F.contains("e", F.lit("@")), F.col("e")).otherwise("").alias("email_norm"), F.col("n").alias("name_norm"),
        F.regexp_replace("n", r"\s+", " ").alias("name_squeezed"), ((F.size("t") >= 2) & ~F.contains("n", F.lit("_"))).alias("eligible"),
        ((F.size("t") >= 2) & F.contains("e", F.lit("@")) & F.forall("t", lambda t: F.contains(local, t))).alias("local_has_name"),
    )


@query("SELECT row_id, project, category, author_name, author_email FROM {P} WHERE trim(author_name) <> '' OR trim(author_email) <> ''")
def p02_p09_p10_drop_nobody(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.where((F.trim("author_name") != "") | (F.trim("author_email") != "")).select("row_id", "project", "category", "author_name", "author_email")


@query("SELECT category, count(*) AS complete_rows FROM name_email_pairs WHERE author_name IS NOT NULL AND author_email IS NOT NULL AND category IS NOT NULL GROUP BY category")
def p11_p12_complete_by_category(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "name_email_pairs").na.drop(subset=["author_name", "author_email", "category"]).groupBy("category").agg(F.count("*").alias("complete_rows"))


@query("SELECT row_id, coalesce(nullif(trim(lower(coalesce(nullif(author_email, ''), author_name, ''))), ''), '?') AS identity, coalesce(upper(category), 'OSS') AS category FROM name_email_pairs")
def p13_identity_key(spark: SparkSession, d: str) -> DataFrame:
    key = F.trim(F.lower(F.coalesce(F.nullif("author_email", F.lit("")), "author_name", F.lit(""))))
    return read(spark, d, "name_email_pairs").select("row_id", F.coalesce(F.nullif(key, F.lit("")), F.lit("?")).alias("identity"), F.coalesce(F.upper("category"), F.lit("OSS")).alias("category"))


@query("""WITH s AS (SELECT project, count(*) AS commits, count(DISTINCT author) AS authors, max(ts) AS last_ts, sum(deletions) AS closed, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS days FROM {C} GROUP BY project),
    t AS (SELECT CASE WHEN NOT last_ts > TIMESTAMP '1999-06-01' - INTERVAL 365 DAY THEN '1 inactive' WHEN authors < 10 THEN '2 few contributors' WHEN commits < 500 THEN '3 few commits'
    WHEN closed < 1800 THEN '4 few closed requests' WHEN days < 365 THEN '5 short' ELSE '6 selected' END AS step FROM s) SELECT step, count(*) AS projects FROM t GROUP BY step""")
def p14_p15_selection_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How many projects fail at each step, the first that fails counting; deletions stand in for closed requests, with a bound of their size."""
    s = commits(spark, d).groupBy("project").agg(
        F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_ts"), F.sum("deletions").alias("closed"),
        ((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 86400).alias("days"),
    )
    active = F.col("last_ts") > F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 365 DAYS")
    step = F.when(~active, "1 inactive").when(F.col("authors") < 10, "2 few contributors").when(F.col("commits") < 500, "3 few commits").when(F.col("closed") < 1800, "4 few closed requests")
    return s.groupBy(step.when(F.col("days") < 365, "5 short").otherwise("6 selected").alias("step")).agg(F.count("*").alias("projects"))


@query("SELECT project, contributions AS n, author FROM {CF} WHERE contributions BETWEEN 2 AND 5 AND project NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def p16_p17_p19_ranges_and_drops(spark: SparkSession, d: str) -> DataFrame:
    broken = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("project"))
    return contributor_file(spark, d).where(F.col("contributions").between(2, 5)).join(broken, "project", "left_anti").select("project", F.col("contributions").alias("n"), "author")


@query("SELECT project, count(*) AS people FROM name_email_pairs WHERE NOT contains(coalesce(author_name, ''), '[bot]') GROUP BY project")
def p18_without_bots(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "name_email_pairs").where(~F.contains(F.coalesce("author_name", F.lit("")), F.lit("[bot]"))).groupBy("project").agg(F.count("*").alias("people"))


@query("SELECT project, sum(CASE WHEN is_core THEN churn ELSE 0 END) AS core_churn, count(*) AS n FROM {C} WHERE ts >= TIMESTAMP '1994-04-01' GROUP BY project")
def p20_p21_core_churn_after_cutoff(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).where("ts >= TIMESTAMP_NTZ '1994-04-01'")
    return c.groupBy("project").agg(F.sum(F.when(F.col("is_core"), F.col("churn")).otherwise(0.0)).alias("core_churn"), F.count("*").alias("n"))


@query("SELECT project, author, first_ts, least(last_ts, TIMESTAMP '1998-01-31 23:59:59') AS last_ts FROM {CF} WHERE first_ts <= TIMESTAMP '1998-01-31 23:59:59'")
def p22_cutoff_clamp(spark: SparkSession, d: str) -> DataFrame:
    cut = F.expr("TIMESTAMP_NTZ '1998-01-31 23:59:59'")
    return contributor_file(spark, d).where(F.col("first_ts") <= cut).select("project", "author", "first_ts", F.least("last_ts", cut).alias("last_ts"))


@query("""WITH c AS (SELECT category, dayofyear(ts)::INT AS doy, count(*) AS n FROM {C} GROUP BY 1, 2) SELECT category, doy, n FROM c WHERE doy > 10 AND doy <= (SELECT max(doy) FROM c) - 10""")
def p23_day_range_trim(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).groupBy("category", F.dayofyear("ts").alias("doy")).agg(F.count("*").alias("n"))
    top = c.agg(F.max("doy").alias("top"))
    return c.where((F.col("doy") > 10) & (F.col("doy") <= top.scalar() - 10)).select("category", "doy", "n")


@query("SELECT row_id, greatest(0, least(1, try_cast(churn AS DOUBLE) / 100)) AS share FROM df_all_commits_with_stats WHERE churn IS NOT NULL AND NOT isnan(churn)")
def p24_clip_unit(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where("churn IS NOT NULL AND NOT isnan(churn)")
    return c.select("row_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("churn").try_cast("double") / 100)).alias("share"))


@query(r"SELECT repo, regexp_replace(replace(repo, '/', '_'), '^([^_]*)_', '\1/') AS first_only, replace(replace(repo, '/', '_'), '_', '/') AS all_of_them FROM project_list")
def p25_p26_owner_repo(spark: SparkSession, d: str) -> DataFrame:
    flat = F.replace("repo", F.lit("/"), F.lit("_"))
    return read(spark, d, "project_list").select("repo", F.regexp_replace(flat, "^([^_]*)_", "$1/").alias("first_only"), F.replace(flat, F.lit("_"), F.lit("/")).alias("all_of_them"))


@query("SELECT project, round(CASE WHEN code_chars > 0 THEN commits / code_chars END, 6) AS commits_per_char, round(CASE WHEN code_chars > 0 THEN (additions + deletions) / code_chars END, 6) AS changes_per_char, additions + deletions AS total FROM {M}")
def p27_p28_per_code_character(spark: SparkSession, d: str) -> DataFrame:
    m, cc, total = part_metrics(spark, d), F.col("code_chars"), F.col("additions") + F.col("deletions")
    return m.select("project", F.round(F.when(cc > 0, F.col("commits") / cc), 6).alias("commits_per_char"), F.round(F.when(cc > 0, total / cc), 6).alias("changes_per_char"), total.alias("total"))


@query("SELECT category, repo FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(repo || '|7'), repo) AS i FROM project_list) WHERE i <= 5")
def p29_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five projects per category by a keyed hash, the same on every run."""
    w = Window.partitionBy("category").orderBy(F.md5(F.concat("repo", F.lit("|7"))), "repo")
    return read(spark, d, "project_list").withColumn("i", F.row_number().over(w)).where("i <= 5").select("category", "repo")


@query("SELECT min_by(project, row_id) AS project FROM {P} WHERE category = 'OSS'")
def p30_first_of_category(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("category = 'OSS'").agg(F.min_by("project", "row_id").alias("project"))


@query("SELECT row_id, author_name FROM name_email_pairs WHERE author_name ILIKE '%son%'")
def p31_name_contains(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "name_email_pairs").where(F.col("author_name").ilike("%son%")).select("row_id", "author_name")


@query("SELECT record_id, project, num_emails, num_names FROM contributors_all_projects WHERE num_emails IN (2, 3)")
def p32_two_or_three_emails(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contributors_all_projects").where(F.col("num_emails").isin(2, 3)).select("record_id", "project", "num_emails", "num_names")


@query("SELECT row_id, CASE WHEN coalesce(trim(category), '') IN ('', 'None') THEN 0 ELSE 1 END AS sg FROM df_all_commits_with_stats")
def p33_flag_from_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, CM).select("row_id", F.when(F.coalesce(F.trim("category"), F.lit("")).isin("", "None"), 0).otherwise(1).alias("sg"))


# ---- joins


@query("""SELECT repo, category, coalesce(n, 0) AS n, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del FROM project_list LEFT JOIN (SELECT lower(project) AS k, count(commit_hash) AS n,
    sum(insertions)::BIGINT AS ins, sum(deletions)::BIGINT AS del FROM df_all_commits_with_stats GROUP BY 1) ON k = lower(repo)""")
def j01_left_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, CM).groupBy(F.lower("project").alias("k")).agg(F.count("commit_hash").alias("n"), F.sum("insertions").alias("ins"), F.sum("deletions").alias("del"))
    j = read(spark, d, "project_list").withColumn("k", F.lower("repo")).join(a, "k", "left")
    return j.select("repo", "category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ins", "del")])


@query("SELECT p.repo AS project, p.category, c.n FROM project_list p JOIN (SELECT project, count(*) AS n FROM contributors_all_projects GROUP BY 1) c ON c.project = p.repo")
def j02_inner(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contributors_all_projects").groupBy("project").agg(F.count("*").alias("n"))
    return read(spark, d, "project_list").join(c, F.col("repo") == F.col("project")).select("project", "category", "n")


@query("""SELECT coalesce(a.project, b.project) AS project, coalesce(a.n, -1) AS n_a, coalesce(b.n, -1) AS n_b FROM (SELECT project, count(*) AS n FROM contributors_all_projects WHERE num_emails > 3 GROUP BY 1) a
    FULL JOIN (SELECT project, count(*) AS n FROM contributors_email_baseline_all_projects WHERE num_names > 3 GROUP BY 1) b ON a.project = b.project""")
def j03_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "contributors_all_projects").where("num_emails > 3").groupBy("project").agg(F.count("*").alias("n_a"))
    b = read(spark, d, "contributors_email_baseline_all_projects").where("num_names > 3").groupBy("project").agg(F.count("*").alias("n_b"))
    return a.join(b, "project", "full").select("project", F.coalesce("n_a", F.lit(-1)).alias("n_a"), F.coalesce("n_b", F.lit(-1)).alias("n_b"))


def method_counts(spark: SparkSession, d: str) -> DataFrame:
    """(method, project, n): contributors per project under each way of counting them."""
    p = pairs(spark, d)
    distinct = p.select("project", "author_name", "author_email").distinct().groupBy("project").agg(F.count("*").alias("n")).withColumn("method", F.lit("distinct"))
    email = read(spark, d, "contributors_email_baseline_all_projects").groupBy("project").agg(F.count("*").alias("n")).withColumn("method", F.lit("email"))
    merged = read(spark, d, "contributors_all_projects").groupBy("project").agg(F.count("*").alias("n")).withColumn("method", F.lit("merged"))
    return distinct.unionByName(email).unionByName(merged).select("method", "project", "n")


METHODS_SQL = """(SELECT 'distinct' AS method, project, count(*) AS n FROM (SELECT DISTINCT project, coalesce(author_name, '') AS a, coalesce(author_email, '') AS b FROM name_email_pairs) GROUP BY project
    UNION ALL SELECT 'email', project, count(*) FROM contributors_email_baseline_all_projects GROUP BY project UNION ALL SELECT 'merged', project, count(*) FROM contributors_all_projects GROUP BY project)"""


@query(f"SELECT project, coalesce(sum(n) FILTER (method = 'distinct'), 0)::BIGINT AS distinct_n, coalesce(sum(n) FILTER (method = 'email'), 0)::BIGINT AS email_n, coalesce(sum(n) FILTER (method = 'merged'), 0)::BIGINT AS merged_n FROM {METHODS_SQL} GROUP BY project")
def j04_method_table(spark: SparkSession, d: str) -> DataFrame:
    """The chain of full joins as one union and pivot."""
    t = method_counts(spark, d).groupBy("project").pivot("method", ["distinct", "email", "merged"]).agg(F.sum("n"))
    return t.select("project", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"{c}_n") for c in ("distinct", "email", "merged")])


@query("""SELECT coalesce(s.k, t.k) AS k, coalesce(s.v, t.v) AS v FROM (SELECT lower(repo) AS k, category AS v FROM project_list) t FULL JOIN
    (SELECT k, max_by(v, row_id) AS v FROM (SELECT lower(project) || CASE WHEN row_id % 7 = 0 THEN '-x' ELSE '' END AS k, contributor AS v, row_id FROM df_all_commits_with_stats WHERE contributor IS NOT NULL) GROUP BY k) s ON s.k = t.k""")
def j05_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where("contributor IS NOT NULL")
    k = F.concat(F.lower("project"), F.when(F.col("row_id") % 7 == 0, "-x").otherwise(""))
    s = c.groupBy(k.alias("k")).agg(F.max_by("contributor", "row_id").alias("sv"))
    t = read(spark, d, "project_list").select(F.lower("repo").alias("k"), F.col("category").alias("tv"))
    return t.join(s, "k", "full").select("k", F.coalesce("sv", "tv").alias("v"))


@query("""SELECT p.repo, CASE WHEN p.category = 'OSS4SG' OR s.sg THEN 'OSS4SG' ELSE 'OSS' END AS category, round(coalesce(m, 0), 6) AS mean_message FROM project_list p
    LEFT JOIN (SELECT project, bool_or(upper(category) = 'OSS4SG') AS sg, avg(length(message)) AS m FROM df_all_commits_with_stats GROUP BY 1) s ON s.project = p.repo""")
def j06_j07_a08_category_upgrade(spark: SparkSession, d: str) -> DataFrame:
    s = cm(spark, d).groupBy("project").agg(F.bool_or(F.col("category") == "OSS4SG").alias("sg"), F.avg(F.length("message")).alias("m"))
    p = read(spark, d, "project_list").join(s, F.col("repo") == F.col("project"), "left")
    up = F.when((F.col("category") == "OSS4SG") | F.col("sg"), "OSS4SG").otherwise("OSS")
    return p.select("repo", up.alias("category"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_message"))


@query("SELECT row_id, coalesce(canon, contributor) AS contributor FROM df_all_commits_with_stats c LEFT JOIN (SELECT author_email AS e, min(author_name) AS canon FROM name_email_pairs WHERE author_email LIKE '%@%' AND author_name <> '' GROUP BY 1) m ON m.e = c.author_email")
def j08_j09_j14_key_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A few addresses, placeholders among them, hold many commits: they are split off (``join_hot_left``)."""
    m = read(spark, d, "name_email_pairs").where("author_email LIKE '%@%' AND author_name <> ''").groupBy("author_email").agg(F.min("author_name").alias("canon"))
    c = read(spark, d, CM).select("row_id", "contributor", "author_email")
    return join_hot_left(c, m, "author_email").select("row_id", F.coalesce("canon", "contributor").alias("contributor"))


@query("""WITH w AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-01', INTERVAL 3 MONTH)) AS w)
    SELECT w.w, count(*) AS active FROM w JOIN {CF} c ON c.first_ts < w.w + INTERVAL 3 MONTH AND c.last_ts >= w.w GROUP BY w.w""")
def j11_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Contributors active in each quarter: intervals become quarter numbers, counted by differences, not by a range join."""
    q = lambda c: F.year(c) * 4 + F.quarter(c) - 1
    lo, hi = 1992 * 4, 1998 * 4 + 3
    c = contributor_file(spark, d).select(F.greatest(q("first_ts"), F.lit(lo)).alias("a"), (F.least(q("last_ts"), F.lit(hi)) + 1).alias("z")).where("a < z")
    steps = c.groupBy(F.col("a").alias("q")).agg(F.count("*").alias("n")).unionByName(c.groupBy(F.col("z").alias("q")).agg((-F.count("*")).alias("n")))
    steps = steps.groupBy("q").agg(F.sum("n").alias("n"))
    axis = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("q"))
    run = axis.join(steps, "q", "left").withColumn("active", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("q")))  # one row per quarter
    return run.where("active > 0").select(F.make_timestamp_ntz(F.floor(F.col("q") / 4).cast("int"), (F.col("q") % 4 * 3 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("w"), "active")


@query(f"SELECT method, project, n FROM {METHODS_SQL} WHERE project IN (SELECT project FROM {METHODS_SQL} GROUP BY project HAVING count(DISTINCT method) = 3)")
def j12_u04_common_projects(spark: SparkSession, d: str) -> DataFrame:
    m = method_counts(spark, d)
    common = m.groupBy("project").agg(F.countDistinct("method").alias("k")).where("k = 3").select("project")
    return m.join(common, "project", "left_semi").select("method", "project", "n")


@query("SELECT repo FROM project_list WHERE repo NOT IN (SELECT project FROM contributors_all_projects WHERE num_pairs_merged > 4)")
def j13_u06_remaining(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "contributors_all_projects").where("num_pairs_merged > 4").select(F.col("project").alias("repo")).distinct()
    return read(spark, d, "project_list").join(done, "repo", "left_anti").select("repo")


# ---- aggregations


@query("SELECT project, count(commit_hash) AS commits, sum(insertions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(*) AS n, count(DISTINCT contributor) AS people FROM df_all_commits_with_stats GROUP BY project")
def a01_a02_a03_commit_totals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, CM).groupBy("project").agg(
        F.count("commit_hash").alias("commits"), F.sum("insertions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("n"), F.countDistinct("contributor").alias("people")
    )


@query("""WITH k AS (SELECT email_norm AS k, count(DISTINCT project) AS p, count(DISTINCT CASE WHEN category = 'OSS' THEN project END) AS a, count(DISTINCT CASE WHEN category = 'OSS4SG' THEN project END) AS b FROM {P} WHERE email_norm <> '' GROUP BY 1)
    SELECT count(*) AS keys, count(*) FILTER (p >= 2) AS intra, count(*) FILTER (a >= 1 AND b >= 1) AS inter_any, count(*) FILTER (a >= 2 AND b >= 2) AS inter_strict, round(100.0 * count(*) FILTER (p >= 2) / count(*), 6) AS intra_pct FROM k""")
def a04_a05_a06_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("email_norm <> ''")
    in_cat = lambda c: F.countDistinct(F.when(F.col("category") == c, F.col("project")))
    k = p.groupBy("email_norm").agg(F.countDistinct("project").alias("p"), in_cat("OSS").alias("a"), in_cat("OSS4SG").alias("b"))
    return k.agg(
        F.count("*").alias("keys"), F.count_if(F.col("p") >= 2).alias("intra"), F.count_if((F.col("a") >= 1) & (F.col("b") >= 1)).alias("inter_any"),
        F.count_if((F.col("a") >= 2) & (F.col("b") >= 2)).alias("inter_strict"), F.round(100.0 * F.count_if(F.col("p") >= 2) / F.nullif(F.count("*"), F.lit(0)), 6).alias("intra_pct"),
    )


@query("SELECT project, email_norm, string_agg(DISTINCT author_name, '; ' ORDER BY author_name) AS names, count(DISTINCT author_name) AS num_names FROM {P} WHERE email_norm <> '' GROUP BY 1, 2")
def a07_sorted_distinct_join(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("email_norm <> ''")
    return p.groupBy("project", "email_norm").agg(F.concat_ws("; ", F.array_sort(F.collect_set("author_name"))).alias("names"), F.countDistinct("author_name").alias("num_names"))


@query("""SELECT project, strftime(ts, '%Y-%m') AS month, round(sum(CASE WHEN is_core THEN churn ELSE 0 END) / sum(churn), 6) AS ratio FROM {C} GROUP BY 1, 2 HAVING sum(churn) <> 0 AND sum(CASE WHEN is_core THEN churn ELSE 0 END) <> 0""")
def a09_monthly_core_ratio(spark: SparkSession, d: str) -> DataFrame:
    core = F.sum(F.when(F.col("is_core"), F.col("churn")).otherwise(0.0))
    g = commits(spark, d).groupBy("project", F.date_format("ts", "yyyy-MM").alias("month")).agg(core.alias("core"), F.sum("churn").alias("all"))
    return g.where("all <> 0 AND core <> 0").select("project", "month", F.round(F.col("core") / F.col("all"), 6).alias("ratio"))


@query("SELECT category, weekofyear(ts)::INT AS week, round(sum(churn) FILTER (is_core) / sum(churn), 6) AS ratio, count(*) AS n FROM {C} GROUP BY 1, 2")
def a10_weekly_ratio(spark: SparkSession, d: str) -> DataFrame:
    core = F.sum(F.when(F.col("is_core"), F.col("churn")))
    return commits(spark, d).groupBy("category", F.weekofyear("ts").alias("week")).agg(F.round(core / F.sum("churn"), 6).alias("ratio"), F.count("*").alias("n"))


DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@query("SELECT monthname(ts) AS month_name, " + ", ".join(f"nullif(count(*) FILTER (dayname(ts) = '{x}'), 0) AS {x.lower()}" for x in DAYS) + " FROM {C} GROUP BY 1")
def a11_month_day_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).select(F.date_format("ts", "MMMM").alias("month_name"), F.date_format("ts", "EEEE").alias("day"))
    p = c.groupBy("month_name").pivot("day", list(DAYS)).agg(F.count(F.lit(1)))
    return p.select("month_name", *[F.col(x).alias(x.lower()) for x in DAYS])


@query("""WITH s AS (SELECT min(ts) AS a, max(ts) AS z FROM {C}), q AS (SELECT a + (z - a) * 0.25 AS q1, a + (z - a) * 0.5 AS q2, a + (z - a) * 0.75 AS q3 FROM s),
    t AS (SELECT c.*, epoch(c.ts) AS e, epoch(s.a) AS ea, epoch(s.z) AS ez FROM {C} c, s)
    SELECT author, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (e < ea + 0.25 * (ez - ea)) AS w1, count(*) FILTER (e >= ea + 0.25 * (ez - ea) AND e < ea + 0.5 * (ez - ea)) AS w2,
    count(*) FILTER (e >= ea + 0.5 * (ez - ea) AND e < ea + 0.75 * (ez - ea)) AS w3, count(*) FILTER (e >= ea + 0.75 * (ez - ea)) AS w4, max(ts) > TIMESTAMP '1998-08-01' - INTERVAL 150 DAY AS active FROM t GROUP BY author""")
def a12_r09_d09_four_windows(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).withColumn("e", F.unix_timestamp(F.col("ts").cast("timestamp")))
    c = c.withColumns({"ea": c.agg(F.min("e")).scalar(), "ez": c.agg(F.max("e")).scalar()})
    at = [F.col("ea") + q * (F.col("ez") - F.col("ea")) for q in (0.25, 0.5, 0.75)]
    e = F.col("e")
    return c.groupBy("author").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(e < at[0]).alias("w1"), F.count_if((e >= at[0]) & (e < at[1])).alias("w2"),
        F.count_if((e >= at[1]) & (e < at[2])).alias("w3"), F.count_if(e >= at[2]).alias("w4"), (F.max("ts") > F.expr("TIMESTAMP_NTZ '1998-08-01' - INTERVAL 150 DAYS")).alias("active"),
    )


@query("""WITH a AS (SELECT project, contributor, contributor LIKE '%bot%' AS bot, count(*) AS c FROM df_all_commits_with_stats WHERE contributor IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, sum(c) OVER (PARTITION BY project) AS n, coalesce(sum(CASE WHEN bot THEN 0 ELSE c END) OVER (PARTITION BY project ORDER BY c DESC, contributor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
    SELECT project, contributor, c AS commits FROM b WHERE NOT bot AND before < 0.8 * n AND c >= 0.05 * n""")
def a13_core_contributors(spark: SparkSession, d: str) -> DataFrame:
    from tributary.operators.lifecycle import core_contributors

    c = read(spark, d, CM).where("contributor IS NOT NULL").groupBy("project", "contributor").agg(F.count("*").alias("commits"))
    return core_contributors(c, "project", "contributor", "commits", F.contains("contributor", F.lit("bot"))).select("project", "contributor", "commits")


@query("SELECT category, " + ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("commits", "additions", "authors") for f, n in (("sum", "sum"), ("avg", "mean"), ("median", "median"), ("max", "max"), ("min", "min"), ("stddev_samp", "std"))) + " FROM {M} GROUP BY category")
def a14_t21_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    fs = ((F.sum, "sum"), (F.avg, "mean"), (F.median, "median"), (F.max, "max"), (F.min, "min"), (F.stddev_samp, "std"))
    return part_metrics(spark, d).groupBy("category").agg(*[F.round(f(c), 4).alias(f"{c}_{n}") for c in ("commits", "additions", "authors") for f, n in fs])


@query("SELECT o_custkey AS project, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) AS total FROM orders GROUP BY 1")
def a15_r05_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.count(F.lit(1)))
    total = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("total"))
    return total.join(o, "project").select("project", F.coalesce("1-URGENT", F.lit(0)).alias("critical"), F.coalesce("2-HIGH", F.lit(0)).alias("high"), "total")


@query("SELECT category, quarter(ts)::INT AS quarter, sum(churn) AS churn_sum, round(avg(churn), 6) AS churn_mean, count(*) AS n, round(sum(churn) FILTER (is_core) / sum(churn), 6) AS core_share FROM {C} GROUP BY 1, 2")
def a16_quarter_report(spark: SparkSession, d: str) -> DataFrame:
    core = F.sum(F.when(F.col("is_core"), F.col("churn")))
    return commits(spark, d).groupBy("category", F.quarter("ts").alias("quarter")).agg(F.sum("churn").alias("churn_sum"), F.round(F.avg("churn"), 6).alias("churn_mean"), F.count("*").alias("n"), F.round(core / F.sum("churn"), 6).alias("core_share"))


@query("""WITH u AS (SELECT category, metric, value FROM (SELECT category, commits, additions, authors FROM {M}) UNPIVOT (value FOR metric IN (commits, additions, authors))),
    s AS (SELECT category, metric, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS med, round(stddev_samp(value), 4) AS std FROM u GROUP BY 1, 2)
    SELECT *, rank() OVER (PARTITION BY metric ORDER BY mean DESC) AS rank FROM s""")
def a17_a18_group_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    u = part_metrics(spark, d).unpivot(["category"], ["commits", "additions", "authors"], "metric", "value")
    s = u.groupBy("category", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("med"), F.round(F.stddev_samp("value"), 4).alias("std"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("mean"))).cast("long"))


@query("""SELECT 'contributor' AS col, count(*) FILTER (coalesce(contributor, '') <> '') AS filled, count(*) FILTER (try_cast(contributor AS DOUBLE) IS NOT NULL) AS numeric_n, count(*) AS n FROM df_all_commits_with_stats
    UNION ALL SELECT 'commit_date', count(*) FILTER (coalesce(commit_date, '') <> ''), count(*) FILTER (regexp_matches(coalesce(commit_date, ''), '^[0-9]+$')), count(*) FROM df_all_commits_with_stats""")
def a19_a20_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM)
    one = c.agg(
        F.count_if(F.coalesce("contributor", F.lit("")) != "").alias("a"), F.count_if(F.col("contributor").rlike(r"^\s*[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+|inf|infinity|nan)\s*$")).alias("b"),
        F.count_if(F.coalesce("commit_date", F.lit("")) != "").alias("c"), F.count_if(F.col("commit_date").rlike("^[0-9]+$")).alias("e"), F.count("*").alias("n"),
    )
    return one.select(F.expr("stack(2, 'contributor', a, b, n, 'commit_date', c, e, n) AS (col, filled, numeric_n, n)"))


@query("""WITH n AS (SELECT project, count(*) AS n FROM {CF} GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM n)
    SELECT (n // 20)::BIGINT AS bin, count(*) AS projects, (SELECT min(n) FROM n) AS least, (SELECT max(n) FROM n) AS most, (SELECT n FROM r WHERE i = k // 2) AS upper_median, (SELECT round(avg(n), 6) FROM n) AS mean, (SELECT round(stddev_samp(n), 6) FROM n) AS std FROM n GROUP BY 1""")
def a21_r06_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = contributor_file(spark, d).groupBy("project").agg(F.count("*").alias("n"))
    # the upper median from counts per value: as many rows as values
    freq = n.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    median = freq.agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))))
    bins = n.groupBy(F.floor(F.col("n") / 20).alias("bin")).agg(F.count("*").alias("projects"))
    return bins.withColumns({"least": freq.agg(F.min("n")).scalar(), "most": freq.agg(F.max("n")).scalar(), "upper_median": median.scalar(), "mean": n.agg(F.round(F.avg("n"), 6)).scalar(), "std": n.agg(F.round(F.stddev_samp("n"), 6)).scalar()})


@query("SELECT round(avg(least(authentic, 500) / least(total, 500)), 6) AS mean_share, round(avg(one_time / total), 6) AS mean_one_time FROM (SELECT project, count(*) FILTER (contributions > 1)::DOUBLE AS authentic, count(*) FILTER (contributions = 1)::DOUBLE AS one_time, count(*)::DOUBLE AS total FROM {CF} GROUP BY project)")
def a22_mean_of_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = contributor_file(spark, d).groupBy("project").agg(F.count_if(F.col("contributions") > 1).alias("authentic"), F.count_if(F.col("contributions") == 1).alias("one_time"), F.count("*").alias("total"))
    return g.agg(F.round(F.avg(F.least("authentic", F.lit(500)) / F.least("total", F.lit(500))), 6).alias("mean_share"), F.round(F.avg(F.col("one_time") / F.col("total")), 6).alias("mean_one_time"))


@query("SELECT category, count(*) AS projects, sum(total)::BIGINT AS total, round(avg(total), 6) AS mean_total, sum(one_time)::BIGINT AS one_time, round(avg(one_time), 6) AS mean_one_time FROM (SELECT project, category, count(*) AS total, count(*) FILTER (contributions = 1) AS one_time FROM {CF} GROUP BY 1, 2) GROUP BY 1")
def a32_totals_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Contributors and one-time contributors of the projects of each category, in all and on average."""
    g = contributor_file(spark, d).groupBy("project", "category").agg(F.count("*").alias("total"), F.count_if(F.col("contributions") == 1).alias("one_time"))
    return g.groupBy("category").agg(F.count("*").alias("projects"), *[x for c in ("total", "one_time") for x in (F.sum(c).alias(c), F.round(F.avg(c), 6).alias(f"mean_{c}"))])


@query(f"SELECT method, floor(log10(n) * 4)::BIGINT AS bin, count(*) AS projects, sum(n)::BIGINT AS contributors FROM {METHODS_SQL} GROUP BY 1, 2")
def a23_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return method_counts(spark, d).groupBy("method", F.floor(F.log10("n") * 4).alias("bin")).agg(F.count("*").alias("projects"), F.sum("n").alias("contributors"))


@query(f"""WITH s AS (SELECT method, count(*) AS n, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, median(n) AS med, min(n) AS lo, max(n) AS hi, round(stddev_pop(n), 6) AS std_pop, round(stddev_samp(n), 6) AS std FROM {METHODS_SQL} GROUP BY method)
    SELECT *, round(100.0 * (1 - total / (SELECT total FROM s WHERE method = 'distinct')), 6) AS reduction_pct FROM s""")
def a24_a25_method_summary(spark: SparkSession, d: str) -> DataFrame:
    s = method_counts(spark, d).groupBy("method").agg(
        F.count("*").alias("n"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("med"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.round(F.stddev_pop("n"), 6).alias("std_pop"), F.round(F.stddev_samp("n"), 6).alias("std"),
    )
    base = s.where("method = 'distinct'").select(F.col("total"))
    return s.withColumn("reduction_pct", F.round(100.0 * (1 - F.col("total") / base.scalar()), 6))


@query("SELECT num_emails, count(*) AS n FROM contributors_all_projects GROUP BY 1 ORDER BY 1")
def a28_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contributors_all_projects").groupBy("num_emails").agg(F.count("*").alias("n")).orderBy("num_emails")


@query("SELECT source AS stage, lang AS cluster, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def a29_share_within(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").groupBy(F.col("source").alias("stage"), F.col("lang").alias("cluster")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("stage")), 6))


@query("SELECT project, arg_max(lang, (n, lang)) AS language FROM (SELECT project, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY project")
def a30_dominant_language(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").where("lang IS NOT NULL").groupBy("project", "lang").agg(F.count("*").alias("n"))
    return g.groupBy("project").agg(F.max_by("lang", F.struct("n", "lang")).alias("language"))


@query("SELECT min_by(category, row_id) AS category, project, min(row_id) AS first_row FROM name_email_pairs WHERE category IS NOT NULL GROUP BY project")
def a35_first_seen_category(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "name_email_pairs").where("category IS NOT NULL").groupBy("project").agg(F.min_by("category", "row_id").alias("category"), F.min("row_id").alias("first_row"))


@query("SELECT category, is_core, count(*) AS n, sum(churn) AS churn FROM {C} GROUP BY CUBE (category, is_core)")
def a36_cube(spark: SparkSession, d: str) -> DataFrame:
    return commits(spark, d).cube("category", "is_core").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"))


# ---- windows


@query("SELECT project, record_id, printf('g%06d', row_number() OVER (PARTITION BY project ORDER BY num_pairs_merged DESC NULLS LAST, record_id)) AS gid FROM contributors_all_projects")
def w01_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ranks come from a range sort, so a project with a third of all records spreads over many tasks."""
    g = read(spark, d, "contributors_all_projects").select("project", "record_id", F.col("num_pairs_merged").isNull().alias("none"), (-F.col("num_pairs_merged")).alias("down"), F.lit(1).alias("one"))
    return prefix_sum(g, ["project"], ["none", "down", "record_id"], "one", "i").select("project", "record_id", F.format_string("g%06d", "i").alias("gid"))


@query("""WITH d AS (SELECT category, ts::DATE AS day, count(*)::DOUBLE AS n FROM {C} GROUP BY 1, 2) SELECT category, day, round(avg(n) OVER (PARTITION BY category ORDER BY day ROWS 13 PRECEDING), 6) AS rolling,
    round(coalesce((n - min(n) OVER (PARTITION BY category)) / nullif(max(n) OVER (PARTITION BY category) - min(n) OVER (PARTITION BY category), 0), 0), 6) AS scaled,
    round(sum(n) OVER (PARTITION BY category ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM d""")
def w03_w05_w07_daily_smoothing(spark: SparkSession, d: str) -> DataFrame:
    g = commits(spark, d).groupBy("category", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    o, a = Window.partitionBy("category").orderBy("day"), Window.partitionBy("category")
    n, lo = F.col("n"), F.min("n").over(a)
    return g.select(
        "category", "day", F.round(F.avg("n").over(o.rowsBetween(-13, 0)), 6).alias("rolling"),
        F.round(F.coalesce((n - lo) / F.nullif(F.max("n").over(a) - lo, F.lit(0)), F.lit(0.0)), 6).alias("scaled"), F.round(F.sum("n").over(o.rowsBetween(-1, 1)) / 3, 6).alias("smooth"),
    )


@query(f"""WITH t AS (SELECT project, sum(n) FILTER (method = 'distinct') - coalesce(sum(n) FILTER (method = 'merged'), 0) AS diff FROM {METHODS_SQL} GROUP BY 1 HAVING diff IS NOT NULL),
    c AS (SELECT project, diff::BIGINT AS diff, (sum(diff) OVER (ORDER BY diff DESC, project ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM t) SELECT project, diff, run, run - diff < 0.5 * (SELECT sum(diff) FROM t) AS needed FROM c""")
def w04_cumulative_to_target(spark: SparkSession, d: str) -> DataFrame:
    m = method_counts(spark, d).groupBy("project").pivot("method", ["distinct", "merged"]).agg(F.sum("n"))
    t = m.where("distinct IS NOT NULL").select("project", (F.col("distinct") - F.coalesce("merged", F.lit(0))).alias("diff"))
    run = F.sum("diff").over(Window.orderBy(F.desc("diff"), "project").rowsBetween(Window.unboundedPreceding, 0))  # one row per project
    total = t.agg(F.sum("diff")).scalar()
    return t.withColumn("run", run).select("project", "diff", "run", (F.col("run") - F.col("diff") < 0.5 * total).alias("needed"))


@query("SELECT project, min(ts) AS first_ts, max(ts) AS last_ts, round(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.0, 6) AS years FROM {C} GROUP BY project")
def w06_d08_lifetime(spark: SparkSession, d: str) -> DataFrame:
    g = commits(spark, d).groupBy("project").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    secs = F.unix_timestamp(F.col("last_ts").cast("timestamp")) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))
    return g.withColumn("years", F.round(F.floor(secs / 86400) / 365.0, 6))


# ---- sorts, limits, sets


@query(f"SELECT project, abs(n_a - n_b) AS gap FROM (SELECT project, coalesce(sum(n) FILTER (method = 'email'), 0)::BIGINT AS n_a, coalesce(sum(n) FILTER (method = 'merged'), 0)::BIGINT AS n_b FROM {METHODS_SQL} GROUP BY 1) ORDER BY gap DESC, project LIMIT 10")
def o01_o03_top_gaps(spark: SparkSession, d: str) -> DataFrame:
    m = method_counts(spark, d).groupBy("project").pivot("method", ["email", "merged"]).agg(F.sum("n"))
    gap = F.abs(F.coalesce("email", F.lit(0)) - F.coalesce("merged", F.lit(0)))
    return m.select("project", gap.alias("gap")).orderBy(F.desc("gap"), "project").limit(10)


@query(f"SELECT arg_max(project, (gap, project)) AS project, max(gap) AS gap FROM (SELECT project, abs(coalesce(sum(n) FILTER (method = 'email'), 0) - coalesce(sum(n) FILTER (method = 'merged'), 0))::BIGINT AS gap FROM {METHODS_SQL} GROUP BY 1)")
def o05_widest_gap(spark: SparkSession, d: str) -> DataFrame:
    m = method_counts(spark, d).groupBy("project").pivot("method", ["email", "merged"]).agg(F.sum("n"))
    gap = F.abs(F.coalesce("email", F.lit(0)) - F.coalesce("merged", F.lit(0)))
    return m.select("project", gap.alias("gap")).agg(F.max_by("project", F.struct("gap", "project")).alias("project"), F.max("gap").alias("gap"))


@query("SELECT record_id, project, num_emails FROM contributors_all_projects WHERE num_emails IS NOT NULL ORDER BY num_emails DESC, lower(project), record_id")
def o02_o07_mixed_order(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "contributors_all_projects").where("num_emails IS NOT NULL").orderBy(F.desc("num_emails"), F.lower("project"), "record_id").select("record_id", "project", "num_emails")


@query("SELECT 'merged' AS origin, project, names FROM contributors_all_projects UNION ALL SELECT 'email', project, names FROM contributors_email_baseline_all_projects")
def u01_labelled_union(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "contributors_all_projects").select(F.lit("merged").alias("origin"), "project", "names")
    return a.unionByName(read(spark, d, "contributors_email_baseline_all_projects").select(F.lit("email").alias("origin"), "project", "names"))


@query("""WITH u AS (SELECT 1 AS o, 'early' AS stage, project, n FROM (SELECT project, count(*) AS n FROM {C} WHERE ts < TIMESTAMP '1994-01-01' GROUP BY 1) UNION ALL SELECT 2, 'middle', project, n FROM (SELECT project, count(*) AS n FROM {C} WHERE ts >= TIMESTAMP '1994-01-01' AND ts < TIMESTAMP '1996-01-01' GROUP BY 1)
    UNION ALL SELECT 3, 'late', project, n FROM (SELECT project, count(*) AS n FROM {C} WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY 1)) SELECT row_number() OVER (ORDER BY o, project) - 1 AS place, stage, project, n FROM u""")
def u08_stacked_stages(spark: SparkSession, d: str) -> DataFrame:
    """The columns of three stages below one another, with a running number."""
    c = commits(spark, d)
    o = F.when(F.expr("ts < TIMESTAMP_NTZ '1994-01-01'"), 1).when(F.expr("ts < TIMESTAMP_NTZ '1996-01-01'"), 2).otherwise(3)
    g = c.groupBy(o.alias("o"), "project").agg(F.count("*").alias("n")).withColumns({"one": F.lit(1), "all": F.lit(0)})
    stage = F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), F.col("o"))
    return prefix_sum(g, ["all"], ["o", "project"], "one", "i").select((F.col("i") - 1).alias("place"), stage.alias("stage"), "project", "n")


@query("SELECT DISTINCT project, category, author_name, author_email FROM {P}")
def u02_u03_distinct(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("project", "category", "author_name", "author_email").dropDuplicates(["project", "category", "author_name", "author_email"])


@query("SELECT project, bool_or(k = 'a') AS in_commits, bool_or(k = 'b') AS in_documents FROM (SELECT project, 'a' AS k FROM df_all_commits_with_stats UNION SELECT project, 'b' FROM documents) GROUP BY project")
def u05_union_of_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, CM).select("project", F.lit("a").alias("k")).distinct().unionByName(read(spark, d, "documents").select("project", F.lit("b").alias("k")).distinct())
    return a.groupBy("project").agg(F.bool_or(F.col("k") == "a").alias("in_commits"), F.bool_or(F.col("k") == "b").alias("in_documents"))


@query("""WITH u AS (SELECT lower(repo) AS k, repo AS name, 0 AS o, category FROM project_list UNION ALL SELECT lower(project), project, 1 + row_id, upper(category) FROM name_email_pairs WHERE category IS NOT NULL)
    SELECT k, min_by(name, o) AS name, CASE WHEN bool_or(category = 'OSS4SG') THEN 'OSS4SG' ELSE 'OSS' END AS category FROM u GROUP BY k""")
def u07_union_with_precedence(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "project_list").select(F.lower("repo").alias("k"), F.col("repo").alias("name"), F.lit(0).cast("long").alias("o"), "category")
    b = read(spark, d, "name_email_pairs").where("category IS NOT NULL").select(F.lower("project").alias("k"), F.col("project").alias("name"), (F.col("row_id") + 1).alias("o"), F.upper("category").alias("category"))
    return a.unionByName(b).groupBy("k").agg(F.min_by("name", "o").alias("name"), F.when(F.bool_or(F.col("category") == "OSS4SG"), "OSS4SG").otherwise("OSS").alias("category"))


QUERIES, SQL = query.queries, query.sql
