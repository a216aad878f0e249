"""Sources, sinks, code metrics and streaming of the survey (S, K, X14, Y, 2.14), as round trips over the driver's tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import codemetrics
from tributary.session import read, scratch_path
from tributary.sources import files, sinks
from tributary.sources.views import Registry
from tributary.streaming import activity

query = Registry()
CM = "df_all_commits_with_stats"


@query("SELECT row_id, project, author_name, author_email FROM name_email_pairs")
def s01_s04_k01_delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every name and address there and back: blanks at the ends, empty texts and nulls stay what they are."""
    p = read(spark, d, "name_email_pairs").select("row_id", "project", "author_name", "author_email")
    path = scratch_path(spark, "csv")
    sinks.write_delimited(p, path)
    return files.read_delimited(spark, path, p.schema)


@query("SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'F'")
def s02_typed_scan(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("price"))
    path = scratch_path(spark, "csv")
    sinks.write_delimited(o, path)
    return files.read_delimited(spark, path, o.schema)


@query("SELECT row_id, replace(project, '/', '__') AS project, author_name FROM name_email_pairs")
def s05_s06_s07_s21_folder_union(spark: SparkSession, d: str) -> DataFrame:
    """One file a project, in a folder a category, read as one table: the project comes from the file's name, a folder that is not there is left out."""
    p = read(spark, d, "name_email_pairs").select("row_id", F.replace("project", F.lit("/"), F.lit("__")).alias("project"), "author_name", F.when(F.col("category").isNull(), "none").otherwise(F.lower("category")).alias("folder"))
    path = scratch_path(spark, "folder")
    sinks.write_named(p, path, "folder", "project")
    names = [f"{path}/{x}" for x in ("oss", "oss4sg", "none", "absent")]
    return files.read_folders(spark, names, "row_id long, author_name string", "*_pairs.csv").select("row_id", "project", "author_name")


@query("SELECT project, count(*) AS n, count(author_name) AS named FROM name_email_pairs GROUP BY project")
def s03_split_scan(spark: SparkSession, d: str) -> DataFrame:
    """A delimited file whose texts hold no line ends, read in splits instead of whole."""
    p = read(spark, d, "name_email_pairs").select("row_id", "project", F.regexp_replace("author_name", r"[\r\n]", " ").alias("author_name"))
    path = scratch_path(spark, "csv")
    sinks.write_delimited(p, path)
    return files.read_delimited(spark, path, p.schema, multiLine="false").groupBy("project").agg(F.count("*").alias("n"), F.count("author_name").alias("named"))


@query(r"""SELECT commit_hash AS commit, string_split(l, '|')[2] AS author_name, count(*) AS n FROM (SELECT commit_hash, concat_ws('|', commit_hash, coalesce(contributor, ''), coalesce(author_email, ''), coalesce(commit_date, ''), coalesce(message, '')) AS l FROM df_all_commits_with_stats) WHERE len(string_split(l, '|')) >= 5 GROUP BY 1, 2""")
def s08_pipe_log(spark: SparkSession, d: str) -> DataFrame:
    """Whole commits as lines between bars; a bar inside a field shifts those behind it, as in the log itself."""
    text = lambda c: F.coalesce(c, F.lit(""))
    lines = read(spark, d, CM).select(F.concat_ws("|", "commit_hash", text("contributor"), text("author_email"), text("commit_date"), text("message")).alias("value"))
    return files.parse_pipe_log(lines).groupBy("commit", "author_name").agg(F.count("*").alias("n"))


def framed(spark: SparkSession, d: str) -> DataFrame:
    """Commits as records of a framed log, of a text and a binary file each; every fifth is a merge of two parents, every seventh has no files."""
    c = read(spark, d, CM)
    dash = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("-"))
    text = lambda x: F.translate(F.coalesce(x, F.lit("")), "\n\x1e\x1f", "   ")
    parents = F.when(F.col("row_id") % 5 == 0, "p1 p2").otherwise("p1")
    head = F.concat_ws("\x1f", "commit_hash", text("contributor"), text("author_email"), text(F.trim("commit_date")), F.lit("message"), parents)
    stat = F.concat(F.lit("\n"), F.concat_ws("\t", dash("insertions"), dash("deletions"), F.lit("src/a.py")), F.lit("\n"), F.concat_ws("\t", F.lit("1"), F.lit("-"), F.lit("b.bin")))
    return c.select(F.concat(F.lit("\x1e"), head, F.when(F.col("row_id") % 7 == 0, "").otherwise(stat)).alias("value"))


FRAMED_SQL = r"""SELECT row_id, commit_hash AS commit, coalesce(insertions, 0) + 1 AS total_additions, coalesce(deletions, 0) AS total_deletions, 2::BIGINT AS num_files, regexp_extract(translate(trim(commit_date, ' '), chr(10) || chr(30) || chr(31), '   '), '([+-]\d{4})$', 1) AS timezone,
    ['b.bin:1:0', 'src/a.py:' || coalesce(insertions, 0) || ':' || coalesce(deletions, 0)] AS by_file FROM df_all_commits_with_stats"""


@query(f"SELECT commit, total_additions, total_deletions, num_files, coalesce(timezone, '') AS timezone, by_file FROM ({FRAMED_SQL}) WHERE row_id % 7 <> 0")
def s09_s11_r04_framed_log(spark: SparkSession, d: str) -> DataFrame:
    """Totals and the maps of added and deleted lines by file, for every commit with files."""
    p = files.parse_framed_log(framed(spark, d), empty=False)
    by_file = F.transform(F.array_sort(F.map_keys("additions_by_file")), lambda k: F.concat_ws(":", k, F.element_at("additions_by_file", k).cast("string"), F.element_at("deletions_by_file", k).cast("string")))
    return p.select("commit", "total_additions", "total_deletions", F.col("num_files").cast("long").alias("num_files"), "timezone", by_file.alias("by_file"))


@query(f"SELECT commit, total_additions FROM ({FRAMED_SQL}) WHERE row_id % 7 <> 0 AND row_id % 5 <> 0 ORDER BY commit, total_additions LIMIT 200")
def s10_sampled_log(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the reference: no merges, no commits without files, the first two hundred in order."""
    p = files.parse_framed_log(framed(spark, d), merges=False, empty=False)
    return p.select("commit", "total_additions").orderBy("commit", "total_additions").limit(200)


@query("SELECT doc_id, length(text) AS chars, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || '[truncated]' ELSE text END AS cut FROM documents")
def s11_x16_cut_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), files.cut_diff(F.col("text"), 500).alias("cut"))


@query("SELECT project, count(*) AS n, sum(insertions)::BIGINT AS ins FROM df_all_commits_with_stats GROUP BY project")
def s14_k04_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).select("project", "commit_hash", "message", F.struct("insertions", "deletions").alias("stat"))
    path = scratch_path(spark, "json")
    sinks.write_lines(c, path)
    return spark.read.schema(c.schema).json(path).groupBy("project").agg(F.count("*").alias("n"), F.sum("stat.insertions").alias("ins"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def s19_problem_reports(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.upper("event_type").alias("severity"), F.lit("x").alias("type"))).alias("listProblem"))
    reports = e.select("user_id", F.to_json(F.struct("listProblem")).alias("json"))
    return files.problem_counts(reports, "user_id", "json", ["CLICK", "VIEW"])


@query("SELECT project, round(sum(churn), 4) AS churn_sum, round(avg(churn), 4) AS churn_mean, round(median(churn), 4) AS churn_median, max(churn) AS churn_max, min(churn) AS churn_min, round(stddev_samp(churn), 4) AS churn_std FROM df_all_commits_with_stats WHERE NOT isnan(churn) GROUP BY project")
def s20_metric_file(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where("NOT isnan(churn)").select("project", F.col("churn").cast("string").alias("churn"))
    s = files.metric_statistics(c, "project", ["churn"])
    return s.select("project", *[(F.round(x, 4) if x.split("_")[1] not in ("max", "min") else F.col(x)).alias(x) for x in s.columns[1:]])


@query("SELECT category, project, count(*) AS n FROM (SELECT upper(category) AS category, project FROM name_email_pairs WHERE category IS NOT NULL) GROUP BY 1, 2")
def s13_k02_k03_k05_k08_partitioned_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows written by category in two appends, then read with partition pruning."""
    p = read(spark, d, "name_email_pairs").where("category IS NOT NULL").select(F.upper("category").alias("category"), "project", "row_id")
    path = scratch_path(spark, "parts")
    sinks.write_partitioned(p.where("row_id % 2 = 0"), path, "category")
    sinks.append_missing(p.where("row_id % 2 = 1"), path + "-rest", "row_id")
    sinks.append_missing(p.where("row_id % 2 = 1"), path + "-rest", "row_id")  # a second run adds nothing
    both = spark.read.parquet(path).select("category", "project").unionByName(spark.read.parquet(path + "-rest").select("category", "project"))
    return both.groupBy("category", "project").agg(F.count("*").alias("n"))


@query("SELECT project, CASE WHEN m IS NULL OR isnan(m) THEN '' ELSE printf('%.6f', m) END AS mean_churn FROM (SELECT project, avg(churn) FILTER (NOT isnan(churn)) AS m FROM df_all_commits_with_stats GROUP BY project)")
def k07_fixed_precision(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).groupBy("project").agg(F.avg(F.when(~F.isnan("churn"), F.col("churn"))).alias("mean_churn"))
    return sinks.as_text(c)


@query("""WITH g AS (SELECT source, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY source) SELECT unnest(['source | n | mean'] || list(concat_ws(' | ', coalesce(source, ''), n::VARCHAR, printf('%.4f', mean)) ORDER BY source NULLS FIRST)) AS line FROM g""")
def k06_report(spark: SparkSession, d: str) -> DataFrame:
    """A small table, one row per source, as lines of text."""
    g = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")).orderBy(F.asc_nulls_first("source"))
    return spark.createDataFrame([(x,) for x in sinks.report(g).split("\n")], "line string")


@query("SELECT row_id, project FROM name_email_pairs WHERE project NOT IN (SELECT repo FROM project_list WHERE category = 'OSS4SG')")
def k10_delete_rows(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "project_list").where("category = 'OSS4SG'").select(F.col("repo").alias("project"))
    return read(spark, d, "name_email_pairs").join(F.broadcast(gone), "project", "left_anti").select("row_id", "project")


@query(r"""SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*#'))) AS comment_lines FROM documents WHERE text <> ''""")
def x14_comment_lines(spark: SparkSession, d: str) -> DataFrame:
    """All documents read as scripts in which '#' opens a comment line."""
    t = read(spark, d, "documents").where("text <> ''").select("doc_id", "text", F.lit("hash").alias("style"))
    return codemetrics.comment_lines(t, "doc_id", "text", "style").select("doc_id", "lines", "comment_lines")


ENDING = {"commitlog": "py", "docs": "tex", "adr": "asm"}


@query(r"""WITH f AS (SELECT project, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, strlen(text) AS size, CASE source WHEN 'commitlog' THEN '^\s*#' WHEN 'docs' THEN '^\s*%' WHEN 'adr' THEN '^\s*;' ELSE '^[^\s\S]' END AS mark FROM documents),
    l AS (SELECT project, mark, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i, len(string_split(t, chr(10))) AS k FROM f), m AS (SELECT project, length(x) + CASE WHEN i < k - 1 THEN 1 ELSE 0 END AS c, regexp_matches(x, mark) AS hit FROM l WHERE i < k - 1 OR x <> ''),
    g AS (SELECT project, count(*) AS lines, sum(c)::BIGINT AS chars, count(*) FILTER (hit) AS comment_lines, count(*) FILTER (NOT hit) AS non_comment_lines, coalesce(sum(c) FILTER (NOT hit), 0)::BIGINT AS code_chars, coalesce(sum(c) FILTER (hit), 0)::BIGINT AS comment_chars FROM m GROUP BY 1),
    z AS (SELECT project, sum(size) / (1024 * 1024) AS size_mb FROM f GROUP BY 1) SELECT project, lines, chars, comment_lines, non_comment_lines, code_chars, comment_chars, round(size_mb, 9) AS size_mb, round(CASE WHEN comment_lines > 0 THEN non_comment_lines / comment_lines WHEN non_comment_lines > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS code_to_comment_lines,
    round(CASE WHEN comment_chars > 0 THEN code_chars / comment_chars WHEN code_chars > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS code_to_comment_chars FROM g JOIN z USING (project)""")
def y01_repository_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their project, their endings by source."""
    ending = F.coalesce(F.create_map(*[F.lit(x) for pair in ENDING.items() for x in pair])[F.col("source")], F.lit("txt"))
    f = read(spark, d, "documents").select("project", F.concat(F.lit("f."), ending).alias("path"), "text")
    m = codemetrics.repository_metrics(codemetrics.file_metrics(f, "path", "text"), "project")
    return m.select("project", *codemetrics.METRICS, *[F.round(c, 9).alias(c) for c in ("size_mb", "code_to_comment_lines", "code_to_comment_chars")])


@query("SELECT project, min_by(source, rank) AS readme FROM (SELECT project, source, CASE source WHEN 'docs' THEN 1 WHEN 'wiki' THEN 2 WHEN 'adr' THEN 3 END AS rank FROM documents) WHERE rank IS NOT NULL GROUP BY project")
def y02_first_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The first of an ordered list of candidates that a project has."""
    rank = F.array_position(F.array(F.lit("docs"), F.lit("wiki"), F.lit("adr")), F.col("source"))
    return read(spark, d, "documents").withColumn("rank", rank).where("rank > 0").groupBy("project").agg(F.min_by("source", "rank").alias("readme"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    static = read(spark, d, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(events_folder(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))


def events_folder(spark: SparkSession, d: str) -> str:
    """The events table as a folder, as a stream needs it."""
    path = scratch_path(spark, "events")
    read(spark, d, "events").write.parquet(path)
    return path


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM events GROUP BY user_id")
def stream_first_last(spark: SparkSession, d: str) -> DataFrame:
    s = activity.first_last(event_stream(spark, d), "ts", "user_id")
    t = activity.run_to_table(s, scratch_path(spark, "sink"), "complete", scratch_path(spark, "stream"))
    return t.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "events")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS events FROM events GROUP BY 1")
def stream_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    s = activity.windowed_activity(event_stream(spark, d), "ts", "user_id", "1 day", "1 day", "1 day")
    t = activity.run_to_table(s, scratch_path(spark, "sink"), "complete", scratch_path(spark, "stream"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * o AS start, count(*) AS events, count(DISTINCT user_id) >= 1 AS some FROM events, (VALUES (0), (1)) t(o) GROUP BY 1")
def stream_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days that start every day, with approximate numbers of users (only whether there are any is compared)."""
    s = activity.windowed_activity(event_stream(spark, d), "ts", "user_id", "2 days", "1 day", "1 day")
    t = activity.run_to_table(s, scratch_path(spark, "sink"), "complete", scratch_path(spark, "stream"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "events", (F.col("users") >= 1).alias("some"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS events FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = activity.sessions(event_stream(spark, d), "ts", "user_id", "6 hours", "1 day")
    t = activity.run_to_table(s, scratch_path(spark, "sink"), "complete", scratch_path(spark, "stream"))
    return t.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("""WITH e AS (SELECT user_id, date_trunc('millisecond', ts) AS ts FROM events), g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, max(ts) AS last_ts, count(*) AS events FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS final FROM s) GROUP BY user_id, k, final HAVING k < final OR max(ts) + INTERVAL 2 DAY < (SELECT max(ts) - INTERVAL 1 DAY FROM e)""")
def stream_departures(spark: SparkSession, d: str) -> DataFrame:
    """Users idle for two days, over the events as they arrive week by week."""
    events, path = read(spark, d, "events"), scratch_path(spark, "weeks")
    week = F.date_trunc("week", "ts")
    first, last = events.agg(F.min(week), F.max(week)).first()
    while first is not None and first <= last:
        events.where(week == F.lit(first).cast(events.schema["ts"].dataType)).write.mode("append").parquet(path)
        first += timedelta(days=7)
    if first is None:
        events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    s = activity.departures(stream, "ts", "user_id", 2 * 86_400_000, "1 day")
    t = activity.run_to_table(s, scratch_path(spark, "sink"), "append", scratch_path(spark, "stream"))
    return t.select("user_id", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "events")


QUERIES, SQL = query.queries, query.sql
