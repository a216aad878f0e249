"""Scalar and array functions, author features and identity operators of the survey (X, R, D, F, G1-G5, M, A26, A27, A33, A34)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.hotjoin import join_hot
from tributary.functions.prefix import prefix_sum
from tributary.operators import blocks, components, similarity
from tributary.session import materialise, read
from tributary.sources.views import Registry, commits, pairs

query = Registry()
CM = "df_all_commits_with_stats"


@query(r"""SELECT row_id, string_split(n, ' ')[1] AS fn, string_split(n, ' ')[-1] AS ln, lower(split_part(trim(author_email), '@', 1)) AS un, regexp_extract_all(lower(author_name), '[a-z0-9_]+') AS tokens,
    regexp_replace(author_name, '<.*?>', '', 'g') AS untagged, author_name || '|' || author_email AS both_key, substring(author_name, 1, 12) AS cut, list_filter(list_transform(string_split(author_name, ';'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_item
    FROM (SELECT *, lower(trim(regexp_replace(author_name, '\s+', ' ', 'g'))) AS n FROM {P})""")
def x03_x04_x07_x08_x10_x15_name_parts(spark: SparkSession, d: str) -> DataFrame:
    p, part = pairs(spark, d), similarity.name_parts(F.col("author_name"))
    items = F.filter(F.transform(F.split("author_name", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return p.select(
        "row_id", part["fn"].alias("fn"), part["ln"].alias("ln"), similarity.local_part(F.col("author_email")).alias("un"), F.regexp_extract_all(F.lower("author_name"), F.lit("([a-z0-9_]+)"), F.lit(1)).alias("tokens"),
        F.regexp_replace("author_name", "<.*?>", "").alias("untagged"), F.concat("author_name", F.lit("|"), "author_email").alias("both_key"), F.substring("author_name", 1, 12).alias("cut"),
        F.try_element_at(items, F.lit(1)).alias("first_item"),
    )


@query(r"""SELECT row_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(author_name, '[^\p{L}\p{N}]+', ' ', 'g'), '([A-Z])', ' \1', 'g'), ' '), lambda x: lower(x)), lambda x: x <> '') AS words, regexp_replace(t, '^.* ', '') AS ln, regexp_replace(t, ' .*$', '') AS fn,
    n1, regexp_replace(n1, '^.*[ _+\-,.]', '') AS ln1, regexp_replace(n1, '[ _+\-,.].*$', '') AS fn1, regexp_replace(lower(trim(author_email, ' ')), '@.*$', '') AS un FROM (SELECT *, trim(author_name, ' ') AS t, regexp_replace(trim(author_name, ' '), '([a-z])([A-Z])', '\1 \2', 'g') AS n1 FROM {P})""")
def x05_x06_name_words(spark: SparkSession, d: str) -> DataFrame:
    p, m = pairs(spark, d), similarity.model_parts(F.col("author_name"), F.col("author_email"))
    return p.select("row_id", similarity.camel_words(F.col("author_name")).alias("words"), *[m[c].alias(c) for c in ("ln", "fn", "n1", "ln1", "fn1", "un")])


@query("SELECT project, list_sort(list(DISTINCT contributor)) AS people, array_to_string(list_sort(list(DISTINCT contributor)), '; ') AS people_text, len(list(DISTINCT contributor)) AS n FROM df_all_commits_with_stats WHERE contributor IS NOT NULL AND NOT contains(contributor, ';') GROUP BY project")
def x11_list_and_text(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as text without brackets, and the text read as a list again."""
    c = read(spark, d, CM).where("contributor IS NOT NULL AND NOT contains(contributor, ';')").select("project", "contributor").distinct()
    t = c.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("contributor")), "; ").alias("people_text"))
    return t.select("project", F.split("people_text", "; ").alias("people"), "people_text", F.size(F.split("people_text", "; ")).cast("long").alias("n"))


@query(r"""SELECT row_id, commit_date, coalesce(nullif(regexp_extract(trim(commit_date), '([+-]\d{4}|\w+)$', 1), ''), '?') AS zone, CASE WHEN regexp_matches(z, '^[+-]\d{4}$') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::INT + z[4:5]::INT / 60.0) END::DOUBLE AS hours, substring(commit_date, 1, 7) AS local_month
    FROM (SELECT *, regexp_extract(trim(commit_date), '([+-]\d{4})$', 1) AS z FROM df_all_commits_with_stats WHERE commit_date IS NOT NULL)""")
def x12_d02_zone_suffix(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where("commit_date IS NOT NULL")
    z = F.regexp_extract(F.trim("commit_date"), r"([+-]\d{4})$", 1)
    zone = F.coalesce(F.nullif(F.regexp_extract(F.trim("commit_date"), r"([+-]\d{4}|\w+)$", 1), F.lit("")), F.lit("?"))
    return c.select("row_id", "commit_date", zone.alias("zone"), similarity.zone_hours(z).alias("hours"), F.substring("commit_date", 1, 7).alias("local_month"))


@query(r"""SELECT project, count(*) AS items, count(DISTINCT k) AS keys FROM (SELECT project, unnest(list_filter(list_transform(string_split(emails, ';'), lambda x: lower(trim(x))), lambda x: x <> '')) AS k FROM contributors_all_projects) GROUP BY project""")
def x08_x09_explode_keys(spark: SparkSession, d: str) -> DataFrame:
    items = F.filter(F.transform(F.split("emails", ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return read(spark, d, "contributors_all_projects").select("project", F.explode(items).alias("k")).groupBy("project").agg(F.count("*").alias("items"), F.countDistinct("k").alias("keys"))


@query("SELECT row_id, concat_ws(' ', insertions::VARCHAR, deletions::VARCHAR, 'f') AS line, coalesce(insertions, 0) + coalesce(deletions, 0) AS changed, insertions IS NULL AS is_binary FROM df_all_commits_with_stats")
def x13_numstat_line(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", F.coalesce(F.col("insertions").cast("string"), F.lit("-")), F.coalesce(F.col("deletions").cast("string"), F.lit("-")), F.lit("f"))
    c = read(spark, d, CM).select("row_id", "insertions", "deletions", F.split(line, "\t", 3).alias("p"))
    add, rem = F.col("p")[0].try_cast("long"), F.col("p")[1].try_cast("long")
    return c.select("row_id", F.concat_ws(" ", F.col("insertions").cast("string"), F.col("deletions").cast("string"), F.col("p")[2]).alias("line"), (F.coalesce(add, F.lit(0)) + F.coalesce(rem, F.lit(0))).alias("changed"), add.isNull().alias("is_binary"))


def winkler_sql(a: str, b: str) -> str:
    """SQL of the similarity of two texts. DuckDB compares bytes, so the letters beyond ASCII are first numbered among themselves, which keeps equal letters equal."""
    odd = f"list_distinct(list_filter(string_split({a} || {b}, ''), lambda c: ord(c) > 127))"
    code = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN ord(c) > 127 THEN chr(list_position({odd}, c)::INT) ELSE c END), '')"
    prefix = "CASE " + " ".join(f"WHEN left({a}, {n}) <> left({b}, {n}) THEN {n - 1}" for n in range(1, 5)) + " ELSE 4 END"
    j = f"jaro_similarity({code(a)}, {code(b)})"
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {j} + 0.1 * ({prefix}) * (1 - {j}) END)"


@query(f"SELECT name_norm, un, round({winkler_sql('name_norm', 'un')}, 9) AS similarity FROM (SELECT DISTINCT name_norm, lower(split_part(trim(author_email), '@', 1)) AS un FROM {{P}})")
def x01_x02_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each row's name and local part, over distinct values."""
    p = pairs(spark, d).select("name_norm", similarity.local_part(F.col("author_email")).alias("un")).distinct()
    return similarity.winkler_columns(p, {"similarity": ("name_norm", "un")}).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT row_id, year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, weekofyear(ts)::BIGINT AS w, dayofyear(ts)::BIGINT AS doy, (isodow(ts) - 1)::BIGINT AS dow, monthname(ts) AS mn, quarter(ts)::BIGINT AS q, (date_trunc('month', ts) + INTERVAL 3 MONTH)::DATE AS plus3,
    (DATE '2023-01-01' + (7 * (weekofyear(ts) - 1))::INT)::DATE AS rep, ts + INTERVAL 7 YEAR AS plus7 FROM (SELECT o_orderkey AS row_id, o_orderdate AS ts FROM orders)""")
def d03_d05_d06_d07_calendar(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts"))
    long = lambda c: c.cast("long")
    return o.select(
        "row_id", long(F.year("ts")).alias("y"), long(F.month("ts")).alias("m"), long(F.weekofyear("ts")).alias("w"), long(F.dayofyear("ts")).alias("doy"), long(F.weekday("ts")).alias("dow"), F.date_format("ts", "MMMM").alias("mn"),
        long(F.quarter("ts")).alias("q"), F.add_months(F.trunc("ts", "month"), 3).alias("plus3"), F.date_add(F.lit("2023-01-01").cast("date"), (7 * (F.weekofyear("ts") - 1)).cast("int")).alias("rep"), (F.col("ts") + F.expr("INTERVAL 7 YEARS")).alias("plus7"),
    )


@query("""SELECT project, m, coalesce(n, 0) AS n FROM (SELECT project, unnest(generate_series(min(ts)::DATE - (day(min(ts)) - 1)::INT, max(ts)::DATE, INTERVAL 1 MONTH))::DATE AS m FROM {C} GROUP BY project) LEFT JOIN
    (SELECT project, date_trunc('month', ts)::DATE AS m, count(*) AS n FROM {C} GROUP BY 1, 2) USING (project, m)""")
def d04_dense_months(spark: SparkSession, d: str) -> DataFrame:
    c = commits(spark, d).groupBy("project", F.trunc("ts", "month").alias("m")).agg(F.count("*").alias("n"))
    axis = c.groupBy("project").agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return axis.join(c, ["project", "m"], "left").select("project", "m", F.coalesce("n", F.lit(0)).alias("n"))


ZONE_SQL = r"""WITH h AS (SELECT author_email, project, (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::INT + z[4:5]::INT / 60.0)::DOUBLE AS h FROM (SELECT author_email, project, regexp_extract(commit_date, '([+-][0-9]{4})$', 1) AS z FROM df_all_commits_with_stats WHERE regexp_matches(commit_date, '[+-][0-9]{4}$'))) """


def zoned(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where(r"commit_date RLIKE '[+-][0-9]{4}$'")
    return c.select("author_email", "project", similarity.zone_hours(F.regexp_extract("commit_date", r"([+-][0-9]{4})$", 1)).alias("h"))


@query(ZONE_SQL + """, a AS (SELECT author_email, list_sort(list(h)) AS z FROM h WHERE author_email IS NOT NULL GROUP BY 1), m AS (SELECT author_email, z[len(z) // 2 + 1] AS median FROM a), p AS (SELECT (list_sort(list(h)))[count(*) // 2 + 1] AS middle FROM h)
    SELECT author_email, median, greatest(0, 1 - least(abs(median - middle), 24) / 24) AS similarity FROM m, p""")
def d10_median_zone(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of an author's offsets and how like it is to that of all commits; offsets are few, so counts of them suffice."""
    n = zoned(spark, d).groupBy("author_email", "h").agg(F.count("*").alias("n"))
    upper = lambda df, *by: df.groupBy(*by).agg(F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -h)").alias("m"))
    by_author = n.where("author_email IS NOT NULL").groupBy("author_email").agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("x"), F.sum("n").alias("all"))
    at = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("m")), lambda a, e: F.struct((a["seen"] + e["n"]).alias("seen"), F.when(a["m"].isNull() & (a["seen"] + e["n"] > F.floor(F.col("all") / 2)), e["h"]).otherwise(a["m"]).alias("m")))
    middle = upper(zoned(spark, d)).select("m")
    return by_author.select("author_email", at["m"].alias("median")).withColumn("similarity", similarity.zone_similarity(F.col("median"), middle.scalar()))


@query(ZONE_SQL + """SELECT author_email, greatest(0, 1 - least(g, 24) / 24) AS plain, greatest(0, 1 - least(CASE WHEN g > 12 THEN 24 - g ELSE g END, 24) / 24) AS wrapped FROM (SELECT author_email, max(h) - min(h) AS g FROM h GROUP BY 1)""")
def d11_zone_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of the least and the greatest offset of each author, as they are and the other way round the clock."""
    g = zoned(spark, d).groupBy("author_email").agg(F.min("h").alias("a"), F.max("h").alias("z"))
    return g.select("author_email", similarity.zone_similarity(F.col("a"), F.col("z")).alias("plain"), similarity.zone_similarity(F.col("a"), F.col("z"), True).alias("wrapped"))


# ---- arrays


@query("""WITH f AS (SELECT o_custkey AS a, list(DISTINCT l_partkey ORDER BY l_partkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT x.a AS a, x.a + 1 AS b, round(len(list_intersect(x.files, y.files))::DOUBLE / len(list_distinct(x.files || y.files)), 6) AS jaccard FROM f x JOIN f y ON y.a = x.a + 1""")
def r01_file_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the part sets of each customer and the next one."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"))
    f = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("a").agg(F.collect_set("l_partkey").alias("files"))
    g = f.select((F.col("a") - 1).alias("a"), F.col("files").alias("other"))
    return f.join(g, "a").select("a", (F.col("a") + 1).alias("b"), F.round(similarity.jaccard(F.col("files"), F.col("other")), 6).alias("jaccard"))


@query(r"""WITH t AS (SELECT source, lang, tok, count(*) AS n FROM (SELECT source, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tok FROM documents WHERE source IS NOT NULL AND lang IN ('en', 'de')) GROUP BY 1, 2, 3),
    dot AS (SELECT a.source, sum(a.n * b.n)::DOUBLE AS dot FROM t a JOIN t b ON a.source = b.source AND a.tok = b.tok AND a.lang = 'en' AND b.lang = 'de' GROUP BY 1),
    norm AS (SELECT source, sqrt(sum(CASE WHEN lang = 'en' THEN n * n END)::DOUBLE) AS na, sqrt(sum(CASE WHEN lang = 'de' THEN n * n END)::DOUBLE) AS nb FROM t GROUP BY 1) SELECT source, round(coalesce(dot, 0) / (na * nb), 6) AS cosine FROM norm LEFT JOIN dot USING (source) WHERE na > 0 AND nb > 0""")
def r02_x07_bag_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the word counts of the English and German texts of each source: tokens meet in one aggregation, not in a join."""
    t = read(spark, d, "documents").where("source IS NOT NULL AND lang IN ('en', 'de')")
    t = t.select("source", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("tok"))
    n = t.groupBy("source", "tok").agg(F.count_if(F.col("lang") == "en").cast("double").alias("x"), F.count_if(F.col("lang") == "de").cast("double").alias("y"))
    g = n.groupBy("source").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sqrt(F.sum(F.col("x") ** 2)).alias("na"), F.sqrt(F.sum(F.col("y") ** 2)).alias("nb"))
    return g.where("na > 0 AND nb > 0").select("source", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


@query("SELECT event_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT user_id))[1:5], ';') AS first_users FROM events GROUP BY event_type")
def r03_array_join(spark: SparkSession, d: str) -> DataFrame:
    """The five smallest users of each type: all others are dropped before the shuffle."""
    u = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    few = u.withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))).where("i <= 5")
    few = few.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("user_id")).cast("array<string>"), ";").alias("first_users"))
    return u.groupBy("event_type").agg(F.sum("n").alias("n")).join(few, "event_type")


@query("SELECT label, i::BIGINT AS i, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def r08_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# ---- author profiles and pair features


@query("""SELECT project, contributor, author_email, count(*) AS n, count(DISTINCT message) AS messages, list_sort(list(DISTINCT category))::VARCHAR[] AS categories FROM (SELECT project, contributor, author_email, message, upper(category) AS category FROM df_all_commits_with_stats WHERE category IS NOT NULL) GROUP BY 1, 2, 3""")
def a33_author_profile(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, CM).where("category IS NOT NULL").withColumn("category", F.upper("category"))
    return c.groupBy("project", "contributor", "author_email").agg(F.count("*").alias("n"), F.countDistinct("message").alias("messages"), F.array_sort(F.collect_set("category")).alias("categories"))


@query(r"""WITH n AS (SELECT DISTINCT lower(trim(regexp_replace(author_name, '\s+', ' ', 'g'))) AS n FROM {P}) SELECT tok, sum(f)::BIGINT AS as_first, sum(l)::BIGINT AS as_last FROM
    (SELECT string_split(n, ' ')[1] AS tok, 1 AS f, 0 AS l FROM n UNION ALL SELECT string_split(n, ' ')[-1], 0, 1 FROM n) GROUP BY tok""")
def a34_token_frequency(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.name_parts(F.col("author_name"))
    n = pairs(spark, d).select(p["n"].alias("n"), p["fn"].alias("fn"), p["ln"].alias("ln")).distinct()
    t = n.select(F.explode(F.array(F.struct(F.col("fn").alias("tok"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("ln").alias("tok"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x"))
    return t.groupBy("x.tok").agg(F.sum("x.f").alias("as_first"), F.sum("x.l").alias("as_last"))


def authors(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where("author_name <> '' AND author_email <> ''")
    return p.groupBy("project", "author_name", "author_email").agg(F.min("row_id").alias("k"))


@query(r"""WITH a AS (SELECT project, author_name, author_email, min(row_id) AS k FROM {P} WHERE author_name <> '' AND author_email <> '' GROUP BY 1, 2, 3), s AS (SELECT project FROM a GROUP BY 1 HAVING count(*) <= 500),
    b AS (SELECT project, k, unnest(list_distinct([string_split(n, ' ')[1], string_split(n, ' ')[-1], split_part(lower(trim(author_email)), '@', 1)])) AS t FROM (SELECT *, lower(trim(regexp_replace(author_name, '\s+', ' ', 'g'))) AS n FROM a) WHERE project IN (FROM s))
    SELECT DISTINCT x.project, x.k AS k1, y.k AS k2 FROM b x JOIN b y ON x.project = y.project AND x.t = y.t AND x.k < y.k WHERE x.t <> ''""")
def j10_f11_author_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Author pairs of a project that share a name token or local part, under the reference's guard (F11) of 500 authors, as its SQL states."""
    return similarity.blocked_author_pairs(authors(spark, d), "project", "k", "author_name", "author_email", most=500).select("project", "k1", "k2")


AUTHORS_SQL = r"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, lower(trim(regexp_replace(author_name, '\s+', ' ', 'g'))) AS nn, lower(trim(author_email)) AS ee FROM (SELECT project, author_name, author_email, min(row_id) AS k FROM {P} WHERE author_name <> '' AND author_email <> '' GROUP BY 1, 2, 3)),
    ap AS MATERIALIZED (SELECT *, string_split(nn, ' ')[1] AS fn, string_split(nn, ' ')[-1] AS ln, split_part(ee, '@', 1) AS un FROM a) """
PAIRED_SQL = AUTHORS_SQL + """, b AS (SELECT project, k, unnest(list_distinct([fn, ln, un])) AS t FROM ap), pr AS MATERIALIZED (SELECT DISTINCT x.project, x.k AS k1, y.k AS k2 FROM b x JOIN b y ON x.project = y.project AND x.t = y.t AND x.k < y.k WHERE x.t <> '') """
WORDS_SQL = r"array_to_string(list_filter(string_split(regexp_replace({X}, '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ')"
FEATURES_SQL = PAIRED_SQL + ", w AS MATERIALIZED (SELECT *, " + WORDS_SQL.replace("{X}", "fn") + " AS fw, " + WORDS_SQL.replace("{X}", "ln") + " AS lw FROM ap), f AS MATERIALIZED (SELECT pr.project, k1, k2, x.nn AS n1, x.fn AS f1, x.ln AS l1, x.un AS u1, x.ee AS e1, x.fw AS fw1, x.lw AS lw1, y.nn AS n2, y.fn AS f2, y.ln AS l2, y.un AS u2, y.ee AS e2, y.fw AS fw2, y.lw AS lw2 FROM pr JOIN w x ON x.k = k1 JOIN w y ON y.k = k2) "
COSINE_SQL = r""", ms AS (SELECT w.k, unnest(regexp_extract_all(lower(message), '[a-z0-9_]+')) AS tok FROM df_all_commits_with_stats c JOIN ap w ON c.project = w.project AND trim(c.author_name) = trim(w.author_name) AND trim(c.author_email) = trim(w.author_email)),
    bw AS MATERIALIZED (SELECT k, tok, count(*)::DOUBLE AS n FROM ms GROUP BY 1, 2), nr AS (SELECT k, sqrt(sum(n * n)) AS norm FROM bw GROUP BY 1) """


@query(PAIRED_SQL + "SELECT * FROM pr")
def j10_author_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs in projects of any size."""
    return similarity.blocked_author_pairs(authors(spark, d), "project", "k", "author_name", "author_email").select("project", "k1", "k2")


@query(PAIRED_SQL + "SELECT * FROM pr ORDER BY project, k1, k2 LIMIT 1000")
def o06_capped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The reference's cap on pairs: the first thousand in order, an option that is asked for."""
    return j10_author_pairs(spark, d).orderBy("project", "k1", "k2").limit(1000)


def all_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = authors(spark, d)
    return a, similarity.blocked_author_pairs(a, "project", "k", "author_name", "author_email")


COMPARED = (("n1", "n2"), ("e1", "e2"), ("l1", "l2"), ("f1", "f2"), ("u1", "u2"), ("f1", "l2"), ("l1", "f2"), ("lw1", "lw2"), ("fw1", "fw2"))
SCORED_SQL = FEATURES_SQL + ", g AS MATERIALIZED (SELECT project, k1, k2, " + ", ".join(f"{winkler_sql(a, b)} AS {c}" for (a, b), c in zip(COMPARED, ("n", "e", "ln", "fn", "un", "x1", "x2", "ln1", "fn1"))) + " FROM f) "


@query(SCORED_SQL + "SELECT project, k1, k2, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("n", "e", "ln", "fn", "un", "ln1", "fn1")) + ", round(greatest(x1, x2), 6) AS ifn FROM g")
def f01_f08_pair_features(spark: SparkSession, d: str) -> DataFrame:
    return blocks.pair_features(authors(spark, d), "project", "k", "author_name", "author_email", digits=6)


@query(FEATURES_SQL + ", nm AS (SELECT DISTINCT nn, fn, ln FROM ap) SELECT project, k1, k2, round(1.0 / (SELECT count(*) FROM nm WHERE nm.ln = l1), 9) AS ln1f, round(1.0 / (SELECT count(*) FROM nm WHERE nm.fn = f1), 9) AS fnf FROM f")
def f09_pair_rarity(spark: SparkSession, d: str) -> DataFrame:
    """How rare the last and the first name of the pair's first author are."""
    a, p = all_features(spark, d)
    r = similarity.rarity_features(p, a, "author_name")
    return r.select("project", "k1", "k2", F.round("ln1f", 9).alias("ln1f"), F.round("fnf", 9).alias("fnf"))


@query(FEATURES_SQL + COSINE_SQL + ", dt AS (SELECT k1, k2, sum(x.n * y.n) AS dot FROM pr JOIN bw x ON x.k = k1 JOIN bw y ON y.k = k2 AND y.tok = x.tok GROUP BY 1, 2) SELECT pr.project, pr.k1, pr.k2, round(coalesce(dot / (a.norm * b.norm), 0), 6) AS d2vsim FROM pr LEFT JOIN dt USING (k1, k2) LEFT JOIN nr a ON a.k = k1 LEFT JOIN nr b ON b.k = k2")
def f10_message_similarity(spark: SparkSession, d: str) -> DataFrame:
    a = authors(spark, d)
    return blocks.message_similarity(a, message_profiles(a, read(spark, d, CM)), "project", "k", "author_name", "author_email", digits=6)


def score(features: DataFrame) -> DataFrame:
    """Default scorer: (k1, k2, p) from a logistic weighting of the name features. Any function of this form, such as a trained model's, can take its place."""
    z = 6 * F.col("n") + 4 * F.col("un") + 3 * F.col("ifn") + 2 * F.col("e") - 10.5
    return features.select("k1", "k2", (1 / (1 + F.exp(-z))).alias("p"))


def merge_by_score(authors: DataFrame, scorer=score, least: float = 0.5) -> DataFrame:
    """Per project its authors, what they merge to where ``scorer`` gives a pair more than ``least``, and the reduction. Pairs are compared once and leave as stars."""
    linked = scorer(blocks.pair_features(authors, "project", "k", "author_name", "author_email")).where(F.col("p") > least)
    return merged_counts(authors, materialise(components.thinned(linked, "k1", "k2"), "linked"))


COMPONENTS_SQL = ", ed AS (SELECT k1 AS a, k2 AS b FROM lk UNION SELECT k2, k1 FROM lk), rc(v, c) AS (SELECT a, a FROM ed UNION SELECT ed.b, rc.c FROM rc JOIN ed ON ed.a = rc.v), cc AS MATERIALIZED (SELECT v, min(c) AS c FROM rc GROUP BY v) "
REDUCED_SQL = "SELECT project, count(*) AS distinct_pairs, count(DISTINCT coalesce(c, k)) AS merged, count(*) - count(DISTINCT coalesce(c, k)) AS reduction, false AS skipped FROM ap LEFT JOIN cc ON cc.v = ap.k GROUP BY project"


@query(SCORED_SQL + ", lk AS MATERIALIZED (SELECT k1, k2 FROM g WHERE 1 / (1 + exp(-(6 * n + 4 * un + 3 * greatest(x1, x2) + 2 * e - 10.5))) > 0.5)" + COMPONENTS_SQL + REDUCED_SQL)
def g04_merge_by_score(spark: SparkSession, d: str) -> DataFrame:
    return merge_by_score(authors(spark, d))


def merged_counts(authors: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Per project its authors, what they merge to over ``edges`` (k1, k2) and the reduction; both null where the guard ``most`` skips the project."""
    cc = components.connected_components(edges, "k1", "k2")
    merged = authors.join(cc, authors.k == cc.vertex, "left").groupBy("project").agg(F.countDistinct(F.coalesce("component", "k")).alias("m"))
    g = similarity.sized_projects(authors, "project", most).join(merged, "project").withColumn("merged", F.when(~F.col("skipped"), F.col("m")))
    return g.select("project", "distinct_pairs", "merged", (F.col("distinct_pairs") - F.col("merged")).alias("reduction"), "skipped")


def message_profiles(authors: DataFrame, commits: DataFrame) -> DataFrame:
    """(k, words, counts): the word counts of the messages of every author of a project."""
    a = authors.select("k", "project", F.trim("author_name").alias("name"), F.trim("author_email").alias("mail"))
    c = commits.select("project", F.trim("author_name").alias("name"), F.trim("author_email").alias("mail"), "message").join(a, ["project", "name", "mail"])
    return similarity.word_counts(c, "k", "message")


def merge_edges(authors: DataFrame, commits: DataFrame) -> DataFrame:
    """(k1, k2) of the authors of a project with d2vSim > 0.8 and n > 0.5 (G5); d2vSim is the cosine of the word counts of their messages."""
    p = message_profiles(authors, commits).join(authors.select("k", "project"), "k")
    names = authors.select("k", similarity.name_parts(F.col("author_name"))["n"].alias("nn"))
    like = similarity.like_profiles(p, "project", "k", 0.8)
    for i in ("1", "2"):
        like = like.join(names.select(F.col("k").alias(f"k{i}"), F.col("nn").alias(f"nn{i}")), f"k{i}")
    return similarity.winkler_columns(like, {"n": ("nn1", "nn2")}).where("n > 0.5").select("k1", "k2")


def multi_email_groups(authors: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, first_row, names, emails, num_emails) of the groups over ``edges`` that hold more than one address with '@'."""
    cc = components.connected_components(edges, "k1", "k2")
    g = authors.join(cc, authors.k == cc.vertex).groupBy("project", F.col("component").alias("first_row"))
    mail = F.when(F.contains("author_email", F.lit("@")), F.trim("author_email"))
    g = g.agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.when(F.trim("author_name") != "", F.col("author_name"))))).alias("names"), F.array_sort(F.collect_set(mail)).alias("emails"))
    return g.withColumn("num_emails", F.size("emails")).where("num_emails > 1")


PROXY_SQL = AUTHORS_SQL + COSINE_SQL + """, sm AS MATERIALIZED (SELECT p.k AS k1, q.k AS k2, p.nn AS n1, q.nn AS n2, sum(x.n * y.n) / (max(a.norm) * max(b.norm)) AS sim FROM ap p JOIN ap q ON p.project = q.project AND p.k < q.k JOIN bw x ON x.k = p.k JOIN bw y ON y.k = q.k AND y.tok = x.tok
    JOIN nr a ON a.k = p.k JOIN nr b ON b.k = q.k GROUP BY 1, 2, 3, 4 HAVING sim > 0.8), lk AS MATERIALIZED (SELECT k1, k2 FROM sm WHERE """ + winkler_sql("n1", "n2") + " > 0.5)" + COMPONENTS_SQL
LISTED_SQL = "SELECT project, c AS first_row, string_agg(DISTINCT CASE WHEN trim(author_name) <> '' THEN author_name END, '; ' ORDER BY CASE WHEN trim(author_name) <> '' THEN author_name END) AS names, list_sort(list(DISTINCT CASE WHEN contains(author_email, '@') THEN trim(author_email) END) FILTER (contains(author_email, '@'))) AS emails FROM ap JOIN cc ON cc.v = ap.k GROUP BY project, c"


@query(PROXY_SQL + REDUCED_SQL)
def g05_f12_threshold_merge(spark: SparkSession, d: str) -> DataFrame:
    """Authors merged by the reference's threshold proxy."""
    a = authors(spark, d)
    return merged_counts(a, merge_edges(a, read(spark, d, CM)))


@query(PROXY_SQL + f"SELECT *, len(emails)::INT AS num_emails FROM ({LISTED_SQL}) WHERE len(emails) > 1")
def g05_multi_email_groups(spark: SparkSession, d: str) -> DataFrame:
    a = authors(spark, d)
    return multi_email_groups(a, merge_edges(a, read(spark, d, CM)))


@query(PROXY_SQL + f"SELECT row_number() OVER (ORDER BY len(emails) DESC, project, first_row) AS rank, *, len(emails)::INT AS num_emails FROM ({LISTED_SQL}) WHERE len(emails) > 2")
def g05b_groups_of_many_emails(spark: SparkSession, d: str) -> DataFrame:
    """Groups with more than two addresses, those with most first; the ranks come from a range sort."""
    g = g05_multi_email_groups(spark, d).where("num_emails > 2").withColumns({"down": -F.col("num_emails"), "one": F.lit(1), "all": F.lit(0)})
    return prefix_sum(g, ["all"], ["down", "project", "first_row"], "one", "rank").drop("down", "one", "all")


# ---- identity


@query("SELECT project, count(DISTINCT nullif(email_norm, '')) + count(*) FILTER (email_norm = '') AS email_baseline, count(*) AS n FROM {P} GROUP BY project")
def a26_email_baseline_count(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy("project").agg((F.countDistinct(F.nullif("email_norm", F.lit(""))) + F.count_if(F.col("email_norm") == "")).alias("email_baseline"), F.count("*").alias("n"))


@query("""SELECT project, category, count(*) AS n, string_agg(DISTINCT author_name, '; ' ORDER BY author_name) AS names, count(DISTINCT nullif(author_email, '')) AS num_emails, min(row_id) AS first_row
    FROM (SELECT *, CASE WHEN email_norm <> '' THEN email_norm ELSE row_id::VARCHAR END AS k FROM {P}) GROUP BY project, category, k""")
def a27_email_baseline_groups(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    k = F.when(F.col("email_norm") != "", F.col("email_norm")).otherwise(F.col("row_id").cast("string"))
    return p.groupBy("project", "category", k.alias("k")).agg(
        F.count("*").alias("n"), F.concat_ws("; ", F.array_sort(F.collect_set("author_name"))).alias("names"), F.countDistinct(F.nullif("author_email", F.lit(""))).alias("num_emails"), F.min("row_id").alias("first_row")
    ).drop("k")


def merged_people(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, project, category, author_name, author_email, group): rows merged by address and by names their address spells out.

    Within a project, rows with one normalised address are together; addresses whose local part contains every token of
    an eligible name are together with that name. Rows without an address stay alone.
    """
    p = materialise(pairs(spark, d), "pairs")
    tokens = F.filter(F.split("name_norm", r"\s+"), lambda t: t != "")
    local = F.substring_index("email_norm", "@", 1)
    fits = (F.size(tokens) >= 2) & ~F.contains("name_norm", F.lit("_")) & (F.col("email_norm") != "") & F.forall(tokens, lambda t: F.contains(local, t))
    mail = p.where("email_norm <> ''").select("row_id", F.concat_ws("\u0001", "project", F.lit("e"), "email_norm").alias("k"))
    name = p.where(fits).select("row_id", F.concat_ws("\u0001", "project", F.lit("n"), "name_norm").alias("k"))
    cc = components.groups_of_shared_values(mail.unionByName(name), "k", "row_id")
    return p.join(cc, p.row_id == cc.vertex, "left").withColumn("group", F.coalesce("component", "row_id")).drop("vertex", "component")


MERGED_SQL = r"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, list_filter(string_split_regex(name_norm, '\s+'), lambda t: t <> '') AS tk FROM {P}),
    k AS MATERIALIZED (SELECT row_id, project || chr(1) || 'e' || email_norm AS k FROM p WHERE email_norm <> '' UNION ALL SELECT row_id, project || chr(1) || 'n' || name_norm FROM p WHERE email_norm <> '' AND len(tk) >= 2 AND NOT contains(name_norm, '_')
      AND len(list_filter(tk, lambda t: NOT contains(split_part(email_norm, '@', 1), t))) = 0),
    e AS MATERIALIZED (SELECT DISTINCT k.row_id AS a, m.b FROM k JOIN (SELECT k, min(row_id) AS b FROM k GROUP BY k) m USING (k)),
    s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(v, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.v),
    g AS (SELECT p.*, coalesce(c, row_id) AS grp FROM p LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) x ON x.v = p.row_id) """


@query(MERGED_SQL + """SELECT project, grp AS first_row, count(*) AS num_pairs, count(DISTINCT nullif(author_email, '')) AS num_emails, string_agg(DISTINCT author_name, '; ' ORDER BY author_name) AS names FROM g GROUP BY project, grp""")
def g01_g02_msn_groups(spark: SparkSession, d: str) -> DataFrame:
    m = merged_people(spark, d)
    return m.groupBy("project", F.col("group").alias("first_row")).agg(
        F.count("*").alias("num_pairs"), F.countDistinct(F.nullif("author_email", F.lit(""))).alias("num_emails"), F.concat_ws("; ", F.array_sort(F.collect_set("author_name"))).alias("names")
    )


@query(MERGED_SQL + """SELECT project, count(*) AS n, count(DISTINCT nullif(email_norm, '')) + count(*) FILTER (email_norm = '') AS email_baseline, count(DISTINCT grp) AS msn,
    (SELECT count(*) FROM (SELECT grp FROM g y WHERE y.project = g.project AND email_norm <> '' GROUP BY grp HAVING count(DISTINCT email_norm) > 1)) AS multi_email_groups FROM g GROUP BY project""")
def g03_m05_identity_summary(spark: SparkSession, d: str) -> DataFrame:
    m = merged_people(spark, d)
    per = m.groupBy("project", "group").agg(F.count("*").alias("n"), F.countDistinct(F.nullif("email_norm", F.lit(""))).alias("mails"), F.count_if(F.col("email_norm") == "").alias("blank"))
    # an address lies in one group of a project, so the groups' counts add up
    return per.groupBy("project").agg(F.sum("n").alias("n"), F.sum(F.col("mails") + F.col("blank")).alias("email_baseline"), F.count("*").alias("msn"), F.count_if(F.col("mails") > 1).alias("multi_email_groups"))


@query(MERGED_SQL + """SELECT row_id, min(CASE WHEN author_name <> '' THEN author_name END) OVER (PARTITION BY grp) AS canonical FROM g""")
def m01_canonical_rewrite(spark: SparkSession, d: str) -> DataFrame:
    m = materialise(merged_people(spark, d), "merged")
    canon = m.groupBy("group").agg(F.min(F.nullif("author_name", F.lit(""))).alias("canonical"), F.count("*").alias("size"))
    return join_hot(m.select("row_id", "group"), canon, "group", "size", m.count()).select("row_id", "canonical")


def overlap(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, keys in two or more projects, keys in both categories, with shares in percent (M2)."""
    k = df.where(F.col(key) != "").groupBy(key).agg(F.countDistinct("project").alias("p"), F.countDistinct("category").alias("c"))
    return k.agg(F.count("*").alias("keys"), F.count_if(F.col("p") >= 2).alias("intra"), F.count_if(F.col("c") >= 2).alias("inter"))


@query(" UNION ALL ".join(f"SELECT '{b}' AS basis, count(*) AS keys, count(*) FILTER (p >= 2) AS intra, count(*) FILTER (c >= 2) AS inter, round(100.0 * count(*) FILTER (p >= 2) / count(*), 2) AS intra_pct FROM (SELECT count(DISTINCT project) AS p, count(DISTINCT category) AS c FROM {{P}} WHERE {k} <> '' GROUP BY {k})" for b, k in (("raw", "author_email"), ("lower", "email_norm"), ("name", "author_name"))))
def m02_m03_overlap_by_key(spark: SparkSession, d: str) -> DataFrame:
    p, out = pairs(spark, d), None
    for basis, key in (("raw", "author_email"), ("lower", "email_norm"), ("name", "author_name")):
        o = overlap(p, key).select(F.lit(basis).alias("basis"), "keys", "intra", "inter", F.round(100.0 * F.col("intra") / F.nullif("keys", F.lit(0)), 2).alias("intra_pct"))
        out = o if out is None else out.unionByName(o)
    return out


@query(r"""SELECT count(*) AS keys, count(*) FILTER (c >= 2) AS inter, count(*) FILTER (p >= 2) AS intra FROM (SELECT k, count(DISTINCT project) AS p, count(DISTINCT category) AS c FROM
    (SELECT project, upper(category) AS category, unnest(list_filter(list_transform(string_split(emails, ';'), lambda x: lower(trim(x))), lambda x: x <> '')) AS k FROM contributors_all_projects) GROUP BY k)""")
def m04_overlap_exploded(spark: SparkSession, d: str) -> DataFrame:
    items = F.filter(F.transform(F.split("emails", ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    g = read(spark, d, "contributors_all_projects").select("project", F.upper("category").alias("category"), F.explode(items).alias("k"))
    return overlap(g, "k").select("keys", "inter", "intra")


@query("""SELECT record_id, item, e.first_record FROM (SELECT record_id, project, unnest(list_distinct(list_filter(list_transform(string_split(emails, ';'), lambda x: lower(trim(x))), lambda x: x <> ''))) AS item FROM contributors_all_projects WHERE num_emails > 1) m
    JOIN (SELECT lower(trim(emails)) AS k, min(record_id) AS first_record FROM contributors_email_baseline_all_projects WHERE emails <> '' GROUP BY 1) e ON e.k = m.item""")
def j15_m05_back_to_email_rows(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_distinct(F.filter(F.transform(F.split("emails", ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    m = read(spark, d, "contributors_all_projects").where("num_emails > 1").select("record_id", F.explode(items).alias("item"))
    e = read(spark, d, "contributors_email_baseline_all_projects").where("emails <> ''").groupBy(F.lower(F.trim("emails")).alias("item")).agg(F.min("record_id").alias("first_record"))
    return m.join(e, "item").select("record_id", "item", "first_record")


@query(r"""SELECT project, abs(a - b) AS gap, abs(a - b) BETWEEN 5 AND 15 AS near FROM (SELECT project, count(DISTINCT author_email) AS a, count(DISTINCT author_name) AS b FROM {P} GROUP BY project)""")
def m06_method_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = pairs(spark, d).groupBy("project").agg(F.countDistinct("author_email").alias("a"), F.countDistinct("author_name").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return g.select("project", gap.alias("gap"), gap.between(5, 15).alias("near"))


QUERIES, SQL = query.queries, query.sql
