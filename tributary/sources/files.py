"""Readers of delimited files, commit logs, reports and source lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.sources.sinks import ABSENT

DIFF_LIMIT = 100_000


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str, **options: str) -> DataFrame:
    """Delimited files with a header, quotes doubled or escaped, values over several lines; wrong values become null."""
    o = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE", "enforceSchema": "false", "nullValue": ABSENT, "emptyValue": ""} | options
    return spark.read.schema(schema).options(**o).csv(path)


def read_folder(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.csv", key: str = "project") -> DataFrame:
    """All matching files of a folder as one table; ``key`` is filled from the file's name where the column is blank or absent."""
    df = read_delimited(spark, path, schema, pathGlobFilter=glob, recursiveFileLookup="true")
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_pairs)?\.[^.]*$", 1)
    return df.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), stem) if key in df.columns else stem)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist; a project without its file is left out."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            out.append(path)
    return out


def read_folders(spark: SparkSession, paths: list[str], schema: StructType | str, glob: str = "*.csv", key: str = "project") -> DataFrame:
    """The folders of ``paths`` that exist, one below the other; wrong lines and values become nulls."""
    out = None
    for path in present(spark, paths):
        df = read_folder(spark, path, schema, glob, key)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


def read_sources(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text, size) of all files below a folder; bytes that are not UTF-8 are left out of the text, a mark of byte order too. Empty files have no row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [bytes(x).decode("utf-8", "ignore").removeprefix("\ufeff") for x in b["content"]], "size": b["length"]})

    return raw.select("path", "content", "length").mapInPandas(run, "path string, text string, size long")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: absent ones null, texts cast where they can be, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def parse_pipe_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(commit, author_name, author_email, date, message) of lines with five fields between bars; others are dropped."""
    p = F.split(value, r"\|", 5)
    names = ("commit", "author_name", "author_email", "date", "message")
    return lines.where(F.size(p) == 5).select(*[p[i].alias(n) for i, n in enumerate(names)])


def parse_framed_log(records: DataFrame, value: str = "value", merges: bool = True, empty: bool = True) -> DataFrame:
    """Commits of a log framed by record (1E) and unit (1F) separators, with added and deleted lines of each file.

    (commit, author_name, author_email, date, timezone, message, num_files, files_changed, total_additions, total_deletions,
    additions_by_file, deletions_by_file). ``-`` for binary files counts as 0. ``empty`` keeps commits without files, ``merges`` those whose sixth
    field names more than one parent.
    """
    lines = F.split(F.trim(F.regexp_replace(value, "\x1e", "")), "\n")
    u = F.split(lines[0], "\x1f")
    stat = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.split(x, "\t", 3)), lambda x: F.size(x) == 3)
    r = records.withColumn("__u", u).withColumn("__s", stat).where(F.size("__u") >= 5)
    if not merges:
        r = r.where(~F.contains(F.trim(F.coalesce(F.get("__u", F.lit(5)), F.lit(""))), F.lit(" ")))
    n = lambda i: F.aggregate("__s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[i].try_cast("long"), F.lit(0).cast("long")))
    per = lambda i: F.map_from_entries(F.array_distinct(F.transform("__s", lambda x: F.struct(x[2], F.coalesce(x[i].try_cast("long"), F.lit(0).cast("long"))))))
    out = r.select(
        F.trim(F.col("__u")[0]).alias("commit"), F.col("__u")[1].alias("author_name"), F.col("__u")[2].alias("author_email"), F.col("__u")[3].alias("date"),
        F.regexp_extract(F.col("__u")[3], r"([+-]\d{4})$", 1).alias("timezone"), F.col("__u")[4].alias("message"), F.size("__s").alias("num_files"),
        F.transform("__s", lambda x: x[2]).alias("files_changed"), n(0).alias("total_additions"), n(1).alias("total_deletions"), per(0).alias("additions_by_file"), per(1).alias("deletions_by_file"),
    )
    return out if empty else out.where("num_files > 0")


def cut_diff(text, limit: int = DIFF_LIMIT):
    """A text cut at ``limit`` characters, with a mark where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[truncated]"))).otherwise(text)


def problem_counts(reports: DataFrame, key: str, json: str, severities: list[str]) -> DataFrame:
    """(key, total, one column per severity) of JSON reports with a list ``listProblem`` of {severity, type}; unreadable reports count 0."""
    s = F.from_json(json, "listProblem array<struct<severity:string,type:string>>")["listProblem"]
    e = reports.select(key, F.explode_outer(s).alias("p"))
    g = e.groupBy(key).agg(F.count("p").alias("total"), *[F.count_if(F.upper("p.severity") == x).alias(x.lower()) for x in severities])
    return g


def metric_statistics(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Sum, mean, median, max, min and sample deviation of every metric per key; texts that are no numbers are missing."""
    kinds = ((F.sum, "sum"), (F.avg, "mean"), (F.median, "median"), (F.max, "max"), (F.min, "min"), (F.stddev_samp, "std"))
    return df.groupBy(key).agg(*[f(F.col(m).try_cast("double")).alias(f"{m}_{n}") for m in metrics for f, n in kinds])
