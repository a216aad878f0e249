"""Writers: tables by partition, text with fixed precision, incremental runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSENT = "\\N"  #: stands for null in delimited files, so that an empty text stays one
DELIMITED = {"header": "true", "escape": '"', "emptyValue": '""', "nullValue": ABSENT, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Delimited files with a header; texts keep the blanks at their ends, and null is told from an empty text."""
    df.write.mode(mode).options(**DELIMITED).csv(path)


def write_named(df: DataFrame, path: str, folder: str, name: str, ending: str = "_pairs.csv") -> None:
    """A folder for each value of ``folder`` and in it one delimited file for each value of ``name``, named after it; for the projects of a study, few as they are."""
    spark = df.sparkSession
    df.repartition(folder, name).write.mode("overwrite").partitionBy(folder, name).options(**DELIMITED).csv(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for one in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}=*/{name}=*/part-*.csv")):
        parts = [x.partition("=")[2] for x in str(one.getPath().toString()).split("/")[-3:-1]]
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{parts[0]}/{parts[1]}{ending}")
        fs.mkdirs(target.getParent())
        fs.rename(one.getPath(), target)


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "append") -> None:
    """Parquet by partition; rows of a partition are brought together first, so small partitions give one file each."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_text(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as text with fixed digits, '' for null and NaN."""
    cols = [F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string(f"%.{digits}f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


def append_missing(new: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at ``path`` does not hold yet, so an interrupted run can be taken up again."""
    spark = new.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    new.write.mode("append").parquet(path)


def report(df: DataFrame, rows: int = 50) -> str:
    """A small table as lines of text between bars; ``rows`` is the most the report shows."""
    got = df.limit(rows).collect()
    lines = [" | ".join(df.columns)] + [" | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in got]
    return "\n".join(lines)
