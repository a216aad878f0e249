"""Session helpers: the shared folder, lineage cuts and a session for tests and benches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(cores: int | str = 8, app: str = "tributary", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session is given."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores) if isinstance(cores, int) else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only where that setting is absent and the master is local (tests, local runs) a folder under /tmp is used; on a cluster
    its absence is an error, since executors do not share their machines' folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file:///tmp/tributary-{spark.sparkContext.applicationId}"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
    return named


_rooted: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder, which is deleted when Python ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/tributary/{app}"
    if app not in _rooted:
        _rooted.add(app)
        atexit.register(clear, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one; nothing happens where the session has ended."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone
        pass


def materialise(df: DataFrame, label: str, **measures: Column) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: a lineage cut that
    survives lost executors. ``measures`` (aggregates) are taken in the same pass, into ``.measured``."""
    path = scratch_path(df.sparkSession, label)
    seen = Observation() if measures else None
    out = df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if measures else df
    out.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    out.measured = seen.get if seen else {}
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` once nothing reads it any more."""
    path = getattr(df, "_tributary_path", None)
    if path:
        clear(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "tributary.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work in Python on tables of few file splits.

    Tables with enough splits, as all large ones have, are left as they are and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
