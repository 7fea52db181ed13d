"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that every task may hold.
FEW = 1 << 20


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the command line; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see.

    Only in local mode, where that setting may be absent, is a folder made and set; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "quillon", f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """The small side of a join: at most `most` rows go to every task, so that the other side stays where it is. Counts df, a written table or cheap."""
    return F.broadcast(df) if df.count() <= most else df


def clear(spark: SparkSession) -> None:
    """Delete all tables that saved() has made in the shared folder. Results that still read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), "quillon"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
