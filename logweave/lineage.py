"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own below spark.checkpoint.dir, removed when the driver ends."""
    context = spark.sparkContext
    if not getattr(context, "_logweave_folder", None):
        above = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        own = not above  # as in tests on one machine
        if own and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        above = above or tempfile.mkdtemp(prefix="logweave-checkpoints-")
        folder = f"{above.rstrip('/')}/logweave-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path.getParent() if own else path)
        context._logweave_folder = folder
    return context._logweave_folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder as a table and read it back, so
    that neither a lost executor nor a second use recomputes what stands above it."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logweave_path = path
    return out


def renamed(table: DataFrame, **columns: str) -> DataFrame:
    """Columns of a table that cut() wrote, under other names; forget() still knows it."""
    out = table.select(*(table[old].alias(new) for old, new in columns.items()))
    out._logweave_path = table._logweave_path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more; other frames are left as they are."""
    for df in tables:
        if path := getattr(df, "_logweave_path", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage: its heap shrinks to what lives, and Spark's cleaner drops shuffles and
    broadcasts that nothing refers to any more. Loops of many jobs call it once a turn."""
    spark.sparkContext._jvm.System.gc()
