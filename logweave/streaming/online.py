"""Mining a stream: each micro-batch is matched against a versioned template table; what is left is mined into its next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.plans.miner import CLASSES, mined


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _version(spark: SparkSession, path: str, below: int) -> int | None:
    """The largest batch number less than `below` with a whole table under path."""
    if not _exists(spark, path):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(at)]
    numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return max((n for n in numbers if n < below and _exists(spark, f"{path}/batch={n}/_SUCCESS")), default=None)


def known_classes(spark: SparkSession, out: str, below: int = 1 << 62) -> DataFrame | None:
    """What the last batch before `below` knew of templates."""
    number = _version(spark, f"{out}/classes", below)
    return None if number is None else spark.read.schema(CLASSES).parquet(f"{out}/classes/batch={number}")


def mine_stream(lines: DataFrame, out: str, checkpoint: str, **options) -> DataStreamWriter:
    """lines(LineId, Content), streaming -> a writer. Below `out`: assigned, templates and classes, each batch=<n>.

    A line that a template of an earlier batch matches joins it; only the rest is mined. A batch
    that is run again overwrites its own folders and reads what was known before it, so results are written once.
    `options` go to the miner.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        found = mined(batch, classes=known_classes(batch.sparkSession, out, number), **options)
        found.assigned.withColumn("EventId", F.xxhash64("EventTemplate")).write.mode("overwrite").parquet(f"{out}/assigned/batch={number}")
        found.templates.withColumn("EventId", F.xxhash64("EventTemplate")).write.mode("overwrite").parquet(f"{out}/templates/batch={number}")
        found.classes.write.mode("overwrite").parquet(f"{out}/classes/batch={number}")  # last: a version is whole or absent

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def template_counts_stream(lines: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(ts, content), streaming -> counts of masked shapes by window; rows later than `late` are dropped by the watermark."""
    from logweave.functions.text import digits_masked, masked

    shaped = lines.withWatermark("ts", late).withColumn("template", digits_masked(masked("content")))
    return shaped.groupBy(F.window("ts", window), "template").count()


def current_templates(spark: SparkSession, out: str) -> DataFrame:
    """All templates found so far, with their occurrences over all batches."""
    if not _exists(spark, f"{out}/templates"):
        return spark.createDataFrame([], "EventId bigint, EventTemplate string, Occurrences bigint")
    return spark.read.parquet(f"{out}/templates").groupBy("EventId", "EventTemplate").agg(F.sum("Occurrences").alias("Occurrences"))
