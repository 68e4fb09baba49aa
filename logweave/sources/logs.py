"""Scans and sinks of logs, truth tables, answer caches and results; every schema is explicit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.lineage import cut
from logweave.sources.formats import CATALOGUE, LineFormat, for_dataset

TRUTH = "LineId BIGINT, Content STRING, EventId STRING, EventTemplate STRING"
TEMPLATES = "EventId STRING, EventTemplate STRING"


def stripped(column: str):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def parse_lines(lines: DataFrame, fmt: LineFormat, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Header fields of the lines that match; the others are dropped. An optional field that is absent is null."""
    rows = lines.select(*keep, stripped(value).alias("_line")).where(F.col("_line").rlike(fmt.pattern))
    fields = [F.regexp_extract("_line", fmt.pattern, k).alias(h) for k, h in enumerate(fmt.headers, 1)]
    fields = [F.nullif(x, F.lit("")).alias(h) if h in fmt.optional else x for x, h in zip(fields, fmt.headers, strict=True)]
    return rows.select(*keep, *fields)


def rejected_lines(lines: DataFrame, fmt: LineFormat, value: str = "value") -> DataFrame:
    return lines.where(~stripped(value).rlike(fmt.pattern))


def with_line_ids(rows: DataFrame) -> DataFrame:
    """LineId 1..n in the order of partitions and rows. The rows are written once with their places, so that
    counts and rows are of one run; one count a partition is joined back."""
    placed = cut(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # one row a partition
    number = F.col("before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_part").select(number.alias("LineId"), *rows.columns)


def read_logs(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """A data set of the catalogue: LineId over matching lines, then its fields."""
    return with_line_ids(parse_lines(spark.read.text(f"{folder}/{CATALOGUE[dataset][0]}"), for_dataset(dataset)))


def read_truth(spark: SparkSession, path: str, schema: str = TRUTH) -> DataFrame:
    """A truth or result table, line-wise: quotes that don't balance can't swallow lines."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_named(spark: SparkSession, path: str, schema: str = TRUTH) -> DataFrame:
    """The columns of `schema`, by name, of a structured log or table, whatever further columns it has; contents may hold line breaks in quotes."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    kinds = [x.rsplit(" ", 1) for x in schema.split(", ")]
    return rows.select(*(F.col(f"`{name}`").cast(kind.lower()).alias(name) for name, kind in kinds))


def read_answers(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """An answer cache, a JSON object of strings nested `depth` levels, as rows (key1, ..., answer). A missing file has no rows."""
    keys = [f"key{k}" for k in range(1, depth + 1)]
    schema = ", ".join(f"{k} string" for k in [*keys, "answer"])
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    kind = "string"
    for _ in range(depth):
        kind = f"map<string,{kind}>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    for key in keys:
        rows = rows.select(*keys[: keys.index(key)], F.explode("v").alias(key, "v"))
    return rows.select(*keys, F.col("v").alias("answer"))


def write_answers(answers: DataFrame, path: str) -> None:
    """The JSON object that read_answers reads, of rows (key1, ..., answer); the last of several answers by text wins.
    A cache is one object in one file, and holds what was asked, which is little beside the log."""
    keys = [c for c in answers.columns if c != "answer"]
    nested: dict = {}
    for row in answers.where("answer is not null").orderBy(*keys, "answer").toLocalIterator():
        at = nested
        for k in keys[:-1]:
            at = at.setdefault(row[k], {})
        at[row[keys[-1]]] = row["answer"]
    spark = answers.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(nested, ensure_ascii=False, indent=1).encode()))
    out.close()


def write_structured(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_templates(assigned: DataFrame, path: str) -> None:
    """EventId, EventTemplate, Occurrences."""
    write_structured(assigned.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences")), path)
