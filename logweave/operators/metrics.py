"""Scores of a parse against the truth: one row a line (LineId, EventId, EventTemplate) on either side.

All are group-bys and joins over pairs of event ids; lines are joined by LineId, never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.equivalence import listed, normalised
from logweave.sources import logs


def joined(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """(LineId, g, gt, p, pt) for lines whose truth has an event."""
    t = truth.where("EventId is not null").select("LineId", F.col("EventId").cast("string").alias("g"), F.col("EventTemplate").alias("gt"))
    return t.join(parsed.select("LineId", F.col("EventId").cast("string").alias("p"), F.col("EventTemplate").alias("pt")), "LineId")


def pair_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("p", "g").agg(F.count("*").alias("n"))


def correct_groups(lines: DataFrame) -> DataFrame:
    """(p, g, n) for parsed groups that are one truth group, whole."""
    pairs = pair_counts(lines)
    of_p = pairs.groupBy("p").agg(F.count("*").alias("kinds"), F.sum("n").alias("in_p"))
    of_g = pairs.groupBy("g").agg(F.sum("n").alias("in_g"))
    return pairs.join(of_p, "p").join(of_g, "g").where("kinds = 1 and in_p = in_g").select("p", "g", "n")


def group_accuracy(lines: DataFrame) -> DataFrame:
    """correct, lines, ga."""
    total = lines.agg(F.count("*").alias("lines"))
    right = correct_groups(lines).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("correct"))
    return right.join(F.broadcast(total)).select("correct", "lines", (F.col("correct") / F.nullif("lines", F.lit(0))).alias("ga"))


def pair_f1(lines: DataFrame) -> DataFrame:
    """Pairs of lines in one truth group, in one parsed group, in both; precision, recall, f1."""
    pairs = pair_counts(lines)
    two = lambda n: F.sum(n * (n - 1) / 2).cast("bigint")
    both = pairs.agg(two(F.col("n")).alias("agreeing"))
    of = lambda k: pairs.groupBy(k).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(f"pairs_{k}"))
    out = both.join(F.broadcast(of("p"))).join(F.broadcast(of("g")))  # three single rows
    precision, recall = F.col("agreeing") / F.nullif("pairs_p", F.lit(0)), F.col("agreeing") / F.nullif("pairs_g", F.lit(0))
    return out.select("agreeing", "pairs_p", "pairs_g", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0))).alias("f1"))


def last_template(rows: DataFrame, event: str = "EventId") -> DataFrame:
    """(event, template): that of the event's last line."""
    return rows.where(F.col(event).isNotNull()).groupBy(F.col(event).cast("string").alias("event")).agg(F.max_by("EventTemplate", "LineId").alias("template"))


def correct_templates(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """Correct groups whose templates count as equal: (p, g, n)."""
    # each side is normalised before they meet: one long chain of replacements to a generated method
    side = lambda rows, k, t, n: last_template(rows).where("template <> ''").select(F.col("event").alias(k), F.col("template").alias(t), normalised("template").alias(n))
    found = correct_groups(joined(truth, parsed))
    both = found.join(side(parsed, "p", "pt", "pn"), "p").join(side(truth, "g", "gt", "gn"), "g")
    return both.where((F.col("pn") == F.col("gn")) | listed("pt", "gt")).select("p", "g", "n")


def scores(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: ga, pa, pta, rta. The last two are over all parsed and all truth events, unassigned lines included."""
    lines = joined(truth, parsed)
    right = correct_templates(truth, parsed).agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    events = lambda rows, name: rows.where("EventId is not null").agg(F.count_distinct("EventId").alias(name))
    one = group_accuracy(lines).join(F.broadcast(right)).join(F.broadcast(events(parsed, "parsed"))).join(F.broadcast(events(truth, "truth")))  # single rows
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return one.select("ga", ratio("n", "lines").alias("pa"), ratio("k", "parsed").alias("pta"), ratio("k", "truth").alias("rta"))


def transposed(rows: DataFrame, datasets: list[str]) -> DataFrame:
    """(dataset, ga, pa, pta, rta) -> one row a metric, one column a data set."""
    long = rows.unpivot("dataset", ["ga", "pa", "pta", "rta"], "metric", "score")
    return long.groupBy("metric").pivot("dataset", datasets).agg(F.first("score"))


def evaluate(spark: SparkSession, groundtruth: str, parsed: str) -> DataFrame:
    """One row of scores of a result file against a truth file, both structured logs."""
    return scores(logs.read_named(spark, groundtruth, logs.TRUTH), logs.read_named(spark, parsed, logs.TRUTH))


def benchmark(spark: SparkSession, files: dict[str, tuple[str, str]]) -> DataFrame:
    """data set -> (truth file, result file): the score table, one row a metric and one column a data set."""
    rows = None
    for name, (groundtruth, parsed) in files.items():
        one = evaluate(spark, groundtruth, parsed).withColumn("dataset", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return transposed(rows, list(files))
