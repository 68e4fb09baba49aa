"""Template clusters: consolidation of templates that one of them covers, and of the most similar ones where an answer says so."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import align
from logweave.functions.align import covered, repeated
from logweave.functions.text import alphabetic_tokens, merged_wildcards
from logweave.lineage import cut
from logweave.operators import adjudicate, similarity
from logweave.shipping import ship


def _constants(template: str):
    return F.length(F.replace(template, F.lit("<*>"), F.lit("")))


def subsumption_pairs(templates: DataFrame) -> DataFrame:
    """templates(tid, template) -> (special, general): ids of pairs where the second template covers the first.

    A covering template's words, those that touch no wildcard, are words of what it covers; it is looked up
    by the rarest of them, so that a word of many templates brings few together. Templates
    without such words meet on their shape.
    """
    ship(templates.sparkSession)
    shape = F.concat(F.lit("\u0001"), F.regexp_replace("template", r"[^<*>]+", " "))
    words = F.array_distinct(alphabetic_tokens(F.col("template")))
    spread = cut(templates.select("tid", F.explode(F.array_append(words, shape)).alias("key")))
    often = spread.groupBy("key").agg(F.count("*").alias("often"))
    free = F.array_distinct(alphabetic_tokens(F.regexp_replace("template", r"\S*<\*>\S*", " ")))
    own = templates.select("tid", F.explode(F.when(F.size(free) > 0, free).otherwise(F.array(shape))).alias("key"))
    rarest = own.join(often, "key").groupBy(F.col("tid").alias("general")).agg(F.min_by("key", F.struct("often", "key")).alias("key"))
    meet = rarest.join(spread.withColumnRenamed("tid", "special"), "key").where("general <> special").select("special", "general").distinct()
    side = lambda k, t: templates.select(F.col("tid").alias(k), F.col("template").alias(t), _constants("template").alias(f"{t}_size"))
    both = meet.join(side("special", "s"), "special").join(side("general", "g"), "general")
    both = both.where((F.col("g_size") < F.col("s_size")) | ((F.col("g_size") == F.col("s_size")) & (F.col("g") < F.col("s"))))
    out = both.withColumn("c", covered("s", "g")).where(F.col("c.covers") & (F.col("c.merged") == F.col("g")))
    return out.select("special", "general")


def labelled(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(tid), pairs(a, b) -> (tid, root): smallest tid of each component, by passing minima along pairs and jumping to them until none moves."""
    pairs = cut(pairs.select("a", "b"))
    ends = cut(pairs.union(pairs.select("b", "a")).distinct())
    label = cut(nodes.select("tid", F.col("tid").alias("root")))
    while True:
        near = ends.join(label, ends.b == label.tid).groupBy("a").agg(F.min("root").alias("low"))
        stepped = label.join(near, label.tid == near.a, "left").select("tid", "root", F.least("root", F.coalesce("low", "root")).alias("next"))
        up = stepped.select(F.col("tid").alias("t"), F.col("next").alias("top"))
        jumped = cut(stepped.join(up, stepped.next == up.t).select("tid", "root", F.col("top").alias("next")))
        moved = jumped.where("root <> next").limit(1).count()
        label = jumped.select("tid", F.col("next").alias("root"))
        if not moved:
            return label


def consolidated(templates: DataFrame) -> DataFrame:
    """templates(tid, template) -> (tid, root, template): the template that stands for each.

    It covers the template itself and is covered by none: of several such the one of fewest constants,
    then the first by text. A template that none covers stands for itself, as does one whose covering templates are all covered.
    """
    pairs = cut(subsumption_pairs(templates))
    covered_ = pairs.select(F.col("special").alias("general")).distinct()
    top = pairs.join(covered_, "general", "left_anti")
    named = top.join(templates.select(F.col("tid").alias("general"), F.col("template").alias("t"), _constants("template").alias("size")), "general")
    best = named.groupBy(F.col("special").alias("tid")).agg(F.min_by(F.struct("general", "t"), F.struct("size", "t")).alias("best"))
    return templates.join(best, "tid", "left").select("tid", F.coalesce("best.general", "tid").alias("root"), F.coalesce("best.t", "template").alias("template"))


def _folded(group: pa.Table) -> pa.Table:
    """One template for all of a component, by merging one after the other."""
    texts = sorted(group.column("template").to_pylist())
    one = functools.reduce(lambda a, b: align.covers_repeated(a, b) or align.merge(a, b)[0], texts)
    return pa.table([group.column("template"), pa.array([one] * group.num_rows)], names=["template", "general"])


def _most_similar(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, template), and pairs (one, two, by_repeats) of each template and the most similar other one."""
    ship(templates.sparkSession)
    named = cut(templates.select(F.xxhash64("template").alias("tid"), "template").distinct())
    side = named.select("tid", F.col("template").alias("text"))
    near = similarity.similar_templates(side.withColumnRenamed("tid", "qid"), side)
    pairs = near.join(named.select(F.col("tid").alias("qid"), F.col("template").alias("one")), "qid").join(named.select("tid", F.col("template").alias("two")), "tid").select("one", "two")
    return named, cut(pairs.withColumn("by_repeats", repeated("one", "two").isNotNull()))


def doubtful(templates: DataFrame) -> DataFrame:
    """(one, two): most similar pairs that are the same template or not by an answer alone."""
    return _most_similar(templates)[1].where("not by_repeats").select("one", "two")


def resolved(templates: DataFrame, answers: DataFrame, rules: adjudicate.Adjudicator | None = None) -> DataFrame:
    """templates(template) -> (template, general): each template against the most similar other one.

    Two are one if they cover each other once their repeats are merged, or else if a memoised answer
    (key1, key2, answer) or the rules say so; their general form has a wildcard wherever they differ.
    """
    named, pairs = _most_similar(templates)
    said = adjudicate.same_answers(pairs.where("not by_repeats").select("one", "two"), answers, rules).where("same").select("one", "two")
    alike = cut(pairs.where("by_repeats").select("one", "two").union(said))
    if alike.isEmpty():
        return named.select("template", F.col("template").alias("general"))
    label = labelled(alike.select(F.xxhash64("one").alias("a"), F.xxhash64("two").alias("b")), named.select("tid"))
    grouped = named.join(label, "tid").withColumn("members", F.count("*").over(Window.partitionBy("root")))
    folded = grouped.where("members > 1").select("root", "template").groupBy("root").applyInArrow(_folded, "template string, general string")
    folded = folded.select("template", merged_wildcards(F.col("general")).alias("general"))
    return cut(folded.union(grouped.where("members = 1").select("template", F.col("template").alias("general"))))
