"""Inverted indexes: example search, template similarity, nearest strings, diverse samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import alphabetic_tokens, letter_tokens


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id), distinct: tokens with a letter."""
    return rows.select(F.explode(letter_tokens(F.col(text_col))).alias("token"), F.col(id_col).alias("id")).distinct()


def term_freq(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id, tf): tokens of letters alone."""
    return rows.select(F.explode(alphabetic_tokens(F.col(text_col))).alias("token"), F.col(id_col).alias("id")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def ranked(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each `by`, with their rank; ties go to the smaller `tie`. A group limit precedes the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= k)


def nearest_examples(queries: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """queries(qid, text), examples(cid, text) -> (qid, cid, score, rank).

    score = hits / (tokens of both - hits); hits count the query's tokens with multiplicity.
    """
    q = queries.select("qid", letter_tokens(F.col("text")).alias("tokens"))
    size = q.select("qid", F.size("tokens").alias("nq"))
    of_c = examples.select("cid", F.size(letter_tokens(F.col("text"))).alias("nc"))
    hits = q.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("tf"))
    hits = hits.join(postings(examples, "cid", "text").withColumnRenamed("id", "cid"), "token").groupBy("qid", "cid").agg(F.sum("tf").alias("hits"))
    score = F.col("hits") / F.nullif(F.col("nq") + F.col("nc") - F.col("hits"), F.lit(0))
    both = hits.join(size, "qid").join(of_c, "cid").select("qid", "cid", F.coalesce(score, F.lit(1.0)).alias("score"))
    return ranked(both, "qid", "score", "cid", k)


def similar_templates(queries: DataFrame, templates: DataFrame, k: int = 1) -> DataFrame:
    """queries(qid, text), templates(tid, text) -> (qid, tid, overlap, score, rank): shared words over both word counts; a template isn't its own match."""
    one, two = term_freq(queries, "qid", "text").select("token", F.col("id").alias("qid"), F.col("tf").alias("a")), term_freq(templates, "tid", "text").select("token", F.col("id").alias("tid"), F.col("tf").alias("b"))
    nq, nt = one.groupBy("qid").agg(F.sum("a").alias("nq")), two.groupBy("tid").agg(F.sum("b").alias("nt"))
    common = one.join(two, "token").where("qid <> tid").groupBy("qid", "tid").agg(F.sum(F.least("a", "b")).alias("overlap"))
    scored = common.join(nq, "qid").join(nt, "tid").select("qid", "tid", "overlap", (F.col("overlap") / (F.col("nq") + F.col("nt"))).alias("score"))
    return ranked(scored, "qid", "score", "tid", k)


#: Texts of a stated set that every row is held against.
CHOSEN_MOST = 1024


def nearest_by_distance(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """queries(qid, text) against a stated set chosen(cid, text) of at most CHOSEN_MOST rows: (qid, cid, distance) of the nearest, ties to the smaller cid."""
    if chosen.limit(CHOSEN_MOST + 1).count() > CHOSEN_MOST:
        raise ValueError(f"more than {CHOSEN_MOST} texts to compare with")
    pairs = queries.select("qid", F.col("text").alias("x")).join(F.broadcast(chosen.select("cid", F.col("text").alias("y"))))
    best = F.min(F.struct(F.levenshtein("x", "y").alias("distance"), "cid"))
    return pairs.groupBy("qid").agg(best.alias("best")).select("qid", "best.cid", "best.distance")


def diverse_sample(rows: DataFrame, text_col: str, num: int = 32, probes: int = 32, seed: int = 0) -> list[str]:
    """Farthest-point sampling: each step draws `probes` distinct texts by a seeded hash and takes the one farthest from those taken.

    A probe that was taken is skipped; the sample ends early once nothing new is drawn.
    """
    texts = rows.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    taken: list[str] = []
    for step in range(num):
        drawn = texts.orderBy(F.xxhash64(F.lit(seed), F.lit(step), "text"), "text").limit(probes)
        if not taken:
            first = drawn.limit(1).collect()
            if not first:
                break
            taken.append(first[0]["text"])
            continue
        known = F.array(*map(F.lit, taken))
        far = F.array_min(F.transform(known, lambda x: F.levenshtein("text", x)))
        best = drawn.select("text", far.alias("d")).where("d > 0").orderBy(F.desc("d"), "text").limit(1).collect()
        if best:
            taken.append(best[0]["text"])
    return taken


def last_by_content(rows: DataFrame) -> DataFrame:
    """rows(at, content, template) -> (content, template): the template of a content's last row."""
    return rows.where("content is not null and template is not null").groupBy("content").agg(F.max_by("template", F.struct("at", "template")).alias("template"))


def looked_up(logs: DataFrame, rows: DataFrame) -> DataFrame:
    """logs(..., content) plus the template of the last of rows(at, content, template) with that content, or null."""
    return logs.join(last_by_content(rows), "content", "left")


def candidate_set(pool: DataFrame, num: int = 32) -> DataFrame:
    """pool(content, template) -> (cid, content, template): `num` examples whose contents are far from each other, numbered in the order of choice."""
    taken = diverse_sample(pool, "content", num)
    order = pool.sparkSession.createDataFrame(list(enumerate(taken)), "cid int, content string")
    return order.join(pool, "content").groupBy("cid", "content").agg(F.min("template").alias("template"))
