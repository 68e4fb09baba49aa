"""Doubtful decisions: memoised answers first, then a rule, then (if one is configured) a language model.

Three questions: the template of a log, whether a snippet is a variable, whether
two templates are the same. Answers are tables; requests are distinct before they are asked.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import answer_text, digits_masked, masked, says_yes


class Adjudicator(Protocol):
    """Columns that decide what no memoised answer does."""

    def initial_template(self, log: Column) -> Column: ...

    def is_variable(self, log: Column, snippet: Column) -> Column: ...

    def same_template(self, one: Column, two: Column) -> Column: ...


class Rules:
    """Digits, paths and addresses are variables; words are constants; templates are merged by coverage alone."""

    def initial_template(self, log: Column) -> Column:
        return digits_masked(masked(log))

    def is_variable(self, log: Column, snippet: Column) -> Column:
        return F.rlike(snippet, F.lit(r"[0-9]|^/|^0[xX]"))

    def same_template(self, one: Column, two: Column) -> Column:
        return F.lit(False)


class Unsaid(Rules):
    """Leaves open what no answer decides."""

    def same_template(self, one: Column, two: Column) -> Column:
        return F.lit(None).cast("boolean")


def template_answers(logs: DataFrame, answers: DataFrame, rules: Adjudicator | None = None) -> DataFrame:
    """logs(log) -> (log, template); answers(key1: log, answer)."""
    found = logs.join(answers.select(F.col("key1").alias("log"), "answer").dropDuplicates(["log"]), "log", "left")
    return found.select("log", F.coalesce(answer_text(F.col("answer")), "answer", (rules or Rules()).initial_template(F.col("log"))).alias("template"))


def variable_answers(asked: DataFrame, answers: DataFrame, rules: Adjudicator | None = None) -> DataFrame:
    """asked(log, snippet) -> (log, snippet, variable); answers(key1: log, key2: snippet, answer)."""
    known = answers.select(F.col("key1").alias("log"), F.col("key2").alias("snippet"), says_yes(F.col("answer")).alias("said")).dropDuplicates(["log", "snippet"])
    found = asked.distinct().join(known, ["log", "snippet"], "left")
    return found.select("log", "snippet", F.coalesce("said", (rules or Rules()).is_variable(F.col("log"), F.col("snippet"))).alias("variable"))


def same_answers(asked: DataFrame, answers: DataFrame, rules: Adjudicator | None = None) -> DataFrame:
    """asked(one, two) -> (one, two, same); an answer in the order asked comes before one in the other order."""
    known = answers.select(F.col("key1").alias("one"), F.col("key2").alias("two"), says_yes(F.col("answer")).alias("said"))
    both = known.withColumn("rank", F.lit(0)).unionByName(known.select(F.col("two").alias("one"), F.col("one").alias("two"), "said", F.lit(1).alias("rank")))
    first = both.groupBy("one", "two").agg(F.min_by("said", "rank").alias("said"))
    return asked.distinct().join(first, ["one", "two"], "left").select("one", "two", F.coalesce("said", (rules or Rules()).same_template(F.col("one"), F.col("two"))).alias("same"))


def refined(units: DataFrame, verdicts: DataFrame) -> DataFrame:
    """units(log, pos, text, content), verdicts(log, snippet, variable) -> (log, template): judged units become a wildcard or their content."""
    known = verdicts.select("log", F.col("snippet").alias("content"), "variable")
    shown = units.join(known, ["log", "content"], "left")
    part = F.when(F.col("content") == "", F.col("text")).when(F.coalesce("variable", F.lit(False)), "<*>").otherwise(F.col("content"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))  # the units of one log
    return shown.groupBy("log").agg(F.array_join(F.transform(in_order, lambda x: x["part"]), "").alias("template"))


def extract_prompt(log: Column, examples: Column) -> Column:
    """examples: array of struct(content, template), the best last."""
    shown = F.transform(examples, lambda e: F.format_string("Log: <START>%s<END>\nTemplate: <START>%s<END>", e["content"], e["template"]))
    return F.format_string(
        "Give the template of a log line: keep its constants and write <*> for each variable; a line without variables is its own template. "
        "Put the template between <START> and <END> and answer nothing else.\n%s\nLog: <START>%s<END>\nTemplate:", F.array_join(shown, "\n"), log,
    )


def variable_prompt(log: Column, snippet: Column) -> Column:
    return F.format_string("Is the snippet of this log line a run-time value (a variable) and not a word that stays the same? Answer Yes or No.\nLog: %s\nSnippet: %s\nAnswer:", log, snippet)


def same_prompt(one: Column, two: Column) -> Column:
    return F.format_string("Do these two log templates differ only in run-time values, so that they are the same template? Answer Yes or No.\nTemplate 1: %s\nTemplate 2: %s\nAnswer:", one, two)


def chat_client(endpoint: str, model: str | None = None, key: str = "", max_tokens: int = 512) -> Callable[[str], str]:
    """A deterministic chat-completion call; without a model name the first that the endpoint lists."""
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}

    def call(path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(f"{endpoint}{path}", json.dumps(body).encode() if body else None, headers)
        with urllib.request.urlopen(request, timeout=60) as reply:  # noqa: S310
            return json.load(reply)

    def ask(prompt: str) -> str:
        nonlocal model
        model = model or call("/models")["data"][0]["id"]
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max_tokens, "n": 1}
        return call("/chat/completions", body)["choices"][0]["message"]["content"].strip()

    return ask


def asked_online(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt: str = "prompt") -> DataFrame:
    """requests plus `answer`, by a client made in each task; null where the call fails, so that lookups and rules decide."""

    def run(batches):
        client = make_client()
        for frame in batches:
            answers = []
            for text in frame[prompt]:
                try:
                    answers.append(client(text))
                except OSError:
                    answers.append(None)
            yield frame.assign(answer=answers)

    return requests.mapInPandas(run, requests.select("*", F.lit("").alias("answer")).schema)


def reachable(make_client: Callable[[], Callable[[str], str]]) -> bool:
    """Whether the backend answers at all; if not, lookups and rules are used alone."""
    try:
        return bool(make_client()("Reply with Yes."))
    except Exception:  # noqa: BLE001  any failure means offline
        return False
