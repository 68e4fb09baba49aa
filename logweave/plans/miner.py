"""Mining: raw lines to (line -> event, template), as rounds of set-oriented steps.

Each round works on the distinct contents that no template matches yet. They
are grouped by a masked shape; representatives of each, one in the first round and
up to twice as many in each later one, go through initial template, wildcard merging,
grounding and reflection, and the classes of their wildcards are united with those
of the known templates. What is matched afterwards or has been a representative
leaves the frontier, so that every content is matched or tried. In the end templates that
another covers give way to it, and the most similar ones are merged where an answer says so.

Doubtful decisions come from memoised answers, then from a language model where one is
configured, then from rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import align
from logweave.functions.text import char_class, digits_masked, masked, merged_wildcards, squeezed, stripped
from logweave.lineage import cut, forget
from logweave.operators import adjudicate, clusters, matching, similarity
from logweave.shipping import ship
from logweave.sources import logs as io

_EMPTY = {1: "key1 string, answer string", 2: "key1 string, key2 string, answer string"}


@dataclass
class Answers:
    """Memoised answers; a missing table is empty."""

    extract: DataFrame | None = None
    variable: DataFrame | None = None
    merge: DataFrame | None = None

    def of(self, spark: SparkSession, name: str, depth: int) -> DataFrame:
        held = getattr(self, name)
        return held if held is not None else spark.createDataFrame([], _EMPTY[depth])

    @staticmethod
    def path(folder: str, name: str, dataset: str) -> str:
        return f"{folder}/cache_{'variable_constant' if name == 'variable' else name}/{dataset}.json"

    @staticmethod
    def load(spark: SparkSession, folder: str, dataset: str) -> Answers:
        return Answers(*(io.read_answers(spark, Answers.path(folder, name, dataset), depth) for name, depth in (("extract", 1), ("variable", 2), ("merge", 2))))


@dataclass
class Backend:
    """A language model that is asked what no memoised answer decides; what it said is kept for the caches.

    pool(content, template): examples; `candidates` of them, far from each other, are chosen once, and the `k`
    nearest of these go with each request for a template.
    """

    make_client: Callable[[], Callable[[str], str]]
    pool: DataFrame | None = None
    k: int = 3
    candidates: int = 32
    said: dict[str, DataFrame] = field(default_factory=dict)
    _chosen: DataFrame | None = None

    def examples(self, logs: DataFrame) -> DataFrame:
        """logs(log) -> (log, examples): the nearest, the best last."""
        kind = "array<struct<content:string,template:string>>"
        if self.pool is None:
            return logs.select("log", F.array().cast(kind).alias("examples"))
        if self._chosen is None:
            self._chosen = cut(similarity.candidate_set(self.pool, self.candidates))
        named = self._chosen.select("cid", F.col("content").alias("text"))
        near = similarity.nearest_examples(logs.select(F.col("log").alias("qid"), F.col("log").alias("text")), named, self.k)
        shown = near.join(F.broadcast(self._chosen), "cid").groupBy(F.col("qid").alias("log")).agg(F.sort_array(F.collect_list(F.struct(-F.col("rank"), "content", "template"))).alias("e"))
        shown = shown.select("log", F.transform("e", lambda x: F.struct(x["content"].alias("content"), x["template"].alias("template"))).alias("examples"))
        return logs.join(shown, "log", "left").select("log", F.coalesce("examples", F.array().cast(kind)).alias("examples"))

    def asked(self, name: str, requests: DataFrame) -> DataFrame:
        """requests(key1, ..., prompt) -> (key1, ..., answer), remembered under `name`."""
        found = cut(adjudicate.asked_online(requests, self.make_client).drop("prompt").where("answer is not null"))
        self.said[name] = found if name not in self.said else self.said[name].unionByName(found)
        return found

    def extract(self, logs: DataFrame) -> DataFrame:
        return self.asked("extract", self.examples(logs).select(F.col("log").alias("key1"), adjudicate.extract_prompt(F.col("log"), F.col("examples")).alias("prompt")))

    def variable(self, asked: DataFrame) -> DataFrame:
        return self.asked("variable", asked.select(F.col("log").alias("key1"), F.col("snippet").alias("key2"), adjudicate.variable_prompt(F.col("log"), F.col("snippet")).alias("prompt")))

    def merge(self, asked: DataFrame) -> DataFrame:
        return self.asked("merge", asked.select(F.col("one").alias("key1"), F.col("two").alias("key2"), adjudicate.same_prompt(F.col("one"), F.col("two")).alias("prompt")))


def contents(lines: DataFrame) -> DataFrame:
    return lines.select("LineId", squeezed(stripped("Content")).alias("content"))


def _templates_of(logs: DataFrame, answers: Answers, rules: adjudicate.Adjudicator, backend: Backend | None) -> DataFrame:
    """logs(log) -> (log, template, text, held): initial template, grounded, judged; text: the template with a wildcard
    for each part of what one holds between delimiters, held: what those hold."""
    spark = logs.sparkSession
    known = answers.of(spark, "extract", 1)
    if backend is not None:
        known = known.unionByName(backend.extract(logs.join(known.select(F.col("key1").alias("log")), "log", "left_anti")))
    first = adjudicate.template_answers(logs, known, rules)
    first = first.withColumn("template", align.grounded(merged_wildcards(F.col("template")), "log")["template"])
    units = cut(first.select("log", F.posexplode(align.candidate_units("template", "log")).alias("pos", "u")).select("log", "pos", "u.text", "u.content"))
    asked = units.where("content <> ''").select("log", F.col("content").alias("snippet")).distinct()
    judged = answers.of(spark, "variable", 2)
    if backend is not None:
        judged = judged.unionByName(backend.variable(asked.join(judged.select(F.col("key1").alias("log"), F.col("key2").alias("snippet")), ["log", "snippet"], "left_anti")))
    verdicts = adjudicate.variable_answers(asked, judged, rules)
    done = adjudicate.refined(units, verdicts).select("log", merged_wildcards(F.col("template")).alias("template"))
    held = done.withColumn("g", align.collapsed("template", "log")).select("log", "g.template", "g.contents")
    return held.withColumn("s", align.split("template", "contents")).select("log", "template", F.col("s.template").alias("text"), F.col("s.contents").alias("held"))


#: What is known of templates: one row a wildcard of each text of each template.
CLASSES = "template string, text string, k int, d boolean, l boolean, rest array<string>"


def _classes(found: DataFrame) -> DataFrame:
    """(template, text, held) -> CLASSES: whether a digit or letter was seen in wildcard k, and the other characters; k is null without wildcards."""
    spread = found.select("template", "text", F.posexplode_outer(F.transform("held", lambda x: char_class(x))).alias("k", "cls"))
    rest = F.filter(F.split(F.regexp_replace("cls", "0-9|a-zA-Z", ""), ""), lambda c: c != "")
    return _united(spread.select("template", "text", "k", F.contains("cls", F.lit("0-9")).alias("d"), F.contains("cls", F.lit("a-zA-Z")).alias("l"), rest.alias("rest")))


def _united(classes: DataFrame) -> DataFrame:
    """One row a wildcard of each text."""
    rest = F.array_sort(F.array_distinct(F.flatten(F.collect_set("rest"))))
    return classes.groupBy("template", "text", "k").agg(F.max("d").alias("d"), F.max("l").alias("l"), rest.alias("rest"))


def _with_patterns(united: DataFrame) -> DataFrame:
    """CLASSES -> (cid, template, pattern): a pattern for each text of a template."""
    cls = F.concat(F.when(F.col("d"), "0-9").otherwise(""), F.when(F.col("l"), "a-zA-Z").otherwise(""), F.array_join("rest", ""))
    ordered = united.select("template", "text", F.struct("k", F.coalesce(cls, F.lit("")).alias("c")).alias("kc"), "k")
    ordered = ordered.groupBy("template", "text").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.col("kc")))).alias("kcs"))

    @F.pandas_udf("string")
    def compiled(text, kcs):
        return text.combine(kcs, lambda t, x: matching.pattern(t, [y["c"] for y in x]))

    return ordered.select(F.xxhash64("template").alias("cid"), "template", compiled("text", "kcs").alias("pattern"))


def _generals(templates: DataFrame, answers: Answers, rules: adjudicate.Adjudicator, backend: Backend | None) -> DataFrame:
    """templates(template) -> (template, general): what stands for each, by coverage, then by answers."""
    named = templates.select(F.xxhash64("template").alias("tid"), "template")
    covered = cut(clusters.consolidated(named).select("tid", F.col("template").alias("top")))
    known = answers.of(templates.sparkSession, "merge", 2)
    tops = covered.select(F.col("top").alias("template")).distinct()
    if backend is not None:
        asked = clusters.doubtful(tops)
        known = known.unionByName(backend.merge(asked.join(adjudicate.same_answers(asked, known, adjudicate.Unsaid()).where("same is not null"), ["one", "two"], "left_anti")))
    last = clusters.resolved(tops, known, rules).withColumnRenamed("template", "top")
    return named.join(covered, "tid").join(last, "top").select("template", "general")


@dataclass
class Mined:
    """assigned(LineId, EventId, EventTemplate), templates(EventId, EventTemplate, Occurrences), and what is known of templates."""

    assigned: DataFrame
    templates: DataFrame
    classes: DataFrame


def mined(lines: DataFrame, answers: Answers | None = None, rules: adjudicate.Adjudicator | None = None, rounds: int | None = None, classes: DataFrame | None = None, backend: Backend | None = None) -> Mined:
    """lines(LineId, Content) mined; contents that the templates of `classes` match are not mined again.

    The result doesn't depend on the order of lines. Every template covers what it is assigned to. Rounds go on until every
    content is matched or has been tried, or, if `rounds` is given, so many at most; lines that no template
    matches then are events of their own text. Event ids are dense, by partition of the template table.
    """
    spark, answers, rules = lines.sparkSession, answers or Answers(), rules or adjudicate.Rules()
    ship(spark)
    rows = cut(contents(lines))
    everything = cut(rows.groupBy("content").agg(F.min("LineId").alias("first")))
    frontier = everything.where("content is not null")
    classes = classes if classes is not None else spark.createDataFrame([], CLASSES)
    known = cut(_with_patterns(classes))
    left = lambda: matching.matched(frontier, known).where("cid is null").select("content", "first")
    if not known.isEmpty():
        frontier = cut(left())
    turn = 0
    while not frontier.isEmpty() and turn != rounds:
        shape, lot = digits_masked(masked("content")), F.pmod(F.xxhash64("content"), F.lit(1 << min(turn, 30)))
        seeds = cut(frontier.groupBy(shape.alias("shape"), lot.alias("lot")).agg(F.min_by("content", "first").alias("log")).select("log"))
        fresh = _classes(_templates_of(seeds, answers, rules, backend).where("template is not null and template <> ''"))
        before, above, tried = classes, known, frontier
        classes = cut(_united(classes.unionByName(fresh)))
        known = cut(_with_patterns(classes))
        frontier = cut(left().join(seeds, F.col("content") == seeds["log"], "left_anti"))
        forget(*([before] if turn else []), above, seeds, *([tried] if turn else []))
        turn += 1
    names = known.select("cid", "template").distinct()
    hit = matching.matched(everything, known).join(names, "cid", "left").select("content", F.coalesce("template", "content").alias("template"))
    generals = _generals(names.select("template"), answers, rules, backend).withColumnRenamed("template", "t")
    final = cut(hit.join(generals, hit.template == generals.t, "left").select("content", F.coalesce("general", "template").alias("EventTemplate")))
    ids = io.with_line_ids(final.select("EventTemplate").distinct()).select("EventTemplate", (F.col("LineId") - 1).alias("EventId"))
    assigned = cut(rows.join(final, rows["content"].eqNullSafe(final["content"])).join(ids, "EventTemplate", "left").select("LineId", "EventId", "EventTemplate").where("EventTemplate is not null"))
    return Mined(assigned, assigned.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences")), classes)


def mine(lines: DataFrame, answers: Answers | None = None, rules: adjudicate.Adjudicator | None = None, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(assigned, templates) of `mined`."""
    found = mined(lines, answers, rules, rounds)
    return found.assigned, found.templates


@dataclass
class LogParser:
    """A data set of the catalogue, its answers and its outputs.

    With make_client a language model is asked what no answer decides, `k` examples a log, from `candidate_num` of the
    truth of the data sets of the other groups; a backend that can't be reached is left out. Its answers are written back.
    """

    spark: SparkSession
    dataset: str
    cache_path: str
    indir: str
    outdir: str
    k: int = 3
    candidate_num: int = 32
    groups: list[list[str]] = field(default_factory=list)
    rules: adjudicate.Adjudicator | None = None
    make_client: Callable[[], Callable[[str], str]] | None = None
    truth: Callable[[str], str] | None = None  # data set -> path of its truth table

    def pool(self) -> DataFrame | None:
        """(content, template) of the groups that this data set isn't in; without groups of no data set."""
        others = [name for group in self.groups if self.dataset not in group for name in group]
        found = None
        for name in others if self.truth is not None else []:
            rows = io.read_truth(self.spark, self.truth(name)).select(F.col("LineId").alias("at"), F.col("Content").alias("content"), F.col("EventTemplate").alias("template"))
            found = rows if found is None else found.unionByName(rows)
        return None if found is None else similarity.last_by_content(found)

    def parse(self) -> DataFrame:
        lines = cut(io.read_logs(self.spark, self.indir, self.dataset))
        answers = Answers.load(self.spark, self.cache_path, self.dataset)
        backend = None
        if self.make_client is not None and adjudicate.reachable(self.make_client):
            backend = Backend(self.make_client, self.pool(), self.k, self.candidate_num)
        found = mined(lines, answers, self.rules, backend=backend)
        for name, said in (backend.said if backend is not None else {}).items():
            held = answers.of(self.spark, name, len(said.columns) - 1)
            io.write_answers(cut(held.unionByName(said)), Answers.path(self.cache_path, name, self.dataset))
        structured = lines.join(found.assigned, "LineId")
        io.write_structured(structured, f"{self.outdir}/{self.dataset}_2k.log_structured.csv")
        io.write_structured(found.templates, f"{self.outdir}/{self.dataset}_2k.log_templates.csv")
        return structured
