import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave import lineage
from logweave.functions import align, equivalence
from logweave.functions.registry import register
from logweave.operators import adjudicate, clusters, matching, metrics, similarity
from logweave.plans import miner, sequential
from logweave.sources import formats, logs
from logweave.streaming import online

LINES = [f"2024-01-0{k % 9 + 1} 10:00:0{k % 10} INFO web: user {k} opened /a/{k}.html" for k in range(12)] + [f"2024-01-01 10:00:00 WARN db: slow query took {k} ms" for k in range(5)] + ["no header"]


@pytest.fixture(scope="module")
def lines(spark):
    raw = spark.createDataFrame([(x,) for x in LINES], "value string")
    return logs.with_line_ids(logs.parse_lines(raw, formats.compile_format("<Date> <Time> <Level> <Component>: <Content>")))


def side(spark, ids, templates=None):
    return spark.createDataFrame([(k, e, (templates or {}).get(e, e)) for k, e in enumerate(ids)], "LineId bigint, EventId string, EventTemplate string")


def test_line_ids(lines):
    assert sorted(r["LineId"] for r in lines.collect()) == list(range(1, 18))


@pytest.mark.parametrize(("parsed", "ga"), [("111", 0.0), ("112", 1.0), ("123", 1 / 3)])
def test_group_accuracy(spark, parsed, ga):
    found = metrics.group_accuracy(metrics.joined(side(spark, "AAB"), side(spark, parsed))).first()
    assert found["ga"] == pytest.approx(ga)


def test_scores(spark):
    truth = side(spark, ["A", "A", "B", None], {"A": "job <*>", "B": "x"})
    found = metrics.scores(truth, side(spark, ["1", "1", "2", "3"], {"1": "job <*>:<*>", "2": "y"})).first()
    assert (found["ga"], found["pa"], found["pta"], found["rta"]) == (1.0, pytest.approx(2 / 3), pytest.approx(1 / 3), 0.5)


def test_mining(lines):
    assigned, templates = miner.mine(lines.select("LineId", "Content"))
    rows = {r["EventTemplate"]: r["Occurrences"] for r in templates.collect()}
    assert rows == {"user <*> opened <*>": 12, "slow query took <*> ms": 5}
    assert assigned.count() == 17


def test_mining_unites_classes_over_rounds(spark):
    """One shape whose lines hold other characters: one template takes them all, in whatever round it was found."""
    held = ["/a_b", "/c-d", "/e_f", "/g-h", "/i=j", "/k_l-m", "/n~o", "/p=q~r"]
    lines = spark.createDataFrame([(k, f"open {x}") for k, x in enumerate(held, 1)], "LineId bigint, Content string")
    _, templates = miner.mine(lines.unionByName(spark.createDataFrame([(20, None), (21, "")], lines.schema)))
    rows = {r["EventTemplate"]: r["Occurrences"] for r in templates.where("EventTemplate <> ''").collect()}
    assert rows == {"open <*>": 8}


def test_mining_in_order(lines):
    found = sequential.mine_in_order(lines.select(F.lit("x").alias("dataset"), "LineId", F.col("Content").alias("content"))).toPandas()
    assert found.groupby("EventId").size().tolist() == [12, 5]


def test_matching_both_ways(spark):
    templates = spark.createDataFrame([(1, "job <*>", matching.pattern("job <*>", ["0-9a-z"])), (2, "job 7", "^job 7$"), (3, "<*> ms", matching.pattern("<*> ms", ["0-9"]))], "cid bigint, template string, pattern string")
    rows = spark.createDataFrame([("job 7",), ("job 8",), ("5 ms",), ("none",), ("",)], "content string")
    for limit in (10, 1):
        found = {r["content"]: r["cid"] for r in matching.matched(rows, templates, limit=limit).collect()}
        assert found == {"job 7": 2, "job 8": 1, "5 ms": 3, "none": None, "": None}


def test_consolidation(spark):
    templates = spark.createDataFrame([(1, "open file <*>"), (2, "open file 5"), (3, "close file 5"), (4, "<*>")], "tid bigint, template string")
    found = {r["tid"]: r["template"] for r in clusters.consolidated(templates).collect()}
    assert found == {1: "open file <*>", 2: "open file <*>", 3: "close file 5", 4: "<*>"}


def test_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"t1": {"t2": "Yes.", "t3": "No"}}')
    known = logs.read_answers(spark, str(tmp_path / "a.json"), 2)
    asked = spark.createDataFrame([("t2", "t1"), ("t1", "t3"), ("t8", "t9")], "one string, two string")
    assert {(r["one"], r["two"]): r["same"] for r in adjudicate.same_answers(asked, known).collect()} == {("t2", "t1"): True, ("t1", "t3"): False, ("t8", "t9"): False}
    assert logs.read_answers(spark, str(tmp_path / "missing.json"), 1).count() == 0


def test_refined(spark):
    units = spark.createDataFrame([("l", 0, "user ", ""), ("l", 1, "<*>", "bob"), ("l", 2, " ", ""), ("l", 3, "<*>", "7")], "log string, pos int, text string, content string")
    asked = units.where("content <> ''").select("log", F.col("content").alias("snippet"))
    verdicts = adjudicate.variable_answers(asked, spark.createDataFrame([], "key1 string, key2 string, answer string"))
    assert adjudicate.refined(units, verdicts).first()["template"] == "user bob <*>"


def test_diverse_sample(spark):
    rows = spark.createDataFrame([(x,) for x in ("aaaa", "aaab", "zzzz", "zzzy", None, "aaaa")], "t string")
    found = similarity.diverse_sample(rows, "t", 2)
    assert len(found) == 2 and found[0][0] != found[1][0]
    assert len(similarity.diverse_sample(rows, "t", 10)) == 4


def test_nearest(spark):
    queries = spark.createDataFrame([(1, "open the file"), (2, "12 34")], "qid bigint, text string")
    pool = spark.createDataFrame([(1, "open a file"), (2, "open the file"), (3, "x")], "cid bigint, text string")
    found = similarity.nearest_examples(queries, pool, 2).orderBy("rank").collect()
    assert [(r["qid"], r["cid"]) for r in found] == [(1, 2), (1, 1)] and found[0]["score"] == 1.0


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select merge_wilds('a <*>:<*>') a, template_cover('x <*>', 'x 1') b, squeeze_spaces('a   b') c, merge_repeats('a<*> a<*>') d, mask_paths('/a/b 1.2.3.4') e, template_merge('x 1', 'x 2') f").first()
    assert tuple(row) == ("a <*>", True, "a  b", "<*>", "<*> <*>", "x <*>")


def test_stream(spark, lines, tmp_path):
    lines.select("LineId", "Content").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("LineId bigint, Content string").parquet(str(tmp_path / "in"))
    online.mine_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r["Occurrences"] for r in online.current_templates(spark, str(tmp_path / "out")).collect()) == 17


def test_outputs(spark, lines, tmp_path):
    assigned, _ = miner.mine(lines.select("LineId", "Content"))
    logs.write_templates(assigned, str(tmp_path / "t"))
    back = logs.read_truth(spark, str(tmp_path / "t"), "EventId STRING, EventTemplate STRING, Occurrences BIGINT").toPandas()
    assert isinstance(back, pd.DataFrame) and back.Occurrences.sum() == 17


def test_consolidation_is_directed(spark):
    """A template takes only one that covers it, and one that none covers."""
    texts = ["open file 5", "open file <*>", "open <*> 5", "open file 7", "open <*> <*>x", "close <*>", "close 5", "<*>"]
    templates = spark.createDataFrame(list(enumerate(texts)), "tid int, template string")
    found = {r["tid"]: r["template"] for r in clusters.consolidated(templates).collect()}
    for k, text in enumerate(texts):
        assert found[k] == text or align.cover(text, found[k]) == (True, found[k])
    assert found[3] == "open file <*>" and found[6] == "close <*>" and found[1] == texts[1] and found[2] == texts[2]


def test_every_line_matches_its_template(spark):
    texts = ["open file 5", "open file 7", "open disk 5", "open disk a5", "open file x9 now", "job 1 on 10.0.0.1", "job 2 on /a/b", "job three on 4:5", "x", "x 1 2 3", "a=b,c=4"]
    lines = spark.createDataFrame([(k, f"{t} {k % 3}") for k, t in enumerate(texts * 3)], "LineId bigint, Content string")
    assigned, templates = miner.mine(lines)
    rows = assigned.join(lines, "LineId").collect()
    assert len(rows) == lines.count() == sum(r["Occurrences"] for r in templates.collect())
    for r in rows:
        parts = r["EventTemplate"].split("<*>")
        assert re.fullmatch(".*".join(map(re.escape, parts)), r["Content"]), r
    assert sorted(r["EventId"] for r in templates.collect()) == list(range(templates.count()))


def test_merge_answers_count(spark):
    lines = spark.createDataFrame([(k, f"disk is {'full' if k % 2 else 'slow'} now") for k in range(6)], "LineId bigint, Content string")
    names = lambda found: sorted(r["EventTemplate"] for r in found[1].collect())
    assert names(miner.mine(lines)) == ["disk is full now", "disk is slow now"]
    said = spark.createDataFrame([("disk is slow now", "disk is full now", "Yes.")], "key1 string, key2 string, answer string")
    assert names(miner.mine(lines, miner.Answers(merge=said))) == ["disk is <*> now"]
    assert names(miner.mine(lines, miner.Answers(merge=said.withColumn("answer", F.lit("No"))))) == ["disk is full now", "disk is slow now"]


def test_stream_matches_known_templates_first(spark, tmp_path):
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    batch = lambda rows: spark.createDataFrame(rows, "LineId bigint, Content string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("LineId bigint, Content string").parquet(source)
        online.mine_stream(stream, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    batch([(k, f"user {k} logged in") for k in range(5)])
    run()
    before = online.known_classes(spark, out).collect()
    batch([(k, f"user {k} logged in") for k in range(70, 75)])
    run()
    assert sorted(before) == sorted(online.known_classes(spark, out).collect())
    assert [(r["EventTemplate"], r["Occurrences"]) for r in online.current_templates(spark, out).collect()] == [("user <*> logged in", 10)]


class Canned:
    """A client that says what it is told to, and is pickled with the task."""

    def __call__(self):
        return lambda prompt: "Yes" if "same template" in prompt else "No" if "snippet" in prompt else "<START>unit <*> up<END>" if "Log: <START>unit" in prompt else "<START><END>"


def test_backend_is_asked_and_remembered(spark, tmp_path):
    pool = spark.createDataFrame([("unit a7 down", "unit <*> down"), ("other text", "other text")], "content string, template string")
    backend = miner.Backend(Canned(), pool, k=1, candidates=2)
    logs_ = spark.createDataFrame([("unit b1 up",)], "log string")
    shown = backend.examples(logs_).first()["examples"]
    assert [(e["content"], e["template"]) for e in shown] == [("unit a7 down", "unit <*> down")]
    lines = spark.createDataFrame([(1, "unit core up"), (2, "unit edge up")], "LineId bigint, Content string")
    found = miner.mined(lines, backend=backend)
    assert {r["EventTemplate"] for r in found.templates.collect()} == {"unit <*> up"}
    path = str(tmp_path / "cache_extract" / "X.json")
    logs.write_answers(backend.said["extract"], path)
    back = {r["key1"]: r["answer"] for r in logs.read_answers(spark, path, 1).collect()}
    assert back and set(back.values()) == {"<START>unit <*> up<END>"}


def test_evaluate_files(spark, lines, tmp_path):
    rows = lines.select("LineId", "Content", F.regexp_replace("Content", "[0-9]+|/.*", "<*>").alias("EventTemplate")).withColumn("EventId", F.when(F.col("Content").startswith("user"), "E1").otherwise("E2"))
    logs.write_structured(rows, str(tmp_path / "truth.csv"))
    logs.write_structured(rows.withColumn("EventId", F.col("EventTemplate")), str(tmp_path / "parsed.csv"))
    one = metrics.evaluate(spark, str(tmp_path / "truth.csv"), str(tmp_path / "parsed.csv")).first()
    assert tuple(one) == (1.0, 1.0, 1.0, 1.0)
    table = metrics.benchmark(spark, {"X": (str(tmp_path / "truth.csv"), str(tmp_path / "parsed.csv"))})
    assert {(r["metric"], r["X"]) for r in table.collect()} == {(m, 1.0) for m in ("ga", "pa", "pta", "rta")}


def test_matching_prefers_constants_and_looks_up_prefixes(spark):
    names = [(1, "a<*>"), (2, "ab<*>"), (3, "abc"), (4, "<*>c"), (5, "a very long literal start <*>")]
    templates = spark.createDataFrame([(k, t, matching.pattern(t, ["0-9" if k == 4 else "a-zA-Z0-9 "])) for k, t in names], "cid bigint, template string, pattern string")
    rows = spark.createDataFrame([(x,) for x in ("abc", "abd", "axc", "77c", "a very long literal start 7", "abc", None)], "content string")
    for limit in (10, 1):
        found = [(r["content"], r["cid"]) for r in matching.matched(rows, templates, limit=limit).collect()]
        assert sorted(found, key=str) == sorted([("abc", 3), ("abc", 3), ("abd", 2), ("axc", 1), ("77c", 4), ("a very long literal start 7", 5), (None, None)], key=str)


def test_too_many_to_compare(spark):
    rows = spark.range(similarity.CHOSEN_MOST + 1).select(F.col("id").alias("cid"), F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="more than"):
        similarity.nearest_by_distance(rows.withColumnRenamed("cid", "qid"), rows)


def test_rules_reach_their_fixpoint(spark):
    deep = "(" * 12 + "<*>" + ")" * 12
    row = spark.createDataFrame([(deep, "((<*>)", "x")], "a string, b string, c string").select(*(equivalence.normalised(c).alias(c) for c in "abc")).first()
    assert tuple(row) == ("<*>", "(<*>", "x")


def test_lineage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, _logweave_folder = "spark://host:7077", None
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        lineage._shared_folder(Session())
