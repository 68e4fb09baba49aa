import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import align, equivalence, text
from logweave.operators import matching
from logweave.sources import formats

TEMPLATES = st.text(alphabet="ab1: /<*>", max_size=12)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (text.squeezed, "a   b", "a  b"),
        (text.letter_tokens, "12 ab", ["ab"]),
        (lambda c: text.letter_tokens(c, compat=True), "12 ab 7", ["12ab"]),
        (text.symbols, "a<>b", ["a", "<*>", "b"]),
        (text.tokens, "ab1 <*>:é", ["ab1", " ", "<*>", ":", "é"]),
        (text.merged_wildcards, "x <*>:<*> y", "x <*> y"),
        (text.merged_wildcards, "<*> <*>", "<*> <*>"),
        (text.runs_collapsed, "u1<*>x:5", "<*>:5"),
        (text.char_class, "a1:", "0-9a-zA-Z:"),
        (text.repeats_merged, "ports a<*> a<*> a<*> end", "ports <*> end"),
        (text.masked, "get /a/b.html from 10.0.0.1", "get <*> from <*>"),
        (text.answer_text, "<START>a <*><END>", "a <*>"),
        (text.answer_text, "<START>a", "a"),
        (text.answer_text, "none", None),
        (text.says_yes, "Yes.", True),
        (text.alphabetic_tokens, "foo-bar baz 1a", ["baz"]),
        (equivalence.normalised, "blk_<*>", "<*>"),
        (equivalence.normalised, "<*>:<*>", "<*>"),
        (equivalence.normalised, '""<*>""', "<*>"),
    ],
)
def test_columns(spark, function, value, expected):
    assert one(spark, value, function) == expected


def test_equivalent(spark):
    rows = spark.createDataFrame([("blk_<*>", "<*>"), ("a", "b"), ("", ""), (None, "a"), equivalence.EQUAL_PAIRS[1]], "p string, t string")
    assert [r[0] for r in rows.select(equivalence.equivalent("p", "t")).collect()] == [True, False, False, False, True]


@settings(max_examples=200, deadline=None)
@given(TEMPLATES, TEMPLATES)
def test_alignment_is_a_longest_common_subsequence(a, b):
    a, b = align.symbols(a), align.symbols(b)
    pairs = align.align(a, b)
    assert all(a[i] == b[j] != align.WILD for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    if align.WILD not in a or align.WILD not in b:
        assert len(pairs) == best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(TEMPLATES, st.text(alphabet="ab1: /", max_size=14))
def test_grounding_gives_the_log_back(template, log):
    text_, held = align.ground(template, log)
    out, k = [], 0
    for s in align.symbols(text_):
        if s == align.WILD:
            out.append(held[k])
            k += 1
        else:
            out.append(s)
    assert k == len(held) and "".join(out).strip() == log.strip()


def test_kernels():
    assert align.cover("open file <*>", "open file 5") == (True, "open file <*>")
    assert align.cover("open file a", "open file b")[0] is False
    assert align.trim_common("ab1c", "ab2c") == ("1", "2")
    assert align.merge("job 1 done", "job 2 done") == ("job <*> done", [("1", "2")])
    assert align.split_captures("<*>.<*>", ["10.0", "x"]) == ("<*>.<*>.<*>", ["10", "0", "x"])
    assert align.split_captures("a <*>", [""]) == ("a ", [])
    assert align.covers_repeated("p a<*> a<*> e", "p <*> e") == "p <*> e"
    assert align.covers_repeated("p a", "p b") is None
    units = align.candidates("user <*> at 10:20.3 path /x/y", "user bob at 10:20.3 path /x/y")
    assert "".join(t for t, _ in units) == "user <*> at <*> path <*>"
    assert [c for _, c in units if c] == ["bob", "10:20.3", "/x/y"]


def test_pattern_gives_nothing_back():
    import regex

    assert not regex.search(matching.pattern("job <*>", ["0-9"]), "job ")
    assert not regex.search(matching.pattern("t <*>3", ["0-9:"]), "t 1:3")
    assert regex.search(matching.pattern("t <*> end", ["0-9"]), "t  end")
    assert not regex.search(matching.pattern("t <*>", [""]), "t x")


@pytest.mark.parametrize("name", formats.CATALOGUE)
def test_formats(name):
    fmt = formats.for_dataset(name)
    assert re.compile(fmt.pattern).groups == len(fmt.headers) and fmt.headers[-1] == "Content"


def test_optional_field():
    fmt = formats.for_dataset("Linux")
    assert fmt.optional == {"PID"}
    assert re.match(fmt.pattern, "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: check pass").group(6) == "19939"


def test_merging_wildcards_is_idempotent(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice(["<*>", "a", "1", ":", " ", "<>"]) for _ in range(10)),) for _ in range(300)]
    once = spark.createDataFrame(rows, "c string").select(text.merged_wildcards(F.col("c")).alias("c"))
    assert once.where(text.merged_wildcards(F.col("c")) != F.col("c")).count() == 0
