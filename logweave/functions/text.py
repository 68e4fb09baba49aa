"""Tokens, masks and predicates as Column functions; all run inside generated code.

A wildcard is `<*>`; `<>`, `<*` and `*>` are read as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
_ALNUM = r"\p{L}\p{N}"


def normal_wildcards(c) -> Column:
    return F.regexp_replace(c, r"<\*>|<>|<\*|\*>", "<*>")


def symbols(c) -> Column:
    """Characters, a wildcard being one symbol."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(<\*>|<>|<\*|\*>|.)")), lambda x: F.when(x.isin("<>", "<*", "*>"), WILD).otherwise(x))


def tokens(c, keep: str = "") -> Column:
    """Runs of letters and digits (and `keep`), wildcards, and every other character by itself."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(<\*>|[{_ALNUM}{keep}]+|.)"))


def letter_tokens(c, compat: bool = False) -> Column:
    """Runs of letters and digits with a letter. compat: a run of digits alone is glued to the next such token."""
    if not compat:
        return F.filter(F.regexp_extract_all(c, F.lit(rf"([{_ALNUM}]+)")), lambda x: x.rlike(r"\p{L}"))
    glued = F.regexp_extract_all(c, F.lit(rf"((?:\p{{N}}+[^{_ALNUM}]+)*\p{{N}}*\p{{L}}[{_ALNUM}]*)"))
    return F.transform(glued, lambda x: F.regexp_replace(x, rf"[^{_ALNUM}]+", ""))


def alphabetic_tokens(c) -> Column:
    """Tokens of letters alone; `-`, `_`, `/` and `.` stay inside a token and so rule it out."""
    return F.filter(F.regexp_extract_all(c, F.lit(rf"([{_ALNUM}\-_/.]+)")), lambda x: x.rlike(r"^\p{L}+$"))


def squeezed(c) -> Column:
    """Two spaces become one, in a single pass: three become two."""
    return F.regexp_replace(c, "  ", " ")


def masked(c) -> Column:
    """Paths, then IPv4 addresses, as wildcards."""
    paths = F.regexp_replace(c, r"/[a-zA-Z0-9\-._~:/?#@!$&'*+,;=]*", WILD)
    return F.regexp_replace(paths, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", WILD)


def digits_masked(c) -> Column:
    return F.regexp_replace(c, "[0-9]+", WILD)


def runs_collapsed(c) -> Column:
    """A run of letters and digits that holds a wildcard is one."""
    return F.regexp_replace(c, rf"[{_ALNUM}]*<\*>(?:[{_ALNUM}]|<\*>)*", WILD)


def merged_wildcards(c) -> Column:
    """Wildcards with nothing but punctuation between them are one."""
    return F.regexp_replace(normal_wildcards(c), rf"<\*>(?:[^{_ALNUM} ]*<\*>)+", WILD)


def repeats_merged(c) -> Column:
    """Consecutive repeats of a token with a wildcard become one wildcard; white space becomes single spaces."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(False).alias("run"))

    def step(s, token):
        again = F.contains(s["last"], F.lit(WILD)) & ((token == s["last"]) | (s["run"] & (token == WILD)))
        shorter = F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        out = F.when(again & ~s["run"], F.array_append(shorter, F.lit(WILD))).when(again, s["out"]).otherwise(F.array_append(s["out"], token))
        return F.struct(out.alias("out"), F.when(again, s["last"]).otherwise(token).alias("last"), again.alias("run"))

    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.aggregate(words, state, step, lambda s: F.array_join(s["out"], " "))


def char_class(c) -> Column:
    """The class of a capture: any digit stands for 0-9, any letter for the ASCII letters, other characters for themselves, sorted."""
    others = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("(?s)(.)")), lambda x: ~x.rlike(rf"[0-9]|\p{{L}}"))))
    return F.concat(F.when(F.rlike(c, F.lit("[0-9]")), "0-9").otherwise(""), F.when(F.rlike(c, F.lit(r"\p{L}")), "a-zA-Z").otherwise(""), F.array_join(others, ""))


def answer_text(c) -> Column:
    """The text between the last usable pair of tags of an answer; a missing end tag is added; null if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    closed = F.when(F.contains(c, F.lit("<END>")), c).otherwise(F.concat(c, F.lit("<END>")))
    inner = F.try_element_at(F.regexp_extract_all(closed, F.lit("(?s)<START>((?:(?!<START>).)+?)<END>")), F.lit(-1))
    return F.nullif(stripped(inner), F.lit(""))


def stripped(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_alnum(c) -> Column:
    return F.rlike(c, F.lit(rf"[{_ALNUM}]"))


def has_letter(c) -> Column:
    return F.rlike(c, F.lit(r"\p{L}"))


def has_ascii_alnum(c) -> Column:
    return F.rlike(c, F.lit("[a-zA-Z0-9]"))


def says_yes(c) -> Column:
    return F.contains(F.lower(c), F.lit("yes"))
