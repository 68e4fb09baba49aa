"""Alignment kernels on template and log text, and their Arrow forms.

These need a dynamic program over two sequences, which no built-in expression
has. Apply them to distinct pairs. All take and give plain Python values; the
Column forms at the end run them on Arrow batches.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
_SYMBOL = regex.compile(r"<\*>|<>|<\*|\*>|.", regex.DOTALL)
_TOKEN = regex.compile(r"<\*>|[\p{L}\p{N}]+|.", regex.DOTALL)
_RUN = regex.compile(r"[\p{L}\p{N}]*<\*>(?:[\p{L}\p{N}]|<\*>)*")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_SPECIAL = regex.compile(r"<\*|\*>|<>|\u0001")
_EDGE = "\u0001"  # a sentinel that text doesn't hold


def symbols(text: str) -> list[str]:
    return [WILD if len(s) > 1 else s for s in _SYMBOL.findall(text)]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, leftmost first; on ties an element of `a` is skipped.
    Wildcards count towards it but their pairs are left out."""
    n, m = len(a), len(b)
    below = [0] * (m + 1)
    table = [below]
    for i in range(n - 1, -1, -1):
        row, x = [0] * (m + 1), a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        table.append(row)
        below = row
    table.reverse()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            if a[i] != WILD:
                out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def character_class(content: str) -> str:
    """As a string: 0-9 if it has a digit, a-zA-Z if it has a letter, then its other characters, sorted."""
    digits, letters = any(c in "0123456789" for c in content), any(c.isalpha() for c in content)
    return "0-9" * digits + "a-zA-Z" * letters + "".join(sorted({c for c in content if not c.isalpha() and c not in "0123456789"}))


def ground(template: str, log: str) -> tuple[str, list[str]]:
    """Set a template back into its log: (template, what each wildcard holds).

    Where template and log differ, a wildcard on the template's side takes the log's text; without one
    the log's text becomes constant. A space at either end of a capture moves out of it.
    A template without wildcards that is its log needs no alignment.
    """
    if template == log and not _SPECIAL.search(log):
        return log.strip(), []
    a, b = symbols(f"{_EDGE} {log} {_EDGE}"), symbols(f"{_EDGE} {template} {_EDGE}")
    out, held, i, j = [], [], 0, 0
    for p, q in align(a, b):
        text = "".join(a[i:p])
        if WILD in b[j:q]:
            left = text.startswith(" ")
            right = text.endswith(" ") and len(text) > left
            held.append(text[left : len(text) - right])
            out.append(" " * left + WILD + " " * right)
        else:
            out.append(text)
        out.append(a[p])
        i, j = p + 1, q + 1
    return "".join(out).replace(_EDGE, "").strip(), held


def collapse(template: str, log: str) -> tuple[str, list[str]]:
    """Runs of letters, digits and wildcards become one wildcard; then set back into the log."""
    return ground(_RUN.sub(WILD, template), log)


def split_captures(template: str, held: list[str]) -> tuple[str, list[str]]:
    """A wildcard whose following delimiter occurs in its capture becomes several, joined by it; empty captures go."""
    parts = symbols(template)
    out, kept, k = [], [], 0
    for i, s in enumerate(parts):
        if s != WILD or k >= len(held):
            out.append(s)
            continue
        content, k = held[k], k + 1
        follow = parts[i + 1] if i + 1 < len(parts) else ""
        if follow and follow != WILD and not _ALNUM.match(follow) and follow in content:
            pieces = content.split(follow)
            out.append(follow.join([WILD] * len(pieces)))
            kept += pieces
        elif content:
            out.append(WILD)
            kept.append(content)
    return "".join(out), kept


def merge(one: str, two: str) -> tuple[str, list[tuple[str, str]]]:
    """Token-level merge of two templates: differing gaps become wildcards; (merged, texts of each gap)."""
    a, b = tokens(f"{_EDGE} {one} {_EDGE}"), tokens(f"{_EDGE} {two} {_EDGE}")
    out, gaps, i, j = [], [], 0, 0
    for p, q in align(a, b):
        if p > i or q > j:
            out.append(WILD)
            gaps.append(("".join(a[i:p]), "".join(b[j:q])))
        out.append(a[p])
        i, j = p + 1, q + 1
    return "".join(out).replace(_EDGE, "").strip(), gaps


def trim_common(a: str, b: str, compat: bool = False) -> tuple[str, str]:
    """Without the common start (up to `<`) and the common end (up to `>`); they don't overlap unless compat."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n] != "<":
        n += 1
    most, k = min(len(a), len(b)) - (0 if compat else n), 0
    while k < most and a[-1 - k] == b[-1 - k] != ">":
        k += 1
    return a[n : len(a) - k], b[n : len(b) - k]


def cover(one: str, two: str, compat: bool = False) -> tuple[bool, str]:
    """(whether the templates differ only where one has a wildcard, their merged text).

    An empty side against a wildcard with punctuation passes as well; with compat only an empty first side does.
    """
    text, gaps = merge(one, two)
    if not regex.search("[a-zA-Z0-9]", text):
        return False, text
    if one == two:
        return True, text

    def fits(a: str, b: str) -> bool:
        a, b = trim_common(a, b, compat)
        loose = lambda x, y: not x and WILD in y and not _ALNUM.search(y)
        return WILD in (a, b) or loose(a, b) or (not compat and loose(b, a))

    return all(fits(a, b) for a, b in gaps), text


def merge_repeats(template: str) -> str:
    """Consecutive repeats of a token with a wildcard become one wildcard."""
    out: list[str] = []
    last, run = "", False
    for word in template.split():
        again = WILD in last and (word == last or run and word == WILD)
        if again and not run:
            out[-1] = WILD
        elif not again:
            out.append(word)
            last = word
        run = again
    return " ".join(out)


def covers_repeated(one: str, two: str) -> str | None:
    """The merged text if merging repeats changes a side and the results cover each other; else null."""
    a, b = merge_repeats(one), merge_repeats(two)
    if (a, b) == (one, two):
        return None
    ok, text = cover(a, b)
    return text if ok else None


_PATH = regex.compile(r"/[a-zA-Z0-9\-._~:/?#@!$&'*+,;=]*")
_IP = regex.compile(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")
_NUMBER = regex.compile(r"\p{Nd}+(?:[^\p{L}\p{N}]+\p{Nd}+)*")


def candidates(template: str, log: str) -> list[tuple[str, str]]:
    """Units (text, content) of a template in its log; a content other than '' is to be judged variable or constant.

    To be judged are: words captured as variables, paths and addresses left as constants, and numbers left as
    constants (numbers with only punctuation between them are one). The units' texts spell the template.
    """
    suspects = [m.group() for m in _PATH.finditer(log)] + [m.group() for m in _IP.finditer(_PATH.sub(WILD, log))]
    exposed = template
    for s in sorted({s for s in suspects if _ALNUM.search(s)}, key=len, reverse=True):
        exposed = exposed.replace(s, WILD)
    text, held = ground(exposed, log)
    units: list[tuple[str, str]] = []
    constant, k = "", 0

    def flush() -> None:
        at = 0
        for m in _NUMBER.finditer(constant):
            before, after = constant[m.start() - 1 : m.start()], constant[m.end() : m.end() + 1]
            if (before and _ALNUM.match(before)) or (after and _ALNUM.match(after)):
                continue
            if m.start() > at:
                units.append((constant[at : m.start()], ""))
            units.append((WILD, m.group()))
            at = m.end()
        if constant[at:]:
            units.append((constant[at:], ""))

    for s in symbols(text):
        if s != WILD:
            constant += s
            continue
        flush()
        constant = ""
        content, k = held[k] if k < len(held) else "", k + 1
        units.append((WILD, content if content.isalpha() or content in suspects else ""))
    flush()
    return units


def _merged_text(one: str, two: str) -> str:
    return merge(one, two)[0]


def _units(template: str, log: str) -> list[dict]:
    return [{"text": t, "content": c} for t, c in candidates(template, log)]


@functools.cache
def _remembered(function):
    """The function with a bounded memory that lasts as long as the Python worker, over all batches and tasks."""
    return functools.lru_cache(100_000)(function)


def _pairwise(function, kind: str):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        remember = _remembered(function)
        return pd.Series([None if x is None or y is None else remember(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return apply


def _structs(function, names: tuple[str, str], kind: str):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        remember = _remembered(function)
        rows = [(None, None) if x is None or y is None else remember(x, y) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=list(names), dtype=object)

    return apply


def split(template, held) -> Column:
    """struct(template, contents) after split_captures; held: array of strings."""

    @F.pandas_udf("template string, contents array<string>")
    def apply(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None or y is None else split_captures(x, list(y)) for x, y in zip(a, b, strict=True)], columns=["template", "contents"], dtype=object)

    return apply(template, held)


def grounded(template, log) -> Column:
    """struct(template, contents)."""
    return _structs(ground, ("template", "contents"), "template string, contents array<string>")(template, log)


def collapsed(template, log) -> Column:
    return _structs(collapse, ("template", "contents"), "template string, contents array<string>")(template, log)


def covered(one, two) -> Column:
    """struct(covers, merged)."""
    return _structs(cover, ("covers", "merged"), "covers boolean, merged string")(one, two)


def merged(one, two) -> Column:
    return _pairwise(_merged_text, "string")(one, two)


def repeated(one, two) -> Column:
    return _pairwise(covers_repeated, "string")(one, two)


def candidate_units(template, log) -> Column:
    """array of struct(text, content)."""
    return _pairwise(_units, "array<struct<text:string,content:string>>")(template, log)
