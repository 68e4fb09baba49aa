"""Templates that count as equal although they are written differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order: kind, then pattern beside a wildcard W. Kinds: prefix P W, suffix W S, infix W X W, wrap A W A,
#: pattern (itself, replacement). Each is applied until nothing changes, before the next; repeats are meant.
RULES: list[tuple[str, ...]] = [
    ("prefix", r"\w+_"), ("pattern", r"<\*>(?:, <\*> - <\*>, <\*>)+", "<*>"), ("infix", "/"), ("prefix", "/"), ("infix", ":"), ("suffix", "]"), ("suffix", ">"), ("infix", "##"), ("suffix", " ms"), ("prefix", "MININT-"),
    ("prefix", "0[xX]"), ("suffix", ","), ("suffix", ";"), ("infix", "-"), ("suffix", "[MKG]B"), ("infix", r"\."), ("suffix", r"\."), ("prefix", r"core\."), ("prefix", "node-"), ("prefix", ":"),
    ("suffix", ":"), ("prefix", "CPU"), ("prefix", "IRQ"), ("wrap", '"', '"'), ("prefix", "v"), ("pattern", r"\s{2,}", " "), ("suffix", r"\.0"), ("prefix", r"\+"), ("prefix", "BP-"), ("suffix", "Kbytes"),
    ("wrap", "#", "#"), ("wrap", r"\(", r"\)"), ("infix", " "), ("suffix", " us"), ("infix", " - "), ("suffix", "0"), ("infix", r"\|"), ("suffix", "ms"), ("infix", "@"), ("prefix", "#"),
    ("infix", ""), ("prefix", r"proxy\."), ("pattern", r"@<\*>(?: @<\*>)+", "@<*>"), ("pattern", r"<\*> bytes <\*>", "<*> "), ("suffix", ":"), ("prefix", "-"), ("pattern", "MININT-<*>", "<*>"), ("suffix", "M"), ("suffix", "rts"), ("suffix", "C"),
    ("prefix", "https:"), ("prefix", "job"), ("suffix", " [MGK]B"), ("prefix", r"\\"), ("suffix", " bytes"), ("prefix", "<"), ("suffix", ","), ("suffix", "GHz"), ("suffix", "K"), ("prefix", "task"),
    ("suffix", " seconds"), ("prefix", "blk_"), ("suffix", r"\w+"), ("infix", " "), ("prefix", "0x"), ("prefix", "blk"), ("prefix", "attempt"), ("prefix", "container"), ("infix", ""), ("suffix", ","),
]

#: Pairs (parsed, truth) that count as equal besides.
EQUAL_PAIRS = [
    ("Alarm uploadStaticsToDB totalSteps=<*>Calories:<*>Floor:<*>Distance:<*>", "Alarm uploadStaticsToDB totalSteps=<*>:<*>:<*>:<*>"),
    ("next day:steps<*>mLastReport<*>", "next day:<*>"),
]

#: Passes of the rules whose fixpoint a single pattern does not reach, where an engine can't repeat them.
UNROLLED = 8


def steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order: one pass of each is the fixpoint of its rule."""
    out: list[tuple[str, str]] = []
    for kind, *parts in RULES:
        if kind == "prefix":
            out.append((rf"(?:{parts[0]})+<\*>", "<*>"))
        elif kind == "suffix":
            out.append((rf"<\*>(?:{parts[0]})+", "<*>"))
        elif kind == "infix":
            out.append((rf"<\*>(?:{parts[0]}<\*>)+", "<*>"))
        elif kind == "wrap":
            out += [(rf"{parts[0]}<\*>{parts[1]}", "<*>")] * UNROLLED
        else:
            out += [(parts[0], parts[1])] * (UNROLLED if "bytes" in parts[0] else 1)
    return out


def normalised(c) -> Column:
    """All rules in order, each to its fixpoint; rules that nest are repeated as often as their closing text occurs."""
    out = F.col(c) if isinstance(c, str) else c
    before = None
    for pattern, replacement in steps():
        if pattern == before:
            continue
        before = pattern
        again = _CLOSING.get(pattern)
        out = _once(out, pattern, replacement) if again is None else _repeated(out, pattern, replacement, again)
    return out


def _once(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, replacement)


def _repeated(c: Column, pattern: str, replacement: str, again: str) -> Column:
    passes = F.length(c) - F.length(F.replace(c, F.lit(again), F.lit("")))
    return F.aggregate(F.sequence(F.lit(0), passes), c, lambda x, _: _once(x, pattern, replacement))


#: What each pass of a rule that nests takes at least one character of, by its pattern.
_CLOSING = {rf"{parts[0]}<\*>{parts[1]}": parts[1].replace("\\", "") for kind, *parts in RULES if kind == "wrap"} | {parts[0]: "<" for kind, *parts in RULES if kind == "pattern" and "bytes" in parts[0]}


def normalised_sql(column: str) -> str:
    """The same chain for an engine with a global flag; for ASCII templates."""
    quote = lambda x: x.replace("'", "''")
    out = column
    for pattern, replacement in steps():
        out = f"regexp_replace({out}, '{quote(pattern)}', '{quote(replacement)}', 'g')"
    return out


def listed(parsed, truth) -> Column:
    """Whether a pair is one of the fixed ones."""
    parsed, truth = (F.col(x) if isinstance(x, str) else x for x in (parsed, truth))
    out = F.lit(False)
    for a, b in EQUAL_PAIRS:
        out = out | ((parsed == a) & (truth == b))
    return out


def equivalent(parsed, truth) -> Column:
    """Whether two templates count as equal; a null or empty one never does."""
    parsed, truth = (F.col(x) if isinstance(x, str) else x for x in (parsed, truth))
    return F.coalesce((parsed != "") & (truth != "") & (listed(parsed, truth) | (normalised(parsed) == normalised(truth))), F.lit(False))
