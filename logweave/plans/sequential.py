"""The order-sensitive form: one pass over each data set's lines in LineId order, as an online fold.

A line that a known template matches joins it; another gets a template, which
is merged with the most similar known one if they cover each other, or opens a cluster. One data set is
one group in one task, so this suits many small data sets; `miner` is the form that scales.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame

from logweave.functions import align
from logweave.operators.matching import pattern
from logweave.shipping import ship

_DIGITS = regex.compile(r"[0-9]+")


def _words(template: str) -> list[str]:
    return [w for w in regex.findall(r"[\p{L}\p{N}\-_/.]+", template) if w.isalpha()]


class Fold:
    """Clusters as [template, compiled pattern, words]; numbered by discovery."""

    def __init__(self):
        self.clusters: list[list] = []

    def _compiled(self, template: str, held: list[str]):
        text, kept = align.split_captures(template, held)
        return regex.compile(pattern(text, [align.character_class(h) for h in kept]))

    def add(self, content: str) -> int:
        for k, (_, known, _) in enumerate(self.clusters):
            if known.search(content):
                return k
        guess = _DIGITS.sub(align.WILD, align._IP.sub(align.WILD, align._PATH.sub(align.WILD, content)))
        template, held = align.collapse(guess, content)
        words = _words(template)
        best, at = 0.0, None
        for k, (other, _, theirs) in enumerate(self.clusters):
            if other == template:
                at = k
                break
            common = sum(min(words.count(w), theirs.count(w)) for w in set(words))
            score = common / max(len(words) + len(theirs), 1)
            if score > best:
                best, at = score, k
        if at is not None:
            text = align.covers_repeated(template, self.clusters[at][0])
            if text is None:
                ok, text = align.cover(template, self.clusters[at][0])
                text = text if ok else None
            if text is not None:
                text, held = align.ground(text, content)
                self.clusters[at] = [text, self._compiled(text, held), _words(text)]
                return at
        self.clusters.append([template, self._compiled(template, held), words])
        return len(self.clusters) - 1


def mine_in_order(lines: DataFrame, group: str = "dataset") -> DataFrame:
    """(group, LineId, content) -> (group, LineId, EventId, EventTemplate)."""
    ship(lines.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, fold = frame.sort_values("LineId"), Fold()
        ids = [fold.add(x or "") for x in frame["content"]]
        return pd.DataFrame({group: frame[group], "LineId": frame["LineId"], "EventId": ids, "EventTemplate": [fold.clusters[k][0] for k in ids]})

    kind = lines.schema[group].dataType.simpleString()
    return lines.select(group, "LineId", "content").groupBy(group).applyInPandas(run, f"{group} {kind}, LineId bigint, EventId bigint, EventTemplate string")
