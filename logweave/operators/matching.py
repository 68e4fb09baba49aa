"""Log x template matching: each template is an anchored pattern whose wildcards take all they can and give nothing back."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logweave.functions.align import WILD, symbols
from logweave.shipping import ship

LAST = "\U0010ffff"  # sorts after every character


def pattern(template: str, classes: list[str]) -> str:
    """The possessive pattern of a template, by the classes of its wildcards: an inner wildcard may be empty, a final one may not."""
    parts, out, k = symbols(template), [], 0
    for i, s in enumerate(parts):
        if s != WILD:
            out.append(re.escape(s))
            continue
        chars, k = classes[k] if k < len(classes) else "", k + 1
        final = i == len(parts) - 1
        if not chars:
            out.append("(?!)" if final else "")
            continue
        known = ("0-9" if "0-9" in chars else "") + ("a-zA-Z" if "a-zA-Z" in chars else "")
        rest = chars.replace("0-9", "").replace("a-zA-Z", "")
        out.append(f"[{known}{''.join(re.escape(c) for c in rest)}]" + ("++" if final else "*+"))
    return "^" + "".join(out) + "$"


def order_key(template) -> Column:
    """Templates in order of preference: at the first difference a constant comes before a wildcard."""
    return F.replace(template, F.lit(WILD), F.lit(LAST))


def literal_prefix(template: str) -> str:
    """The text before the first wildcard."""
    return "".join(itertools.takewhile(lambda s: s != WILD, symbols(template)))


class Index:
    """Patterns by the literal prefix of their templates: a text tries those alone whose prefix it begins with."""

    def __init__(self, table: list[tuple]):
        self.by_length: dict[int, dict[str, list]] = {}
        for n, (cid, prefix, p) in enumerate(table):
            self.by_length.setdefault(len(prefix), {}).setdefault(prefix, []).append((n, cid, regex.compile(p)))

    def first(self, text: str | None):
        """The id of the first pattern in the table's order that matches."""
        if text is None:
            return None
        tried = [x for n, held in self.by_length.items() for x in held.get(text[:n], ())]
        return next((cid for _, cid, p in sorted(tried, key=lambda x: x[0]) if p.search(text)), None)


#: Lengths of literal prefixes on which texts and templates meet in a join.
PREFIXES = (16, 8, 4, 2, 1)


def matched(logs: DataFrame, templates: DataFrame, log_col: str = "content", limit: int = 200_000) -> DataFrame:
    """logs plus cid: the preferred template that matches, or null. templates(cid, template, pattern).

    Distinct texts are matched, by the literal prefix of the templates. A table of at most `limit` rows
    goes to every worker; beyond that, texts and templates meet on prefixes in a join.
    """
    ship(logs.sparkSession)
    distinct = logs.select(log_col).where(F.col(log_col).isNotNull()).distinct()
    if templates.limit(limit + 1).count() <= limit:
        rows = templates.select("cid", "template", "pattern", order_key("template").alias("k")).orderBy("k", "cid", "pattern").collect()
        shared = logs.sparkSession.sparkContext.broadcast([(r["cid"], literal_prefix(r["template"]), r["pattern"]) for r in rows])
        kind = to_arrow_type(templates.schema["cid"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.first(x) for x in batch.column(0).to_pylist()], kind)], [log_col, "cid"])

        best = distinct.mapInArrow(run, f"`{log_col}` string, cid {templates.schema['cid'].dataType.simpleString()}").where("cid is not null")
    else:
        prefix = F.substring_index(F.regexp_replace("template", r"<\*>|<>|<\*|\*>", "\u0001"), "\u0001", 1)
        length = F.coalesce(*(F.when(F.length("prefix") >= n, F.lit(n)) for n in PREFIXES), F.lit(0))
        keyed = templates.select("cid", "pattern", order_key("template").alias("k"), prefix.alias("prefix")).withColumn("length", length)
        keyed = keyed.withColumn("start", F.expr("left(prefix, length)")).drop("prefix")
        starts = F.array(*(F.struct(F.lit(n).alias("length"), F.left(F.col(log_col), F.lit(n)).alias("start")) for n in (*PREFIXES, 0)))
        spread = distinct.select(log_col, F.inline(starts))
        hits = spread.join(keyed, ["length", "start"]).where(F.rlike(F.col(log_col), F.col("pattern")))
        best = hits.groupBy(log_col).agg(F.min_by("cid", F.struct("k", "cid")).alias("cid"))
    return logs.join(best, log_col, "left")
