"""Connected components of an edge table, by randomised contraction.

Each round every node points to the neighbour (or itself) of the smallest hash
under that round's seed, and on to that one's target; edges are rewritten to the
targets, loops and repeats dropped. Stars collapse in one round and chains shrink by a
constant factor, so rounds grow with the logarithm of the longest path. No step
gathers a node's neighbours: only minima are taken, which combine before the
shuffle. Once at most `SMALL` edges are left, one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, forget, renamed

#: Edges that one task may finish: a fixed bound, whatever the input.
SMALL = 15_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a few edges (a, b): (node, to)."""
    above: dict = {}

    def root(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            low, high = sorted((root(a), root(b)))
            above[high] = low
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([root(x) for x in list(above)], kind)], ["node", "to"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges(a, b) -> (node, root): every node of an edge, with one node that
    stands for its component. Null ends are ignored; an empty table gives none."""
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    live = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = live.schema["a"].dataType.simpleString()
    seed, steps = 0, []
    while left := live.count():
        if left <= small:
            steps.append(cut(live.coalesce(1).mapInArrow(_finish, f"node {kind}, to {kind}")))
            break
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        ends = live.union(live.select("b", "a"))
        hop = ends.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        hop = cut(hop.select("node", F.least(F.col("m"), rank(F.col("node")))["id"].alias("to")))
        on = hop.select(F.col("node").alias("at"), F.col("to").alias("then"))
        target = cut(hop.join(on, hop["to"] == on["at"]).select("node", F.col("then").alias("to")))
        steps.append(target)
        forget(hop)
        moved = live.join(target, live.a == target.node).select(F.col("to").alias("a"), "b")
        moved = moved.join(target, moved.b == target.node).select("a", F.col("to").alias("b")).where("a <> b")
        above, live = live, cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        forget(above)
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if len(steps) == 1:
        forget(live)
        return renamed(steps[0], node="node", to="root")
    found = steps[0].select("node", F.col("to").alias("root"))
    for target in steps[1:]:
        target = target.select(F.col("node").alias("at"), "to")
        found = found.join(target, found.root == target["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
    found = cut(found)
    forget(live, *steps)
    return found
