"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns `points` virtual nodes,
each in the cell of its hash; a row's key falls into a cell and belongs to the
first virtual node clockwise of it. A shard that is full passes the rest of a
cell on, clockwise, to the next shard with room. Capacities are the row count
shared out evenly, the first shards getting one more each, so counts differ by one
at most. Rows of one cell differ in nothing but their place in it, so the
overflow needs only the number of rows in each cell, as many numbers as there are
cells whatever the input's size. Each row then finds its shard and slot from its
rank within its cell, by a join with the cells' segments.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import mix, rows_for, table


def ring(shards: int, points: int, bits: int) -> tuple[list[int], list[int]]:
    """The virtual nodes' shards in ring order, and for each cell the first node at or after it.

    A shard's cells do not depend on the number of shards.
    """
    seeds = (np.arange(shards, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(points, dtype=np.uint64)
    cells = (mix(mix(seeds + np.uint64(1))).ravel() >> np.uint64(64 - bits)).astype(np.int64)
    owners = np.repeat(np.arange(shards), points)
    order = np.lexsort((owners, cells))
    return owners[order].tolist(), (np.searchsorted(cells[order], np.arange(1 << bits)) % len(order)).tolist()


def overflow(counts: list[int], first: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each cell the (shard, rows) it fills, in the order of its rows.

    First every cell offers its rows to its own node, in ring order; what finds
    the shard full moves on by one node at a time, until all are placed.
    """
    room, n = list(capacity), len(owners)
    placed: list[list[tuple[int, int]]] = [[] for _ in counts]
    waiting = [(cell, first[cell], rows) for cell, rows in enumerate(counts) if rows]
    while waiting:
        further = []
        for cell, node, rows in waiting:
            shard = owners[node]
            take = min(rows, room[shard])
            if take:
                room[shard] -= take
                placed[cell].append((shard, take))
            if rows > take:
                further.append((cell, (node + 1) % n, rows - take))
        waiting = further
    return placed


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, points: int = 64, bits: int = 13) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shard 0..shards-1, slots gapless from 0 within one.

    The key is the id with the text's checksum and size, so that rows which repeat
    an id spread unless they are equal throughout. A null text has 16 bytes and
    checksum 0; null ids are hashed by the text alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows_for(docs, id=id_col, text=text_col).select("id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("place", F.xxhash64("id", "text_crc32", "size"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("place", 64 - bits).cast("int"))
    owners, first = ring(shards, points, bits)
    counted = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row a cell at most
    counts = [counted.get(k, 0) for k in range(1 << bits)]
    total = sum(counts)
    placed = overflow(counts, first, owners, [total // shards + (k < total % shards) for k in range(shards)])

    filled, segments = [0] * shards, []
    for cell, parts in enumerate(placed):
        rank = 1
        for k, n in parts:
            segments.append((cell, rank, rank + n, k, filled[k] - rank))
            filled[k] += n
            rank += n
    seats = F.broadcast(spark.createDataFrame(segments, "at int, low bigint, high bigint, shard int, base bigint"))  # cells and shards bound it
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("place", "id", "text_crc32", "size")))
    out = ranked.join(seats, (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
