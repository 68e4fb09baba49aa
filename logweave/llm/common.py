"""Helpers that several operators share: lineage cuts, reading tables, word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.lineage import cut, forget, renamed, sweep
from logweave.shipping import ship

__all__ = ["added", "cut", "forget", "labels_of", "mix", "remainder", "renamed", "rows_for", "shingles", "sweep", "table", "text_key", "WordTable"]

#: Distinct words that one Python worker remembers before it starts afresh.
WORD_CACHE = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_for(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under the operator's own names, so that further
    columns of docs cannot clash; the workers get the package on the way."""
    ship(docs.sparkSession)
    return docs.select(*(docs[old].alias(new) for new, old in columns.items()))


def text_key(column: str = "text"):
    """A hash of the text, which tells rows of one id (or of none) apart."""
    return F.xxhash64(F.col(column).cast("binary")).alias("text_key")


def remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; null ids count as remainder 0 of crc32('')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


class WordTable(dict):
    """word bytes -> 64-bit hash, bounded: it empties itself when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), elementwise over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, width: int, words: WordTable) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of a text.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space. A
    text of 1..width-1 words is one shingle as a whole; no words, no shingle.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    span = min(width, len(found))
    out = h[: len(h) - span + 1].copy()
    for k in range(1, span):
        out = out * _STEP + h[k : len(h) - span + 1 + k]
    return np.unique(mix(out + np.uint64(span)))


def added(df: DataFrame, size: int, lot: int = 16) -> np.ndarray:
    """The elementwise sum of an array column v of `size` numbers, one row a partition of df or few.

    Rows are added up by lots of `lot` partitions, those by lots again, until one lot is left for
    the driver: no task adds more than its lot's rows, however many partitions there are.
    """

    def total(rows: pa.Table) -> pa.Table:
        out = np.zeros(size)
        for chunk in rows.column("v").chunks:
            out += chunk.flatten().to_numpy().reshape(-1, size).sum(axis=0)
        return pa.table([rows.column("lot").slice(0, 1), pa.array([out], pa.list_(pa.float64()))], names=["lot", "v"])

    lots, df = df.rdd.getNumPartitions(), df.select(F.spark_partition_id().alias("lot"), "v")
    while lots > lot:
        lots = -(-lots // lot)
        df = df.withColumn("lot", F.floor(F.col("lot") / lot).cast("int")).groupBy("lot").applyInArrow(total, "lot int, v array<double>")
    return sum((np.array(r["v"]) for r in df.toLocalIterator()), np.zeros(size))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(id, y): one label an id, the larger of several; ids or labels that are null are left out."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(column).alias("y")).where("id is not null and y is not null")
    return known.groupBy("id").agg(F.max("y").cast("int").alias("y"))
