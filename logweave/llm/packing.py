"""Sum-of-squares online packing of documents into token windows.

Each task packs the documents it tokenises, as they come. A document longer than
a window fills whole windows; the rest goes online to the fill level that keeps
the sum of squared counts of partially filled windows smallest, tracked in one
array by level. Only windows that are open are held, at most `open_windows`
of them: beyond that the fullest one is closed with the next document cut to
fit. When a task ends, what is open is laid end to end and cut into full windows
and power-of-two tails, which need no padding. Nothing is shuffled, and a task
that is run again yields the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import rows_for, table
from logweave.llm.words_bpe import WordIds

END_ID = 2
_memory: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Online sum-of-squares placement. `emit` gets a list of pieces for each closed window.

    A piece is (document, start, ids); a document is whatever the caller passes.
    """

    def __init__(self, capacity: int, emit, open_windows: int = 64):
        self.capacity, self.emit, self.most = capacity, emit, open_windows
        self.count = np.zeros(capacity + 1, np.int64)  # open windows by level; levels 0 and capacity stay 0
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level h (0: a new window) that gives the smallest sum of squares
        after h's window becomes one of level h + size; the fuller one on ties."""
        c = self.capacity
        after = 2 * self.count[size : c + 1] + 1
        after[-1] = 0  # a full window counts no more
        before = 1 - 2 * self.count[: c - size + 1]
        before[0] = 0
        change = np.where(self.count[: c - size + 1] > 0, after + before, np.iinfo(np.int64).max)
        change[0] = after[0]
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.capacity:
            self.emit([(doc, start, ids[start : start + self.capacity])])
            start += self.capacity
        while start < n:
            size = n - start
            level = self.level_for(size)
            if not level and sum(map(len, self.open.values())) >= self.most:
                level = max(self.open)  # closes it, with what fits
                size = min(size, self.capacity - level)
            window = self._take(level) if level else []
            window.append((doc, start, ids[start : start + size]))
            self._put(level + size, window)
            start += size

    def _take(self, level: int) -> list:
        held = self.open[level]
        window = held.pop()
        self.count[level] -= 1
        if not held:
            del self.open[level]
        return window

    def _put(self, level: int, window: list) -> None:
        if level == self.capacity:
            self.emit(window)
        else:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1

    def finish(self) -> None:
        """Cut what is open into full windows and power-of-two tails."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        left, total = [], sum(len(p[2]) for p in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        pieces.reverse()
        for size in sizes:
            left = []
            while size:
                doc, start, ids = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc, start + size, ids[size:]))
                    ids = ids[:size]
                left.append((doc, start, ids))
                size -= len(ids)
            self.emit(left)
        self.open.clear()
        self.count[:] = 0


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = END_ID, open_windows: int = 64, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids.

    A null or empty text is its end id alone. Rows that repeat an id, or have a
    null one, are documents of their own. An empty table gives no rows. A
    sequence's length is the capacity or a power of two. sequence_id is the task's
    number shifted left by 32 bits plus the window's number in the task.
    """
    rows = rows_for(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _memory.get(tokenizer) or _memory.setdefault(tokenizer, WordIds(tokenizer))
        number, ready = TaskContext.get().partitionId() << 32, []

        def emit(window: list) -> None:
            nonlocal number
            offset = 0
            for (name, size), start, ids in window:
                raw = ids.astype("<u4").tobytes()
                ready.append((name, start, len(ids), zlib.crc32(raw), size, number, offset, ids if with_ids else None))
                offset += len(ids)
            number += 1

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [()] * 8
            ready.clear()
            kinds = [id_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            out = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(out if with_ids else out[:-1], names if with_ids else names[:-1])

        packer, id_type = Packer(capacity, emit, open_windows), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.ids(text, end=end_id)
                packer.add((name, len(ids)), ids)
            yield rows_out()
        if id_type is not None:
            packer.finish()
            yield rows_out()

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
