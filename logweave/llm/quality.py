"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

A text's statistics (shares of character classes, word and line shapes,
repetition) are standardised on the training rows and mapped to
cos(W x + b), whose inner products approximate a Gaussian kernel. Each partition
adds up its normal equations, partitions are added up by lots; their sum is solved on the driver, whose size
depends on the number of features alone. Two halves of the training rows score
each other for the isotonic step, which turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import added, cut, labels_of, remainder, rows_for, table, text_key

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "newline": (10,), "space": (32, 9), "stop": b".,;:", "mark": b"!?",
    "symbol": b"%$#*&|<>{}[]=+~^\\/_@", "quote": b"'\"()-`", "high": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
WIDTH = 28


def statistics(text: bytes | None) -> np.ndarray:
    """WIDTH statistics of a whole text; an empty or null one has zeros."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    codes = np.frombuffer(text, np.uint8)
    n, c = len(codes), len(_CLASSES) + 1
    out[:c] = np.bincount(_CLASS_OF[codes], minlength=c) / n
    words = text.split()
    if not words:
        return out
    space = _SPACE[codes]
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = codes[np.flatnonzero(~space & np.r_[True, space[:-1]])]
    last = codes[np.flatnonzero(~space & np.r_[space[1:], True])]
    seen = Counter(words)
    counts = np.fromiter(seen.values(), np.int64, len(seen))
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_length = np.fromiter(map(len, lines), np.int64, len(lines))
    pairs = len({*zip(words, words[1:], strict=False)})
    m = len(words)
    out[c:] = [
        np.log1p(n), np.log1p(m), length.mean(), length.std(), np.log(length.max()), len(seen) / m, len(seen) / np.sqrt(m), counts.max() / m,
        (counts[counts > 1].sum()) / m, pairs / max(m - 1, 1), sum(map(bytes.__eq__, words, words[1:])) / m,
        np.isin(first, list(range(65, 91))).mean(), np.isin(last, list(b".,;:!?")).mean(), np.isin(last, list(b"%$#*&|!")).mean(),
        np.log1p(line_length.mean()), len(set(lines)) / len(lines),
    ]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(id, text, further columns) -> (id, further columns, x)."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), x], [*kept, "x"])

    return docs.mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept), "x array<double>"]))


def isotonic(value: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (value, probability), both ascending."""
    stack: list[list[float]] = []
    for v, w, y in zip(value, weight, mean, strict=True):
        stack.append([v * w, w, y * w])
        while len(stack) > 1 and stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    blocks = np.array(stack)
    return blocks[:, 0] / blocks[:, 1], blocks[:, 2] / blocks[:, 1]


@dataclass
class Model:
    """What scoring needs; `constant` stands alone if the training rows have one class or none."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    shift: np.ndarray | None = None
    beta: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.weights + self.shift), z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.features(x) @ self.beta, *self.knots), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def fit(train: DataFrame, features: int = 160, width: float = 6.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> Model:
    """train: (fold 0 or 1, x, y 0 or 1)."""
    train = cut(train)
    one = train.groupBy().agg(
        F.count("*").alias("n"), F.sum("y").alias("k"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(WIDTH)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(WIDTH)],
    ).first()
    if not one["n"] or one["k"] in (0, one["n"]):
        return Model(constant=0.5 if not one["n"] else float(one["k"] > 0))
    rng = np.random.default_rng(seed)
    scale = np.array([one[f"s{i}"] for i in range(WIDTH)])
    model = Model(
        mean=np.array([one[f"m{i}"] for i in range(WIDTH)]), scale=np.where(scale > 1e-9, scale, 1.0),
        weights=rng.normal(size=(WIDTH, features)) / width, shift=rng.uniform(0, 2 * np.pi, features),
    )
    size = 1 + features + WIDTH

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            fold, y, f = batch.column("fold").to_numpy(), batch.column("y").to_numpy(), model.features(_matrix(batch))
            for k in (0, 1):
                part = f[fold == k]
                total[k] += part.T @ np.column_stack([part, y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    both = added(train.mapInArrow(normal, "v array<double>"), 2 * size * (size + 1)).reshape(2, size, size + 1)
    solve = lambda m: np.linalg.solve(m[:, :size] + ridge * (1 + m[0, 0]) * np.eye(size), m[:, size])
    model.beta = solve(both.sum(axis=0))
    halves = np.stack([solve(both[1]), solve(both[0])])  # a half is scored by the other

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (model.features(_matrix(batch)) * halves[batch.column("fold").to_numpy()]).sum(axis=1)
            bin_ = np.clip((raw + 1) / 3 * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), batch.column("y")], ["bin", "y"])

    found = train.mapInArrow(scores, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("p")).orderBy("bin").collect()
    at = np.array([[(r["bin"] + 0.5) / bins * 3 - 1, r["n"], r["p"]] for r in found]).T
    model.knots = isotonic(*at)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1, label: str = "quality", keyed: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) and, if `keyed`, the text_key, for every row of docs.

    Labels are learnt from ids whose crc32 modulo `modulus` is not `held`; all such
    rows count. Empty and null texts are scored by their zeros; a null id is
    never a training row of its own label but is scored; rows that repeat an id
    are scored each; very long texts are read whole. Without labels every score is 0.5, with one class its label.
    An empty table gives no rows; other columns of docs are ignored.
    """
    plain = rows_for(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    plain = plain.withColumn("text_key", text_key())
    rated = cut(measured(plain).withColumn("r", remainder("id", modulus)))
    known = labels_of(labels, label)
    fold = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold")
    train = rated.where(F.col("r") != held).join(known, "id").select(fold, "x", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    model = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(_matrix(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "r", "text_key")), pa.array(p)], ["id", "r", "text_key", "score"])

    kind = rated.schema["id"].dataType.simpleString()
    out = rated.mapInArrow(run, f"id {kind}, r bigint, text_key bigint, score double")
    return out.select(F.col("id").alias(id_col), (F.col("r") == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["text_key"] * keyed)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
