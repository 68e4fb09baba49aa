"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Training counts tokens in toxic and other documents. A token is seen through
its whole word and its first four and five letters, hashed into a fixed number of
classes; a class's log-odds carry an informative Dirichlet prior (the corpus's own
shares) and are drawn towards zero by `caution` standard errors, so that rare
tokens weigh nothing. A word takes the evidence of its most telling class,
less a drift that makes ordinary text score below zero. One linear scan finds every
maximal segment of positive score; a segment's score is normalised with the
Karlin-Altschul parameters of non-toxic text and the text's length. The
significant segments of a text together give its statistic, which a logistic
curve turns into a probability. K and the curve come from texts scored by the counts of others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, forget, labels_of, remainder, rows_for, table, text_key

_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def units(word: bytes, classes: int) -> list[int]:
    """The hashed classes of a word: whole, first four and first five characters."""
    text = word.strip(_EDGE).decode("utf-8", "replace").lower()
    if not text:
        return []
    kinds = ["=" + text, *("^" + text[:n] for n in (4, 5) if len(text) >= n)]
    return [xxhash.xxh3_64_intdigest(k) % classes for k in kinds]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Each open segment knows the nearest earlier one that begins at a smaller total, so that a search
    passes over a segment once. Non-positive tokens between two positive ones are passed over at once.
    """
    total = [0.0, *np.cumsum(scores).tolist()]  # plain numbers: they are looked at one by one
    open_: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest earlier of smaller total before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, total[i], total[i + 1]
        j = len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= high:
                break
            start, _, low, _, earlier = open_[j]
            del open_[j:]
            j = earlier
        open_.append((start, end, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in open_]


class Scores(dict):
    """word -> score, bounded."""

    def __init__(self, evidence: np.ndarray, drift: float, limit: int = 500_000):
        super().__init__()
        self.evidence, self.drift, self.limit = evidence, drift, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        found = self.evidence[units(word, len(self.evidence))]
        best = float(found[np.argmax(np.abs(found))]) if len(found) else 0.0
        value = self[word] = best - self.drift
        return value


@dataclass
class Model:
    constant: float | None = None
    evidence: np.ndarray | None = None
    drift: float = 0.0
    rate: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # K
    level: float = -2.0  # least normalised score of a significant segment
    curve: tuple[float, float] = (0.0, 1.0)

    def passages(self, text: bytes | None, words: Scores) -> list[tuple[int, int, float]]:
        """Significant segments of a whole text: first word, word after the last, normalised score."""
        found = text.lower().split() if text else []
        if not found:
            return []
        s = np.fromiter(map(words.__getitem__, found), np.float64, len(found))
        base = np.log(self.size * len(found))
        return [(a, b, z) for a, b, x in segments(s) if (z := self.rate * x - base) >= self.level]


def statistic(found: list[tuple[int, int, float]]) -> float:
    """One number for a text: the logarithm of 1 plus the inverse expected counts of its segments; 0 without any."""
    return float(np.logaddexp.reduce([0.0, *(z for *_, z in found)]))


def _karlin(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p e^(x s) = 1; the mean score is negative and some score positive."""
    low, high = 1e-6, 1.0
    mass = lambda x: float((shares * np.exp(np.minimum(x * scores, 600))).sum())
    while mass(high) < 1 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < 1 else (low, mid)
    return (low + high) / 2


def _model(counts: np.ndarray, strength: float, caution: float, drift: float, level: float) -> Model:
    """counts: tokens by other or toxic, and class."""
    size = counts.sum(axis=1)
    if not size.all():
        return Model(constant=0.5 if not size.any() else float(size[1] > 0))
    prior = strength * (counts.sum(axis=0) + 0.01) / (size.sum() + 0.01 * counts.shape[1])
    odds = lambda k: np.log((counts[k] + prior) / (size[k] + strength - counts[k] - prior))
    delta, error = odds(1) - odds(0), np.sqrt(1 / (counts[1] + prior) + 1 / (counts[0] + prior))
    evidence = np.sign(delta) * np.maximum(np.abs(delta) - caution * error, 0)
    # scores of non-toxic text, in cells: their law gives the rate of the extreme-value law
    cells, at = np.unique(np.round(evidence - drift, 2), return_inverse=True)
    share = np.bincount(at, counts[0], len(cells)) + 1e-3
    share /= share.sum()
    mean = float((cells * share).sum())
    if mean >= 0:
        drift += mean + 0.05
        cells = cells - mean - 0.05
    rate = _karlin(cells, share) if cells.max() > 0 else 1.0
    return Model(evidence=evidence, drift=drift, rate=rate, level=level)


def fit(train: DataFrame, classes: int = 1 << 18, strength: float = 1000.0, caution: float = 2.0, drift: float = 0.1, level: float = -2.0, at: float = 3.0) -> Model:
    """train: (text, y, fold 0 or 1), a bounded sample. strength: the prior's weight in tokens.

    Each half is scored by the counts of the other. K is what the non-toxic texts then show: so many
    segments a token reach the rate times score `at`, against e^-at. The curve is fitted on the same scores.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, classes), np.int64)
        seen = [Counter() for _ in range(4)]  # twice the fold plus the label

        def flush() -> None:
            for k, words in enumerate(seen):
                for word, n in words.items():
                    for unit in units(word, classes):
                        total[k, unit] += n
                words.clear()

        for batch in batches:
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                seen[2 * fold + y].update(text.lower().split() if text else ())
                if len(seen[2 * fold + y]) > 300_000:
                    flush()
        flush()
        unit = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(unit), *(pa.array(total[k, unit]) for k in range(4))], ["unit", *_COUNTS])

    train = cut(train)
    rows = train.mapInArrow(count, "unit bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)).groupBy("unit").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    got = rows.toPandas()  # `classes` rows at most
    counts = np.zeros((2, 2, classes))
    counts.reshape(4, classes)[:, got["unit"].to_numpy(np.int64)] = got[_COUNTS].to_numpy(np.float64).T
    options = (strength, caution, drift, level)
    model, halves = _model(counts.sum(axis=0), *options), [_model(counts[1 - k], *options) for k in (0, 1)]
    if model.constant is not None or any(m.constant is not None for m in halves):
        return model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Scores(m.evidence, m.drift) for m in halves]
        for batch in batches:
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                n = len(text.split()) if text else 0
                z = [x for *_, x in replace(halves[fold], level=-at - np.log(n + 1)).passages(text, words[fold])]
                out.append((n, sum(x + np.log(n) >= at for x in z), [x for x in z if x >= level - 10]))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64()))))], ["y", "n", "over", "z"])

    rated = train.mapInArrow(score, "y int, n bigint, over bigint, z array<double>").toPandas()  # the sample, a few numbers a text
    other = rated[rated["y"] == 0]
    model.size = float((other["over"].sum() + 0.5) / max(other["n"].sum(), 1) * np.exp(at))
    stat = np.array([statistic([(0, 0, x - np.log(model.size)) for x in z if x - np.log(model.size) >= level]) for z in rated["z"]])
    cells, where = np.unique(np.round(stat, 2), return_inverse=True)
    model.curve = _logistic(cells, np.bincount(where).astype(float), np.bincount(where, rated["y"].to_numpy(float)))
    forget(train)
    return model


_COUNTS = ["other0", "toxic0", "other1", "toxic1"]


def _logistic(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of k of n successes at x, with a weak prior; Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (k - n * p) - 0.01 * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), gradient)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, label: str = "toxic", sample: int = 50_000, spans: bool = False, keyed: bool = False, **options) -> DataFrame:
    """(id, held_out, score, predicted, n_passages) and, on request, the passages and the text_key, for every row of docs.

    Labels are learnt from ids whose crc32 modulo `modulus` is not `held`; token
    counts, K and the curve come from at most about `sample` of these, chosen by hash of the id, and once for each text. Empty and null
    texts have no passage; very long ones are scanned whole, in linear time; a null id is scored but never learnt from; rows that
    repeat an id are scored each. Without labels every score is 0.5. An empty table gives no rows; other columns of docs are ignored.
    """
    plain = rows_for(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary")).withColumn("r", remainder("id", modulus)).withColumn("text_key", text_key())
    known = labels_of(labels, label).where(remainder("id", modulus) != held)
    known = cut(known.withColumn("y", F.when(F.col("y") > 0, 1).otherwise(0)))
    cells = 1 << 20
    share = min(cells, int(cells * sample / max(known.count(), 1)))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(cells)) < share)
    train = plain.join(F.broadcast(chosen), "id")  # ids and labels of `sample` rows: under a megabyte
    once = train.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"), F.max("y").alias("y"))  # copies of a text count once
    fold = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).cast("int").alias("fold")
    model = fit(plain.join(F.broadcast(cut(once.select("id", "y"))), "id").select("text", "y", fold), **options)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Scores(model.evidence, model.drift) if model.constant is None else None
        for batch in batches:
            found = [model.passages(t, words) if words is not None else [] for t in batch.column("text").to_pylist()]
            stat, n = pa.array([statistic(x) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int32())
            cut_ = pa.array([[{"start": a, "end": b, "score": z} for a, b, z in x] if spans else None for x in found], span_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "r", "text_key")), stat, n, cut_], ["id", "r", "text_key", "stat", "n_passages", "passages"])

    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    rated = cut(plain.mapInArrow(run, f"id {kind}, r bigint, text_key bigint, stat double, n_passages int, passages array<struct<start:int,end:int,score:double>>"))
    if model.constant is None:
        score = 1 / (1 + F.exp(-(F.lit(model.curve[0]) + F.lit(model.curve[1]) * F.col("stat"))))
    else:
        score = F.lit(model.constant)
    columns = [F.col("id").alias(id_col), (F.col("r") == held).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("n_passages")]
    return rated.select(*columns, *["passages"] * spans, *["text_key"] * keyed)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
