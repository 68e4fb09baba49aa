"""Embedding near-duplicates: PCA-ordered, tiled, exact cosine comparison.

Equal vectors are one class from the start. Unit vectors are rotated to their
principal axes, which leaves products as they are, and cut into tiles by a k-d tree over the
leading ones. A pair of tiles is compared only if boxes around their leading
coordinates come near enough. Within it, products of the leading dimensions are
accumulated first; what the rest can add is bounded by the suffix norms (Cauchy and
Schwarz), and a pair is dropped once its cosine cannot reach the threshold. What
is left is confirmed on the vectors themselves, in double precision. A pair of
tiles reports for each of its vectors the number of links and one spanning
edge, so that its output is linear in its rows however dense the links are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import added, cut, rows_for, table
from logweave.llm.components import components

BOX = 8  # leading coordinates of a tile's box


def _packed(kind: str) -> str:
    return {"float": "<f4", "double": "<f8"}[kind]


def _unit(batch, dim: int) -> np.ndarray:
    x = batch.column("v").combine_chunks() if isinstance(batch, pa.Table) else batch.column("v")
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, lead: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (unit vectors) with cosine at or above the threshold; i < j if same."""
    ra, rb = a @ axes, b @ axes
    dim = a.shape[1]
    cuts = [k for k in (lead, 2 * lead, 4 * lead) if k < dim]
    suffix = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0))
    sa, sb = [suffix(ra, k) for k in cuts], [suffix(rb, k) for k in cuts]
    out_i, out_j = [], []
    k0 = cuts[0] if cuts else dim
    b32 = np.ascontiguousarray(rb[:, :k0].astype(np.float32).T)
    for start in range(0, len(a), block):
        rows = slice(start, start + block)
        first = ra[rows, :k0].astype(np.float32) @ b32
        if cuts:
            first += np.multiply.outer(sa[0][rows].astype(np.float32), sb[0].astype(np.float32))
        i, j = np.nonzero(first >= threshold - 1e-4)  # single precision is only a sieve, with slack
        i = i + start
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 200_000):
            p, q = i[part : part + 200_000], j[part : part + 200_000]
            reached = np.einsum("ij,ij->i", ra[p, :k0], rb[q, :k0])
            for n, k in enumerate(cuts[1:], 1):
                reached = reached + np.einsum("ij,ij->i", ra[p, cuts[n - 1] : k], rb[q, cuts[n - 1] : k])
                can = reached + sa[n][p] * sb[n][q] >= threshold - 1e-9
                p, q, reached = p[can], q[can], reached[can]
            sure = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
            out_i.append(p[sure])
            out_j.append(q[sure])
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(out_i), join(out_j)


def _lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and edges i-j the smallest node of each one's component."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def _halved(rows: np.ndarray, leaves: int, names) -> tuple | int:
    """A k-d tree of so many leaves: (axis, value, below, above), split along the axis of the widest spread; a leaf is its number."""
    spread = rows.std(axis=0) if len(rows) > 16 else np.zeros(1)
    if leaves < 2 or not spread.any():
        return next(names)
    axis = int(spread.argmax())
    low = leaves // 2
    value = float(np.quantile(rows[:, axis], low / leaves))
    below = rows[:, axis] <= value
    if below.all() or not below.any():
        return next(names)
    return axis, value, _halved(rows[below], low, names), _halved(rows[~below], leaves - low, names)


def _leaf_of(tree: tuple | int, rows: np.ndarray) -> np.ndarray:
    out, waiting = np.empty(len(rows), np.int64), [(tree, np.arange(len(rows)))]
    while waiting:
        node, at = waiting.pop()
        if isinstance(node, int):
            out[at] = node
            continue
        axis, value, low, high = node
        below = rows[at, axis] <= value
        waiting += [(low, at[below]), (high, at[~below])]
    return out


def _tiles(classes: DataFrame, dim: int, axes: np.ndarray, size: int, sample: int = 100_000) -> DataFrame:
    """(tile, low, high, cls, n, v): vectors by leaves of a k-d tree over their leading principal coordinates, `size` to a tile or so.

    The tree is fitted on some `sample` vectors at most, chosen by hash; every vector is in a tile, whose box holds all its members.
    """
    kind = classes.schema["v"].dataType.elementType.simpleString()
    box = min(BOX, dim)

    def first(batches):
        for batch in batches:
            lead = _unit(batch, dim) @ axes[:, :box]
            y = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * box), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), y, batch.column("v")], ["cls", "n", "y", "v"])

    placed = cut(classes.mapInArrow(first, f"cls bigint, n bigint, y array<double>, v array<{kind}>"))
    count, cells = placed.count(), 1 << 20
    share = min(cells, int(cells * sample / max(count, 1)))
    seen = placed.where(F.pmod(F.xxhash64("cls"), F.lit(cells)) < share).select("y").toPandas()["y"]
    tree = _halved(np.array(seen.tolist(), np.float64).reshape(-1, box), max(1, -(-count // size)), itertools.count())

    def number(batches):
        for batch in batches:
            tile = _leaf_of(tree, batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, box))
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(batch.column(c) for c in ("cls", "n", "v"))], ["tile", "cls", "n", "v"])

    def lay(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(_unit(group, dim) @ axes[:, 0], kind="stable"))
        rows = {c: [] for c in ("tile", "low", "high", "cls", "n", "v")}
        for k, at in enumerate(range(0, group.num_rows, 2 * size)):
            part = group.slice(at, 2 * size)
            lead = _unit(part, dim) @ axes[:, :BOX]
            rows["tile"].append((part.column("tile")[0].as_py() << 20) + k)
            rows["low"].append(lead.min(axis=0))
            rows["high"].append(lead.max(axis=0))
            for c in ("cls", "n"):
                rows[c].append(part.column(c).to_numpy().astype("<i8").tobytes())
            rows["v"].append(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(_packed(kind)).tobytes())
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    numbered = placed.mapInArrow(number, f"tile bigint, cls bigint, n bigint, v array<{kind}>")
    return cut(numbered.groupBy("tile").applyInArrow(lay, "tile bigint, low array<double>, high array<double>, cls binary, n binary, v binary"))


def _near(tiles: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes are within `reach`; found by cells of the first two coordinates."""
    cell = lambda c, k: F.floor(F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0.0)) / reach)
    box = tiles.select("tile", "low", "high")

    def spread(s: str, more: int) -> DataFrame:
        rows = box.select(F.col("tile").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
        for k in (1, 2):
            rows = rows.withColumn(f"cell{k}", F.explode(F.sequence(cell(f"low_{s}", k) - more, cell(f"high_{s}", k) + more)))
        return rows

    gap = F.aggregate(
        F.arrays_zip("low_a", "high_a", "low_b", "high_b"), F.lit(0.0),
        lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["low_a"] - x["high_b"], x["low_b"] - x["high_a"]), F.lit(2)),
    )
    met = spread("a", 0).join(spread("b", 1), ["cell1", "cell2"]).where(F.col("a") <= F.col("b"))
    return met.where(gap <= reach * reach + 1e-9).select("a", "b").distinct()


def _compared(classes: DataFrame, dim: int, threshold: float, size: int) -> DataFrame:
    """(cls, links, low) by pair of tiles, for the vectors that have links there."""

    def outer(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(batch, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    spread = added(classes.mapInArrow(outer, "v array<double>"), dim * dim).reshape(dim, dim)
    axes = np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1])
    lead, packed = max(1, dim // 4), _packed(classes.schema["v"].dataType.elementType.simpleString())

    def pair(group: pa.Table) -> pa.Table:
        row = {c: group.column(c)[0].as_py() for c in group.column_names}
        unit = lambda c: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))((lambda x: x / np.abs(x).max(axis=1, keepdims=True))(np.frombuffer(row[c], packed).astype(np.float64).reshape(-1, dim)))
        same = row["a"] == row["b"]
        ids, weight = ([np.frombuffer(row[f"{c}_{s}"], "<i8") for s in "ab"] for c in ("cls", "n"))
        i, j = linked(unit("v_a"), unit("v_b"), axes, threshold, same, lead)
        shift = 0 if same else len(ids[0])
        j = j + shift
        names = ids[0] if same else np.concatenate(ids)
        weights = weight[0] if same else np.concatenate(weight)
        links = np.bincount(i, weights[j], len(names)) + np.bincount(j, weights[i], len(names))
        low = _lowest(i, j, len(names))
        have = np.flatnonzero(links)
        return pa.table([pa.array(names[have]), pa.array(links[have].astype(np.int64)), pa.array(names[low[have]])], names=["cls", "links", "low"])

    tiles = _tiles(classes, dim, axes, size)
    near = cut(_near(tiles, float(np.sqrt(2 - 2 * threshold))))
    side = lambda s: tiles.select(F.col("tile").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "v")))
    return near.join(side("a"), "a").join(side("b"), "b").groupBy("a", "b").applyInArrow(pair, "cls bigint, links bigint, low bigint")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, size: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: all pairs of cosine at or above the threshold.

    Vectors that are null, empty, zero, or hold a null or a value that isn't finite have no link;
    nor have vectors of different lengths. Rows that repeat an id are rated each by
    its own vector; a null id counts as larger than any other. An empty table gives no rows; other columns are ignored.
    Numbers are kept as they are stored, and compared in double precision.
    """
    plain = rows_for(rows, id=id_col, v=vector_col)
    if plain.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        plain = plain.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    keyed = plain.withColumn("fit", F.coalesce(~bad, F.lit(False)))
    keyed = keyed.select("id", "fit", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2"))
    classes = keyed.where("fit").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    found = None
    for row in classes.groupBy(F.size("v").alias("dim")).count().collect():  # one row for each length of vectors
        part = _compared(classes.where(F.size("v") == row["dim"]).select("cls", "n", "v"), row["dim"], threshold, size)
        found = part if found is None else found.union(part)
    base = classes.select("cls", "h1", "h2", "id", "n")
    if found is None:
        rated = base.select("h1", "h2", F.lit(0).cast("bigint").alias("n_links"), "id")
    else:
        found = cut(found)
        links = found.groupBy("cls").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")))
        named = base.join(links, "cls", "left").join(roots, base["cls"] == roots.node, "left")
        named = cut(named.select("h1", "h2", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
        lowest = named.groupBy("root").agg(F.min("id").alias("low"))
        rated = named.join(lowest, "root").select("h1", "h2", "n_links", F.col("low").alias("id"))
    rated = rated.withColumnRenamed("id", "component")
    out = keyed.select("id", "fit", "h1", "h2").join(rated.withColumn("fit", F.lit(True)), ["fit", "h1", "h2"], "left")
    whole = F.when(F.col("fit"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), whole.alias("component_id"), whole.eqNullSafe(F.col("id")).alias("kept"))


#: All pairs, in DuckDB's SQL.
ORACLE = """
with recursive fit as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from fit a join fit b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95
), reached(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reached r join links l on r.b = l.a
), least_of as (
  select a, min(b) as component_id from reached group by a
), degree as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least_of on least_of.a = vec_id left join degree on degree.a = vec_id"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
