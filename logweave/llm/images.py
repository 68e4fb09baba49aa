"""Local image descriptors: copies of grey images, cropped or edited, by corners and geometric consensus.

At several scales, corners are local maxima of the Harris response. A corner's
orientation is that of its patch's centroid; a descriptor is `BITS` comparisons of
pixel pairs, turned by that orientation. Descriptors meet in a Hamming table:
each is cut into words of `WORD` bits and entered under every one, so that two
within BITS / WORD - 1 bits always share an entry; of two that differ by more, some word
is equal often enough that copies, which have many descriptors in common, share several entries. An entry's rows are joined with
one hub, never with each other: the member of the least hash, which varies with the
seed of the round. Entries whose members are of one component leave after each round.
A candidate pair is confirmed by matching both images'
descriptors and counting the matches that agree on one scale, turn and shift.

Copies that no hub joins are found by an exact check that follows: images meet block by block, and each pair of
two components that has matches enough for a link is confirmed likewise. No pair is
left out, so the result is that of all pairs; this part's work is quadratic in distinct images. Distances come from matrix
products that have three descriptors in a number, as digits to the base 256: sums are below 2^24, so floats are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, forget, mix, rows_for, table
from logweave.llm.components import components

BITS, WORD, RADIUS, TURNS = 128, 32, 6, 32
MOST = 20  # differing bits of a match
_APART = np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(11)
_pairs = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS, RADIUS)
_angle = np.arange(TURNS) * 2 * np.pi / TURNS
_cos, _sin = np.cos(_angle)[:, None], np.sin(_angle)[:, None]
#: Offsets (dy, dx) of both pixels of each test, by turn.
_TESTS = [(np.rint(_sin * _pairs[:, k] + _cos * _pairs[:, k + 1]).astype(int), np.rint(_cos * _pairs[:, k] - _sin * _pairs[:, k + 1]).astype(int)) for k in (0, 2)]
_oy, _ox = (x.ravel() for x in np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1])
_disc = _oy**2 + _ox**2 <= RADIUS**2
_oy, _ox = _oy[_disc], _ox[_disc]

#: One feature: place in the full image, scale step, turn, 128 bits.
FEATURE = np.dtype([("y", "<f4"), ("x", "<f4"), ("scale", "u1"), ("turn", "u1"), ("bits", "u1", BITS // 8)])


def _box(x: np.ndarray, r: int = 1) -> np.ndarray:
    """Mean over a square of 2r + 1 pixels, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        x = (np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)) / (2 * r + 1)
    return x


def features(images: np.ndarray, scales: int = 2, corners: int = 48, least: float = 1.0) -> list[np.ndarray]:
    """Features of each of a stack of equal-sized images (n, height, width); at most `corners` a scale, the strongest."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    level = images.astype(np.float64)
    edge = RADIUS + 2
    for step in range(scales):
        n, h, w = level.shape
        if min(h, w) <= 2 * edge:
            break
        smooth = _box(level)
        gy, gx = np.gradient(smooth, axis=1), np.gradient(smooth, axis=2)
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        strength = a * c - b * b - 0.05 * (a + c) ** 2
        peak = strength > least
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = np.roll(strength, (dy, dx), (1, 2))
                    peak &= (strength > near) if (dy, dx) > (0, 0) else (strength >= near)
        peak[:, :edge], peak[:, -edge:], peak[:, :, :edge], peak[:, :, -edge:] = False, False, False, False
        k, y, x = np.nonzero(peak)
        order = np.lexsort((x, y, -strength[k, y, x], k))
        k, y, x = k[order], y[order], x[order]
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        k, y, x = (v[rank < corners] for v in (k, y, x))
        if len(k):
            patch = smooth[k[:, None], y[:, None] + _oy, x[:, None] + _ox]
            patch = patch - patch.mean(axis=1, keepdims=True)
            turn = np.rint(np.arctan2(patch @ _oy, patch @ _ox) / (2 * np.pi) * TURNS).astype(int) % TURNS
            (ay, ax), (by, bx) = _TESTS
            one = smooth[k[:, None], y[:, None] + ay[turn], x[:, None] + ax[turn]]
            two = smooth[k[:, None], y[:, None] + by[turn], x[:, None] + bx[turn]]
            out = np.zeros(len(k), FEATURE)
            out["y"], out["x"], out["scale"], out["turn"] = y * 2**step, x * 2**step, step, turn
            out["bits"] = np.packbits(one > two + 0.5, axis=1)
            for i, at in zip(*np.unique(k, return_index=True), strict=True):
                found[i].append(out[at : np.searchsorted(k, i, "right")])
        level = level[:, : h - h % 2, : w - w % 2].reshape(n, h // 2, 2, w // 2, 2).mean(axis=(2, 4))
    return [np.concatenate(x) if x else np.zeros(0, FEATURE) for x in found]


def agreement(a: np.ndarray, b: np.ndarray, most: int = MOST, least: int = 1) -> int:
    """Matches between two images' features that agree on scale, turn and shift; fewer than `least` may be given as 0."""
    if not len(a) or not len(b):
        return 0
    x, y = (np.ascontiguousarray(f["bits"]).view("<u8") for f in (a, b))
    far = sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]) for k in range(BITS // 64))
    j = far.argmin(axis=1)
    i = np.arange(len(a))
    good = (far[i, j] <= most) & (far.argmin(axis=0)[j] == i)
    a, b = a[good], b[j[good]]
    if not len(a):
        return 0
    scale = b["scale"].astype(int) - a["scale"]
    turn = (b["turn"].astype(int) - a["turn"]) % TURNS
    count = np.bincount((scale - scale.min()) * TURNS + turn).tolist()
    count += [0] * (-len(count) % TURNS)
    around = [count[k] and count[k] + count[k - k % TURNS + (k + 1) % TURNS] + count[k - k % TURNS + (k - 1) % TURNS] for k in range(len(count))]
    best = 0
    for k in sorted(range(len(count)), key=lambda k: -around[k]):  # the largest first
        if around[k] <= best or around[k] < least:
            break
        s, t = k // TURNS + scale.min(), k % TURNS
        near = (scale == s) & (np.minimum((turn - t) % TURNS, (t - turn) % TURNS) <= 1)
        p, q = a[near], b[near]
        c, d = np.cos(t * 2 * np.pi / TURNS) * 2.0**s, np.sin(t * 2 * np.pi / TURNS) * 2.0**s
        dx, dy = q["x"] - (c * p["x"] - d * p["y"]), q["y"] - (d * p["x"] + c * p["y"])
        best = max(best, int(((np.abs(dx - dx[:, None]) <= 5) & (np.abs(dy - dy[:, None]) <= 5)).sum(axis=1).max()))
    return best


#: Distances of one matrix product, and images of its right side at most, a power of two.
CELLS, SIDE = 1 << 23, 256
_PAD, _SHIFT = 60, np.float32(2**23)  # the distance of no feature, beyond any match; its float has the integer in its low bytes


def _filled(feats: list[np.ndarray], name: str, size: int, step: int = 1) -> np.ndarray:
    """(image, feature): one field of each image's features, `step` places apart."""
    out = np.zeros((len(feats), size), np.int32 if name in ("scale", "turn") else np.float32)
    for k, f in enumerate(feats):
        out[k, : len(f) * step : step] = f[name]
    return out


def _left(feats: list[np.ndarray], flip: np.ndarray, step: int) -> tuple[np.ndarray, dict]:
    """(image, triple of features, bits and 2): three descriptors a row, as the digits of numbers to the base 256."""
    size = 3 * -(-max(len(f) for f in feats) * step // 3)
    out = np.zeros((len(feats), size, BITS + 2), np.float32)
    out[..., BITS + 1] = _PAD
    for k, f in enumerate(feats):
        at = out[k, : len(f) * step : step]
        at[:, :BITS], at[:, BITS], at[:, BITS + 1] = np.unpackbits(f["bits"], axis=1) ^ flip, 1, 0
    return out[:, 0::3] + 256 * out[:, 1::3] + 65536 * out[:, 2::3], {c: _filled(feats, c, size, step).ravel() for c in ("scale", "turn", "x", "y")}


def _right(feats: list[np.ndarray], flip: np.ndarray, side: int) -> tuple[np.ndarray, dict]:
    """(bits and 2, feature, image), images filled up to `side`: a product with _left is the number of differing bits."""
    size = max(len(f) for f in feats)
    out = np.zeros((BITS + 2, size, side), np.float32)
    out[BITS], out[BITS + 1] = _PAD, 1
    for k, f in enumerate(feats):
        bits = np.unpackbits(f["bits"], axis=1) ^ flip
        out[:BITS, : len(f), k], out[BITS, : len(f), k] = 1 - 2.0 * bits.T, bits.sum(axis=1)
    more = [np.zeros(0, FEATURE)] * (side - len(feats))
    return out, {c: np.ascontiguousarray(_filled(feats + more, c, size).T).ravel() for c in ("scale", "turn", "x", "y")}


def _matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places (image, triple, feature, image, digit), flat, of matches: at most MOST bits apart and nearest on both sides, ties included."""
    images, triples, depth = left.shape
    _, size, side = right.shape
    far = left.reshape(-1, depth) @ right.reshape(depth, -1)
    far = far.reshape(images, triples, size, side)
    most, good = np.empty((triples, size, side * 4), np.uint8), np.empty((triples, size, side * 4), bool)
    found = []
    for k, one in enumerate(far):
        one += _SHIFT
        one = one.view(np.uint8).reshape(triples, size, side * 4)  # three distances, and the exponent: 75, no match
        low = one.min(axis=0)
        for bits in (16, 8):
            w = low.view("<u4")
            low = np.minimum(low, (w >> bits | w << (32 - bits)).view(np.uint8))
        np.minimum(low, MOST, out=low)
        np.minimum(low[None], one.min(axis=1)[:, None], out=most)
        np.less_equal(one, most, out=good)
        w = good.ravel().view("<u8")
        at = np.flatnonzero(w != 0)
        hit = np.flatnonzero(w[at].view(bool))
        found.append((at[hit >> 3] << 3 | hit & 7).astype(np.int32) + np.int32(k * good.size))
    return np.concatenate(found)


def _voted(left: dict, right: dict, hit: np.ndarray, triples: int, size: int, side: int, swap: np.ndarray, least: int) -> np.ndarray:
    """Pairs (image * side + image) with `least` matches of one step of scale within three neighbouring turns and one shift, or more than 64 such matches.

    swap: by pair, whether the shift counts from the right image to the left one, as agreement() is asked.
    """
    low, m = hit & (side * 4 - 1), hit // (side * 4)
    row = m // size
    x, image = 3 * row + (low & 3), low >> 2
    y = (m - row * size) * side + image
    pair = row // triples * side + image
    code = (pair * 3 + right["scale"][y] - left["scale"][x] + 1) * TURNS + (right["turn"][y] - left["turn"][x] & TURNS - 1)
    count = np.bincount(code, minlength=len(swap) * 3 * TURNS).astype(np.uint16).reshape(-1, TURNS)
    around = count.copy()
    around[:, 1:] += count[:, :-1]
    around[:, :-1] += count[:, 1:]
    around[:, 0] += count[:, -1]
    around[:, -1] += count[:, 0]
    vote = np.flatnonzero(around.ravel() >= least)
    if not len(vote):
        return vote
    many = around.ravel()[vote] > 64
    sure, vote = vote[many] // (3 * TURNS), vote[~many]
    kept = np.zeros(len(swap), bool)
    kept[vote // (3 * TURNS)] = True
    kept = np.flatnonzero(kept[pair])
    kept = kept[np.argsort(code[kept], kind="stable")]
    code, x, y = code[kept], x[kept], y[kept]
    place = [np.zeros(0, np.int64)] * 2
    for side_ in (0, 1, TURNS - 1):
        beside = vote - vote % TURNS + (vote + side_) % TURNS
        first, last = np.searchsorted(code, beside), np.searchsorted(code, beside, "right")
        n = last - first
        place = [np.concatenate([place[0], np.repeat(np.arange(len(vote)), n)]), np.concatenate([place[1], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])]
    order = np.argsort(place[0], kind="stable")
    of, k = place[0][order], place[1][order]
    p, step, turn = vote // (3 * TURNS), vote // TURNS % 3 - 1, vote % TURNS
    back = swap[p]
    step, turn = np.where(back, -step, step), np.where(back, -turn, turn) * 2 * np.pi / TURNS
    c, d = (np.cos(turn) * 2.0**step)[of], (np.sin(turn) * 2.0**step)[of]
    ax, ay, bx, by = left["x"][x[k]], left["y"][x[k]], right["x"][y[k]], right["y"][y[k]]
    ax, ay, bx, by = (np.where(back[of], u, v) for u, v in ((bx, ax), (by, ay), (ax, bx), (ay, by)))
    shift = np.full((2, len(vote), 64), np.inf)
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    shift[:, of, rank] = bx - (c * ax - d * ay), by - (d * ax + c * ay)
    shift = shift[:, :, : rank.max(initial=-1) + 1]
    with np.errstate(invalid="ignore"):
        near = (np.abs(shift[:, :, :, None] - shift[:, :, None, :]) <= 5.001).all(axis=0).sum(axis=2).max(axis=1, initial=0)
    return np.unique(np.concatenate([sure, p[near >= least]]))


def alike(one: list[np.ndarray], two: list[np.ndarray], rank_one: np.ndarray, rank_two: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of features one[i], two[j] with rank_one[i] < rank_two[j] or the other way round: all whose agreement() from the lower to
    the higher rank is `least` or more, and few others. least: 1 or more."""
    by_size = [sorted((k for k, f in enumerate(feats) if len(f) >= max(1, least)), key=lambda k: len(feats[k])) for feats in (one, two)]
    if not all(by_size):
        return
    bits = [np.concatenate([np.ascontiguousarray(feats[k]["bits"]) for k in at]) for feats, at in zip((one, two), by_size, strict=True)]
    flip = (sum(np.unpackbits(b, axis=1).sum(axis=0, dtype=np.int64) for b in bits) * 2 > sum(map(len, bits))).astype(np.uint8)
    # a digit holds 127 at the top place: where two descriptors differ in every bit, a row has one alone, in the lowest
    step = 1 if {b.tobytes() for b in ~bits[0]}.isdisjoint(b.tobytes() for b in bits[1]) else 3
    side = min(SIDE, max(8, 1 << (len(by_size[1]) - 1).bit_length()))
    rows = max(1, CELLS // (side * max(len(one[by_size[0][-1]]) * step, 3) * len(two[by_size[1][-1]])))
    lefts = [(at, *_left([one[k] for k in at], flip, step)) for at in (by_size[0][n : n + rows] for n in range(0, len(by_size[0]), rows))]
    for n in range(0, len(by_size[1]), side):
        at_two = np.array(by_size[1][n : n + side])
        right, y = _right([two[k] for k in at_two], flip, side)
        rank = np.concatenate([rank_two[at_two], np.zeros(side - len(at_two), rank_two.dtype)])
        for at, left, x in lefts:
            swap = (rank_one[at][:, None] > rank[None]).ravel()
            pairs = _voted(x, y, _matches(left, right), left.shape[1], right.shape[1], side, swap, least)
            for i, j in zip(*(z.tolist() for z in np.divmod(pairs, side)), strict=True):
                if rank_one[at[i]] != rank[j]:
                    yield at[i], int(at_two[j])


def described(images: DataFrame) -> DataFrame:
    """(key, height, width, pixels) -> (key, n, features, words, turns): pixels are rows of bytes, words and turns are entries of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, raw = batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("pixels").to_pylist()
            out: list[np.ndarray] = [np.zeros(0, FEATURE)] * len(raw)
            by_size: dict = {}
            for k, size in enumerate(zip(h, w, strict=True)):
                by_size.setdefault(size, []).append(k)
            for (height, width), rows in by_size.items():
                step = max(1, 2_000_000 // (height * width))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    stack = np.stack([np.frombuffer(raw[k], np.uint8).reshape(height, width) for k in part])
                    for k, f in zip(part, features(stack), strict=True):
                        out[k] = f
            words, turns = [], []
            for f in out:
                word, at = np.unique(mix(np.ascontiguousarray(f["bits"]).view(f"<u{WORD // 8}").astype(np.uint64) + np.arange(BITS // WORD, dtype=np.uint64) * _APART), return_index=True)
                words.append(word.view(np.int64))
                turns.append(f["turn"][at // (BITS // WORD)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(f) for f in out], pa.int32()), pa.array([f.tobytes() for f in out], pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(turns, pa.list_(pa.int32()))], ["key", "n", "features", "words", "turns"])

    return images.mapInArrow(run, "key bigint, n int, features binary, words array<bigint>, turns array<int>")


def _confirmed(pairs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    one, two = found.select(F.col("key").alias("a"), F.col("features").alias("x")), found.select(F.col("key").alias("b"), F.col("features").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [agreement(np.frombuffer(x, FEATURE), np.frombuffer(y, FEATURE), least=least) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


#: Images of a block of the exact check at most, and, where there are fewer than a dozen blocks of that, at least.
BLOCK, SMALL = 4096, 512


def _unjoined(found: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that join what is still of two components, of all pairs: every block of images meets every block."""
    rows = found.where(F.col("n") >= least).join(label, "key").select("key", "root", "features")
    images = rows.count()
    blocks = max(1, -(-images // BLOCK), min(12, -(-images // SMALL)))  # each image is sent once a block
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    rows = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "root", "features")

    def meet(group: pa.Table) -> pa.Table:
        key, root, block = (group.column(c).to_numpy() for c in ("key", "root", "block"))
        i, j = (group.column(c)[0].as_py() for c in "ij")
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        feats = [np.frombuffer(x, FEATURE) for x in group.column("features").to_pylist()]
        above, links = {r: r for r in root.tolist()}, []

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in alike([feats[k] for k in one], [feats[k] for k in two], key[one], key[two], least):
            a, b = one[a], two[b]
            if key[a] > key[b]:
                a, b = b, a
            u, v = top(root[a]), top(root[b])
            if u != v and agreement(feats[a], feats[b], least=least) >= least:
                above[u] = v
                links.append((key[a], key[b]))
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    # so many partitions that none gets much more than its share of the groups
    return rows.repartition(max(1, min(1000, blocks * (blocks + 1) // 2)), "i", "j").groupBy("i", "j").applyInArrow(meet, "a bigint, b bigint")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (key, root) after links (a, b) between keys; the table of the labels before goes."""
    known = label.select(F.col("key").alias("a"), F.col("root").alias("root_a")), label.select(F.col("key").alias("b"), F.col("root").alias("root_b"))
    merged = components(links.join(known[0], "a").join(known[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    after = cut(label.join(merged, label["root"] == merged["node"], "left").select("key", F.coalesce(merged["root"], label["root"]).alias("root")))
    forget(label)
    return after


def near_images(images: DataFrame, id_col: str = "id", least: int = 8, rounds: int = 3, shared: int = 3) -> DataFrame:
    """(id, n_features, copy_id, kept) for rows (id, height, width, pixels); copy_id is the smallest id that links reach.

    shared: entries that two images have in common, at one turn between them, before a round compares them; the exact check that follows compares all
    the rest, so rounds and shared change the work alone. least: agreeing matches of a link. Images that are null, or whose pixels don't fill height x width, have no features and stand alone, as do images without enough corners, but
    images equal in every pixel are copies in any case. A null id counts as larger than any other; an empty table
    gives no rows.
    """
    rows = rows_for(images, id=id_col, height="height", width="width", pixels="pixels")
    fit = F.coalesce((F.col("height") > 0) & (F.octet_length("pixels") == F.col("height") * F.col("width")), F.lit(False))
    keyed = rows.withColumn("key", F.when(fit, F.xxhash64("height", "width", "pixels")))
    classes = cut(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.any_value("height").alias("height"), F.any_value("width").alias("width"), F.any_value("pixels").alias("pixels")))
    found = cut(described(classes.select("key", "height", "width", "pixels")))
    entries = found.where(F.col("n") >= least).select("key", F.explode(F.arrays_zip("words", "turns")).alias("e")).select("key", F.col("e.words").alias("word"), F.col("e.turns").alias("turn"))
    often = entries.groupBy("word").agg(F.count("*").alias("members")).where("members > 1").select("word")
    live = cut(entries.join(often, "word").select("word", "key", "turn"))
    label = cut(found.select("key", F.col("key").alias("root")))
    for seed in range(rounds):
        hub = live.groupBy("word").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "key").alias("h"), "key", "turn")).alias("m")).select("word", F.col("m.key").alias("hub"), F.col("m.turn").alias("from"))
        turned = F.pmod(F.when(F.col("hub") < F.col("key"), F.col("turn") - F.col("from")).otherwise(F.col("from") - F.col("turn")), F.lit(TURNS))
        near = live.join(hub, "word").where("hub <> key").groupBy(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b"), turned.alias("by")).agg(F.count("*").alias("common"))
        known = label.select(F.col("key").alias("a"), F.col("root").alias("root_a")), label.select(F.col("key").alias("b"), F.col("root").alias("root_b"))
        pairs = near.where(F.col("common") >= shared).select("a", "b").distinct().join(known[0], "a").join(known[1], "b").where("root_a <> root_b")
        links = _confirmed(pairs.select("a", "b"), found.select("key", "features"), least)
        label = _joined(label, links)
        rooted = live.join(label, "key")
        mixed = rooted.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("word")
        before, live = live, cut(live.join(mixed, "word", "left_semi"))  # entries of one component are done
        forget(before)
    forget(live)
    label = _joined(label, _unjoined(found, label, least))
    roots = label.select(F.col("key").alias("node"), "root")
    named = classes.select("key", "id").join(found.select("key", "n"), "key").join(roots, F.col("key") == roots.node, "left").select("key", "id", "n", F.coalesce("root", "key").alias("root"))
    named = cut(named)
    lowest = named.groupBy("root").agg(F.min("id").alias("low"))
    named = named.join(lowest, "root").select("key", "n", "low")
    out = keyed.select("id", "key").join(named, "key", "left")
    copy = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_features"), copy.alias("copy_id"), copy.eqNullSafe(F.col("id")).alias("kept"))


def as_images(rows: DataFrame, cell: int = 8) -> DataFrame:
    """(id, height, width, pixels): each vector of a table as a picture of 8 x 8 points of grey, blended over `cell` pixels between them.

    There is no media table; the pictures of near-duplicate vectors are edited copies of each other.
    """
    rows = rows_for(rows, id="vec_id", v="embedding").withColumn("v", F.col("v").cast("array<float>"))
    place = np.linspace(0, 7, 8 * cell)
    blend = np.maximum(1 - np.abs(place[:, None] - np.arange(8)), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if e is None else e for e in v], np.float64) if v is not None and len(v) == 64 else np.array([np.nan])
                top = np.abs(x).max()
                if not np.isfinite(top) or not top:
                    pixels.append(None)
                    continue
                grey = np.rint(x / np.sqrt((x / top) @ (x / top) / 64) / top * 48 + 128).clip(0, 255).astype(np.uint8)
                pixels.append(np.rint(blend @ grey.reshape(8, 8) @ blend.T).astype(np.uint8).tobytes())
            n = len(pixels)
            size = pa.array(np.full(n, 8 * cell, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, size, pa.array(pixels, pa.binary())], ["id", "height", "width", "pixels"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, height int, width int, pixels binary")


def query(spark, sf_dir: str) -> DataFrame:
    return near_images(as_images(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")
