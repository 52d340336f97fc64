"""Copies among images by local descriptors: multiscale corners, oriented binary tests, Hamming tables, geometric consensus."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shuffles_removed, written
from ._words import mix

SCALES = (1.0, 0.75, 0.5)
BITS, POINTS, RADIUS, TURNS = 128, 16, 12, 32
#: Side of the cells whose own strongest corners are kept besides the POINTS strongest of the image, and how many a cell.
CELL, CELL_POINTS = 32, 4
TABLES, TABLE_BITS = 24, 30
#: Tables that meet in one join; their rows are gone before the next is made.
AT_ONCE = 8
#: Parts of the pairs of classes whose places are gathered one after another, as most pairs are unrelated and met once.
PARTS = 4
#: Bits of a filter that corners' keys are held against before they are shuffled (32 MB).
FILTER_BITS = 1 << 28
#: Images of one task whose pixels are known again there, so that equal ones are described once a task.
REMEMBERED = 200_000
#: Rows whose pixels a task holds at once, in Python.
AT_A_TIME = 128
#: Pixels of a bin of shifts.
SHIFT = 16
#: A described corner: descriptor bits, place in pixels of its scale, step of SCALES and orientation.
CORNER = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("turn", "u1")])
_rng = np.random.Generator(np.random.Philox(key=[9, 64]))
_tests = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 4)), -RADIUS, RADIUS)
_angles = np.arange(TURNS) * 2 * np.pi / TURNS


def _turned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Offsets (turn, test, [row, column]) of test points for each quantised orientation."""
    c, s = np.cos(_angles)[:, None], np.sin(_angles)[:, None]
    return np.stack([np.rint(s * x + c * y), np.rint(c * x - s * y)], -1).astype(int)


_FIRST, _SECOND = _turned(_tests[:, 0], _tests[:, 1]), _turned(_tests[:, 2], _tests[:, 3])
#: Bits of the descriptor that make the key of each table.
_KEYS = np.stack([_rng.permutation(BITS)[:TABLE_BITS] for _ in range(TABLES)])
_disc = [(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dx * dx + dy * dy <= RADIUS * RADIUS]
_DY, _DX = np.array(_disc).T


def _edged(a: np.ndarray, r: int) -> np.ndarray:
    """Images on the last two axes with their edges repeated r times."""
    out = np.empty((*a.shape[:-2], a.shape[-2] + 2 * r, a.shape[-1] + 2 * r), a.dtype)
    out[..., r:-r, r:-r] = a
    out[..., :r, r:-r], out[..., -r:, r:-r] = a[..., :1, :], a[..., -1:, :]
    out[..., :r], out[..., -r:] = out[..., r : r + 1], out[..., -r - 1 : -r]
    return out


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1 of images on the last two axes, edges repeated."""
    k = 2 * r + 1
    p = np.zeros((*a.shape[:-2], a.shape[-2] + k, a.shape[-1] + k))
    np.cumsum(np.cumsum(_edged(a, r), axis=-2), axis=-1, out=p[..., 1:, 1:])
    return (p[..., k:, k:] - p[..., :-k, k:] - p[..., k:, :-k] + p[..., :-k, :-k]) / (k * k)


def _resized(a: np.ndarray, scale: float, b: np.ndarray | None = None) -> np.ndarray:
    """An image at a scale, from its means b over squares of side 3."""
    if scale == 1:
        return a
    h, w = (max(1, int(round(n * scale))) for n in a.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, a.shape[0] - 1), np.clip(np.floor(x).astype(int), 0, a.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    b = _box(a, 1) if b is None else b
    return (b[y0][:, x0] * (1 - fx) + b[y0][:, x1] * fx) * (1 - fy) + (b[y1][:, x0] * (1 - fx) + b[y1][:, x1] * fx) * fy


def describe_image(pixels: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(first and last 64 descriptor bits, x, y, scale step, turn) of corners of a grey image, as packed() finds them."""
    return packed(pixels).tolist()


def packed(pixels: np.ndarray) -> np.ndarray:
    """The corners of a grey image as rows of CORNER: at each scale the POINTS strongest, and the CELL_POINTS strongest of
    every cell, so that a small part of a large image has its own."""
    out, whole = [np.zeros(0, CORNER)], pixels.astype(float)
    means = _box(whole, 1)
    for level, scale in enumerate(SCALES):
        a = _resized(whole, scale, means)
        if min(a.shape) < 2 * RADIUS + 3:
            continue
        smooth = means if scale == 1 else _box(a, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
        strong = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2  # Harris
        top = np.nonzero(strong > max(1.0, 0.001 * float(strong.max())))
        edge = np.full((strong.shape[0] + 2, strong.shape[1] + 2), -np.inf)
        edge[1:-1, 1:-1] = strong
        for dy in (0, 1, 2):  # of those that may be corners, those above all neighbours stay
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    here, n = strong[top], edge[top[0] + dy, top[1] + dx]
                    held = here > n if (dy, dx) < (1, 1) else here >= n
                    top = top[0][held], top[1][held]
        y, x = top
        best = np.argsort(-strong[y, x], kind="stable")
        y, x = y[best], x[best]
        cell = (y // CELL) * (strong.shape[1] // CELL + 1) + x // CELL
        by = np.argsort(cell, kind="stable")  # strongest first in each cell
        place = np.arange(len(by)) - np.searchsorted(cell[by], cell[by])
        keep = np.arange(len(by)) < POINTS
        keep[by[place < CELL_POINTS]] = True
        y, x = y[keep], x[keep]
        if not len(y):
            continue
        s = _edged(smooth, 2 * RADIUS)
        at, wide = (y + 2 * RADIUS) * s.shape[1] + x + 2 * RADIUS, s.shape[1]
        s = s.ravel()
        patch = s[at[:, None] + (_DY * wide + _DX)]
        patch = patch - patch.mean(axis=1, keepdims=True)
        turn = np.rint(np.arctan2(patch @ _DY, patch @ _DX) / (2 * np.pi / TURNS)).astype(int) % TURNS
        f, g = _FIRST @ (wide, 1), _SECOND @ (wide, 1)
        bits = s[at[:, None] + f[turn]] < s[at[:, None] + g[turn]]
        corners = np.zeros(len(y), CORNER)
        words = np.packbits(bits, axis=1).view(">i8")
        corners["hi"], corners["lo"], corners["x"], corners["y"], corners["level"], corners["turn"] = words[:, 0], words[:, 1], x, y, level, turn
        out.append(corners)
    return np.concatenate(out)


def places(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, scale) of corners in the pixels of their image."""
    scale = np.array(SCALES)[c["level"]]
    return (c["x"] + 0.5) / scale, (c["y"] + 0.5) / scale, scale


_UPPER = TABLE_BITS // 2
_WEIGHTS = np.zeros((2, BITS, TABLES), np.float32)  # of the lower and upper half of each table's bits: sums stay exact
for _t, _k in enumerate(_KEYS):
    _WEIGHTS[0, _k[:_UPPER], _t], _WEIGHTS[1, _k[_UPPER:], _t] = 2.0 ** np.arange(_UPPER), 2.0 ** np.arange(TABLE_BITS - _UPPER)


def table_keys(c: np.ndarray, tables: slice = slice(None)) -> np.ndarray:
    """Each corner's key [corner, table]: the table's number above the bits it looks at."""
    words = np.stack([c["hi"], c["lo"]], 1).astype(">i8")
    bits = np.unpackbits(words.view(np.uint8).reshape(len(c), BITS // 8), axis=1).astype(np.float32)
    low, high = ((bits @ w[:, tables]).astype(np.int64) for w in _WEIGHTS)
    return low + (high << _UPPER) + (np.arange(TABLES)[tables] << TABLE_BITS)


def _spots(c: np.ndarray) -> np.ndarray:
    """Where each corner stands, as one number: place, scale step and turn."""
    return (c["x"].astype(np.int64) << 32) | (c["y"].astype(np.int64) << 16) | (c["level"].astype(np.int64) << 8) | c["turn"]


def _standing(spots: np.ndarray) -> np.ndarray:
    """Corners of spots, without descriptors."""
    out = np.zeros(len(spots), CORNER)
    for name, shift, mask in (("x", 32, 0xFFFF), ("y", 16, 0xFFFF), ("level", 8, 0xFF), ("turn", 0, 0xFF)):
        out[name] = (spots >> shift) & mask
    return out


def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(salt << 48)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _shared(sc, salt: int, filters: tuple[np.ndarray, np.ndarray]):
    """(salt, broadcast) of key_filter()'s filters, compressed: workers read them from files."""
    return salt, sc.broadcast(tuple(zlib.compress(f, 1) for f in filters))


def _keyed(tables: slice, filters: list) -> Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """(class_id, asks, corners) -> (class_id, keys, their corners) of each image: a key for each corner and each of tables that
    may stand in all filters. Where an image's own keys were put in a filter that tells so, only keys that others put there too pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        opened = [(salt, [np.frombuffer(zlib.decompress(f), np.uint8) for f in shared.value]) for salt, shared in filters]
        for batch in batches:
            for i, asks, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c = np.frombuffer(blob or b"", CORNER)
                keys = table_keys(c, tables)
                keys, of = keys.ravel(), np.repeat(np.arange(len(c)), keys.shape[1])
                for salt, (any_, twice) in opened:
                    at = _slot(keys, salt)
                    held = ((twice if asks and len(twice) else any_)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    keys, of = keys[held], of[held]
                if len(keys):
                    yield i, keys, c[of]

    return run


def _index(tables: slice, filters: list):
    """(class_id, asks, corners) -> (key, class_id, spot, hi, lo): a row for each corner and table that pass the filters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, keys, c in _keyed(tables, filters)(batches):
            columns = keys, np.full(keys.size, i, np.int64), _spots(c), np.ascontiguousarray(c["hi"]), np.ascontiguousarray(c["lo"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "class_id", "spot", "hi", "lo"])

    return run


def key_filter(images: DataFrame, tables: slice, filters: list, salt: int, twice: bool = False, part: int = 1 << 20, wide: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """FILTER_BITS bits, with those set that keys of images (class_id, asks, corners) in tables fall on, of keys that pass filters; and, if
    asked for, as many with those set that keys of two images or more fall on. Parts, a row each, are put together in tasks; the
    driver gets so many bits at most, however many keys there are."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part and wide keys: the steps between its bits, two bytes each, longer ones in several; and one
        for bits that come twice."""

        def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            for at in (at, at[n > 1]) if twice else (at,):
                parts, starts = np.unique(at // part, return_index=True)
                steps = []
                for x in np.split(at % part, starts[1:]) if len(at) else []:
                    far = np.diff(x, prepend=0)
                    longer = far // 0xFFFF
                    row = np.full(len(x) + longer.sum(), 0xFFFF, "<u2")
                    row[np.cumsum(longer + 1) - 1] = far - longer * 0xFFFF
                    steps.append(row.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(steps, pa.binary())], ["part", "steps"])

        held: list[np.ndarray] = []
        for _, keys, _ in _keyed(tables, filters)(batches):
            held.append(np.unique(_slot(keys, salt)))
            if sum(map(len, held)) >= wide:
                yield from rows(held)
                held = []
        yield from rows(held)

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, more = np.zeros(part // 8, np.uint8), np.zeros(part // 8, np.uint8)
        for batch in batches:
            for row in batch.column(1).to_pylist():
                steps = np.frombuffer(row, "<u2")
                at = np.cumsum(steps, dtype=np.int64)[steps != 0xFFFF]
                new = np.zeros(part // 8, np.uint8)
                np.bitwise_or.at(new, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
                more |= bits & new
                bits |= new
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (bits.tobytes(), more.tobytes() if twice else b""))], ["part", "bits", "more"])

    out = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8 if twice else 0, np.uint8)
    placed = images.select("class_id", "asks", "corners").mapInArrow(place, "part int, steps binary")
    for r in written(placed.groupBy("part").applyInArrow(join, "part int, bits binary, more binary"), "zstd").toLocalIterator():
        for bits, x in zip(out, (r.bits, r.more), strict=True):
            if len(bits):
                bits[r.part * (part // 8) : (r.part + 1) * (part // 8)] = np.frombuffer(x, np.uint8)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits descriptors differ; numpy counts a negative number's bits without its sign."""
    hi, lo = (np.bitwise_count(a[n].view("<u8") ^ b[n].view("<u8")) for n in ("hi", "lo"))
    return hi + lo


def consensus(q: np.ndarray, m: np.ndarray, pairs: np.ndarray, most_distance: int) -> int:
    """How many corners agree at most on one turn, scale and shift of q, among pairs (place in q, place in m) that differ in
    at most most_distance bits. Bins overlap by half."""
    a, b = q[pairs[:, 0]], m[pairs[:, 1]]
    near = _apart(a, b) <= most_distance
    a, b, pairs = a[near], b[near], pairs[near]
    turn = (b["turn"].astype(int) - a["turn"]) % TURNS
    (xq, yq, sq), (xm, ym, sm) = places(a), places(b)
    angle, zoom = turn * (2 * np.pi / TURNS), sq / sm
    dx = xm - zoom * (np.cos(angle) * xq - np.sin(angle) * yq)
    dy = ym - zoom * (np.sin(angle) * xq + np.cos(angle) * yq)
    two = lambda v, wide: np.stack([np.floor(v / wide), np.floor(v / wide + 0.5) + 0.5], 1).tolist()
    turns = np.stack([turn // 4, (turn + 2) // 4 % (TURNS // 4) + 100], 1).tolist()
    seen: dict[tuple, tuple[set[int], set[int]]] = {}
    for (i, j), bt, bs, bx, by in zip(pairs.tolist(), turns, np.round(np.log2(zoom)).tolist(), two(dx, SHIFT), two(dy, SHIFT), strict=True):
        for bin_ in itertools.product(bt, bx, by):
            left, right = seen.setdefault((bs, *bin_), (set(), set()))
            left.add(i)
            right.add(j)
    return max((min(len(x), len(y)) for x, y in seen.values()), default=0)


def near_corners(q: np.ndarray, m: np.ndarray, most_distance: int) -> np.ndarray:
    """All pairs (place in q, place in m) of corners that differ in at most so many bits, compared in blocks."""
    out, step = [np.zeros((0, 2), np.int64)], max(1, (1 << 22) // max(1, len(m)))
    for at in range(0, len(q), step):
        a = q[at : at + step]
        out.append(np.argwhere(_apart(a[:, None], m) <= most_distance) + (at, 0))
    return np.concatenate(out)


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id_q, class_id_m, spots that met) -> the pairs of classes of which two different corners met in one place."""
    for batch in batches:
        met = batch.column(2)
        ends, flat = met.offsets.to_numpy(), met.values
        left, right = (flat.field(i).to_numpy() for i in (0, 1))
        good = np.zeros(len(batch), bool)
        for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if e - s > 1:
                (a, x), (b, y) = (np.unique(v[s:e], return_inverse=True) for v in (left, right))
                good[i] = consensus(_standing(a), _standing(b), np.stack([x, y], 1), BITS) > 1
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["class_id_q", "class_id_m"])


def _votes(most_distance: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, m, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(left, CORNER), np.frombuffer(right, CORNER)
                rows.append((q, m, consensus(a, b, near_corners(a, b, most_distance), most_distance)))
            rows = [r for r in rows if r[2] >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["class_id_q", "class_id_m", "agreeing"])

    return run


def _corners(p: bytes | None, w: float | None) -> bytes:
    good = p is not None and len(p) and w == w and w and len(p) % int(w) == 0
    return packed(np.frombuffer(p, np.uint8).reshape(-1, int(w))).tobytes() if good else b""


def describe(media: DataFrame, id_col: str = "image_id", pixels_col: str = "pixels", width_col: str = "width") -> DataFrame:
    """(image_id, h1, h2, corners): two hashes of the pixels, and the described corners (CORNER) of each grey image of one
    byte a pixel.

    Null or empty pixels, or a width that does not divide them: no corners; null or empty pixels have null hashes.
    """

    @F.pandas_udf("binary")
    def run(pixels, widths):
        import pandas as pd

        rows = []
        for p, w in zip(pixels, widths, strict=True):
            rows.append(_corners(p, w))
        return pd.Series(rows, dtype=object)

    return _hashed(media, id_col, pixels_col, width_col).select("image_id", "h1", "h2", run(F.col(pixels_col), F.col(width_col)).alias("corners"))


def _hashed(media: DataFrame, id_col: str, pixels_col: str, width_col: str) -> DataFrame:
    full = F.length(pixels_col) > 0
    h = [F.when(full, F.xxhash64(F.lit(i), pixels_col, width_col)).alias(f"h{i}") for i in (1, 2)]
    return media.select(F.col(id_col).cast("long").alias("image_id"), *h, F.col(pixels_col), F.col(width_col)).filter("image_id is not null")


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of AT_A_TIME rows, so that memory follows these."""
    return (batch.slice(at, AT_A_TIME) for batch in batches for at in range(0, len(batch), AT_A_TIME))


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, h1, h2, pixels, width) -> (image_id, h1, h2, corners); null where the task has described these pixels before."""
    seen: set[tuple[int, int]] = set()
    for batch in _sliced(batches):
        out = []
        for h1, h2, p, w in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            out.append(None if h1 is None or (h1, h2) in seen else _corners(p, w))
            if len(seen) < REMEMBERED:
                seen.add((h1, h2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["image_id", "h1", "h2", "corners"])


def _classes(media: DataFrame, query_every: int, *names: str) -> tuple[DataFrame, DataFrame]:
    """Each image's class (image_id, class_id), and the classes (class_id, asks, corners)."""
    found = _hashed(media, *names).mapInArrow(_once, "image_id long, h1 long, h2 long, corners binary")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "zstd")
    asks = F.col("image_id") % query_every == 0
    same = found.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("image_id").alias("class_id"), F.bool_or(asks).alias("class_asks"), F.min(F.when(F.col("corners").isNotNull(), F.col("row"))).alias("holder"), F.count("*").alias("n")).filter("n > 1")
    same = written(found.select("row", "h1", "h2").join(same, ["h1", "h2"]).select("row", "class_id", "class_asks", (F.col("row") == F.col("holder")).alias("holds")))
    named = found.join(same, "row", "left")
    class_id = F.coalesce("class_id", "image_id").alias("class_id")
    members = named.select("image_id", "h1", "h2", class_id).distinct().select("image_id", "class_id")
    holds = F.col("corners").isNotNull() & F.coalesce("holds", F.lit(True))
    return members, named.filter(holds).select(class_id, F.coalesce("class_asks", asks).alias("asks"), "corners")


def _met(reps: DataFrame, tables: slice, most_distance: int) -> DataFrame:
    """(class_id_q, spot_q, class_id_m, spot_m): corners of two classes, the first of which asks, that meet in one of tables and
    differ in at most most_distance bits. Before rows are made, filters drop keys that no query has, or that no other class has."""
    asking, sc = reps.filter("asks"), reps.sparkSession.sparkContext
    wanted = _shared(sc, 1, key_filter(asking, tables, [], 1, twice=True))
    answered = _shared(sc, 2, key_filter(reps, tables, [wanted], 2))
    side = lambda d, s, f: d.mapInArrow(_index(tables, [f]), "key long, class_id long, spot long, hi long, lo long").select("key", *[F.col(c).alias(c + s) for c in ("class_id", "spot", "hi", "lo")])
    near = F.expr("bit_count(hi_q ^ hi_m) + bit_count(lo_q ^ lo_m)") <= most_distance
    met = side(asking, "_q", answered).join(side(reps, "_m", wanted), "key").filter((F.col("class_id_q") != F.col("class_id_m")) & near)
    met = written(met.select("class_id_q", "spot_q", "class_id_m", "spot_m"), "zstd")
    for _, shared in (wanted, answered):
        shared.destroy()
    return met


def _paired(met: DataFrame) -> DataFrame:
    """The pairs of classes (class_id_q, class_id_m) of which two different corners met in places that agree."""
    pairs = met.groupBy("class_id_q", "class_id_m").agg(F.collect_set(F.struct("spot_q", "spot_m")).alias("spots")).filter(F.size("spots") > 1)
    return written(pairs.mapInArrow(_agreeing, "class_id_q long, class_id_m long"), "zstd")


def find_copies(media: DataFrame, query_every: int = 20, most_distance: int = 22, least: int = 5, id_col: str = "image_id", pixels_col: str = "pixels", width_col: str = "width") -> DataFrame:
    """(kind, image_id, class_id, agreeing). A 'member' row says which class an image is in: images of equal pixels are one
    class, named by its smallest id. A 'match' row says that the class image_id, which holds a query, has an edited or
    cropped copy in class class_id, with so many corners that agree on one turn, scale and shift.

    Queries are the images whose id query_every divides; they are held against all classes. Corners meet in TABLES hash
    tables of TABLE_BITS bits of their descriptors: equi-joins of small rows, before which broadcast filters of fixed size
    drop the keys that no query has and the queries' keys that no other image has. They drop no key that two classes share,
    one of them a query. AT_ONCE tables are joined at a time, and what was shuffled is removed before the next are. The join
    itself holds corners of one key against each other and keeps those within most_distance, which alone may vote: most that
    share a key by chance differ in more. Two classes of which two different corners met in places that agree go on: their descriptors are fetched, and all their
    corners within most_distance differing bits vote for a turn, scale and shift of the query. least corners or more must
    agree. No image meets every other; a key that many classes share is split by Spark's skew join.

    Null id: left out. No pixels: a class of its own without matches. Rows of one id and pixels count once; an id with two
    different pixels is in two classes. Very large images: corners follow the area, CELL by CELL pixels; widths up to
    65,535. Ties: the strongest corner first in row order. Empty table: empty result. Other columns are left out.
    """
    with shuffles_removed(media.sparkSession):
        members, reps = _classes(media, query_every, id_col, pixels_col, width_col)
        rows = [_met(reps, slice(at, at + AT_ONCE), most_distance) for at in range(0, TABLES, AT_ONCE)]
        met = reduce(DataFrame.unionByName, rows)
        met = reduce(DataFrame.unionByName, [_paired(met.filter(F.pmod(F.xxhash64("class_id_q"), F.lit(PARTS)) == part)) for part in range(PARTS)])
        few = written(reps.select("class_id", "corners").join(met.select(F.explode(F.array("class_id_q", "class_id_m")).alias("class_id")).distinct(), "class_id"), "zstd")
    for s in ("_q", "_m"):
        met = met.join(few.select(F.col("class_id").alias("class_id" + s), F.col("corners").alias("corners" + s)), "class_id" + s)
    match = met.select("class_id_q", "class_id_m", "corners_q", "corners_m").mapInArrow(_votes(most_distance, least), "class_id_q long, class_id_m long, agreeing long")
    match = match.select(F.lit("match").alias("kind"), F.col("class_id_q").alias("image_id"), F.col("class_id_m").alias("class_id"), "agreeing")
    return members.select(F.lit("member").alias("kind"), "image_id", "class_id", F.lit(None).cast("long").alias("agreeing")).unionByName(match)


# --- images drawn from vectors, for tables without media ---------------------------------------------------------------

SIDE = 96


def draw(vector: np.ndarray) -> np.ndarray:
    """A grey image of sixteen crossing waves, each given by four of the vector's numbers: a texture without repeats."""
    v = np.abs(np.asarray(vector, float)) * 53.0
    v = np.resize(v - np.floor(v), 64).reshape(16, 4)
    turn, pace, at = v[:, 0] * np.pi, 0.25 + 1.0 * v[:, 1], np.arange(SIDE)
    # sin(a x + b y + c) is the imaginary part of a product of one factor a column and one a row
    rows = np.exp(1j * (np.outer(at, np.sin(turn) * pace) + 2 * np.pi * v[:, 2])) * (0.4 + v[:, 3])
    waves = (rows @ np.exp(1j * np.outer(np.cos(turn) * pace, at))).imag
    return np.clip(128 + 26 * waves, 0, 255).astype(np.uint8)


def edited(img: np.ndarray, how: int) -> np.ndarray:
    """A copy: 1 cropped, 2 brighter with less contrast, 3 turned by a quarter and cropped."""
    if how == 1:
        return img[10:90, 6:86]
    if how == 2:
        return np.clip(img * 0.8 + 35, 0, 255).astype(np.uint8)
    return np.rot90(img)[4:84, 8:88]


def media_of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(image_id, pixels, width): each vector's image at id * 4, and at id * 4 + id % 4, unless that is 0, an edited copy."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v:
                    continue
                img = draw(np.array([0.0 if n is None else n for n in v]))
                rows.append((i * 4, img))
                if i % 4:
                    rows.append((i * 4 + i % 4, edited(img, i % 4)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([np.ascontiguousarray(m).tobytes() for _, m in rows], pa.binary()), pa.array([m.shape[1] for _, m in rows], pa.int32())], ["image_id", "pixels", "width"])

    spread = 2 * vectors.sparkSession.sparkContext.defaultParallelism  # drawing takes long for what the rows weigh
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).repartition(spread).mapInArrow(run, "image_id long, pixels binary, width int")
