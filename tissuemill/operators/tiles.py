"""Tiled rasters: halo exchange, user functions on tiles, filters, segmentation and stitching of tiles.

A tile is one row (keys, ty, tx, y0, x0, h, w, payload, held) with its pixels as little-endian doubles and, as packed bits, which
of them the image has: an image may lack pixels, as at the end of a last row, and those are 0 to functions and no rows of a
result unless a filter reaches them. The halo of a tile is sent by
its neighbours: each tile explodes into the parts that the nine tiles around need, and a tile's group holds at most nine parts,
so that a task needs memory for some tiles and not for an image. A result is the same as without tiles where the function looks
no further than the halo.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import keeper

_TILE = "ty long, tx long, y0 long, x0 long, h long, w long, payload binary, held binary"
_COLUMNS = ["ty", "tx", "y0", "x0", "h", "w", "payload", "held"]


def _array(payload: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(payload, "<f8").reshape(int(h), int(w))


def _bits(held: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held, "u1"), count=int(h * w)).astype(bool).reshape(int(h), int(w))


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def to_tiles(pixels: DataFrame, size: int, keys: Sequence[str] = ("c",), value: str = "value") -> DataFrame:
    """Long pixels (keys, y, x, value) to dense tiles; missing pixels are 0 and not held."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.ty.iloc[0]) * size, int(pdf.tx.iloc[0]) * size
        h, w = int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1
        out, held = np.zeros((h, w)), np.zeros((h, w), bool)
        out[pdf.y - y0, pdf.x - x0] = pdf[value]
        held[pdf.y - y0, pdf.x - x0] = True
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "ty": pdf.ty.iloc[:1], "tx": pdf.tx.iloc[:1], "y0": y0, "x0": x0, "h": h, "w": w, "payload": [out.astype("<f8").tobytes()], "held": [np.packbits(held).tobytes()]})

    rows = pixels.select(*keys, F.col("y").cast("long"), F.col("x").cast("long"), F.col(value).cast("double"), F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return rows.groupBy(*keys, "ty", "tx").applyInPandas(pack, _types(pixels, keys) + _TILE)


def from_tiles(tiles: DataFrame, keys: Sequence[str] = ("c",), value: str = "value") -> DataFrame:
    """Tiles back to long pixels, those that are held."""

    def unpack(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                a = _array(r.payload, r.h, r.w)
                y, x = np.nonzero(_bits(r.held, r.h, r.w))
                yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, "y": y + r.y0, "x": x + r.x0, value: a[y, x]})

    return tiles.mapInPandas(unpack, _types(tiles, keys) + f"y long, x long, `{value}` double")


def with_halo(tiles: DataFrame, depth: int, size: int, keys: Sequence[str] = ("c",)) -> DataFrame:
    """Parts (keys, ty, tx, y0, x0, h, w, payload, held) of tiles as the tile (ty, tx) needs them within ``depth`` pixels."""
    if depth > size:
        raise ValueError("the halo is deeper than a tile")

    def send(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                a, held = _array(r.payload, r.h, r.w), _bits(r.held, r.h, r.w)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ys = slice(0, depth) if dy < 0 else slice(max(0, size - depth), None) if dy > 0 else slice(None)
                        xs = slice(0, depth) if dx < 0 else slice(max(0, size - depth), None) if dx > 0 else slice(None)
                        part = a[ys, xs]
                        if part.size:
                            out.append((*[getattr(r, k) for k in keys], r.ty + dy, r.tx + dx, r.y0 + (ys.start or 0), r.x0 + (xs.start or 0), *part.shape, np.ascontiguousarray(part).tobytes(), np.packbits(held[ys, xs]).tobytes()))
            yield pd.DataFrame(out, columns=[*keys, *_COLUMNS])

    return tiles.mapInPandas(send, _types(tiles, keys) + _TILE)


def _assemble(parts: pd.DataFrame, size: int, depth: int, extent: tuple[int, int, int, int] | None) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """The haloed array of a tile, what of it is held, and its own place in it; None where the tile itself has no pixels, or lies outside ``extent``."""
    ty, tx = int(parts.ty.iloc[0]), int(parts.tx.iloc[0])
    if extent is None:
        own = parts[(parts.y0 == ty * size) & (parts.x0 == tx * size)]
        if not len(own):
            return None
        y0, x0, y1, x1 = int(parts.y0.min()), int(parts.x0.min()), int((parts.y0 + parts.h).max()), int((parts.x0 + parts.w).max())
    else:
        top, left, bottom, right = extent
        if not (top < (ty + 1) * size and ty * size < bottom and left < (tx + 1) * size and tx * size < right):
            return None
        y0, x0 = max(top, ty * size - depth), max(left, tx * size - depth)
        y1, x1 = min(bottom, (ty + 1) * size + depth), min(right, (tx + 1) * size + depth)
    out, held = np.zeros((y1 - y0, x1 - x0)), np.zeros((y1 - y0, x1 - x0), bool)
    for r in parts.itertuples():
        place = slice(r.y0 - y0, r.y0 - y0 + r.h), slice(r.x0 - x0, r.x0 - x0 + r.w)
        out[place], held[place] = _array(r.payload, r.h, r.w), _bits(r.held, r.h, r.w)
    return out, held, y0, x0


def _map_held(tiles: DataFrame, fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], depth: int, size: int, keys: Sequence[str], extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``map_tiles`` with a function of the array and what of it is held to both.

    With ``extent`` (top, left, bottom, right; half-open) arrays end there and not with the pixels at hand, and tiles without
    pixels that a neighbour's halo reaches take part.
    """

    def work(parts: pd.DataFrame) -> pd.DataFrame:
        found = _assemble(parts, size, depth, extent)
        columns = [*keys, *_COLUMNS]
        if found is None:
            return pd.DataFrame(columns=columns)
        whole, held, y0, x0 = found
        ty, tx = int(parts.ty.iloc[0]), int(parts.tx.iloc[0])
        top, left = max(ty * size, y0), max(tx * size, x0)
        cut = slice(top - y0, (ty + 1) * size - y0), slice(left - x0, (tx + 1) * size - x0)
        out, held = fn(whole, held)
        own = np.asarray(out, dtype="<f8")[cut]
        return pd.DataFrame([(*[parts[k].iloc[0] for k in keys], ty, tx, top, left, *own.shape, np.ascontiguousarray(own).tobytes(), np.packbits(held[cut]).tobytes())], columns=columns)

    return with_halo(tiles, depth, size, keys).groupBy(*keys, "ty", "tx").applyInPandas(work, _types(tiles, keys) + _TILE)


def map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray], depth: int, size: int, keys: Sequence[str] = ("c",)) -> DataFrame:
    """Apply a same-shape function to every tile with a halo of ``depth`` and cut the halo off; missing pixels are 0 to it and stay missing."""
    return _map_held(tiles, lambda a, held: (fn(a), held), depth, size, keys)


def _along(a: np.ndarray, reach: int, mode: str) -> np.ndarray:
    return np.pad(a, [(reach, reach), (0, 0)], mode=mode)


def gaussian(a: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian blur with mirrored borders; sigma 0 copies."""
    if sigma == 0:
        return a.copy()
    reach = int(truncate * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for _ in range(2):
        padded = _along(a, reach, "symmetric")
        a = sum(k * padded[i : i + len(a)] for i, k in enumerate(kernel)).T
    return a


def _extreme(a: np.ndarray, k: int, best) -> np.ndarray:
    for _ in range(2):
        padded = _along(a, k // 2, "symmetric")
        a = best(np.lib.stride_tricks.sliding_window_view(padded, k, axis=0), axis=-1).T
    return a


def top_hat(a: np.ndarray, k: int, held: np.ndarray | None = None) -> np.ndarray:
    """The image less its opening (maximum of the minimum) over a square of ``k``, made odd; pixels that aren't held take no part and stay 0."""
    k += 1 - k % 2
    if held is None or held.all():
        return a - _extreme(_extreme(a, k, np.min), k, np.max)
    least = np.where(held, _extreme(np.where(held, a, np.inf), k, np.min), -np.inf)
    return np.where(held, a - _extreme(least, k, np.max), 0.0)


def gaussian_filter(image: DataFrame, sigma: float, size: int = 1024) -> DataFrame:
    """Gaussian blur of long pixels per channel, mirrored at the ends of all channels' rectangle from (0, 0).

    Pixels that a channel lacks are 0; those that the kernel reaches from a pixel of the channel get a value too.
    """
    depth = int(4 * sigma + 0.5)
    size = max(size, depth)
    ends = image.agg(*[f(c) for f in (F.min, F.max) for c in ("y", "x")]).first()
    extent = None if ends[0] is None else (min(0, ends[0]), min(0, ends[1]), ends[2] + 1, ends[3] + 1)
    blur = lambda a, held: (gaussian(a, sigma), _extreme(held, 2 * depth + 1, np.max))
    return from_tiles(_map_held(to_tiles(image, size), blur, depth, size, ("c",), extent))


def min_max_filter(image: DataFrame, k: int, size: int = 1024) -> DataFrame:
    """White top-hat of long pixels per channel, over the pixels that the channel has."""
    depth = 2 * (k // 2 + 1)
    return from_tiles(_map_held(to_tiles(image, max(size, depth)), lambda a, held: (top_hat(a, k, held), held), depth, max(size, depth), ("c",)))


def equalize(a: np.ndarray, clip: float = 3.5, bins: int = 256) -> np.ndarray:
    """Histogram equalisation of one tile with a clipped histogram; clipped counts are spread evenly."""
    lo, hi = a.min(), a.max()
    if hi <= lo:
        return a.copy()
    place = np.minimum(((a - lo) / (hi - lo) * bins).astype(int), bins - 1)
    counts = np.bincount(place.ravel(), minlength=bins).astype(float)
    most = clip * a.size / bins
    over = np.maximum(counts - most, 0).sum()
    counts = np.minimum(counts, most) + over / bins
    return lo + (hi - lo) * (counts.cumsum() / counts.sum())[place]


def enhance_contrast(image: DataFrame, clip: float = 3.5, size: int = 256) -> DataFrame:
    """Contrast per tile and channel over the pixels that it has (an approximation of adaptive equalisation, without blending between tiles)."""

    def even(a: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(a.shape)
        out[held] = equalize(a[held], clip)
        return out, held

    return from_tiles(_map_held(to_tiles(image, size), even, 0, size, ("c",)))


def components_2d(binary: np.ndarray) -> np.ndarray:
    """Labels of the four-connected parts of a boolean array, from 1 in the order of their first pixel."""
    parent = np.arange(binary.size).reshape(binary.shape)
    parent[~binary] = binary.size
    while True:
        new = parent.copy()
        for axis in (0, 1):
            a, b = (np.take(new, range(new.shape[axis] - 1), axis), np.take(new, range(1, new.shape[axis]), axis))
            both = np.take(binary, range(new.shape[axis] - 1), axis) & np.take(binary, range(1, new.shape[axis]), axis)
            low = np.where(both, np.minimum(a, b), binary.size)
            head, tail = [slice(None)] * 2, [slice(None)] * 2
            head[axis], tail[axis] = slice(None, -1), slice(1, None)
            new[tuple(head)] = np.where(both, np.minimum(a, low), a)
            new[tuple(tail)] = np.where(both, np.minimum(new[tuple(tail)], low), new[tuple(tail)])
        flat = np.append(new.ravel(), binary.size)
        new = flat[new]  # a label's own label
        if np.array_equal(new, parent):
            break
        parent = new
    _, out = np.unique(np.append(parent.ravel(), binary.size), return_inverse=True)
    out = out[:-1].reshape(binary.shape) + 1
    out[~binary] = 0
    return out


def threshold_model(level: float) -> Callable[[np.ndarray], np.ndarray]:
    """A segmentation model: connected parts above a level."""
    return lambda a: components_2d(a > level)


def _stack(parts: pd.DataFrame, size: int, channels: int) -> tuple[np.ndarray, int, int] | None:
    """The haloed arrays of a tile, one a channel, and their place; None where no channel has the tile itself."""
    ty, tx = int(parts.ty.iloc[0]), int(parts.tx.iloc[0])
    if not ((parts.y0 == ty * size) & (parts.x0 == tx * size)).any():
        return None
    y0, x0 = int(parts.y0.min()), int(parts.x0.min())
    out = np.zeros((channels, int((parts.y0 + parts.h).max()) - y0, int((parts.x0 + parts.w).max()) - x0))
    for r in parts.itertuples():
        out[r.c, r.y0 - y0 : r.y0 - y0 + r.h, r.x0 - x0 : r.x0 - x0 + r.w] = _array(r.payload, r.h, r.w)
    return out, y0, x0


def _labelled(stack: DataFrame, channels: int, fn: Callable[..., np.ndarray], size: int, depth: int, relabel: bool) -> DataFrame:
    """(ty, tx, y, x, instance, own): labels of ``fn`` on each tile's haloed channels; relabelled ones are shifted over the tile's number."""

    def work(parts: pd.DataFrame) -> pd.DataFrame:
        found = _stack(parts, size, channels)
        if found is None:
            return pd.DataFrame(columns=["ty", "tx", "y", "x", "instance", "own"])
        arrays, y0, x0 = found
        ty, tx = int(parts.ty.iloc[0]), int(parts.tx.iloc[0])
        labels = np.asarray(fn(*arrays)).astype(np.int64)
        y, x = np.nonzero(labels)
        instance = labels[y, x]
        if relabel:
            instance = ((np.int64(ty) & 0x7FFF) << 47) | ((np.int64(tx) & 0x7FFF) << 32) | instance
        y, x = y + y0, x + x0
        own = (y // size == ty) & (x // size == tx)
        return pd.DataFrame({"ty": ty, "tx": tx, "y": y, "x": x, "instance": instance, "own": own})

    return with_halo(to_tiles(stack, size), depth, size).groupBy("ty", "tx").applyInPandas(work, "ty long, tx long, y long, x long, instance long, own boolean")


def _stitched(seen: DataFrame, iou: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(y, x, instance): each tile's own pixels, labels that agree between tiles made one."""
    from .graph import connected_components

    links = stitch_links(seen, iou)
    labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), seen.select(F.col("instance").alias("node")).distinct(), keep)
    return seen.where("own").join(labels.withColumnRenamed("node", "instance"), "instance").select("y", "x", F.col("component").alias("instance"))


def segment(image: DataFrame, model: Callable[..., np.ndarray], size: int = 1024, depth: int = 32, iou: float = 0.7, keep: Callable[[DataFrame], DataFrame] | None = None, channels: Sequence | None = None) -> DataFrame:
    """Segment long pixels tile by tile and stitch the tiles: (y, x, instance).

    The model gets one array, or one for each of ``channels`` of an image (c, y, x, value). A tile's labels are shifted by 32
    bits over the tile's number; labels of neighbouring tiles whose intersection over union in the pixels that both tiles saw
    is at least ``iou`` are one instance. Each tile keeps its own pixels.
    """
    keep = keep or keeper(image.sparkSession)
    if channels is None:
        stack = image.withColumn("c", F.lit(0))
    else:
        place = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("c")) - 1
        stack = image.where(F.col("c").isin(list(channels))).withColumn("c", place.cast("int"))
    return _stitched(keep(_labelled(stack, 1 if channels is None else len(channels), model, size, depth, True)), iou, keep)


def map_labels(masks: Sequence[DataFrame], fn: Callable[..., np.ndarray], size: int = 1024, depth: int = 100, iou: float = 0.7, relabel: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Apply a function of aligned masks to one mask, tile by tile: (y, x, instance) without background.

    ``fn`` gets an array of labels of each mask, with a halo of ``depth``, and returns labels of the same shape. With
    ``relabel`` these are a tile's own and tiles are stitched as in ``segment``; without it they name instances of the whole
    image and every tile keeps its own pixels. Pixels that a mask lacks are 0. Raises where a label is over 2**53, as tiles
    hold doubles.
    """
    spark = masks[0].sparkSession
    stack = None
    for i, m in enumerate(masks):
        one = m.select(F.lit(i).alias("c"), "y", "x", F.col("instance").alias("value"))
        stack = one if stack is None else stack.unionByName(one)
    if stack.where(F.abs("value") > 2**53).limit(1).count():
        raise ValueError("a label is over 2**53; number the instances first")
    whole = lambda *a: fn(*[x.astype(np.int64) for x in a])
    seen = _labelled(stack, len(masks), whole, size, min(depth, size), relabel)
    if not relabel:
        return seen.where("own").select("y", "x", "instance")
    keep = keep or keeper(spark)
    return _stitched(keep(seen), iou, keep)


def flat_field(image: DataFrame, size: int) -> DataFrame:
    """(c, ty, tx, flat): the median over all tiles of ``size`` at each place of a tile, over the channel's mean of those medians.

    Stands in for an optimised flat field: what stands at the same place of most tiles is the illumination.
    """
    medians = image.groupBy("c", (F.col("y") % size).alias("ty"), (F.col("x") % size).alias("tx")).agg(F.percentile("value", 0.5).alias("m"))
    means = medians.groupBy("c").agg(F.avg("m").alias("a"))
    return medians.join(F.broadcast(means), "c").select("c", "ty", "tx", F.try_divide("m", "a").alias("flat"))


def tiling_correction(image: DataFrame, size: int, ragged: bool = False) -> DataFrame:
    """Long pixels over the flat field of their tile's places; places without light (0 or null) keep their values.

    Raises ``ValueError`` where the image isn't whole tiles, unless ``ragged``: then a place's median is over the tiles that
    have it.
    """
    ends = None if ragged else image.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    if ends and ends.y is not None and ((ends.y + 1) % size or (ends.x + 1) % size):
        raise ValueError("the image's sides must be multiples of the tile's")
    keyed = image.withColumn("ty", F.col("y") % size).withColumn("tx", F.col("x") % size)
    corrected = F.coalesce(F.try_divide("value", "flat"), F.col("value").cast("double"))
    return keyed.join(flat_field(image, size), ["c", "ty", "tx"]).withColumn("value", corrected).select(image.columns)


def stitch_links(seen: DataFrame, iou: float = 0.7) -> DataFrame:
    """(a, b): labels of two tiles whose overlap over union, counted in the pixels where both tiles have a label or none, is at least ``iou``."""
    twice = seen.groupBy("y", "x").agg(F.count("*").alias("k")).where("k > 1").select("y", "x")
    shared = seen.join(twice, ["y", "x"]).select("y", "x", "ty", "tx", "instance")
    other = shared.select("y", "x", F.col("ty").alias("ty2"), F.col("tx").alias("tx2"), F.col("instance").alias("b"))
    pairs = shared.withColumnRenamed("instance", "a").join(other, ["y", "x"]).where("a < b and (ty <> ty2 or tx <> tx2)").groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = shared.groupBy("instance").agg(F.count_distinct("y", "x").alias("s"))
    both = pairs.join(sizes.select(F.col("instance").alias("a"), F.col("s").alias("sa")), "a").join(sizes.select(F.col("instance").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(F.col("n") >= F.lit(iou) * (F.col("sa") + F.col("sb") - F.col("n"))).select("a", "b")


def keep_by_majority(seen: DataFrame) -> DataFrame:
    """Rows (ty, tx, y, x, instance) of each label from the tile with most of its pixels, the first tile of equals."""
    areas = seen.groupBy("instance", "ty", "tx").agg(F.count("*").alias("n"))
    best = areas.groupBy("instance").agg(F.max(F.struct("n", (-F.col("ty")).alias("a"), (-F.col("tx")).alias("b"))).alias("m")).select("instance", (-F.col("m.a")).alias("ty"), (-F.col("m.b")).alias("tx"))
    return seen.join(best, ["instance", "ty", "tx"])


def segment_points(image: DataFrame, points: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = 1024) -> DataFrame:
    """Segment tiles with a model that also gets the tile's points as rows (y, x) inside the tile: (y, x, instance), labels unique across tiles."""

    def work(tile: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame(columns=["y", "x", "instance"])
        r = tile.iloc[0]
        labels = np.asarray(model(_array(r.payload, r.h, r.w), own[["y", "x"]].to_numpy(dtype=float) - [r.y0, r.x0])).astype(np.int64)
        y, x = np.nonzero(labels)
        return pd.DataFrame({"y": y + r.y0, "x": x + r.x0, "instance": (np.int64(r.ty) << 47) | (np.int64(r.tx) << 32) | labels[y, x]})

    tiles = to_tiles(image.withColumn("c", F.lit(0)), size)
    placed = points.select("y", "x", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    return tiles.groupBy("ty", "tx").cogroup(placed.groupBy("ty", "tx")).applyInPandas(work, "y long, x long, instance long")
