"""Per-instance aggregation of rasters.

An image is long rows (c, [z,] y, x, value), a mask rows ([z,] y, x, instance) with 0 as background. Image and mask meet by an
equi-join on the pixel; everything after is a partial and final hash aggregate, so that a pass over the pixels serves all
statistics at once. Label 0 is kept unless ``index`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import YX

#: Statistics that ``aggregate_stats`` knows; moments are those of the population, kurtosis is Fisher's.
STATS = ("sum", "mean", "count", "var", "kurtosis", "skew", "min", "max")


def _stat(name: str, value: Column) -> Column:
    if name == "count":
        return F.count(value)
    if name in ("kurtosis", "skew"):
        # a group of one value has no spread: 0; a group without values has no moment
        moment = F.kurtosis(value) if name == "kurtosis" else F.skewness(value)
        return F.when(F.count(value) > 0, F.coalesce(moment, F.lit(0.0)))
    return {"sum": F.sum, "mean": F.avg, "var": F.var_pop, "min": F.min, "max": F.max}[name](value)


def index_frame(like: DataFrame, index: Sequence[int]) -> DataFrame:
    """The requested labels as a frame; the list is the caller's and stays on the driver."""
    return like.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(index)], "instance long")


def aggregate_stats(image: DataFrame, mask: DataFrame, stats: Sequence[str] = ("sum",), index: Sequence[int] | None = None, on: Sequence[str] = YX) -> DataFrame:
    """(instance, c, one column per statistic) in the order of ``stats``.

    A label of ``index`` that has no pixel gets sum 0, count 0, NaN for mean and var, 0 for skew and kurtosis, null for min and
    max.
    """
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise AssertionError(f"unknown statistics {unknown}; known are {STATS}")
    joined = image.join(mask, list(on))
    if index is not None:
        wanted = index_frame(mask, index)
        joined = joined.join(F.broadcast(wanted), "instance", "left_semi")
    out = joined.groupBy("instance", "c").agg(*[_stat(s, F.col("value")).alias(s) for s in stats])
    if index is None:
        return out
    grid = F.broadcast(wanted).join(image.select("c").distinct())
    empty = {"sum": F.lit(0.0), "count": F.lit(0).cast("long"), "mean": F.lit(float("nan")), "var": F.lit(float("nan")), "skew": F.lit(0.0), "kurtosis": F.lit(0.0)}
    return grid.join(out, ["instance", "c"], "left").select("instance", "c", *[F.coalesce(s, empty[s]).alias(s) if s in empty else F.col(s) for s in stats])


def instance_size(mask: DataFrame, index: Sequence[int] | None = None) -> DataFrame:
    """(instance, size) in pixels, label 0 included unless ``index`` leaves it out."""
    sizes = mask.groupBy("instance").agg(F.count("*").alias("size"))
    if index is None:
        return sizes
    return F.broadcast(index_frame(mask, index)).join(sizes, "instance", "left").select("instance", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def center_of_mass(mask: DataFrame, on: Sequence[str] = YX) -> DataFrame:
    """(instance, mean of each coordinate)."""
    return mask.groupBy("instance").agg(*[F.avg(c).alias(c) for c in on])


def quantiles(image: DataFrame, mask: DataFrame, probabilities: Sequence[float] = tuple(i / 10 for i in range(1, 10)), on: Sequence[str] = YX) -> DataFrame:
    """(instance, c, q, value): exact linear quantiles of the pixels of each instance other than background."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    found = image.join(mask.where("instance <> 0"), list(on)).groupBy("instance", "c").agg(F.percentile("value", wanted).alias("v"))
    return found.select("instance", "c", F.posexplode("v").alias("i", "value")).select("instance", "c", F.get(wanted, F.col("i")).alias("q"), "value")


def feature_matrix(image: DataFrame, mask: DataFrame, features: Sequence[str], channels: Sequence[int], names: dict[int, str] | None = None, on: Sequence[str] = YX) -> DataFrame:
    """Wide rows (instance, feature__channel ...), feature by feature; ``channels`` is given, so that no pass looks for them."""
    names = names or {c: str(c) for c in channels}
    long = aggregate_stats(image.where(F.col("c").isin(list(channels))), mask.where("instance <> 0"), features, on=on)
    return long.groupBy("instance").agg(*[F.max(F.when(F.col("c") == c, F.col(f))).alias(f"{f}__{names[c]}") for f in features for c in channels])


def allocate_intensity(image: DataFrame, mask: DataFrame, mode: str = "sum", obs_stats: Sequence[str] = (), offset: tuple[float, float] = (0.0, 0.0), on: Sequence[str] = YX) -> dict[str, DataFrame]:
    """The intensity table of a mask: ``x`` (instance, c, value) and ``obs`` (instance, size, x, y, {stat}_{c} as long stats)."""
    if mode not in ("sum", "mean"):
        raise ValueError(f"mode is sum or mean, not {mode}")
    cells = mask.where("instance <> 0")
    wanted = tuple(dict.fromkeys([mode, *obs_stats]))
    stats = aggregate_stats(image, cells, wanted, on=on)
    place = cells.groupBy("instance").agg(F.count("*").alias("size"), (F.avg("x") + offset[1]).alias("x"), (F.avg("y") + offset[0]).alias("y"))
    return {"x": stats.select("instance", "c", F.col(mode).alias("value")), "obs": place, "stats": stats.select("instance", "c", *obs_stats)}


def combine_channels(image: DataFrame, groups: Sequence[Sequence[int]], on: Sequence[str] = YX) -> DataFrame:
    """Sum the channels of each group into one: group i becomes channel i."""
    target = F.create_map(*[F.lit(x) for i, own in enumerate(groups) for c in own for x in (c, i)])
    rows = image.where(F.col("c").isin([c for own in groups for c in own]))
    return rows.groupBy(F.element_at(target, F.col("c")).alias("c"), *on).agg(F.sum("value").alias("value"))


def normalize(image: DataFrame, low: float = 3.0, high: float = 99.8, eps: float = 1e-20, per_channel: bool = True) -> DataFrame:
    """Clip (v - p_low) / (p_high - p_low + eps) to [0, 1]; percentiles are exact, over values other than 0 and NaN."""
    real = image.where((F.col("value") != 0) & ~F.isnan("value"))
    # values are counted first, so that the percentile's buffer holds distinct values
    keys = ["c"] if per_channel else []
    counted = real.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    bounds = counted.groupBy(*keys).agg(F.percentile("value", F.lit(low / 100), F.col("n")).alias("lo"), F.percentile("value", F.lit(high / 100), F.col("n")).alias("hi"))
    joined = image.join(F.broadcast(bounds), "c", "left") if per_channel else image.join(F.broadcast(bounds))
    scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(eps))
    return joined.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).select(image.columns)


def histogram(image: DataFrame, bins: int, low: float, high: float, exclude_zeros: bool = False, density: bool = False) -> DataFrame:
    """(c, bin, n): counts per channel and bin of [low, high], the last bin closed; values outside and NaN are left out."""
    v = F.col("value")
    rows = image.where(~F.isnan(v) & v.between(low, high) & ((v != 0) | F.lit(not exclude_zeros)))
    width = (high - low) / bins
    out = rows.groupBy("c", F.least(F.floor((v - low) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return out
    totals = out.groupBy("c").agg(F.sum("n").alias("all"))
    return out.join(F.broadcast(totals), "c").select("c", "bin", (F.col("n") / (F.col("all") * width)).alias("n"))


def ecdf(image: DataFrame) -> DataFrame:
    """(c, value, share): share of a channel's values up to each distinct value."""
    from pyspark.sql import Window

    counted = image.where(~F.isnan("value")).groupBy("c", "value").agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy("c").orderBy("value"), Window.partitionBy("c")
    return counted.select("c", "value", (F.sum("n").over(up) / F.sum("n").over(whole)).alias("share"))


def otsu(counts: np.ndarray, centers: np.ndarray) -> float:
    """The threshold between two classes of a histogram that separates them most."""
    left, right = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean_left = np.cumsum(counts * centers) / left
        mean_right = (np.cumsum((counts * centers)[::-1]) / right[::-1])[::-1]
        between = left[:-1] * right[1:] * (mean_left[:-1] - mean_right[1:]) ** 2
    return float(centers[int(np.nanargmax(between))])


def signal_to_noise(image: DataFrame, bins: int = 65_536) -> DataFrame:
    """(c, threshold, snr, signal): mean above over mean up to Otsu's threshold; the driver sees at most ``bins`` counts a channel."""
    ranges = image.groupBy("c").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spread = image.join(F.broadcast(ranges), "c")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = spread.groupBy("c", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))

    def threshold(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(bins)
        full[pdf.bin.to_numpy(int)] = pdf.n
        lo, hi = pdf.lo[0], pdf.hi[0]
        return pd.DataFrame({"c": pdf.c[:1], "threshold": [otsu(full, lo + (np.arange(bins) + 0.5) * (hi - lo) / bins) if hi > lo else lo]})

    cut = counts.groupBy("c").applyInPandas(threshold, image.select("c", F.lit(0.0).alias("threshold")).schema)
    v, t = F.col("value"), F.col("threshold")
    return image.join(F.broadcast(cut), "c").groupBy("c", "threshold").agg((F.avg(F.when(v > t, v)) / F.avg(F.when(v <= t, v))).alias("snr"), F.avg(F.when(v > t, v)).alias("signal"))


def mean_normalized(image: DataFrame) -> DataFrame:
    """(c, value): asinh of the mean of each channel's normalised image."""
    return normalize(image).groupBy("c").agg(F.asinh(F.avg("value")).alias("value"))


def pixel_preprocess(images: DataFrame, p: float = 99.0, p_sum: float = 5.0, p_post: float = 99.9, cap: float = 1.0, blur: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Prepare images (image, c, y, x, value) for pixel clustering.

    Channels are divided by their percentile ``p`` averaged over images; pixels whose channel sum is below the percentile
    ``p_sum`` of all sums are dropped; after an optional blur values are divided by the pixel's channel sum, then by the
    channel's percentile ``p_post``, and capped.
    """
    share = images.where("value <> 0").groupBy("image", "c").agg(F.percentile("value", p / 100).alias("q")).groupBy("c").agg(F.avg("q").alias("q"))
    scaled = images.join(F.broadcast(share), "c").withColumn("value", F.coalesce(F.try_divide("value", "q"), F.lit(0.0))).drop("q")
    pixel = ["image", "y", "x"]
    sums = scaled.groupBy(*pixel).agg(F.sum("value").alias("s"))
    least = sums.agg(F.percentile("s", p_sum / 100).alias("least"))
    kept = sums.join(F.broadcast(least)).where("s >= least and s > 0").select(*pixel)
    rows = scaled.join(kept, pixel, "left_semi")
    if blur is not None:
        rows = blur(rows)
    totals = rows.groupBy(*pixel).agg(F.sum("value").alias("s"))
    shares = rows.join(totals, pixel).withColumn("value", F.coalesce(F.try_divide("value", "s"), F.lit(0.0))).drop("s")
    top = shares.where("value <> 0").groupBy("c").agg(F.percentile("value", p_post / 100).alias("q"))
    return shares.join(F.broadcast(top), "c", "left").withColumn("value", F.least(F.coalesce(F.try_divide("value", "q"), F.lit(0.0)), F.lit(cap))).select(images.columns)


def shape_moments(mask: DataFrame) -> DataFrame:
    """Shape properties in closed form from coordinate sums: area, centroid, axes, eccentricity, equivalent diameter, box, orientation.

    Axes are four roots of the eigenvalues of the pixels' covariance, with 1/12 for a pixel's own extent.
    """
    m = mask.where("instance <> 0").groupBy("instance").agg(
        F.count("*").alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        (F.var_pop("y") + 1 / 12).alias("vy"), (F.var_pop("x") + 1 / 12).alias("vx"), F.covar_pop("y", "x").alias("vyx"),
        F.min("y").alias("min_y"), (F.max("y") + 1).alias("max_y"), F.min("x").alias("min_x"), (F.max("x") + 1).alias("max_x"),
    )
    root = F.sqrt(F.pow(F.col("vy") - F.col("vx"), 2) + 4 * F.pow("vyx", 2))
    m = m.withColumn("l1", (F.col("vy") + F.col("vx") + root) / 2).withColumn("l2", F.greatest(F.lit(0.0), (F.col("vy") + F.col("vx") - root) / 2))
    return m.select(
        "instance", "area", "centroid_y", "centroid_x", (4 * F.sqrt("l1")).alias("axis_major_length"), (4 * F.sqrt("l2")).alias("axis_minor_length"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("l2") / F.col("l1"))).alias("eccentricity"), F.sqrt(4 * F.col("area") / F.lit(np.pi)).alias("equivalent_diameter_area"),
        "min_y", "min_x", "max_y", "max_x", (0.5 * F.atan2(2 * F.col("vyx"), F.col("vy") - F.col("vx"))).alias("orientation"),
    )


def shape_ratios(properties: DataFrame) -> DataFrame:
    """Ratios of shape properties: major/minor (null where minor is 0), major over equivalent diameter, and from perimeter and convex area where present."""
    out = properties.withColumn("major_minor_axis_ratio", F.try_divide("axis_major_length", F.expr("nullif(axis_minor_length, 0)")))
    out = out.withColumn("major_axis_equiv_diam_ratio", F.col("axis_major_length") / F.col("equivalent_diameter_area"))
    if "perimeter" in properties.columns:
        out = out.withColumn("perim_square_over_area", F.pow("perimeter", 2) / F.col("area"))
    if "convex_area" in properties.columns:
        out = out.withColumn("convex_hull_resid", (F.col("convex_area") - F.col("area")) / F.col("convex_area"))
    if "convex_centroid_y" in properties.columns:
        far = F.sqrt(F.pow(F.col("convex_centroid_y") - F.col("centroid_y"), 2) + F.pow(F.col("convex_centroid_x") - F.col("centroid_x"), 2))
        out = out.withColumn("centroid_dif", far / F.sqrt("area"))
    return out


def _hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (y, x), counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def shape_outlines(mask: DataFrame) -> DataFrame:
    """(instance, perimeter, convex_area, convex_centroid_y, convex_centroid_x) from the pixels of each instance.

    The perimeter counts pixel edges to other labels; the hull is that of the pixels' corners. A group is one instance.
    """

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        yx = pdf[["y", "x"]].to_numpy(dtype=np.int64)
        own = set(map(tuple, yx.tolist()))
        perimeter = sum((y + dy, x + dx) not in own for y, x in own for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        corners = _hull(np.concatenate([yx, yx + [0, 1], yx + [1, 0], yx + [1, 1]]))
        y, x = corners.T.astype(float)
        cross = y * np.roll(x, -1) - np.roll(y, -1) * x
        area = cross.sum() / 2
        cy, cx = ((y + np.roll(y, -1)) * cross).sum() / (6 * area), ((x + np.roll(x, -1)) * cross).sum() / (6 * area)
        return pd.DataFrame({"instance": pdf.instance[:1], "perimeter": float(perimeter), "convex_area": abs(area), "convex_centroid_y": cy - 0.5, "convex_centroid_x": cx - 0.5})

    return mask.where("instance <> 0").select(F.col("instance").cast("long"), "y", "x").groupBy("instance").applyInPandas(outline, "instance long, perimeter double, convex_area double, convex_centroid_y double, convex_centroid_x double")


def radii_and_axes(mask: DataFrame) -> DataFrame:
    """(instance, radii, axes): roots of the sample covariance's eigenvalues of (z, y, x), largest first, with their directions row by row.

    Sums are taken by Spark; numpy sees one 3x3 matrix per instance. Fewer than three pixels give zeros and the identity.
    """
    z = F.col("z") if "z" in mask.columns else F.lit(0)
    rows = mask.where("instance <> 0").select(F.col("instance").cast("long"), z.cast("double").alias("z"), F.col("y").cast("double"), F.col("x").cast("double"))
    pairs = [(a, b) for i, a in enumerate("zyx") for b in "zyx"[i:]]
    sums = rows.groupBy("instance").agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(a + b) for a, b in pairs])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            radii, axes = [], []
            for r in f.itertuples():
                if r.n < 3:
                    radii.append([0.0] * 3), axes.append(np.eye(3).ravel().tolist())
                    continue
                m = np.array([[r.zz, r.zy, r.zx], [r.zy, r.yy, r.yx], [r.zx, r.yx, r.xx]], dtype=float)
                values, vectors = np.linalg.eigh(m)
                order = np.argsort(-values, kind="stable")
                radii.append(np.sqrt(np.maximum(values[order], 0)).tolist()), axes.append(vectors[:, order].T.ravel().tolist())
            yield pd.DataFrame({"instance": f.instance, "radii": radii, "axes": axes})

    return sums.mapInPandas(work, "instance long, radii array<double>, axes array<double>")


def instance_statistics(image: DataFrame, mask: DataFrame, fn: Callable[[np.ndarray], np.ndarray], on: Sequence[str] = YX) -> DataFrame:
    """(instance, stats) of a user's function of the (channels, pixels) values of an instance; channels ascend, pixels by place."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["c", *on])
        values = ordered.value.to_numpy(dtype=float).reshape(ordered.c.nunique(), -1)
        return pd.DataFrame({"instance": pdf.instance[:1], "stats": [np.asarray(fn(values), dtype=float).ravel().tolist()]})

    rows = image.join(mask.where("instance <> 0"), list(on)).select(F.col("instance").cast("long"), "c", *on, "value")
    return rows.groupBy("instance").applyInPandas(work, "instance long, stats array<double>")
