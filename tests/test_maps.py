"""Functions of masks over tiles, several channels, the flat field and table subsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.operators import masks, points, table, tiles
from tissuemill.sources import arrays


def blocks(h, w, step):
    y, x = np.indices((h, w))
    return np.where((y % step < step - 1) & (x % step < step - 1), (y // step) * 100 + x // step + 1, 0)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.instance, set()).add((r.y, r.x))
    return sorted(map(sorted, out.values()))


def expected(a):
    return sorted([sorted((int(y), int(x)) for y, x in zip(*np.nonzero(a == v), strict=True)) for v in np.unique(a[a > 0])])


def test_map_labels_tiled_is_as_untiled(spark):
    one, two = blocks(14, 17, 5), blocks(14, 17, 4)
    fn = lambda a, b: tiles.components_2d((a > 0) & (b > 0))
    masks = [arrays.mask_from_array(spark, a) for a in (one, two)]
    assert groups(tiles.map_labels(masks, fn, size=6, depth=5, iou=0.5)) == expected(fn(one, two))


def test_map_labels_with_names_of_the_whole_image(spark):
    one, two = blocks(9, 9, 3), blocks(9, 9, 4)
    # a mask without its background rows is 0 there
    sparse = arrays.mask_from_array(spark, two).where("instance <> 0")
    got = tiles.map_labels([arrays.mask_from_array(spark, one), sparse], lambda a, b: np.where(b > 0, a, 0), size=4, depth=1, relabel=False)
    assert {(r.y, r.x): r.instance for r in got.collect()} == {(int(y), int(x)): int(one[y, x]) for y, x in zip(*np.nonzero((one > 0) & (two > 0)), strict=True)}


def test_map_labels_raises_for_labels_doubles_cannot_hold(spark):
    with pytest.raises(ValueError):
        tiles.map_labels([spark.createDataFrame([(0, 0, 2**60)], "y long, x long, instance long")], lambda a: a, size=4, depth=1)


def test_segment_of_two_channels(spark):
    a, b = blocks(10, 10, 5) * 1.0, (np.indices((10, 10)).sum(0) % 7 > 0) * 1.0
    rows = [(c, int(y), int(x), float(v)) for c, ch in (("p", a), ("q", b), ("other", a * 0)) for (y, x), v in np.ndenumerate(ch)]
    image = spark.createDataFrame(rows, "c string, y long, x long, value double")
    model = lambda p, q: tiles.components_2d((p > 0) & (q > 0))
    assert groups(tiles.segment(image, model, size=6, depth=5, iou=0.5, channels=["p", "q"])) == expected(model(a, b))


def test_tiling_correction_takes_the_light_out(spark):
    light = np.array([[1.0, 2.0], [3.0, 2.0]])
    scene = np.repeat(np.repeat(np.arange(1.0, 10).reshape(3, 3), 2, 0), 2, 1)
    rows = [(0, y, x, float(v)) for (y, x), v in np.ndenumerate(scene * np.tile(light, (3, 3)))]
    image = spark.createDataFrame(rows, "c int, y long, x long, value double")
    got = {(r.y, r.x): r.value for r in tiles.tiling_correction(image, 2).collect()}
    assert all(got[y, x] == pytest.approx(scene[y, x] * light.mean()) for y in range(6) for x in range(6))
    with pytest.raises(ValueError):
        tiles.tiling_correction(image, 4)
    dark = image.withColumn("value", F.lit(0.0))
    assert {r.value for r in tiles.tiling_correction(dark, 2).collect()} == {0.0}


def test_subset(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (3, "a", 4.0)], "instance int, gene string, value double")
    obs = spark.createDataFrame([(1, "r"), (2, "r"), (3, "s")], "instance int, region string")
    got = table.subset(x, obs, regions=["r"], genes=["c", "a"])
    assert {tuple(r) for r in got["x"].collect()} == {(1, "a", 1.0, 1), (2, "c", 3.0, 0)} and got["obs"].count() == 2
    assert {r.gene for r in table.subset(x, obs, positions=[1])["x"].collect()} == {"b"}
    assert table.subset(x, obs)["x"].count() == 4
    for wrong in ({"genes": ["z"]}, {"positions": [3]}, {"genes": ["a"], "positions": [0]}):
        with pytest.raises(ValueError):
            table.subset(x, obs, **wrong)


def test_cells_without_a_size_stay(spark):
    x = spark.createDataFrame([(1, "a", 4.0), (2, "a", 1.0)], "instance int, gene string, value double")
    sizes = spark.createDataFrame([(1, 8)], "instance int, size int")
    assert {r.instance: r.value for r in table.normalize_by_size(x, sizes).collect()} == {1: 50.0, 2: None}


def test_correlation_raises_for_a_lost_gene(spark):
    p = spark.createDataFrame([(0.0, 0.0, "a"), (1.0, 1.0, "b")], "x double, y double, gene string")
    kept = spark.createDataFrame([(1, "a", 1)], "instance int, gene string, count long")
    with pytest.raises(ValueError):
        points.left_out_correlation(p, kept, (0, 2, 0, 2))
    both = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "instance int, gene string, count long")
    assert tuple(points.left_out_correlation(p, both, (0, 2, 0, 2)).first()) == (2, None)


def _ragged(spark, missing):
    """Two channels of 9 x 10 pixels, ``missing`` of each left out: the frame, the array and what of it is there."""
    a = np.random.default_rng(3).random((2, 9, 10)) - 0.3
    held = np.ones(a.shape, bool)
    for m in missing:
        held[m] = False
    rows = [(int(c), int(y), int(x), float(a[c, y, x])) for c, y, x in zip(*np.nonzero(held), strict=True)]
    return spark.createDataFrame(rows, "c int, y long, x long, value double"), a, held


RAGGED = [(slice(None), 8, slice(3, None)), (1, slice(4, 9), slice(0, 9))]


def test_tiling_correction_of_a_ragged_image(spark):
    frame, a, held = _ragged(spark, RAGGED)
    got = {(r.c, r.y, r.x): r.value for r in tiles.tiling_correction(frame.withColumn("value", F.abs("value")), 4, ragged=True).collect()}
    assert len(got) == held.sum()
    for c in range(2):
        m = {(i, j): np.median(np.abs(a[c, i::4, j::4])[held[c, i::4, j::4]]) for i in range(4) for j in range(4)}
        mean = np.mean(list(m.values()))
        for y, x in zip(*np.nonzero(held[c]), strict=True):
            assert got[c, y, x] == pytest.approx(abs(a[c, y, x]) * mean / m[y % 4, x % 4])


def test_tiles_keep_missing_pixels_out(spark):
    frame, a, held = _ragged(spark, RAGGED)
    got = {(r.c, r.y, r.x): r.value for r in tiles.from_tiles(tiles.map_tiles(tiles.to_tiles(frame, 4), lambda v: 2 * v + 1, 2, 4)).collect()}
    assert got == {k: pytest.approx(2 * a[k] + 1) for k in zip(*map(np.ndarray.tolist, np.nonzero(held)), strict=True)}


def test_gaussian_of_a_ragged_image(spark):
    frame, a, held = _ragged(spark, RAGGED)
    got = {(r.c, r.y, r.x): r.value for r in tiles.gaussian_filter(frame, 0.5, 4).collect()}
    want = {}
    for c in range(2):
        blurred = tiles.gaussian(np.where(held[c], a[c], 0.0), 0.5)
        for y in range(9):
            for x in range(10):
                # pixels at most 2 away, mirrored at the ends
                ys = [i if 0 <= i < 9 else -1 - i if i < 0 else 17 - i for i in range(y - 2, y + 3)]
                xs = [i if 0 <= i < 10 else -1 - i if i < 0 else 19 - i for i in range(x - 2, x + 3)]
                if held[c][np.ix_(ys, xs)].any():
                    want[c, y, x] = pytest.approx(blurred[y, x])
    assert got == want and 90 < len(want) < 180


def test_top_hat_of_a_ragged_image(spark):
    frame, a, held = _ragged(spark, RAGGED)
    got = {(r.c, r.y, r.x): r.value for r in tiles.min_max_filter(frame, 3, 4).collect()}
    assert len(got) == held.sum()
    for c in range(2):
        near = lambda v, y, x: v[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2][held[c, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]]  # noqa: E731, B023
        low = np.zeros((9, 10))
        for y, x in zip(*np.nonzero(held[c]), strict=True):
            low[y, x] = near(a[c], y, x).min()
        for y, x in zip(*np.nonzero(held[c]), strict=True):
            assert got[c, y, x] == pytest.approx(a[c, y, x] - near(low, y, x).max())


def test_rasterize_by_edges(spark):
    """Labels with holes and touching corners come back; a sloped polygon's pixels are those whose centers are inside."""
    a = np.random.default_rng(5).integers(0, 3, (30, 20))
    rings = masks.vectorize(arrays.mask_from_array(spark, a))
    got = {(r.y, r.x): r.instance for r in masks.rasterize_rings(rings).collect()}
    assert got == {(y, x): a[y, x] for y, x in zip(*map(np.ndarray.tolist, np.nonzero(a)), strict=True)}
    rows = [(7, 2, [(0.0, 0.0), (9.0, 2.0), (3.0, 8.0)]), (8, 1, [(5.0, 1.0), (9.5, 1.0), (9.5, 5.5), (5.0, 5.5)]), (7, 2, [(0.0, 0.0), (9.0, 2.0), (3.0, 8.0)])]
    found = masks.rasterize(spark.createDataFrame(rows, "instance long, place long, ring array<struct<x: double, y: double>>"))
    inside = lambda ring, y, x: sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) % 2
    want = {}
    for y in range(10):
        for x in range(10):
            hits = [(place, i) for i, place, ring in rows if inside(ring, y + 0.5, x + 0.5)]
            if hits:
                want[y, x] = min(hits)[1]
    assert {(r.y, r.x): r.instance for r in found.collect()} == want
    # no row of a polygon carries its ring along
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("ring" in line for line in plan.split("\n") if "Generate" in line and "sequence" in line)
