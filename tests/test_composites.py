"""Composites and instrument tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.operators import composites, raster
from tissuemill.sources import arrays, instruments


def mask(spark, a):
    return arrays.mask_from_array(spark, np.array(a))


def test_pixel_neighbors(spark):
    a = np.kron([[1, 2], [1, 2]], np.ones((4, 4), dtype=int))
    for mode in ("most_frequent", "center"):
        out = composites.spatial_pixel_neighbors(mask(spark, a), 4, mode, 10)
        assert {(r.a, r.b): r.n for r in out["enrichment"].collect() if r.n} == {(1, 1): 2, (2, 2): 2, (1, 2): 2, (2, 1): 2}
    with pytest.raises(ValueError):
        composites.spatial_pixel_neighbors(mask(spark, a), 4, "other")


def test_voronoi_and_density(spark):
    a = np.zeros((5, 9), dtype=int)
    a[2, 2], a[2, 6] = 1, 2
    rings = composites.voronoi_boundaries(mask(spark, a), 2).collect()
    assert sorted({r.instance for r in rings}) == [1, 2]
    pts = spark.createDataFrame([(2.0, 1.0, "g"), (2.5, 1.5, "g"), (0.0, 0.0, "h")], "x double, y double, gene string")
    out = {(r.y, r.x): r.value for r in composites.density_image(pts, 4, 5, 0.0, 8).collect()}
    assert len(out) == 20 and out[1, 2] == 1.0 and out[0, 0] == 0.5 and sum(out.values()) == 1.5


def test_signal_table(spark):
    a = np.zeros((1, 4, 4))
    a[0, :2] = 10
    a[0, 2:] = 1
    image = arrays.image_from_array(spark, a)
    images = image.withColumn("image", F.lit("a")).unionByName(image.withColumn("value", F.col("value") * 2).withColumn("image", F.lit("b")))
    r = composites.signal_table(images, ["a", "b", "z"]).first()
    assert (r.a, r.b, r.z) == (10, 10, 0) and composites.signal_table(images, [], {"a": "g", "b": "g"}).first().g == 10


def test_merge_halos_and_regionprops(spark):
    seen = spark.createDataFrame([(0, 0, 0, 0, 5), (0, 1, 0, 0, 7), (0, 1, 0, 1, 7), (0, 0, 0, 2, 5)], "ty long, tx long, y long, x long, instance long")
    assert {(r.y, r.x): r.instance for r in composites.merge_halos(seen, 2).collect()} == {(0, 0): 5, (0, 1): 7, (0, 2): 5}
    obs = spark.createDataFrame([("r", 1), ("s", 9)], "region string, instance long")
    assert composites.regionprops_table(mask(spark, [[1, 1]]), obs, "r").first().area == 2
    with pytest.raises(ValueError):
        composites.regionprops_table(mask(spark, [[1, 1]]), obs, "s")
    assert raster.instance_size(mask(spark, [[1, 1]]), []).count() == 0


def test_instruments(spark, tmp_path):
    frame = spark.createDataFrame([(2.0, 4.0, "A"), (2.0, 4.0, "NegControl")], "x_location double, y_location double, feature_name string")
    frame.write.parquet(str(tmp_path / "s"))
    out = instruments.read_samples(spark, {"one": (str(tmp_path / "s"), 0.5), "two": (str(tmp_path / "s"), 2.0)}, filter_genes=["control"])
    assert {(r.sample, r.x, r.y) for r in out.collect()} == {("one", 4.0, 8.0), ("two", 1.0, 2.0)}
    counts = spark.createDataFrame([("c1", 1, 0, 2), ("c2", 0, 3, 0)], "cell string, A int, B int, `Blank-1` int")
    meta = spark.createDataFrame([("c1", 5.0), ("c2", 6.0)], "cell string, v double")
    got = instruments.counts_with_metadata(counts, meta)
    assert got["x"].count() == 2 and got["blank"].first()["gene"] == "Blank-1"
    with pytest.raises(ValueError):
        instruments.counts_with_metadata(counts, meta.limit(1))
    with pytest.raises(ValueError):
        instruments.attach_shapes(meta, meta.where("cell = 'c1'").select("cell"))
    names = spark.createDataFrame([(n,) for n in ("10_CD3", "2_DAPI", "1_DAPI", "3_B_CD4", "1_CD8")], "name string")
    assert [r.name for r in instruments.select_channels(names).collect()] == ["1_CD8", "1_DAPI", "10_CD3"]
    assert [r.name for r in instruments.select_channels(names, ["cd3"]).collect()] == ["10_CD3"]
    spots = spark.createDataFrame([("b", 5.0, 5.0, 1.0), ("a", 1.5, 1.5, 1.0)], "barcode string, x double, y double, radius double")
    pixels = {(r.y, r.x): r.instance for r in instruments.spots_to_mask(spots).collect()}
    assert pixels[1, 1] == 1 and pixels[5, 5] == 2 and len([v for v in pixels.values() if v == 2]) == 4
