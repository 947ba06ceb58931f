"""Hand-computed fixtures of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tissuemill.functions import qc
from tissuemill.operators import annotate, cluster, graph, masks, patches, points, raster, table, tiles
from tissuemill.sources import arrays
from tissuemill.sources.catalog import Elements
from tissuemill.sources.transcripts import read_resolve, read_stereoseq, read_transcripts


@pytest.fixture(scope="module")
def keep(spark, tmp_path_factory):
    root, step = tmp_path_factory.mktemp("keep"), iter(range(10_000))

    def write(df):
        path = str(root / str(next(step)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def mask(spark, a):
    return arrays.mask_from_array(spark, np.array(a))


def back(df, shape):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r.y, r.x] = r.instance
    return out.tolist()


M = [[3, 0, 0, 0], [0, 3, 1, 1], [1, 0, 1, 1], [1, 1, 0, 0]]


def test_sums_and_counts(spark):
    image = arrays.image_from_array(spark, 0.5 + np.arange(16).reshape(4, 4))
    got = {r.instance: (r["sum"], r["count"]) for r in raster.aggregate_stats(image, mask(spark, M), ["sum", "count"]).collect()}
    assert got == {0: (51.5, 7), 1: (70.5, 7), 3: (6.0, 2)}
    absent = raster.aggregate_stats(image, mask(spark, M), ["sum", "count", "mean", "var", "skew", "min"], index=[3, 9]).where("instance = 9").first()
    assert (absent["sum"], absent["count"], absent["skew"], absent["min"]) == (0, 0, 0, None) and math.isnan(absent["mean"]) and math.isnan(absent["var"])
    with pytest.raises(AssertionError):
        raster.aggregate_stats(image, mask(spark, M), ["median"])


def test_merge(spark):
    assert back(masks.merge_labels(mask(spark, [[1, 1, 2, 2], [1, 1, 2, 0]]), mask(spark, [[5, 5, 0, 0], [5, 5, 0, 0]]), 0.5), (2, 4)) == [[5, 5, 6, 6], [5, 5, 6, 0]]
    assert back(masks.merge_labels(mask(spark, [[1, 1, 1, 1, 2, 2]]), mask(spark, [[5, 5, 0, 0, 0, 0]]), 0.4), (1, 6)) == [[5, 5, 0, 0, 6, 6]]
    with pytest.raises(ValueError):
        masks.merge_nuclei(mask(spark, [[1, 0]]), mask(spark, [[1, 2]]), mask(spark, [[0, 0]]))


SOURCE = [[0, 1, 1, 2], [3, 3, 2, 2], [4, 4, 4, 2]]
REFERENCE = [[9, 5, 5, 8], [1, 1, 8, 7], [2, 2, 3, 7]]


def pairs(df):
    return {(r.source, r.reference): r.n for r in df.collect()}


def test_overlaps(spark):
    assert pairs(masks.overlap_counts(mask(spark, SOURCE), mask(spark, REFERENCE))) == {(1, 5): 2, (2, 7): 2, (2, 8): 2, (3, 1): 2, (4, 2): 2, (4, 3): 1}
    assert pairs(masks.overlap_counts(mask(spark, [[1, 1, 2, 2]]), mask(spark, [[0, 0, 5, 5]]))) == {(2, 5): 2}
    assert pairs(masks.overlap_counts(mask(spark, [[1, 1, 2, 2], [3, 3, 2, 2]]), mask(spark, [[5, 5, 7, 7], [9, 9, 7, 8]]), [2, 99], [7, 8])) == {(2, 7): 3, (2, 8): 1}


def test_majority_vote(spark):
    vote = lambda *a: {r.source: r.reference for r in masks.majority_vote(*a).collect()}
    assert vote(mask(spark, SOURCE), mask(spark, REFERENCE)) == {1: 5, 2: 7, 3: 1, 4: 2}
    assert vote(mask(spark, [[1, 1, 1, 1]]), mask(spark, [[3, 2, 2, 3]])) == {1: 2}
    assert vote(mask(spark, [[1, 2, 2], [3, 3, 0]]), mask(spark, [[4, 5, 5], [7, 7, 9]]), [99, 3, 2]) == {2: 5, 3: 7}


def test_matches(spark):
    source = mask(spark, [[1, 1, 2, 2], [1, 0, 2, 3]])
    got = masks.match_to_reference(source, {"a": mask(spark, [[5, 5, 7, 7], [0, 0, 8, 0]]), "b": mask(spark, [[10, 10, 0, 0], [10, 0, 0, 20]])})
    assert {(r.instance, r.a, r.b) for r in got.collect()} == {(1, 5, 10), (2, 7, 0), (3, 0, 20)}
    s, r = mask(spark, [[1, 1, 0, 0], [1, 0, 0, 0]]), mask(spark, [[5, 5, 5, 5], [0, 0, 5, 0]])
    assert [masks.match_to_reference(s, {"r": r}, m, 0.5).first().r for m in masks.METRICS] == [5, 0, 0]
    s = np.zeros((4, 4), dtype=int)
    s[:2, :3] = 1
    r = mask(spark, [[5, 5, 5, 5], [5, 6, 6, 5], [5, 5, 5, 5], [5, 5, 0, 0]])
    assert [masks.match_to_reference(mask(spark, s), {"r": r}, m).first().r for m in masks.METRICS] == [5, 6, 6]
    assert masks.match_to_reference(mask(spark, [[0, 0]]), {"r": mask(spark, [[1, 1]])}).columns == ["instance", "r"]
    assert masks.match_to_reference(mask(spark, [[0, 0]]), {"r": mask(spark, [[1, 1]])}).count() == 0


def test_filter_by_size(spark):
    assert back(masks.filter_by_size(mask(spark, [[1, 1, 1, 1, 2, 2]]), 3, 10), (1, 6)) == [[1, 1, 1, 1, 0, 0]]
    with pytest.raises(ValueError):
        masks.filter_by_size(mask(spark, [[1]]), 5, 4)


def test_radii(spark):
    a = np.zeros((1, 3, 4), dtype=int)
    a[0, 0, :3] = 1
    r = raster.radii_and_axes(mask(spark, a)).first()
    assert r.radii == pytest.approx([1, 0, 0]) and np.abs(np.array(r.axes).reshape(3, 3)[0]).tolist() == pytest.approx([0, 0, 1])


def test_chain_composition(spark):
    labels = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(6)], "node long, label string")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "src long, dst long, weight double")
    got = {(r.node, r.label): r.share for r in graph.neighbor_composition(edges, labels).collect()}
    assert got[0, "odd"] == 1 and got[1, "even"] == 1 and (0, "even") not in got
    with pytest.raises(ValueError):
        graph.neighbor_counts(edges, labels.withColumn("label", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        graph.neighborhood_kmeans(edges, labels, 99)
    alone = labels.unionByName(spark.createDataFrame([(77, "odd")], labels.schema))
    assert graph.neighborhood_kmeans(edges, alone, 2).where("niche = -1").first().node == 77


def test_grids(spark):
    pixels = mask(spark, np.zeros((40, 50), dtype=int)).select("y", "x")
    for size in (5, 13):
        column, n = masks.square_grid(40, 50, size, (8, 7))
        a = np.array(back(pixels.withColumn("instance", column), (40, 50)))
        assert a.max() == n and sorted(set(a.ravel())) == list(range(n + 1)) and np.argwhere(a > 0).min(0).tolist() == [8, 7]
        assert (np.bincount(a.ravel())[1:] == size * size).all()
    centers = masks.hexagon_centers(40, 50, 5, (3, 2))
    a = np.array(back(masks.hexagon_grid(pixels, 40, 50, 5, (3, 2)), (40, 50)))
    assert sorted(set(a.ravel())) == list(range(len(centers) + 1))
    for label, y, x in centers:
        py, px = np.argwhere(a == label).mean(0)
        assert abs(py + 0.5 - y) < 0.6 and abs(px + 0.5 - x) < 0.6


def test_weighted_mean_and_moments(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1)], "k string, value double, size int")
    assert table.weighted_mean(rows, ["k"]).first().value == 2.0
    props = raster.shape_moments(mask(spark, np.ones((4, 8), dtype=int)))
    r = raster.shape_ratios(props.join(raster.shape_outlines(mask(spark, np.ones((4, 8), dtype=int))), "instance")).first()
    assert (r.area, r.perimeter, r.convex_area, r.convex_hull_resid, r.centroid_dif) == (32, 24, 32, 0, 0)
    assert r.axis_major_length == pytest.approx(8 * 2 / math.sqrt(3)) and r.axis_minor_length == pytest.approx(4 * 2 / math.sqrt(3))


def test_append_and_catalog(spark, tmp_path):
    a = spark.createDataFrame([("r", 1, 5.0)], "region string, instance long, v double")
    with pytest.raises(ValueError):
        points.append_table(a, a)
    with pytest.raises(ValueError):
        points.append_table(a, a.withColumnRenamed("instance", "cell"))
    assert points.append_table(a, a.withColumn("region", F.lit("s"))).count() == 2
    e = Elements(spark, str(tmp_path))
    e.add_table("t", a)
    with pytest.raises(ValueError):
        e.add_table("t", a)
    with pytest.raises(ValueError):
        e.add_table("u", a.union(a))
    e.add_table("t", e.get("table", "t").withColumn("v", F.col("v") + 1), overwrite=True)
    assert e.get("table", "t").first().v == 6.0 and e.names("table") == ["t"]
    with pytest.raises(KeyError):
        e.get("image", "t")
    with pytest.raises(ValueError):
        e.add_labels("l", spark.createDataFrame([(0, 0, 1.5)], "y int, x int, instance double"))


def test_transcript_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1.38\t2.76\tq\tActb\n0.138\t0.138\tq\tBLANK-1\n")
    assert [tuple(r) for r in read_resolve(spark, str(tmp_path / "a.tsv"), filter_genes=["blank"]).collect()] == [(pytest.approx(10), pytest.approx(20), "Actb")]
    (tmp_path / "b.tsv").write_text("geneID\tx\ty\tMIDCount\nA\t1\t2\t3\nB\t1\t2\t0\n")
    assert [r.gene for r in read_stereoseq(spark, str(tmp_path / "b.tsv")).collect()] == ["A"] * 3
    with pytest.raises(ValueError):
        read_transcripts(spark, str(tmp_path / "a.tsv"), matrix=((2, 0, 0), (0, 1, 0), (0, 0, 1)), pixel_size=0.1)


def test_half_even_rounding(spark):
    pts = spark.createDataFrame([(0.5, 1.5, "g"), (1.5, 0.5, "g"), (2.5, 2.4, "h"), (9.0, 9.0, "h")], "x double, y double, gene string")
    got = points.allocate(pts, mask(spark, [[0, 0, 7], [0, 0, 0], [8, 0, 9]]))["x"]
    assert {(r.instance, r.gene, r["count"]) for r in got.collect()} == {(8, "g", 1), (7, "g", 1), (9, "h", 1)}


def test_tiles_equal_whole(spark, keep):
    rng = np.random.default_rng(0)
    a = rng.random((23, 31))
    image = arrays.image_from_array(spark, a)
    for fn, whole in ((lambda: tiles.gaussian_filter(image, 1.0, 8), tiles.gaussian(a, 1.0)), (lambda: tiles.min_max_filter(image, 3, 6), tiles.top_hat(a, 3))):
        out = np.full(a.shape, np.nan)
        for r in fn().collect():
            out[r.y, r.x] = r.value
        assert np.allclose(out, whole)
    blocks = np.zeros((24, 24))
    for y, x in ((2, 2), (6, 6), (14, 3), (3, 15), (15, 15)):
        blocks[y : y + 3, x : x + 3] = 1
    whole = tiles.components_2d(blocks > 0.5)
    got = np.array(back(tiles.segment(arrays.image_from_array(spark, blocks).drop("c"), tiles.threshold_model(0.5), 8, 4, 0.5, keep).withColumn("instance", F.dense_rank().over(Window.orderBy("instance"))), (24, 24)))
    assert ((got > 0) == (whole > 0)).all() and len(set(zip(got.ravel(), whole.ravel(), strict=True))) == whole.max() + 1


def test_components_2d():
    rng = np.random.default_rng(2)
    a = rng.random((20, 25)) > 0.45
    got, seen = tiles.components_2d(a), {}
    for y, x in np.argwhere(a):
        for dy, dx in ((0, 1), (1, 0)):
            if y + dy < 20 and x + dx < 25 and a[y + dy, x + dx]:
                assert got[y, x] == got[y + dy, x + dx]
        seen.setdefault(got[y, x], (y, x))
    assert (got[~a] == 0).all() and sorted(seen) == list(range(1, len(seen) + 1))


def test_sample_through_annotation(spark):
    s = arrays.blobs(spark, 64, 9, 3, 4, 0.01)
    out = raster.allocate_intensity(s["image"], s["labels"], "mean")
    vectors = cluster.wide_vectors(out["x"].select("instance", F.col("c").cast("string").alias("gene"), "value"), ["0", "1", "2", "3"])
    found = cluster.kmeans(vectors, 3).join(s["obs"], "instance").select("cluster", "type").distinct().collect()
    assert len(found) == len({r.type for r in s["obs"].collect()})
    two = arrays.multisample_blobs(spark, 2, size=32, cells=4)
    assert two["obs"].select("region").distinct().count() == 2


def test_annotation_ties_and_unknown(spark):
    scores = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", -1.0), (2, "b", 0.0), (3, "a", 3.0), (3, "b", -3.0)], "instance long, type string, score double")
    got = {r.instance: (r.annotation, r.cleanliness) for r in annotate.annotate(scores, ["b", "a"]).collect()}
    assert got == {1: ("b", 0.0), 2: ("unknown", 0.0), 3: ("a", float("inf"))}


def test_patches(spark):
    a = np.arange(25.0).reshape(5, 5)
    m = np.zeros((5, 5), dtype=int)
    m[1:4, 1:4] = 4
    vectors = patches.patch_vectors(patches.extract_instances(arrays.image_from_array(spark, a), mask(spark, m), 5), 1, 5).first()
    assert np.array(vectors.patch).reshape(5, 5).tolist() == np.where(m == 4, a, 0).tolist()
    rows = spark.range(50).withColumnRenamed("id", "instance")
    parts = [{r.instance for b in patches.iterate(rows, k, 3, batch=7) for r in b} for k in range(3)]
    assert sum(map(len, parts)) == 50 and set.union(*parts) == set(range(50))


def test_small_helpers(spark):
    assert qc.intersect_boxes((0, 2, 0, 2), (2, 3, 0, 1)) is None and qc.intersect_boxes((0, 3, 0, 3), (1, 5, 2, 9)) == (1, 3, 2, 3)
    assert qc.resolve_channels(["b", 0, 1], ["a", "b"]) == [1, 0]
    with pytest.raises(ValueError):
        qc.resolve_channels([5], ["a"])
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    assert qc.resolve_column("a", one, two) == "obs"
    with pytest.raises(ValueError):
        qc.resolve_column("c", one, two)


def test_streaming_allocation(spark, tmp_path):
    from tissuemill.streaming.allocate import allocate_stream

    pts = spark.createDataFrame([(0.2, 0.1, "g"), (1.0, 1.0, "g"), (1.1, 0.9, "h")], "x double, y double, gene string")
    pts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    query = allocate_stream(stream, mask(spark, [[1, 0], [0, 2]])).writeStream.format("memory").queryName("alloc").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert {(r.instance, r.gene, r["count"]) for r in spark.table("alloc").collect()} == {(1, "g", 1), (2, "g", 1), (2, "h", 1)}
    finally:
        query.stop()
