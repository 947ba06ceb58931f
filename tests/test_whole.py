"""Registered queries cover the whole image."""

import pytest
from pyspark.sql import functions as F

from tissuemill import plans

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["signal_to_noise", "pixel_preprocess", "gaussian_tiled", "signal_table"])
def test_all_channels(spark, name):
    assert {r.c for r in plans.queries()[name](spark, DIR).select("c").distinct().collect()} == set(range(64))


def test_flowsom_sees_all_components(spark, tmp_path):
    """Two groups of pixels that differ in component 50 only."""
    embedding = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == 50, (F.col("id") % 2) * 100.0 + F.col("id") / 1000).otherwise(0.0))
    spark.range(200).select(F.col("id").alias("vec_id"), embedding.alias("embedding"), F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = plans.queries()["flowsom"](spark, str(tmp_path)).collect()
    one, two = ({r.metaclustering for r in rows if r.vec_id % 2 == k} for k in (0, 1))
    assert len(rows) == 200 and not one & two


def test_operators_defaults(spark, monkeypatch):
    """Queries leave rounds, iterations and permutations to the operators."""
    import inspect

    from tissuemill.operators import composites, graph

    seen = {}

    def watch(module, name, argument):
        own = getattr(module, name)
        signature = inspect.signature(own)

        def call(*args, **more):
            bound = signature.bind(*args, **more)
            bound.apply_defaults()
            seen[name] = bound.arguments[argument] == signature.parameters[argument].default
            return spark.range(0).selectExpr("id as node", "0 as niche", "0 as a", "0 as b", "0 as n", "0 as z") if name != "spatial_pixel_neighbors" else {"enrichment": spark.range(0).selectExpr("0 as a", "0 as b", "0 as n")}

        monkeypatch.setattr(module, name, call)

    watch(graph, "label_propagation", "rounds")
    watch(graph, "neighborhood_lda", "max_iter")
    watch(graph, "enrichment", "permutations")
    watch(composites, "spatial_pixel_neighbors", "permutations")
    for name in ("label_propagation", "nhood_lda", "nhood_enrichment", "spatial_pixel_neighbors"):
        plans.queries()[name](spark, DIR)
    assert seen == dict.fromkeys(("label_propagation", "neighborhood_lda", "enrichment", "spatial_pixel_neighbors"), True)


def test_score_genes_iter_computes_its_inputs_once(spark):
    from tissuemill.operators import annotate

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(i, f"g{j}", float((i * 5 + j * 3) % 7)) for i in range(30) for j in range(6)]
    x = spark.createDataFrame(rows, "instance long, gene string, value double").mapInPandas(counted, "instance long, gene string, value double")
    markers = spark.createDataFrame([(f"g{j}", f"t{j % 2}", 1.0) for j in range(6)], "gene string, type string, weight double")
    out = annotate.score_genes_iter(x, spark.range(30).withColumnRenamed("id", "instance"), markers, ["t0", "t1"], 3, stop=-1.0)
    assert out.count() == 30 and seen.value == len(rows)
