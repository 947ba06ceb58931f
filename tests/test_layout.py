"""Plans of the layouts: no shuffle for the join, filters that reach the scan."""

import numpy as np
from pyspark.sql import functions as F

from tissuemill.operators import raster
from tissuemill.sources import arrays, layout


def test_bucketed_rasters_join_without_shuffle(spark):
    image = arrays.image_from_array(spark, np.arange(64.0).reshape(8, 8))
    mask = arrays.mask_from_array(spark, np.arange(64).reshape(8, 8) % 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = layout.save_bucketed(image, "bucketed_image", 4), layout.save_bucketed(mask, "bucketed_mask", 4)
        out = raster.aggregate_stats(a, b, ["sum"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1  # the aggregate's, none for the join
        want = {r.instance: r["sum"] for r in raster.aggregate_stats(image, mask, ["sum"]).collect()}
        assert {r.instance: r["sum"] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_image")
        spark.sql("DROP TABLE IF EXISTS bucketed_mask")


def test_box_query_is_pushed_down(spark, tmp_path):
    layout.save_by_tile(arrays.image_from_array(spark, np.arange(256.0).reshape(16, 16)), str(tmp_path / "i"), 4)
    df = spark.read.parquet(str(tmp_path / "i")).where("y < 3 and x >= 4").select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(y,3)" in plan and "GreaterThanOrEqual(x,4)" in plan and "ReadSchema: struct<y:bigint,x:bigint,value:double>" in plan
    assert df.agg(F.count("*")).first()[0] == 36
