"""Positions in a total order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keeper


def numbered(rows: DataFrame, order: Sequence[str], name: str, after: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``name``, their place in ``order`` from ``after`` + 1; ``order`` should be a total order, as equal rows share a task.

    Rows are range-partitioned and written with their partition's number, as the bounds are sampled anew by every job that asks
    for them; each partition then numbers its own rows from the sum of the sizes before it, of which the driver sees one each.
    """
    keep = keep or keeper(rows.sparkSession)
    ranged = keep(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    base, total = [], after
    for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        base.append((r["_p"], total))
        total += r["n"]
    bases = rows.sparkSession.createDataFrame(base, "_p int, _base long")
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(bases), "_p").select(*rows.columns, (F.col("_base") + F.col("_r")).alias(name))
