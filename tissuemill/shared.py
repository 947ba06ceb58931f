"""The folder that driver and executors share, and tables written there which go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOTS: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset and driver and executors are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tissuemill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame under the shared folder and reads it back, for loops."""
    root = f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}"
    delete_at_exit(spark, root)
    step = iter(range(1 << 30))

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(step):05d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends: frames that read it end with the driver too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _ROOTS.append((where, where.getFileSystem(spark._jsc.hadoopConfiguration())))


@atexit.register
def _delete_roots() -> None:
    for where, store in _ROOTS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            store.delete(where, True)
