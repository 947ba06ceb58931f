"""Helpers shared by the operators: the cluster's shared folder, written tables and Arrow batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import delete, delete_at_exit, shared_dir

#: Bytes of an Arrow batch while a table is written, and of the slices in which Python handles the texts of a batch.
BATCH_BYTES, RUN_BYTES = 8 << 20, 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hold Arrow batches to ``BATCH_BYTES`` for the jobs run inside; the caller's setting comes back afterwards."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING) if before is None else spark.conf.set(_BATCH_SETTING, before)


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs a read and not the whole lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        delete_at_exit(spark, self.root)
        self._next = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table read back with the same schema."""
        self._next += 1
        path = f"{self.root}/{self._next:03d}-{name}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tissuemill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables which no later step reads."""
        for table in tables:
            delete(self.spark, table._tissuemill_path)


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices with about ``limit`` bytes in the texts (or binaries) of column ``at``; every row is in exactly one.

    A plan may run under any setting of its session, so that a batch can hold far more than Python should copy at once.
    """
    for b in batches:
        if b.num_rows:
            part = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            yield from (b.slice(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, for work columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remembered(memo: dict[str, bytes], chunks: pa.ListArray, learn: Callable[[list[str]], None], limit: int, dtype: str) -> list[np.ndarray]:
    """For each list of chunks the memo's values, one after another, as numbers.

    Chunks are made distinct first, so that the memo is asked once for each; ``learn`` puts those it doesn't hold into it, and it
    is emptied beyond ``limit`` entries.
    """
    coded = chunks.flatten().dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    values = [*map(memo.get, distinct)]
    gaps = [i for i, x in enumerate(values) if x is None]
    if gaps:
        if len(memo) + len(gaps) > limit:
            memo.clear()
        learn([distinct[i] for i in gaps])
        for i in gaps:
            values[i] = memo[distinct[i]]
    numbers = np.frombuffer(b"".join(values), dtype=dtype)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // np.dtype(dtype).itemsize
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.append(0, np.cumsum(n))
    flat = numbers[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n)]
    cuts = ends[np.append(0, np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))].tolist()
    return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
