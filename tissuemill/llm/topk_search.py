"""Exact top-k search by inner product.

Query blocks and candidate shards are packed into rows of binary matrices and dealt to the cells of a two-dimensional grid;
a cell multiplies every block by every shard it holds (one tile each), selects per tile, and keeps one list per query. The
lists of a query are then merged by a tree of grouped merges. The grid's two sides follow from the sizes of both inputs, so
that a cell stays within some MB of input and the replicated bytes are least.

Cases: vectors that are null, hold null or hold non-finite components, and rows without id, take no part. Only vectors of
equal length are compared. Equal scores go to the smaller id. A row is never its own candidate: rows with the query's id are
left out. Repeated query rows give repeated results. Scores beyond a signed 64-bit integer become the nearest one. Empty
inputs give an empty result. Only the two named columns are read, so further columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

QUERY_ROWS, SHARD_ROWS = 512, 4096
#: Tiles per grid cell; a tile of 64 dimensions takes some tens of milliseconds.
CELL_TILES = 64
#: Lists of a query that one merge takes.
FAN_IN = 16

_PACKED = "block long, dim int, n int, keys binary, ids binary, vectors binary"


def _pack(df: DataFrame, rows: int, scale: float) -> DataFrame:
    """Rows (key, id, vector) to blocks of at most ``rows`` rows, sorted by id; components become floor(scale * x)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim: int, own: list) -> pa.RecordBatch:
            nonlocal number
            keys, ids = np.array([o[0] for o in own], dtype="<i8"), np.array([o[1] for o in own], dtype="<i8")
            order = np.argsort(ids, kind="stable")
            vectors = np.stack([o[2] for o in own])[order]
            small = np.abs(vectors).max(initial=0) < 32768
            number += 1
            data = [[(part << 32) + number], [dim], [len(own)], [keys[order].tobytes()], [ids[order].tobytes()], [(b"h" + vectors.astype("<i2").tobytes()) if small else (b"d" + vectors.astype("<f8").tobytes())]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "n", "keys", "ids", "vectors"])

        for batch in batches:
            column = batch.column(2)
            flat = column.flatten()
            values, ends = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)))
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
            for i, (key, id_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = values[ends[i] : ends[i + 1]]
                if id_ is None or not column[i].is_valid or not np.isfinite(own).all():
                    continue
                rows_of = held.setdefault(len(own), [])
                rows_of.append((key, id_, own))
                if len(rows_of) == rows:
                    yield block(len(own), rows_of)
                    rows_of.clear()
        for dim, rows_of in held.items():
            if rows_of:
                yield block(dim, rows_of)

    return df.mapInArrow(work, _PACKED)


def _matrix(packed: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(packed[1:], dtype="<i2" if packed[:1] == b"h" else "<f8").reshape(n, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b."""
    bound = float(np.abs(a.astype("<f8")).max(initial=0)) * float(np.abs(b.astype("<f8")).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**24:
        return (a.astype("<f4") @ b.astype("<f4").T).astype("<i8")
    if bound < 2**53:
        return (a.astype("<f8") @ b.astype("<f8").T).astype("<i8")
    exact = np.vectorize(int, otypes=[object])
    out = exact(a) @ exact(b).T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    most = 2**63 - 1
    return np.minimum(np.maximum(out, -most), most).astype("<i8")


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of the k highest scores, ties to the smaller id, in that order; ids ascend along columns."""
    n = scores.shape[1]
    if n > k and np.abs(scores).max(initial=0) < 2**49:
        place = scores * 8192 - np.arange(n)
        top = np.argpartition(place, n - k, axis=1)[:, n - k :]
        order = np.argsort(-np.take_along_axis(place, top, 1), axis=1)
        top = np.take_along_axis(top, order, 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, 1), ids[top]


def _cell(k: int):
    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_key", "query_id", "part", "scores", "ids")}
        shards = [(s["dim"], np.frombuffer(s["ids"], "<i8"), _matrix(s["vectors"], s["n"], s["dim"])) for s in right.select(["dim", "n", "ids", "vectors"]).to_pylist()] if len(left) else []
        for q in left.select(["dim", "n", "keys", "ids", "vectors"]).to_pylist():
            keys, qids, matrix = np.frombuffer(q["keys"], "<i8"), np.frombuffer(q["ids"], "<i8"), _matrix(q["vectors"], q["n"], q["dim"])
            best_s, best_i = np.zeros((len(qids), 0), "<i8"), np.zeros((len(qids), 0), "<i8")
            for dim, ids, vectors in shards:
                if dim != q["dim"]:
                    continue
                scores = _products(matrix, vectors)
                own = np.isin(qids, ids)
                if own.any():  # leave out the query's own rows: select more there, and drop them below
                    extra = int(max((ids == i).sum() for i in qids[own]))
                else:
                    extra = 0
                s, i = _select(scores, ids, k + extra)
                best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
                mine = best_i == qids[:, None]
                order = np.lexsort((best_i, -best_s, mine), axis=1)[:, : k + int(mine.sum(1).max(initial=0))]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            keep = best_i != qids[:, None]
            for r in range(len(qids)):
                s, i = best_s[r][keep[r]][:k], best_i[r][keep[r]][:k]
                if len(s):
                    out["query_key"].append(int(keys[r])), out["query_id"].append(int(qids[r])), out["part"].append(key[1].as_py())
                    out["scores"].append(s), out["ids"].append(i)
        schema = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("part", pa.int64()), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
        return pa.table({c: pa.array(v, schema.field(c).type) for c, v in out.items()}, schema=schema)

    return work


def top_k(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """The k best candidates among all rows for each row on which ``query`` holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    work = Workspace(spark, "topk")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), query.alias("is_query"))
    queries = work.write(rows.where("is_query").select(F.monotonically_increasing_id().alias("key"), "id", "vector"), "queries")
    blocks = work.write(_pack(queries, QUERY_ROWS, scale), "blocks")
    shards = work.write(_pack(rows.select(F.lit(0).cast("long").alias("key"), "id", "vector"), SHARD_ROWS, scale), "shards")
    n_blocks, n_shards = blocks.count(), shards.count()
    cells = max(1, math.ceil(n_blocks * n_shards / CELL_TILES), min(n_blocks * n_shards, spark.sparkContext.defaultParallelism))
    # a side of R query groups and G shard groups copies R * shards + G * queries; least where G / R is their ratio
    across = max(1, min(n_blocks, round(math.sqrt(cells * (n_blocks * QUERY_ROWS) / max(1, n_shards * SHARD_ROWS)))))
    down = max(1, min(n_shards, math.ceil(cells / across)))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("r", F.pmod(F.xxhash64("block"), F.lit(across))).withColumn("g", spread(down))
    right = shards.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(down))).withColumn("r", spread(across))
    lists = left.groupBy("r", "g").cogroup(right.groupBy("r", "g")).applyInArrow(_cell(k), "query_key long, query_id long, part long, scores array<long>, ids array<long>")
    lists = lists.select("query_key", "query_id", "part", F.expr("transform(arrays_zip(scores, ids), x -> struct(-x.scores as minus, x.ids as id))").alias("top"))
    width = down
    while True:
        width = -(-width // FAN_IN)
        lists = lists.groupBy("query_key", "query_id", F.expr(f"part div {FAN_IN}").alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if width <= 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "found")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("vec_id"), (-F.col("found.minus")).alias("score"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for every row whose vec_id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
