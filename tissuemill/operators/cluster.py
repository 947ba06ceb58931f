"""Clustering: k-means and PCA on tables, self-organising maps with metaclusters, rank-sum tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_vectors(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """(instance, features): one dense vector per cell over the given genes."""
    from pyspark.ml.functions import array_to_vector

    wide = x.groupBy("instance").agg(*[F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("value"))), F.lit(0.0)).alias(f"g{i}") for i, g in enumerate(genes)])
    return wide.select("instance", array_to_vector(F.array(*[f"g{i}" for i in range(len(genes))])).alias("features"))


def kmeans(vectors: DataFrame, k: int = 5, seed: int = 100) -> DataFrame:
    """(instance, cluster)."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed).fit(vectors).transform(vectors).select("instance", F.col("prediction").alias("cluster"))


def pca(vectors: DataFrame, n: int) -> DataFrame:
    """(instance, pcs): principal components, as many as asked and the data allow."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    size = len(vectors.select("features").first()[0])
    return PCA(k=min(n, size), inputCol="features", outputCol="pcs").fit(vectors).transform(vectors).select("instance", vector_to_array("pcs").alias("pcs"))


def lloyd_step(points: DataFrame, centers: DataFrame, value: str = "value") -> DataFrame:
    """(cluster, center): means of the points (node, value) nearest to each of the given one-dimensional centers (cluster, center), ties to the smaller cluster."""
    near = points.join(F.broadcast(centers)).groupBy("node", value).agg(F.min(F.struct(F.abs(F.col(value) - F.col("center")).alias("d"), "cluster")).alias("m"))
    return near.groupBy(F.col("m.cluster").alias("cluster")).agg(F.avg(value).alias("center"))


class SelfOrganizingMap:
    """A batch self-organising map with metaclusters of its units by average linkage."""

    def __init__(self, width: int = 10, height: int = 10, metaclusters: int = 20, epochs: int = 10, seed: int = 0):
        self.width, self.height, self.n_meta, self.epochs, self.seed = width, height, metaclusters, epochs, seed

    def fit(self, data: np.ndarray) -> SelfOrganizingMap:
        rng = np.random.default_rng(self.seed)
        units = self.width * self.height
        data = np.asarray(data, dtype=float)
        self.codes = data[rng.choice(len(data), units, replace=len(data) < units)].copy()
        place = np.stack(np.divmod(np.arange(units), self.width), 1)
        apart = np.abs(place[:, None] - place[None]).max(2)
        for radius in np.linspace(max(self.width, self.height) / 2, 0.5, self.epochs):
            own = self.predict_units(data)
            sums, counts = np.zeros_like(self.codes), np.bincount(own, minlength=units).astype(float)
            np.add.at(sums, own, data)
            pull = np.exp(-((apart / max(radius, 0.5)) ** 2) / 2)
            weight = pull @ counts
            self.codes = np.where(weight[:, None] > 1e-9, pull @ sums / np.maximum(weight, 1e-9)[:, None], self.codes)
        self.meta = self._link()
        return self

    def predict_units(self, data: np.ndarray) -> np.ndarray:
        scores = data @ self.codes.T * -2 + (self.codes**2).sum(1)
        return scores.argmin(1)

    def _link(self) -> np.ndarray:
        groups = {i: [i] for i in range(len(self.codes))}
        d = np.sqrt(np.maximum(0, ((self.codes[:, None] - self.codes[None]) ** 2).sum(2)))
        while len(groups) > max(1, self.n_meta):
            keys = list(groups)
            best = min(((d[np.ix_(groups[a], groups[b])].mean(), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]))
            groups[best[1]] += groups.pop(best[2])
        out = np.zeros(len(self.codes), dtype=int)
        for n, own in enumerate(sorted(groups.values(), key=min)):
            out[own] = n
        return out


def flowsom(rows: DataFrame, keys: Sequence[str], features: Sequence[str], train_rows: int = 50_000, seed: int = 0, **shape) -> tuple[DataFrame, DataFrame]:
    """Cluster rows: (keys, clustering, metaclustering) from 1, 0 where a feature is null or NaN; and the map of clusters to metaclusters.

    The map is trained on the driver from at most ``train_rows`` rows, those with the smallest hash of their keys; all rows are
    predicted in Arrow batches against the broadcast codes.
    """
    sample = rows.dropna(subset=list(features)).where(" and ".join(f"not isnan(`{f}`)" for f in features)).orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(train_rows).select(*features).toPandas()
    som = SelfOrganizingMap(seed=seed, **shape).fit(sample.to_numpy(dtype=float))
    n = len(keys)
    source = rows.select(*keys, *[F.col(f).cast("double") for f in features])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[n:]], 1)
            good = ~np.isnan(data).any(1)
            unit, meta = np.zeros(len(data), dtype=np.int32), np.zeros(len(data), dtype=np.int32)
            if good.any():
                own = som.predict_units(data[good])
                unit[good], meta[good] = own + 1, som.meta[own] + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(unit), pa.array(meta)], names=[*keys, "clustering", "metaclustering"])

    schema = source.select(*keys, F.lit(0).alias("clustering"), F.lit(0).alias("metaclustering")).schema
    mapping = rows.sparkSession.createDataFrame([(i + 1, int(m) + 1) for i, m in enumerate(som.meta)], "clustering int, metaclustering int")
    return source.mapInArrow(predict, schema), mapping


def rank_genes(x: DataFrame, obs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, gene, z): one-against-rest rank sums of each gene, zeros of absent rows included as one block of ties below all.

    Values are taken to be at least 0. Ties are averaged; the variance has the correction for ties.
    """
    n = obs.select("instance").distinct().count()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    stored = x.where("value > 0")
    tied = stored.groupBy("gene", "value").agg(F.count("*").alias("t"))
    up = Window.partitionBy("gene").orderBy("value")
    own = Window.partitionBy("gene")
    ranked = tied.select("gene", "value", "t", F.sum("t").over(up).alias("upto"), F.sum("t").over(own).alias("present"))
    ranks = ranked.select("gene", "value", (F.lit(n) - F.col("present") + F.col("upto") - (F.col("t") - 1) / 2).alias("rank"))
    ties = ranked.groupBy("gene").agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"), F.max("present").alias("present")).select("gene", (F.lit(n) - F.col("present")).alias("zeros"), (F.col("ties") + F.pow(F.lit(n) - F.col("present"), 3) - (F.lit(n) - F.col("present"))).alias("ties"))
    sums = stored.join(ranks, ["gene", "value"]).join(clusters, "instance").groupBy("cluster", "gene").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    grid = F.broadcast(sizes).join(ties).join(sums, ["cluster", "gene"], "left")
    r = F.coalesce("r", F.lit(0.0)) + (F.col("size") - F.coalesce("k", F.lit(0))) * (F.col("zeros") + 1) / 2
    mean = F.col("size") * (n + 1) / 2
    spread = F.col("size") * (n - F.col("size")) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return grid.select("cluster", "gene", F.coalesce(F.try_divide(r - mean, F.sqrt(spread)), F.lit(0.0)).alias("z"))
