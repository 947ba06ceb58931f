"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a vector of statistics (character classes, word and line shape, repetition). Trees of fixed depth are
grown on binned statistics of labelled documents and flattened into arrays, which numpy walks for whole batches at once.

The fit takes at most ``train_rows`` labelled rows, those with the smallest hash of their doc_id; everything else covers all
rows. Each text is measured once for its score, and those of the fit once more. Cases: null and empty texts have statistics of zero and are scored like any other. Labels that are null or neither 0
nor 1 are passed over; a document with several labels counts once for each. Without labels every score is 0.5; with labels of
one kind the score follows that kind. Rows without doc_id are scored, and are not held out. Repeated rows repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_name, slices, small_batches

#: Bound on the labelled rows that the fit takes.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_chars", "log_words", "upper", "lower", "digit", "space", "newline", "point_comma", "bang", "mark", "bracket_line", "quote", "high",
    "control", "word_mean", "word_max", "word_sd", "distinct_words", "top_word", "distinct_lines", "line_mean", "packed", "words_with_mark", "repeat_next", "letters_per_word",
)

_CLASS = np.zeros(256, dtype=np.uint8)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"#$%&*@^~+=", b"|<>[]{}()\\/_-", b"\"'`"), 1):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 11
_CLASS[[c for c in range(32) if c not in (10, 13)] + [127]] = 12


def statistics(text: str) -> list[float]:
    """The document statistics of one whole text, in the order of ``FEATURES``."""
    data = text.encode("utf-8", errors="replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=13)[1:] / n
    words = data.split()
    if words:
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        distinct = set(words)
        ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        ordered = np.sort(ids)
        edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        top = np.diff(np.append(edges, len(ordered))).max() / len(words)
        again = float((ids[1:] == ids[:-1]).mean()) if len(words) > 1 else 0.0
        marked = np.fromiter((not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words), dtype=bool, count=len(words)).mean()
        shape = [float(lengths.mean()), float(lengths.max()), float(lengths.std())]
        rest = [len(distinct) / len(words), float(top)]
    else:
        shape, rest, again, marked = [0.0, 0.0, 0.0], [0.0, 0.0], 0.0, 0.0
    lines = data.split(b"\n")
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), *kinds.tolist(), *shape, *rest,
        len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), len(zlib.compress(data, 1)) / n, float(marked), again,
        float((kinds[0] + kinds[1] + kinds[10]) * n / max(1, len(words))),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: [tree, inner node] and [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of x, walking all rows down one tree at a time."""
        total = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss on binned columns; split gains come from histograms of gradients."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, d = x.shape
    flat = binned + np.arange(d) * bins
    total = np.full(n, base)
    features, thresholds, values = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (flat + ((node - first) * d * bins)[:, None]).ravel()
            g, h = (np.bincount(at, np.repeat(w, d), count * d * bins).reshape(count, d, bins).cumsum(2) for w in (grad, hess))
            all_g, all_h = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            for j in range(d):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(count, -1).argmax(1)
            worth = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            for i in range(count):
                if worth[i]:
                    features[t, first + i], k = divmod(int(best[i]), bins)
                    thresholds[t, first + i] = edges[features[t, first + i]][k]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        total += values[t, leaf]
    return Trees(features, thresholds, values, base)


def _measured(texts: list) -> np.ndarray:
    return np.array([statistics(x or "") for x in texts], dtype="<f4").reshape(len(texts), len(FEATURES)).astype(float)


def text_statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the statistics of the text as 32-bit floats in ``stats``."""
    return _of_text(df, text_col, keep, F.lit(b"").alias("stats"), lambda x: pa.array([row.astype("<f4").tobytes() for row in x], pa.binary()))


def _of_text(df: DataFrame, text_col: str, keep: list[str], column: Column, made: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """The columns of ``keep`` and one made from the statistics of each text; ``column`` gives its name and type."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(fresh_name(df, "whole_text")))
    schema = source.select(*[F.col(f"`{c}`") for c in keep], column).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keep)):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made(_measured(b.column(len(keep)).to_pylist()))], names=schema.names)

    return source.mapInArrow(work, schema)


def _rows(stats: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(stats), dtype="<f4").reshape(len(stats), len(FEATURES)).astype(float)


def sampled(labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 17) -> DataFrame:
    """h, key, label of usable labels (doc_id, label): all, or about ``train_rows`` of least hash.

    The bound on the hash follows from the number of labels, so that of all partitions together no more than that is read on.
    """
    hashed = labels.where("label in (0, 1) and doc_id is not null").select(F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.col("doc_id").alias("key"), "label")
    n = hashed.count()
    if n <= train_rows:
        return hashed
    # five standard deviations of the number of hashes under the bound are left free
    share = max(0.0, train_rows - 5 * math.sqrt(train_rows)) / n
    return hashed.where(F.col("h") < int(-(2**63) + share * 2**64))


def _fit(stats: DataFrame, chosen: DataFrame, train_rows: int) -> Trees:
    found = stats.select(F.col("doc_id").alias("own"), "stats").join(F.broadcast(chosen), F.col("own") == F.col("key"))
    with small_batches(stats.sparkSession):
        rows = found.select("h", "key", "label", "stats").orderBy("h", "key", "label", "stats").limit(train_rows).collect()
    return fit_trees(_rows([bytes(r.stats) for r in rows]), np.array([r.label for r in rows], dtype=float))


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 17) -> Trees:
    """Fit on the labelled rows (doc_id, label) of ``stats`` with the smallest hashes, ``train_rows`` at most."""
    return _fit(stats, sampled(labels, train_rows, seed), train_rows)


def fit_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 17) -> Trees:
    """``fit`` for documents (doc_id, text): only the texts that the fit takes are measured."""
    chosen = sampled(labels, train_rows, seed)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("key").distinct()), F.col("doc_id") == F.col("key"), "left_semi")
    return _fit(text_statistics(texts, "text", ["doc_id"]), chosen, train_rows)


def apply_trees(stats: DataFrame, trees: Trees) -> DataFrame:
    """``stats`` with score in place of the statistics."""
    keep = [c for c in stats.columns if c != "stats"]
    schema = stats.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("stats")
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(trees.score(_rows(b.column(at).to_pylist())), pa.float64())], names=[*keep, "score"])

    return stats.mapInArrow(work, schema)


def scored(docs: DataFrame, trees: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` and score."""
    return _of_text(docs, text_col, keep, F.lit(0.0).alias("score"), lambda x: pa.array(trees.score(x), pa.float64()))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label of the rows that may be learned from: crc32 of the doc_id's text mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("quality").cast("int").alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of ``documents``: doc_id, held_out, score, predicted."""
    docs = documents(spark, sf_dir)
    out = scored(docs, fit_documents(docs, training_labels(spark, sf_dir)), ["doc_id"])
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; columns and texts stay as they are."""
    trees = fit_documents(docs, training_labels(spark, sf_dir))
    schema, at = docs.schema, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            yield b.filter(pa.array(trees.score(_measured(b.column(at).to_pylist())) >= least))

    return docs.mapInArrow(work, schema)
