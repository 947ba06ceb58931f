"""Document fingerprints by Order MinHash.

The k-mers of a text (runs of ``K`` code points) are numbered by occurrence, so that repeats differ. For each of ``SKETCHES``
orders - multiplications of one 32-bit hash by odd numbers - the ``TUPLE`` least k-mers are selected, put back into text order
and hashed as a tuple. Equal entries of two fingerprints estimate how alike the texts are, with regard to order: texts of equal
k-mers in another order differ, as edit distance does.

Neighbours (each text with the next in descending doc_id) come from one range partitioning by doc_id: a partition handles its
rows in order, and only its first and last row are carried over to be joined with the neighbouring partition's.

Cases: null texts are empty. The empty text has the fingerprint of no k-mers; texts shorter than ``K`` are one k-mer; texts
with fewer k-mers than a tuple takes use those there are. Equal doc_ids are ordered by text, null doc_ids come last. A single
document is its own next. An empty table gives an empty result. Repeated rows repeat; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, slices

K, TUPLE, SKETCHES = 8, 2, 64
#: Hex digits of a fingerprint's entry.
DIGITS = 4

_RNG = np.random.default_rng(1906)
_ORDERS = (_RNG.integers(1 << 31, size=SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def kmer_hashes(text: str) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers, in text order."""
    points = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h, power, width = points + np.uint64(1), int(_BASE), 1
    while width < K and n - 2 * width + 1 > 0:  # doubles the run; K is a power of two
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = (power * power) & 0xFFFFFFFFFFFFFFFF, 2 * width
    if width < K:  # shorter than K: the text is one k-mer
        value = 0
        for p in points.tolist():
            value = (value * int(_BASE) + p + 1) & 0xFFFFFFFFFFFFFFFF
        h = np.array([value], dtype=np.uint64)
    h = _mix(h)
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        at = np.minimum(np.searchsorted(again, h), len(again) - 1)
        rows = np.flatnonzero(again[at] == h)
        group = at[rows]
        order = np.argsort(group, kind="stable")
        firsts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        numbers = np.empty(len(rows), dtype=np.uint64)
        numbers[order] = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.append(firsts, len(rows))))
        h[rows] = _mix(h[rows] + numbers * _BASE)
    return h


def sketch(text: str) -> np.ndarray:
    """The fingerprint's entries as 16-bit numbers."""
    h = kmer_hashes(text)
    if not len(h):
        return np.zeros(SKETCHES, dtype=np.uint16)
    small = (h >> np.uint64(32)).astype(np.uint32)
    at = np.empty((SKETCHES, min(TUPLE, len(h))), dtype=np.int64)
    for i, order in enumerate(_ORDERS):
        place = small * order
        for j in range(at.shape[1]):
            at[i, j] = k = int(place.argmin())
            place[k] = np.uint32(0xFFFFFFFF)
    at.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1)
    for column in at.T:
        out = _mix(out * _BASE + h[column])
    return (out >> np.uint64(48)).astype(np.uint16)


def written(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/3) code points replaced by the first as many (or all) of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(key: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    fresh = own if changed == text else sketch(changed)
    return (key, len(text), hashlib.sha256(changed.encode("utf-8", errors="surrogatepass")).hexdigest(), written(own), written(fresh), float((own == fresh).mean()), float((own == theirs).mean()))


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form: columns of ``_RESULT``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last()]
    rows = rows.repartitionByRange(*order, F.substring("text", 1, 32).desc()).sortWithinPartitions(*order, F.col("text").desc())
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = [*_RESULT, "part", "role", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        edge = lambda role, x: (x[0], *[None] * 6, part, role, x[1])
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for b in slices(batches, 1):
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sketch(text)
                if last is None:
                    out.append(edge("first", (key, text)))
                else:
                    out.append((*_row(*last, text, own), part, "row", None))
                last = (key, text, own)
            if out:
                yield pack(out)
        if last is not None:
            yield pack([edge("last", last)])

    parts = Workspace(spark, "fingerprints").write(rows.mapInArrow(work, f"{_SCHEMA}, part int, role string, text string"), "parts")
    # one number per partition that had rows: as many as tasks, whatever the input
    have = sorted(r.part for r in parts.where("role = 'first'").select("part").collect())
    chain = spark.createDataFrame(list(zip(have, [*have[1:], *have[:1]], strict=True)), "part int, next int")
    firsts = parts.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = parts.where("role = 'last'").select("part", "doc_id", "text").join(chain, "part").join(firsts, "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_row(k, t, sketch(t), f, sketch(f)) for k, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[:7], strict=True)], names=_RESULT)

    return parts.where("role = 'row'").select(_RESULT).union(edges.mapInArrow(finish, _SCHEMA))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents`` with their neighbours."""
    return fingerprint_neighbours(documents(spark, sf_dir))
