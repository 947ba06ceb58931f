"""MinHash near-duplicates by HyperMinHash registers.

Each text becomes its set of distinct word shingles. The shingle hashes fall into ``BUCKETS`` buckets; a register keeps, of
the bucket's least hash, the count of leading zeros and ``MANTISSA`` bits after them. Empty buckets borrow from others by a
fixed order (densification). Bands of registers propose candidates, the registers' equal share corrected for chance
collisions estimates the Jaccard similarity, and candidates near the threshold or above are confirmed on their full sets.

Texts with equal sets are one class and are compared once. First the classes of a band meet one pivot, the member that agrees
with most others in most bands (the common source of copies, where there is one); links are joined into components. Then the
members of bands with several components are indexed by their rarest shingles, of which linked sets must share one, and those
that meet there and aren't in one component yet are compared. So no link between components is passed over, while a group
whose members are linked, or only somewhat alike, costs little. A link with similarity s is missed only if none of
its bands agree: (1 - s**r)**b, 1e-13 at 0.85 and 2e-9 at 0.8 with the 51 bands of 5 registers used here.

Candidates are confirmed on their whole sorted sets of hashes, which are written once for the classes that have candidates.

Cases: null texts and texts without words have no set (n_shingles 0) and are linked with nothing. Texts shorter than a shingle
are one shingle. Rows without doc_id neither name a component nor join one: their component_id is null and they are kept.
Rows that share a doc_id but not a text are grouped each by its own text. Repeated rows repeat. Empty tables give empty
results. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, slices

BUCKETS, MANTISSA, BAND = 256, 10, 5
BANDS = BUCKETS // BAND
#: Remembered words per worker; the memo is emptied when full.
MEMO_WORDS = 500_000
#: Cells that count shingles for the order of rarity (8 MB), and cells of a chunk.
CELLS, CHUNK = 1 << 21, 1 << 13
#: Standard errors below the threshold at which an estimate still counts as near.
SLACK = 6.0

_RNG = np.random.default_rng(20240229)
#: For every bucket the order in which it borrows from others.
_LENDERS = np.argsort(_RNG.random((BUCKETS, BUCKETS)), axis=1).astype(np.int64)
_MUL = _RNG.integers(1 << 62, dtype=np.uint64, size=16) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct hashes of the word shingles of a text; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words = words
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", errors="surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        fresh = set(words).difference(memo)
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = set(words)
        for w in fresh:
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        mixed = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            mixed = _mix(mixed * _MUL[0] + h[i : i + n])
        return np.unique(mixed)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set of shingle hashes: leading zeros, then mantissa bits, of each bucket's least hash."""
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    edges = np.arange(BUCKETS, dtype=np.uint64) << shift
    first = np.searchsorted(shingles, edges)
    full = first < np.append(first[1:], len(shingles))
    rest = (shingles[np.minimum(first, len(shingles) - 1)] & ((np.uint64(1) << shift) - np.uint64(1))) | np.uint64(1)
    width = int(shift)
    top = np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    top -= (rest >> top.astype(np.uint64)) == 0  # rounding up of the float
    zeros = width - 1 - top
    mantissa = np.where(top >= MANTISSA, rest >> np.maximum(top - MANTISSA, 0).astype(np.uint64), rest << np.maximum(MANTISSA - top, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = np.argmax(full[_LENDERS[empty]], axis=1)
        out[empty] = out[_LENDERS[empty, lender]]
    return out.astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers."""
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in regs[: BANDS * BAND].reshape(BANDS, BAND).T.astype(np.uint64):
        h = _mix(h * _MUL[1] + column)
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by chance.

    Two unequal minima of one bucket agree when they fall into the same cell of leading zeros and mantissa. With about u
    hashes in a bucket the least of them is near 1/u; its cell spans a share 2**-(MANTISSA+1) to 2**-MANTISSA of its own
    size, so that two independent minima agree with a chance of about half of 2**-MANTISSA, whatever u is.
    """
    share = (a == b).mean(1)
    chance = 0.5 / (1 << MANTISSA)
    jaccard = np.clip((share - chance) / (1 - chance), 0, 1)
    most = np.minimum(size_a, size_b) / np.maximum(1, np.maximum(size_a, size_b))  # no more than the sizes allow
    return np.minimum(jaccard, most)


def set_id(shingles: np.ndarray) -> bytes:
    """Name of a set of shingle hashes; equal for equal sets only (128 bits)."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (hash of the set, null without one) and the registers of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in slices(batches, 1):
            size, ids, regs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingler(text)
                size.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])

    return rows.mapInArrow(work, "doc_id long, n_shingles long, set_id binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(b.num_rows, BUCKETS)
            keys = np.concatenate([band_keys(r) for r in regs])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["band", "node"])

    return classes.select("node", "registers").mapInArrow(work, "band long, node long")


def _near(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose estimate isn't clearly below ``similarity``."""
    part = lambda c: classes.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.join(part("a"), "a").join(part("b"), "b").select("a", "b", "ra", "rb", "na", "nb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, BUCKETS) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy() for i in (4, 5))
            # a set of n hashes fills about so many buckets; the others borrow and say nothing new
            filled = BUCKETS * -np.expm1(-np.minimum(na, nb) / BUCKETS)
            least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / filled)
            sizes = np.minimum(na, nb) >= (similarity - 1e-9) * np.maximum(na, nb)
            keep = pa.array(sizes & (estimate(a, b, na, nb) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def _sets(work: Workspace, nodes: DataFrame, classes: DataFrame, text_rows: DataFrame, words: int) -> DataFrame:
    """``nodes`` (node and other longs) with shingles: the sorted hashes of each set, from a text of the class's first document, written once."""
    own = [c for c in nodes.columns if c != "node"]
    wanted = nodes.join(classes.select("node", "set_id", "first"), "node")
    rows = text_rows.join(wanted, "first").select("node", *own, "set_id", "text")
    n = 1 + len(own)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for b in slices(batches, n + 1):
            found, keep = [shingler(text) for text in b.column(n + 1).to_pylist()], []
            for s, node, name in zip(found, b.column(0).to_pylist(), b.column(n).to_pylist(), strict=True):
                # rows that share the document's id may hold another text, or the same once more
                keep.append(node not in seen and set_id(s) == name)
                if keep[-1]:
                    seen.add(node)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([*[c.filter(keep) for c in b.columns[:n]], pa.array([s.tobytes() for s in found], pa.binary()).filter(keep)], names=["node", *own, "shingles"])

    return work.write(rows.mapInArrow(shingle, f"node long, {''.join(f'{c} long, ' for c in own)}shingles binary"), "sets")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common elements of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
    return int((large[at] == small).sum()) if len(small) else 0


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    part = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(part("b"), "b").join(part("a"), "a").select("a", "b", "sa", "sb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = _shared(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Each round a node takes the least label of its neighbours and itself, and then that label's own label, which halves the
    way to the smallest node each time; until nothing changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = work.write(both.union(both.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = work.write(edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component", F.lit(True).alias("changed")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
        new = heard.groupBy("a").agg(F.min("component").alias("m"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old"))
        jump = new.join(labels.select(F.col("node").alias("m"), F.col("component").alias("further")), "m")
        labels, before = work.write(jump.select(F.col("a").alias("node"), F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("changed")), "labels"), labels
        work.drop(before)
        if not labels.where("changed").limit(1).count():
            work.drop(edges)
            return labels.select("node", "component")


#: Parts into which a join deals a hot key.
SALTS = 4


def _salted(rows: DataFrame, by: str, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` joined on ``key`` with ``keyed``, which has a row for each key; a key's rows are dealt into ``SALTS`` parts by a hash of ``by``."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).alias("salt")
    return rows.select("*", salt).join(keyed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), [key, "salt"]).drop("salt")


def grouped(work: Workspace, docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id, component and component_id of every row of ``docs``.

    ``component`` is a number of the group, null for rows without a set or doc_id; ``component_id`` is its smallest doc_id.
    """
    all_rows = work.write(signatures(docs, words, id_col, text_col), "signatures")
    usable = all_rows.where("set_id is not null and doc_id is not null")
    named = usable.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # a class of equal sets has a number of its own, as two texts may share a doc_id; numbers ascend with the first doc_id
    classes = work.write(named.repartitionByRange("first").sortWithinPartitions("first", "set_id").withColumn("node", F.monotonically_increasing_id()), "classes")
    text_rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("first"), F.col(f"`{text_col}`").cast("string").alias("text"))

    bands = work.write(_bands(classes), "bands")
    members = _salted(bands, "node", bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    # central members agree with many others in many bands; a group's common source is the most central of all
    weight = members.groupBy("node").agg(F.sum(F.log2("n")).alias("weight"))
    weighed = work.write(members.join(weight, "node").select("band", "node", "weight"), "weighed")
    work.drop(bands)
    pivot = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("p")).select("band", (-F.col("p.m")).alias("x"))
    stars = _salted(weighed, "node", pivot, "band").where("node <> x").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    tested = work.write(stars, "stars")
    near = work.write(_near(tested, classes, percent / 100), "near")
    sets = _sets(work, near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(), classes, text_rows, words)
    links = work.write(_confirm(near, sets, percent), "links")
    work.drop(sets, near)
    labels = components(work, links)

    # what is left: members of bands with several components
    placed = work.write(weighed.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "placed")
    work.drop(weighed)
    sets = _sets(work, _mixed(placed, "band").select("node", "component").distinct(), classes, text_rows, words)
    tokens = _rarest(work, sets, percent)
    work.drop(placed)
    rows = _mixed(tokens, "token")
    minor = rows.where("component <> main").select("token", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("place").alias("px"), F.col("n").alias("nx"))
    # behind their first common shingle both sets must have room for the intersection that a link needs
    room = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place")) * (100 + percent) >= percent * (F.col("nx") + F.col("n"))
    pairs = minor.join(rows, "token").where("cx <> component and (component = main or x < node)").where(room)
    rest = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    further = work.write(_confirm(_near(rest, classes, percent / 100), sets.select("node", "shingles"), percent), "further")
    work.drop(sets, tokens, tested)
    if further.limit(1).count():
        # links between components, which are few and small beside the links within
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        end = lambda c: F.coalesce(f"c{c}", c).alias(c)
        met = components(work, further.join(of("a"), "a", "left").join(of("b"), "b", "left").select(end("a"), end("b")))
        met = met.select(F.col("node").alias("old"), F.col("component").alias("joined"))
        every = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("old"))
        labels = every.join(met, "old", "left").select("node", F.coalesce("joined", "old").alias("component"))
    heads = classes.select(F.col("node").alias("component"), F.col("first").alias("component_id"))
    known = (
        classes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
        .join(heads, "component").select("set_id", "component", "component_id")
    )
    columns = ["doc_id", "n_shingles", "set_id"]
    alone = all_rows.where("set_id is null or doc_id is null").select(*columns, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return usable.select(columns).join(known, "set_id").select(*columns, "component", "component_id").union(alone)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union of the sets of ``words``-word shingles."""
    rows = grouped(Workspace(docs.sparkSession, "neardup"), docs, words, percent, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The members (key, node, component, ...) of groups with several components, with the group's commonest one in ``main``."""
    tally = placed.groupBy(key, "component").agg(F.count("*").alias("n"))
    mixed = tally.groupBy(key).agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    return _salted(placed, "node", mixed.select(key, F.col("most.component").alias("main")), key)


def _rarest(work: Workspace, held: DataFrame, percent: int) -> DataFrame:
    """(token, node, component, place in the order, n) from ``held`` (node, component, shingles): of each node's set of n the n - ceil(n * percent / 100) + 1 shingles that are rarest in ``held``.

    Linked sets share at least ceil(n * percent / 100) shingles of either, so one of the rarest, in any order common to all.
    Counts are kept in ``CELLS`` cells, which makes the order coarser and loses no pair; a shingle counted once has no partner.
    """
    spark = held.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        for b in batches:
            for own in b.column(2):
                np.add.at(cells, (np.frombuffer(own.as_buffer(), "<u8") % np.uint64(CELLS)).astype(np.int64), 1)
        for chunk, own in enumerate(cells.reshape(-1, CHUNK)):
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<u4").tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        cells = np.zeros(CHUNK, dtype=np.uint32)
        for at, n in zip(group.column("at").to_pylist(), group.column("n").to_pylist(), strict=True):
            cells[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        return pa.table({"chunk": group.column("chunk").slice(0, 1).cast(pa.int32()), "n": pa.array([cells.astype("<u4").tobytes()], pa.binary())})

    chunks = held.mapInArrow(count, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary")
    table = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.uint32)
    for r in chunks.collect():  # CELLS numbers, whatever the input
        table[r.chunk] = np.frombuffer(r.n, "<u4")
    shared = spark.sparkContext.broadcast(table.ravel())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            tokens, sizes, places, lengths = [], [], [], []
            for packed in b.column(2):
                own = np.frombuffer(packed.as_buffer(), "<u8")
                n = cells[(own % np.uint64(CELLS)).astype(np.int64)]
                first = np.lexsort((own, n))[: len(own) - -(-len(own) * percent // 100) + 1]
                at = np.flatnonzero(n[first] > 1)
                tokens.append(own[first[at]])
                places.append(at)
                sizes.append(len(at))
                lengths.append(len(own))
            columns = [np.concatenate(tokens).view(np.int64), np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), np.concatenate(places), np.repeat(lengths, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "node", "component", "place", "n"])

    return work.write(held.mapInArrow(pick, "token long, node long, component long, place long, n long"), "tokens")


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 3-word shingles at a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row of its smallest doc_id; other columns stay.

    Where rows share that doc_id and the component, the least by content stays, once; rows without words that share a doc_id
    stay once too. Rows without doc_id stay.
    """
    work = Workspace(docs.sparkSession, "neardup-filter")
    rows = grouped(work, docs, words, percent).where("doc_id is not null")
    # of a component with several rows of its smallest doc_id the texts must be looked at; commonly there are none
    tally = work.write(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("k")).where("k = 1").select("doc_id", "n"), "kept")
    once = docs.join(tally.where("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    out = once.unionByName(docs.where("doc_id is null"))
    several = tally.where("n > 1").select("doc_id")
    if not several.limit(1).count():
        return out
    plain = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.join(several, "doc_id", "left_semi").select(docs.columns).toDF(*plain)
    text_at = docs.columns.index("text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in slices(batches, text_at):
            found = [shingler(x) for x in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_id(s) if len(s) else None for s in found], pa.binary())], names=[*plain, "own_set"])

    sets = held.mapInArrow(name, held.withColumn("own_set", F.lit(None).cast("binary")).schema)
    kept = rows.where("doc_id = component_id").select(F.col("doc_id").alias("own"), F.col("set_id").alias("kept_set"), "component").distinct()
    both = sets.join(kept, (F.col(plain[docs.columns.index("doc_id")]) == F.col("own")) & F.col("own_set").eqNullSafe(F.col("kept_set")))
    least = both.groupBy("own", "component").agg(F.min(F.struct(*plain)).alias("row"))
    return out.unionByName(least.select([F.col(f"row.{p}").alias(c) for p, c in zip(plain, docs.columns, strict=True)]))
