"""Token-ID files compressed by a static range asymmetric numeral system (rANS).

Texts are range-partitioned and sorted by doc_id, tokenised, and gathered into segments of some million ids. A segment is a
self-contained binary image (``SEGMENT`` below): one frequency table shared by its blocks, and blocks of ids, each coded by
its own interleaved lane states. Every block has checkpoints (lane states and stream place each ``CHECKPOINT`` steps), so
that spans of a block decode side by side, and a checksum of its ids, which decoding verifies. Segments are rows of a parquet
table in a folder that all machines share; their order by (part, segment) is that of the documents.

Segment image, little-endian: magic ``TMR1``; header length and a JSON header (counts, shape, scale, lanes, doc ids and
lengths as deflated bytes' lengths); then, in this order, deflated document lengths, frequency table (ids, frequencies),
block checksums, words per block and span, lane states per span, and the words of all blocks.

Cases: a null or empty text has no ids but the end id. Null doc_ids come first. Rows with equal doc_id are ordered by text and
stay separate documents. An empty table gives an empty store. Further columns are not read. A segment is closed by the
document that fills it, so that a document longer than a segment ends one, which is as long as need be.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Workspace, documents, remembered, slices
from .sentencepiece_codec import tokenizer_path

#: Ids in a segment and in a block, lanes of a block, steps between checkpoints.
SEGMENT_IDS, BLOCK_IDS, LANES, CHECKPOINT = 2_000_000, 65_536, 32, 128
#: Bits of the frequency scale; states are in [2**31, 2**63) and move in words of 32 bits.
SCALE, LOW = 20, 1 << 31
#: Remembered words per worker; the memo is emptied when full.
MEMO_WORDS = 1_000_000

#: Characters for which the vocabulary's normalizer and pattern act as ``_WORD`` does: printable ASCII, white space, and Latin
#: letters and signs which have one lower-case form, are composed, and are no numbers outside 0-9.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-©«-¬®-±´¶-¸»¿-įĲ-Ňŋ-ſ]*")
#: The normalizer and pattern of a vocabulary file for which ``_PLAIN`` and ``_WORD`` hold.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters of each task's first texts for which the ids are compared with the library's.
COMPARED_CHARS = 100_000

_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class WordTokenizer:
    """Ids as the tokenizers library gives them; words of plain texts are remembered with their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = _is_known(json.loads(self.library.to_str()))
        self.width = "<u2" if self.library.get_vocab_size() <= 65_536 else "<u4"
        self.memo: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text with spaces between: every word ends in the one piece that carries its end."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.width)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._bytes(words)
        data, at = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
        return [data[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember chunks without white space, and the words they consist of."""
        memo, several = self.memo, [(c, _WORD.findall(c)) for c in chunks if not c.isalpha()]
        memo[""] = b""
        words = {c for c in chunks if c.isalpha()}.union(*(parts for _, parts in several))
        fresh = [*words.difference(memo)]
        for i in range(0, len(fresh), 512):
            run = fresh[i : i + 512]
            memo.update(zip(run, self._words(run), strict=True))
        for c, parts in several:
            memo[c] = b"".join([memo[w] for w in parts])

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        # no word spans white space, so that chunks between white space are remembered whole
        if not self.known:
            return self._bytes(texts)
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        lowered = pc.utf8_lower(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string()))
        known = iter(remembered(self.memo, pc.utf8_split_whitespace(lowered), self._learn, MEMO_WORDS, self.width))
        others = iter(self._bytes([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(known).tobytes() if p else next(others) for p in plain]


def _is_known(file: dict) -> bool:
    """Whether a vocabulary file cuts and normalises texts as ``_PLAIN`` and ``_WORD`` assume; others go to the library whole."""
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = file.get("model") or {}
    return (
        (file.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": _PATTERN}, "Removed", True)
        and (cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == (False, False)
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and all(a.get("content", "").startswith("<|") for a in file.get("added_tokens") or [])
    )


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, so that its memo outlives a task."""
    return WordTokenizer(path)


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, at least 1 each, that sum to 2**SCALE."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more distinct ids than the frequency scale holds")
    freq = np.maximum(1, counts.astype(np.int64) * total // counts.sum())
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - total
    if over < 0:
        freq[order[0]] -= over
    for i in order:  # few steps: large frequencies take most of the surplus
        if over <= 0:
            break
        take = min(over, int(freq[i]) - 1, max(1, int(freq[i]) // 2))
        freq[i] -= take
        over -= take
    while over > 0:
        i = int(freq.argmax())
        take = min(over, int(freq[i]) - 1)
        freq[i] -= take
        over -= take
    return symbols.astype("<u4"), freq.astype("<u4")


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The segment image of ``ids`` (all documents' one after another), with the documents' lengths."""
    n = len(ids)
    blocks = max(1, n // BLOCK_IDS)
    steps = max(1, -(-n // (blocks * LANES)))
    symbols, freq = _frequencies(ids)
    number = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
    number[symbols] = np.arange(len(symbols))
    dense = number[ids]
    padded = np.full(blocks * steps * LANES, int(freq.argmax()), dtype=np.int64)
    padded[:n] = dense
    grid = padded.reshape(blocks, steps, LANES)
    start = np.append(0, np.cumsum(freq[:-1])).astype(np.uint64)
    wide = freq.astype(np.uint64)
    spans = -(-steps // CHECKPOINT)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    given = np.zeros((steps, blocks, LANES), dtype=bool)
    words = np.zeros((steps, blocks, LANES), dtype=np.uint32)
    marks = np.zeros((spans, blocks, LANES), dtype="<u8")
    scale, half = np.uint64(SCALE), np.uint64(32)
    limit = wide << np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = wide[s]
        give = state >= limit[s]
        given[t] = give
        words[t] = state.astype(np.uint32)
        state = np.where(give, state >> half, state)
        q = state // f
        state = (q << scale) + (state - q * f) + start[s]
        if t % CHECKPOINT == 0:
            marks[t // CHECKPOINT] = state
    per = np.stack([given[i : i + CHECKPOINT].sum((0, 2)) for i in range(0, steps, CHECKPOINT)], 1).astype("<u4")
    stream = words.transpose(1, 0, 2)[given.transpose(1, 0, 2)].astype("<u4")
    flat = padded.reshape(blocks, -1)
    sums = np.array([zlib.crc32(symbols[b].tobytes()) for b in flat], dtype="<u4")
    parts = [zlib.compress(lengths.astype("<u4").tobytes(), 1), zlib.compress(symbols.tobytes() + freq.tobytes(), 1), sums.tobytes(), per.tobytes(), marks.tobytes(), stream.tobytes()]
    header = json.dumps({"n": n, "blocks": blocks, "steps": steps, "lanes": LANES, "checkpoint": CHECKPOINT, "scale": SCALE, "parts": [len(p) for p in parts]}).encode()
    return b"TMR1" + len(header).to_bytes(4, "little") + header + b"".join(parts)


def decode_segment(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a segment image and the documents' lengths; all spans of all blocks decode side by side."""
    if image[:4] != b"TMR1":
        raise ValueError("not a segment image")
    size = int.from_bytes(image[4:8], "little")
    h = json.loads(image[8 : 8 + size])
    parts, at = [], 8 + size
    for p in h["parts"]:
        parts.append(image[at : at + p])
        at += p
    blocks, steps, lanes, each, bits = h["blocks"], h["steps"], h["lanes"], h["checkpoint"], h["scale"]
    lengths = np.frombuffer(zlib.decompress(parts[0]), "<u4")
    table = np.frombuffer(zlib.decompress(parts[1]), "<u4").reshape(2, -1)
    symbols, freq = table[0], table[1].astype(np.uint64)
    start = np.append(0, np.cumsum(table[1][:-1].astype(np.int64))).astype(np.uint64)
    slots = np.repeat(np.arange(len(symbols), dtype=np.int32), table[1])
    spans = -(-steps // each)
    per = np.frombuffer(parts[3], "<u4").reshape(blocks * spans).astype(np.int64)
    state = np.frombuffer(parts[4], "<u8").reshape(spans, blocks, lanes).transpose(1, 0, 2).reshape(blocks * spans, lanes).copy()
    stream = np.append(np.frombuffer(parts[5], "<u4"), np.uint32(0)).astype(np.uint64)
    place = np.append(0, np.cumsum(per))[:-1]
    out = np.zeros((blocks * spans, each, lanes), dtype=np.int32)
    low, mask, scale, half = np.uint64(LOW), np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    tail = steps - (spans - 1) * each
    live = np.arange(blocks * spans)
    for t in range(each):
        if t == tail and spans > 1:
            live = live[live % spans != spans - 1]
            state, place = state[live], place[live]
        elif t == tail:
            break
        slot = state & mask
        s = slots[slot]
        out[live, t] = s
        state = freq[s] * (state >> scale) + slot - start[s]
        need = state < low
        rank = np.cumsum(need, 1)
        word = stream[np.minimum(place[:, None] + rank - 1, len(stream) - 1)]
        state = np.where(need, (state << half) | word, state)
        place = place + rank[:, -1]
    ids = symbols[out.reshape(blocks, spans * each, lanes)[:, :steps]]
    sums = np.frombuffer(parts[2], "<u4")
    for b in range(blocks):
        if zlib.crc32(np.ascontiguousarray(ids[b]).tobytes()) != sums[b]:
            raise ValueError(f"checksum of block {b} doesn't match")
    return ids.reshape(-1)[: h["n"]], lengths


_SEGMENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("image", T.BinaryType())])


def write_store(work: Workspace, docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Tokenise ``docs``, append ``end_id`` to each, and write the segments in ascending doc_id order; returns the store's table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, tokens = TaskContext.get().partitionId(), 0, worker_tokenizer(tokenizer)
        end = np.array([end_id], dtype=tokens.width).tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        size, compared = 0, False

        def close() -> pa.RecordBatch:
            nonlocal number
            width = np.dtype(tokens.width).itemsize
            lengths = np.array([len(x) // width for x in held])
            ids = np.frombuffer(b"".join(held), dtype=tokens.width)
            keys = pa.array(doc_ids, pa.int64())
            packed = zlib.compress(np.packbits(keys.is_valid().to_numpy(zero_copy_only=False)).tobytes() + keys.fill_null(0).to_numpy().astype("<i8").tobytes(), 1)
            data = [[part], [number], [len(held)], [len(ids)], [packed], [encode_segment(ids, lengths)]]
            number += 1
            held.clear(), doc_ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[f.name for f in _SEGMENT])

        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            coded = tokens.encode(texts)
            if not compared:
                first = next((i for i, n in enumerate(accumulate(map(len, texts)), 1) if n >= COMPARED_CHARS), len(texts))
                if tokens._bytes(texts[:first]) != coded[:first]:
                    raise RuntimeError("the ids differ from the tokenizers library's")
                compared = True
            for key, ids in zip(b.column(0).to_pylist(), coded, strict=True):
                held.append(ids + end)
                doc_ids.append(key)
                size += len(ids) // len(end) + 1
                if size >= segment_ids:
                    yield close()
                    size = 0
        if held:
            yield close()

    return work.write(rows.mapInArrow(gather, _SEGMENT), "store")


def read_store(store: DataFrame) -> DataFrame:
    """Decode the segments: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and the ids as little-endian 32-bit binary."""
    spark = store.sparkSession
    sizes = store.select("part", "segment", "n_ids")
    by_part = Window.partitionBy("part").orderBy("segment")
    # one row per partition of the writer: as many as it had tasks, whatever the input
    bases, total = [], 0
    for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r.part, total))
        total += r.n
    base = spark.createDataFrame(bases, "part int, base long")
    starts = sizes.withColumn("before", F.sum("n_ids").over(by_part) - F.col("n_ids")).join(F.broadcast(base), "part").select("part", "segment", (F.col("base") + F.col("before")).alias("start"))
    rows = store.join(starts, ["part", "segment"]).select("start", "doc_ids", "image")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 1):  # a segment at a time
            for start, packed, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, lengths = decode_segment(image)
                n = len(lengths)
                raw = zlib.decompress(packed)
                keys = np.frombuffer(raw[-8 * n :], "<i8")
                valid = np.unpackbits(np.frombuffer(raw[: -8 * n], np.uint8))[:n].astype(bool)
                ends = np.cumsum(lengths.astype(np.int64))
                data = ids.astype("<u4").tobytes()
                pieces = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=~valid), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return rows.mapInArrow(scatter, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``documents`` as a token store and read it back: doc_id, start, n_tokens, ids_crc32."""
    store = write_store(Workspace(spark, "tokens"), documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return read_store(store).select("doc_id", "start", "n_tokens", "ids_crc32")
