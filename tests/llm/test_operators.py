"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.llm import fingerprints, licenses, mixing, near_dups, quality, secrets, sentencepiece_codec, token_store, topk_search, url_filter
from tissuemill.llm.common import Workspace

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, short, long and repeated texts, equal and null ids, and columns that clash with work columns.
ODD = [
    (5, None, "a", None), (4, "", "b", "s"), (4, "", "b", "s"), (3, " \n ", "c", "s"), (2, "x", "d", "t"), (None, "one two three four", "e", None),
    (9, "The quick brown fox jumps over the lazy dog. " * 3000, "f", "s"), (8, "ein ▁ Zeichen\x00 日本 😀 é" * 3, "g", "s"), (7, "one two three four", "h", "u"),
]
ODD_SCHEMA = "doc_id long, text string, ids string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, ODD_SCHEMA)
    for c in ("decoded", "node", "row", "words", "part", "start", "stats", "rate", "copy_no", "whole_text", "spans", "key"):
        frame = frame.withColumn(c, F.lit("own"))
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def random_texts(n, alphabet, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


# 1


def test_sentencepiece_matches_library(spark, odd, docs):
    import sentencepiece

    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(800, "aeiou  ▁▁thernsIN\n\t'\"0123é日本語😀\x00\x01</s><0x0A>́ſ", 90) + ["a" * 5000, "ab" * 3000, "日本語" * 500, "", " ", "▁"]
    codec = sentencepiece_codec.Codec(path)
    ids = [x.tolist() for x in codec.encode(texts)]
    assert ids == library.encode(texts)
    assert codec.decode(ids) == library.decode(ids)
    v = codec.vocabulary
    short = ["▁the", "strengths", "\x00", "日ab"]
    assert [np.frombuffer(x, "<i4").tolist() for x in v.merge_many(short)] == [v.piece_ids(v.merge_heap(x)) for x in short]
    out = sentencepiece_codec.encode_decode(odd, path)
    assert out.columns.count("ids") == 1 and out.count() == len(ODD)
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    rows = sentencepiece_codec.op1_sentencepiece(spark, DIR).join(docs, "doc_id").collect()
    for r in rows:
        want = library.encode(r.text)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(odd.limit(0), path).count() == 0


def test_sentencepiece_memory_of_a_large_batch():
    """A batch of 8 MB is encoded whole, but by parts: what Python holds at a time stays under a bound."""
    import tracemalloc

    import pyarrow as pa

    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [None if i == 77 else " ".join(rng.choices(words, k=400)) for i in range(3300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    assert batch.column(1).nbytes > 8 << 20
    library, rows = sentencepiece_codec.worker_codec(path).library, 0
    tracemalloc.start()
    try:
        for out in sentencepiece_codec.coded_batches(iter([batch]), 1, path, ["doc_id", "ids", "decoded"]):
            assert out.column(0).to_pylist() == list(range(rows, rows + out.num_rows))
            own = [t or "" for t in texts[rows : rows + out.num_rows]]
            assert out.column(2).to_pylist() == own
            for k in (0, out.num_rows - 1):
                assert out.column(1)[k].as_py() == library.encode(own[k])
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 100 << 20


# 2


def test_topk_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.3, 0.7]) for _ in range(4)], "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, [1.0, None, 0.0, 0.0], "x"), (1002, [float("nan")] * 4, "x"), (1003, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (1020, [1.0, 2.0], "x"), (1040, [3.0, 1.0], "x"), (40, rows[40][1], "x"), (1060, [1e10, 1.0, -1e3, 7.0], "x"), (1080, [1e300, 1.0, 0.0, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    got = defaultdict(list)
    for r in topk_search.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    most = 2**63 - 1
    for q in {i for i, _ in valid if i % 20 == 0}:
        want = []
        for _, v in [x for x in valid if x[0] == q]:
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for i, w in valid if i != q and len(w) == len(v))[:20]
            want += [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
        assert sorted(got.pop(q, [])) == sorted(want)
    assert not got
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_selects_ties_by_id():
    scores = np.array([[5, 7, 7, 7, 1, 7]])
    s, i = topk_search._select(scores, np.array([10, 11, 12, 13, 14, 15]), 3)
    assert s.tolist() == [[7, 7, 7]] and i.tolist() == [[11, 12, 13]]


# 3


def test_quality_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    rows = quality.op3_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)


def test_quality_edges(spark, odd, none):
    stats = quality.text_statistics(odd, "text", ["doc_id", "source"])
    empty = quality.fit(stats, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in quality.apply_trees(stats, empty).collect()} == {0.5} and stats.count() == len(ODD)
    one = quality.fit(stats, spark.createDataFrame([(9, 1), (8, 1), (2, 7), (7, None), (None, 0)], "doc_id long, label int"))
    assert all(0.5 < r.score <= 1 for r in quality.apply_trees(stats, one).collect())
    assert quality.text_statistics(none, "text", ["doc_id"]).count() == 0
    assert len(quality.statistics("a b")) == len(quality.FEATURES) == len(quality.statistics(""))


def brute_statistics(text):
    """The statistics one character and word at a time."""
    data = text.encode()
    if not data:
        return [0.0] * len(quality.FEATURES)
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r", ".,;:", "!?", "#$%&*@^~+=", "|<>[]{}()\\/_-", "\"'`"]
    share = [sum(chr(c) in g for c in data) / len(data) for g in groups]
    share += [sum(c > 127 for c in data) / len(data), sum((c < 32 and c not in (10, 13)) or c == 127 for c in data) / len(data)]
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", data)
    n = len(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n if n else 0.0
    shape = [mean, max(lengths, default=0), math.sqrt(sum((x - mean) ** 2 for x in lengths) / n) if n else 0.0]
    rest = [len(set(words)) / n, max(words.count(w) for w in set(words)) / n] if n else [0.0, 0.0]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0
    marked = sum(w[-1] < 128 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ".,;:" for w in words) / n if n else 0.0
    lines = data.split(b"\n")
    letters = sum(chr(c).isalpha() and c < 128 or c > 127 for c in data)
    return [math.log1p(len(text)), math.log1p(n), *share, *shape, *rest, len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)), len(zlib.compress(data, 1)) / len(data), marked, again, letters / max(1, n)]


def test_quality_statistics_match_brute_force():
    texts = random_texts(300, ["a", "Bc", " ", " ", "\n", "7", "é", "!", ",", "#", "\x01", "\t", "'", "(", "word", "word "], 60, 4) + ["", " ", "\n", "x", "same same same\nsame same same", "A" * 70_000, "日本 " * 9000]
    for text in texts:
        assert quality.statistics(text) == pytest.approx(brute_statistics(text), abs=1e-9)


def brute_trees(x, y, trees, depth, bins, rate, l2, least):
    """Boosting row by row and split by split; the scores of the rows."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    total = [math.log(share / (1 - share))] * len(y)
    edges = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-9) for a in p]

        def grow(rows, level, grad=grad, hess=hess):
            g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            if level == depth:
                for i in rows:
                    total[i] -= rate * g / (h + l2)
                return
            best = (1e-6, None, None)
            for j, own in enumerate(edges):
                for e in own:
                    left = [i for i in rows if x[i][j] <= e]
                    gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                    if hl < least or h - hl < least:
                        continue
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, e)
            if best[1] is None:
                grow(rows, level + 1)
            else:
                grow([i for i in rows if x[i][best[1]] <= best[2]], level + 1)
                grow([i for i in rows if x[i][best[1]] > best[2]], level + 1)

        grow(list(range(len(y))), 0)
    return [1 / (1 + math.exp(-t)) for t in total]


def test_trees_match_brute_force():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 4)), 1)  # ties
    x = np.concatenate([x, x[:30]])  # repeated rows
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) * 0.3) > 0).astype(float)
    fitted = quality.fit_trees(x, y, trees=5, depth=3, bins=16)
    assert fitted.score(x) == pytest.approx(brute_trees(x.tolist(), y.tolist(), 5, 3, 16, 0.15, 1.0, 1.0), abs=1e-6)
    for row, score in zip(x.tolist(), fitted.score(x).tolist(), strict=True):  # the flattened trees, walked plainly
        total = fitted.base
        for f, t, leaf in zip(fitted.feature, fitted.threshold, fitted.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_fit_takes_a_bounded_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, label int").repartition(16)
    n = quality.sampled(labels, 1000).count()
    assert 600 < n <= 1000 and quality.sampled(labels, 5000).count() == 5000


# 4


def test_token_store_round_trip(spark, odd, docs, none):
    path = token_store.tokenizer_path("word_bpe_49k.json")
    tokens = token_store.WordTokenizer(path)
    texts = random_texts(3000, "aeiou  'sdllrve  thernsIN\n\t\"0123éÉßÀþŁıİŉſĳ$%&_-!?<|>日Σ½ºª²\x85\xa0\xad¡«¬®°´¶»¿÷×ŐŊǅ\x7f\x1c", 40) + [f"x{chr(i)}y {chr(i)}" for i in range(0x250)]
    assert tokens.encode(texts) == tokens._bytes(texts)
    for frame in (docs, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in frame.select("doc_id", "text").collect())
        want, start = [], 0
        for (there, key), text in rows:
            ids = np.append(np.array(tokens.library.encode(text, add_special_tokens=False).ids, dtype="<u4"), np.uint32(1)).astype("<u4")
            want.append((key if there else None, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
            start += len(ids)
        got = token_store.read_store(token_store.write_store(Workspace(spark, "t"), frame, path)).collect()
        assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in got), key=lambda r: r[1]) == want
    assert token_store.read_store(token_store.write_store(Workspace(spark, "t"), none, path)).count() == 0


def test_token_store_of_several_segments(spark):
    path = token_store.tokenizer_path("word_bpe_49k.json")
    texts = random_texts(60, ["ab", "cd ", " ", "x1"], 40, 3) + ["word " * 500, "", None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, x) for x in texts], "doc_id long, text string").repartition(3)
    store = token_store.write_store(Workspace(spark, "t"), frame, path, segment_ids=50)
    assert store.groupBy("part").count().agg(F.max("count")).first()[0] > 3
    rows = sorted(token_store.read_store(store).collect(), key=lambda r: r.start)
    tokens = token_store.WordTokenizer(path)
    want = [(None, x) for x in sorted(x or "" for x in texts)] + [(i, x or "") for i, x in enumerate(texts)]
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == [(i, np.array([*tokens.library.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in want]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()


def test_other_tokenizer_files_go_to_the_library():
    import json

    from tokenizers import Tokenizer

    tokens = token_store.WordTokenizer(token_store.tokenizer_path("word_bpe_49k.json"))
    assert tokens.known
    file = json.loads(tokens.library.to_str())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        other = Tokenizer.from_str(json.dumps(file | change))
        tokens.library, tokens.known = other, token_store._is_known(json.loads(other.to_str()))
        assert not tokens.known and tokens.encode(["Ab c"]) == tokens._bytes(["Ab c"])


def test_rans_images():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (2, 3), (31, 49_000), (33, 2), (5000, 10), (140_000, 49_000), (200_000, 1)):
        ids = np.minimum((rng.pareto(0.6, n)).astype(np.int64), top - 1).astype("<u2")
        image = token_store.encode_segment(ids, np.array([n]))
        back, lengths = token_store.decode_segment(image)
        assert np.array_equal(back, ids) and lengths.tolist() == [n]
    broken = bytearray(image)
    broken[-2] ^= 255
    broken[len(broken) // 2] ^= 255
    with pytest.raises(ValueError):
        ids = rng.integers(0, 40_000, 70_000).astype("<u2")
        image = bytearray(token_store.encode_segment(ids, np.array([70_000])))
        image[-40] ^= 85
        token_store.decode_segment(bytes(image))


# 5


def brute_components(rows, k, percent):
    sets, of = {}, {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
        of[key] = key

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {key: (len(sets[key]), find(key), find(key) == key) for key in keys}


def family(seed=4):
    """Chains and stars of edited copies, short texts and exact copies."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    for n in (4, 7, 12, 40, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 40), max(1, n // 15)])):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[word()], [], [copy[at], word()]])
                rows.append(" ".join(copy))
                if rng.random() < 0.3:
                    base = copy
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, k, percent):
    for rows in (family(), [(r.doc_id, r.text) for r in docs.collect()]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(frame, k, percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_near_duplicates_edges(odd, none):
    rows = near_dups.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[5].n_shingles == by[4].n_shingles == by[3].n_shingles == 0 and by[2].n_shingles == 1
    assert by[None].component_id is None and by[None].kept and by[7].kept and by[7].n_shingles == 2
    assert near_dups.near_duplicates(none).count() == 0
    kept = near_dups.keep_one(odd.select("doc_id", "text", "ids")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 3, 4, 5, 7, 8, 9] and len(kept) == 8


def test_near_duplicates_of_equal_ids_with_different_texts(spark):
    words = [f"w{i}" for i in range(60)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, one, "a"), (1, other, "b"), (2, one + " x", "c"), (3, other + " y", "d"), (3, other + " y", "e"), (4, "alone", "f"), (4, "alone", "g"), (5, None, "h"), (5, "", "i"), (6, one + " z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, own_set string")
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in near_dups.near_duplicates(frame, 3, 85).collect())
    assert got == [(1, 1, 58), (1, 1, 58), (2, 1, 59), (3, 1, 59), (3, 1, 59), (4, 4, 1), (4, 4, 1), (5, 5, 0), (5, 5, 0), (6, 1, 59)]
    kept = near_dups.keep_one(frame, 3, 85)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, one, "a"), (1, other, "b"), (4, "alone", "f"), (5, None, "h")], key=repr)


def test_registers_keep_bucket_minima():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(1 << 63, size=5000, dtype=np.uint64) * np.uint64(2))
    regs = near_dups.registers(s)
    for b in range(0, near_dups.BUCKETS, 17):
        rest = min(int(x) & ((1 << 56) - 1) for x in s.tolist() if x >> 56 == b) | 1
        zeros = 56 - rest.bit_length()
        assert regs[b] == (zeros << 10 | ((rest << 10 >> (rest.bit_length() - 1)) & 1023))
    a, b = near_dups.registers(s[:4000]), near_dups.registers(s[500:4500])
    assert abs(near_dups.estimate(a[None], b[None], np.array([4000]), np.array([4000]))[0] - 3500 / 4500) < 0.15


# 6


def test_mixing_expected_counts_and_edges(spark, odd, none):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("s0", 3.0)], "source string, weight double")
    out = mixing.mix(frame, weights=weights, target_rows=20_000)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(counts) == {"big", "s0"} and abs(counts["big"] - 5000) < 300 and abs(counts["s0"] - 15_000) < 600
    again = mixing.mix(frame.repartition(7), weights=weights, target_rows=20_000)
    assert out.exceptAll(again).count() == again.exceptAll(out).count() == 0
    mixed = mixing.mix(odd).collect()
    assert all(r.copy_no >= 0 for r in mixed) and {r.doc_id for r in mixed} <= {r[0] for r in ODD}
    assert mixing.mix(none).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_mixing_salted_join(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"s{i % 7}" if i % 2 else None) for i in range(500)], "doc_id long, source string")
    want = sorted(map(tuple, mixing.mix(frame).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(frame).collect()), key=repr) == want


def test_mixing_rows_without_id_draw_alone(spark):
    frame = spark.createDataFrame([(None, f"t{i}", "s") for i in range(1000)] + [(i, "x", "t") for i in range(1000)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s", 1.0), ("t", 1.0), ("s", 2.0), ("u", None)], "source string, weight double")
    counts = [r["count"] for r in mixing.mix(frame, weights=weights).where("doc_id is null").groupBy("text").count().collect()]
    assert len(set(counts)) > 2 and abs(sum(counts) - 1500) < 200
    with pytest.raises(ValueError):
        mixing.mix(frame, weights=spark.createDataFrame([("s", -1.0)], "source string, weight double"))


# 7


def test_url_filter_rules(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/7x?q", "http://example.com/en/8#t", "http://net/de/1", "http://xnet/de/1", "ftp://example.net/de/89", "http://org?x=/es/", "http://sub.org/es/", "x://com/en/://com/fr/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3] == ("example.com", "/en/8", "com/en/", "block") and got[4] == ("net", "/de/1", "net/de/", "block")
    assert got[5][:3] == ("xnet", "/de/1", None) and got[6] == ("example.net", "/de/89", "example.net/de/8", "allow")
    assert got[7][:3] == ("org", "", None) and got[8] == ("sub.org", "/es/", "org/es/", "block") and got[9][:3] == ("com", "/en/://com/fr/", "com/en/")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_filter_rules_are_the_contracts(spark):
    listed = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: verdict for verdict, host, path in url_filter.RULES} == listed
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://net/de/1", "http://a.net/de/8", "http://example.net/de/7", "http://b.example.net/de/89", "http://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r["rule"], r.verdict) for r in url_filter.filter_urls(pages).collect()}
    rules = ["com/en/", "example.com/en/7", "net/de/", "net/de/", "net/de/", "example.net/de/8", "org/es/"]
    assert [got[i] for i in range(len(urls))] == [(r, listed[r]) for r in rules]


def test_mined_rules_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for _ in range(400):
        own = sorted({rng.choice("abcdef") for _ in range(rng.randint(1, 4))})
        rows.append((own, "block" if {"a", "b"} <= set(own) or rng.random() < 0.05 else "allow"))
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9)
    n = {v: sum(r[1] == v for r in rows) for v in ("block", "allow")}
    assert any(set(own) == {"a", "b"} and v == "block" for own, v, _ in mined)
    for own, v, sure in mined:
        share = {x: sum(set(own) <= set(r[0]) and r[1] == x for r in rows) / n[x] for x in n}
        assert sure == pytest.approx(share[v] / sum(share.values())) and sure >= 0.9
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id int, tokens array<string>")
    for r in url_filter.judge(frame, mined).collect():
        hit = [(s, v == "block") for own, v, s in mined if set(own) <= set(rows[r.page_id][0])]
        assert r.mined == ("block" if max(hit, default=(0, False))[1] else "allow")


def test_mining_takes_all_tokens(spark):
    common = [f"c{i}" for i in range(9)]
    rows = [([*common, "bad" if i % 4 == 0 else "good"], "block" if i % 4 == 0 else "allow") for i in range(40)]
    assert {own: v for own, v, _ in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))} == {("bad",): "block", ("good",): "allow"}
    rows = [([f"t{i}"], "block" if i % 2 else "allow") for i in range(300)]
    assert {own[0]: v for own, v, _ in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))} == {own[0]: v for own, v in rows}


def test_url_filter_of_pages(spark):
    rows = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()}
    found, labels = {}, []
    for key, url in rows.items():
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        found[key] = (host, path, best and best[1], best and best[2])
        if best or any(host == h or host.endswith("." + h) for _, h, _ in url_filter.RULES):
            labels.append((set(url_filter.tokens_of(host, path, url)), best[2] if best else "allow"))
    n = {v: sum(x[1] == v for x in labels) for v in ("block", "allow")}
    out = url_filter.op7_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.page_id for r in out) == sorted(rows)
    # every set of tokens that 20 labelled URLs hold with one verdict, by plain counting
    counts = defaultdict(lambda: defaultdict(int))
    for own, verdict in labels:
        own = sorted(own)
        for mask in range(1, 1 << len(own)):
            counts[frozenset(t for i, t in enumerate(own) if mask >> i & 1)][verdict] += 1
    least = max(20, math.ceil(0.002 * len(labels)))
    rules = []
    for own, c in counts.items():
        for v, w in (("block", "allow"), ("allow", "block")):
            share, against = c[v] / n[v], c[w] / max(1, n[w])
            if c[v] >= least and share / (share + against) >= 0.9:
                rules.append((own, v, share / (share + against)))
    for r in out:
        assert (r.host, r.path, r.rule) == found[r.page_id][:3]
        want = found[r.page_id][3]
        if want is None:
            have = set(url_filter.tokens_of(r.host, r.path, rows[r.page_id]))
            want = "block" if max(((s, v == "block") for own, v, s in rules if own <= have), default=(0, False))[1] else "allow"
        assert r.verdict == want
    unlisted = [r for r in out if r.rule is None]
    assert sum(r.verdict == "block" for r in unlisted) < 0.2 * len(unlisted)


# 8


def test_license_spans_count_places_once(spark):
    rng, clause = random.Random(7), licenses.TEMPLATES["bsd"][0].split()
    texts = ["the software " * 12, "the software " * 40_000]
    for drop in range(0, 20, 2):
        own = list(clause)
        for _ in range(drop):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [own[at], "new"], ["x"]])
        texts.append("before " * rng.randint(0, 30) + " ".join(own) + " after" * rng.randint(0, 30))
    texts.append(" ".join(clause[:10] + ["gap"] * 60 + clause[10:]))
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    assert got[0].labels == got[1].labels == "" and got[0].score == got[1].score == 0
    assert got[2].labels == "bsd" and got[2].score == 1
    grams = list(zip(clause, clause[1:], strict=False))
    for i, text in enumerate(texts):
        words = text.split()
        hits = [(at - p, at, p) for at, pair in enumerate(zip(words, words[1:], strict=False)) for p, g in enumerate(grams) if g == pair]
        best = 0.0
        runs = []
        for d, at, p in sorted(hits):
            if not runs or d - runs[-1][-1][0] > licenses.DRIFT:
                runs.append([])
            runs[-1].append((d, at, p))
        for run in runs:
            parts = []
            for _, at, p in sorted(run, key=lambda h: h[1:]):
                if not parts or at - parts[-1][-1][0] > len(grams):
                    parts.append([])
                parts[-1].append((at, p))
            for part in parts:
                share = len({p for _, p in part}) / len(grams)
                if share >= licenses.COVERAGE and part[-1][0] - part[0][0] < 2 * len(grams) + licenses.DRIFT:
                    best = max(best, share)
        assert (got[i].labels == "bsd", got[i].score) == (best > 0, pytest.approx(best))


def test_license_places_match_brute_force(spark, docs, odd, none):
    texts = ["MIT license, mit-LICENSE; Mit  licenses", "a general public license General Public LICENSE", "ÉMIT license mit_license", "Licensed under the Apache License, Version 2.0.", "mit", None, "", "gnu general public x license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files, the software, to deal in the software"]
    frame = spark.createDataFrame([*enumerate(texts), (None, "apache license")], "doc_id long, text string")
    for source in (frame, docs.select("doc_id", "text")):
        want = {r.doc_id: r.text for r in source.collect()}
        for r in licenses.license_scan(source).collect():
            words = licenses.words_of(want[r.doc_id] or "")
            found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            assert (r.n_words, r.n_base) == (len(words), len(found))
            assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
            assert r.base_labels == ",".join(sorted({x[1] for x in found})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
            assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    assert by[8].labels == "mit" and by[8].base_labels == "" and by[8].score > 0.8
    assert licenses.license_scan(odd).count() == len(ODD) and licenses.license_scan(none).count() == 0
    assert "Python" not in licenses.license_scan(frame)._jdf.queryExecution().toString()


# 9


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_secret_spans_match_brute_force(spark, docs, odd, none):
    texts = random_texts(1500, ["password", "SECRET", "toKen", "api_key", "ſecret", '"', "'", "=", ":", " ", "AKIA", "Z9", "0a1b2c3d4e5f", "abc", "\n", "日", "-"], 30)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for source in (frame, docs.select("doc_id", "text"), odd):
        rows = {r.doc_id: r.text or "" for r in source.collect()}
        for r in secrets.digest(secrets.secret_spans(source, ["doc_id"])).collect():
            base = brute_secrets(rows[r.doc_id])
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)
            assert r.base_sha256 == secrets.digest_of(base)
            assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
    assert secrets.secret_spans(none, ["doc_id"]).count() == 0


def test_weak_parts_need_their_complement():
    pair = 'client_id = "svc-mail"\nclient_secret = "hunter22"\nhttps://api.example.org/v1'
    assert [s[0] for s in secrets.scan(pair)] == ["ident", "weak", "endpoint"]
    assert secrets.scan('client_secret = "hunter22"') == [] and secrets.scan('client_id = "svc-mail"') == []
    assert secrets.scan('client_id = "svc-mail"\n\nclient_secret = "hunter22"') == []
    assert secrets.scan('client_id = "svc-mail"' + " x" * 300 + ' client_secret = "hunter22"') == []
    many = "user=abc pass=secret1 " * 2000
    assert len(secrets.scan(many)) == 4000


def brute_links(text):
    """Every pair of parts, by the definition of a scope."""
    span = lambda m, g=0: m.span(g)
    idents = {span(m, 1) for m in secrets._IDENT.finditer(text)} | {span(m) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 8}
    named = {span(m, 1) for m in secrets._WEAK.finditer(text)}
    weak = (named | {span(m) for m in secrets._BARE.finditer(text) if secrets._entropy(m[0]) >= 3.5}) - idents
    ends = {span(m) for m in secrets._ENDPOINT.finditer(text)}
    scope = lambda s: len([1 for m in secrets._BLANK.finditer(text) if m.start() <= s[0]])
    line = lambda s: text.count("\n", 0, s[0])
    apart = lambda a, b: b[0] - a[1] if a[1] <= b[0] else a[0] - b[1] if b[1] <= a[0] else 10**9
    out, linked = set(), set()
    for w in weak:
        for i in idents:
            if scope(i) == scope(w) and (line(i) != line(w) or apart(i, w) <= secrets.REACH):
                out |= {("ident", *i), ("weak", *w)}
                linked.add(scope(w))
        if any(scope(e) == scope(w) for e in ends) and (w in named or not any(e[0] <= w[0] and w[1] <= e[1] for e in ends)):
            out.add(("weak", *w))
            linked.add(scope(w))
    return out | {("endpoint", *e) for e in ends if scope(e) in linked}


def test_linked_parts_match_brute_force():
    parts = ["user=abc", 'client_id: "x-1"', "pass=hunter22", "AKIA12345678", "https://a.example.org/q?token=hunter22", "zX81kQpWmN4rT7vYb2LsD9eF", " ", " ", "\n", "\n\n", " word " * 50]
    rng = random.Random(9)
    for _ in range(600):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(2, 14)))
        assert set(secrets.linked_spans(text)) == brute_links(text)


def test_secrets_of_a_block_of_settings_and_of_long_texts():
    import time

    block = "AKIA12345678\n" + "setting = 5\n" * 30 + "client_secret = hunter22"
    assert [s[0] for s in secrets.scan(block)] == ["ident", "weak"]
    long = "user=abc pass=secret1 https://a.example.org/c " * 22_000
    start = time.perf_counter()
    assert len(secrets.scan(long)) == 66_000
    assert time.perf_counter() - start < 10


def test_secrets_pair_with_endpoints_of_their_scope():
    near = "https://db.example.org/x\npassword: hunter22"
    assert [s[0] for s in secrets.scan(near)] == ["endpoint", "weak"]
    far = "https://db.example.org/x" + " x" * 300 + "\npassword: hunter22"
    assert secrets.scan(far) == [("endpoint", 0, 24), ("weak", len(far) - 8, len(far))]
    assert secrets.scan("https://db.example.org/x\n\npassword: hunter22") == []
    assert secrets.scan("https://a.example.org/2024/a-long-name-of-a-page-17 https://b.example.org/x") == []
    assert [s[0] for s in secrets.scan("https://a.example.org/x?token=hunter22")] == ["endpoint", "weak"]
    assert len(secrets.scan("https://db.example.org/x pass=secret1 " * 2000)) == 4000


def test_redaction(spark):
    text = 'a token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" z'
    frame = spark.createDataFrame([(1, text, len(text)), (2, "clean", 99), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(frame).collect()}
    assert got == {1: ('a [SECRET]" z', 13), 2: ("clean", 99), 3: (None, None)}


# 10


def brute_sketch(text):
    seen, kmers = defaultdict(int), []
    width = fingerprints.K if len(text) >= fingerprints.K else len(text)
    for i in range(len(text) - width + 1 if text else 0):
        kmers.append((text[i : i + width], seen[text[i : i + width]]))
        seen[text[i : i + width]] += 1
    return kmers


def test_fingerprints(spark, docs, odd, none):
    for source in (docs, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in source.select("doc_id", "text").collect())[::-1]
        got = fingerprints.fingerprint_neighbours(source.repartition(5)).collect()
        assert len(got) == len(rows)
        want = []
        for i, ((there, key), text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            cut = len(text) // 3
            changed = text[: len(text) - cut] + following[:cut]
            want.append((key if there else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.written(fingerprints.sketch(text)), fingerprints.written(fingerprints.sketch(changed)),
                         float((fingerprints.sketch(text) == fingerprints.sketch(changed)).mean()), float((fingerprints.sketch(text) == fingerprints.sketch(following)).mean())))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert fingerprints.fingerprint_neighbours(none).count() == 0
    alone = fingerprints.fingerprint_neighbours(docs.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_sketch_selects_least_kmers_in_text_order():
    for text in ("abc", "a" * 50, "the cat sat on the mat and the cat ran off", "ab" * 40 + "xyz"):
        h = fingerprints.kmer_hashes(text)
        kmers = brute_sketch(text)
        assert len(h) == len(kmers) == len(set(h.tolist()))
        again = {}
        for k, v in zip(kmers, h.tolist(), strict=True):
            assert again.setdefault(k, v) == v
        entries = fingerprints.sketch(text)
        for i, order in enumerate(fingerprints._ORDERS[:8].tolist()):
            place = [((v >> 32) * order) & 0xFFFFFFFF for v in h.tolist()]
            least = sorted(sorted(range(len(place)), key=lambda j: place[j])[: fingerprints.TUPLE])
            out = np.array([i + 1], dtype=np.uint64)
            for j in least:
                out = fingerprints._mix(out * fingerprints._BASE + h[j])
            assert entries[i] == int(out[0]) >> 48
    a = "alpha beta gamma delta epsilon zeta eta theta " * 3
    words = a.split()
    assert (fingerprints.sketch(a) == fingerprints.sketch(" ".join(words[::-1]))).mean() < 0.3
    assert (fingerprints.sketch(a) == fingerprints.sketch(a + "!")).mean() > 0.7


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "encoding"]
    big = "/root/testdata/sf0.01"
    work, kept = Workspace(spark, "test"), {}
    current = spark.read.parquet(f"{big}/documents.parquet")
    for name, stage in p.STAGES:
        before, current = current, work.write(stage(spark, current, big), name)
        kept[name] = (before, current)
        if name != "encoding":
            assert current.columns == p.COLUMNS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    passed = {r.doc_id for r in kept["quality"][1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in passed for d in good]) > 0.98 and np.mean([d in passed for d, q in labels.items() if q == 0]) < 0.1
    before, after = kept["near_duplicates"]
    want = {d for d, x in brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80).items() if x[2]}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = kept["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.text == texts[r.doc_id] if not secrets.scan(texts[r.doc_id]) else "[SECRET]" in r.text
        assert not [s for s in secrets.scan(r.text) if s[0] in secrets.BASE]
    before, after = kept["mixture"]
    assert after.select("doc_id", "text").distinct().exceptAll(before.select("doc_id", "text")).count() == 0
    before, after = kept["encoding"]
    assert before.count() == after.count()
