"""Secret scan with multipart credential linking.

Base spans are found by three patterns (assign, access, hex) on their own. Weak candidates - identifiers, short or unnamed
secrets, endpoints - are reported only where complementary parts co-occur within a scope: a paragraph, cut by blank lines.
An identifier and a secret on different lines of the paragraph (a block of settings) are paired whatever lies between them; on
one line (running text) where they are at most ``REACH`` code points apart. A secret is paired with every endpoint of the
paragraph, with or without an identifier. Paired parts are reported as ident, weak and endpoint. An unnamed secret inside an
endpoint is a piece of that endpoint and pairs with identifiers only. Each part looks its nearest complement up in sorted
intervals and is marked; no pairs are formed, so that time grows with the number of parts and its logarithm.

Cases: null and empty texts have no spans. Text is taken whole. Positions are code points, ends exclusive; spans are ordered
by start, then kind as in ``KINDS``, then end. Rows repeat as they are; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_name, slices

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE = KINDS[:3]
#: Code points between an identifier and its secret on one line.
REACH = 200

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# The patterns of weak parts.
_IDENT = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|access_?id|user_?name|user|login|account)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9@._-]{3,})""")
_WEAK = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:client_?secret|private_?key|secret_?key|credential|passphrase|password|passwd|secret|token|api_?key|pwd|pass|key)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9+/_.=-]{6,})""")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,40}[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:https?|ftp|amqp|jdbc:[a-z]{1,20}|postgres|postgresql|mysql|redis|mongodb)://[^\x00-\x20"'<>]+""")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


class _Parts:
    """The intervals of one kind in one scope, with their lines."""

    def __init__(self, spans: list[tuple[int, int]], line: Callable[[int], int]):
        self.spans = spans
        self.starts, self.ends = sorted((line(s), s) for s, _ in spans), sorted((line(s), e) for s, e in spans)

    def near(self, line: int, start: int, end: int) -> bool:
        """Whether some interval is on another line, or beside this one on its own line at most ``REACH`` away."""
        if self.starts[0][0] != line or self.starts[-1][0] != line:
            return True
        after = bisect_left(self.starts, (line, end))
        before = bisect_right(self.ends, (line, start)) - 1
        return (after < len(self.starts) and self.starts[after][1] - end <= REACH) or (before >= 0 and start - self.ends[before][1] <= REACH)


def linked_spans(text: str) -> list[tuple[str, int, int]]:
    """Weak parts that complement one another within a scope."""
    idents = {m.span(1) for m in _IDENT.finditer(text)}
    if "AKIA" in text:
        idents |= {m.span() for m in ACCESS.finditer(text) if 8 <= m.end() - m.start()}
    endpoints = [m.span() for m in _ENDPOINT.finditer(text)] if "://" in text else []
    if not idents and not endpoints:
        return []
    named = {m.span(1) for m in _WEAK.finditer(text)}
    secrets = named | {m.span() for m in _BARE.finditer(text) if _entropy(m[0]) >= 3.5}
    secrets -= idents
    if not secrets:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    breaks = [m.start() for m in re.finditer("\\n", text)]
    scope = lambda s: bisect_right(cuts, s[0])
    # matches don't overlap, so that both ends ascend
    begins = [s[0] for s in endpoints]
    reached = {scope(s) for s in endpoints}

    def within_endpoint(s: tuple[int, int]) -> bool:
        at = bisect_right(begins, s[0]) - 1
        return at >= 0 and s[1] <= endpoints[at][1]

    line = lambda at: bisect_right(breaks, at)
    parts: dict[str, dict[int, _Parts]] = {}
    for kind, spans in (("ident", idents), ("weak", secrets)):
        own: dict[int, list] = {}
        for s in spans:
            own.setdefault(scope(s), []).append(s)
        parts[kind] = {k: _Parts(v, line) for k, v in own.items()}
    out, linked = set(), set()
    for kind, other in (("ident", "weak"), ("weak", "ident")):
        for own, mine in parts[kind].items():
            theirs = parts[other].get(own)
            for s in mine.spans:
                paired = theirs is not None and theirs.near(line(s[0]), *s)
                if paired or (kind == "weak" and own in reached and (s in named or not within_endpoint(s))):
                    out.add((kind, *s))
                    linked.add(own)
    out.update(("endpoint", *s) for s in endpoints if scope(s) in linked)
    return list(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: base ones and linked weak ones."""
    return ordered(base_spans(text) + linked_spans(text))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` and spans: array of (kind, start, end)."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(fresh_name(docs, "whole_text")))
    schema = source.select(*[F.col(f"`{c}`") for c in keep], F.expr("cast(null as array<struct<kind: string, start: bigint, end: bigint>>)").alias("spans")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keep)):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(spans, _SPAN)], names=[*keep, "spans"])

    return source.mapInArrow(work, schema)


def digest(spans: DataFrame) -> DataFrame:
    """The digest columns of ``secret_spans``'s result."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark`` (touching spans by one) and ``n_chars`` counted anew for changed rows."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def clean(text: str | None) -> str | None:
        spans = scan(text) if text else []
        if not spans:
            return text
        out, done = [], 0
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if start > done or not out:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts, counts = b.column(at).to_pylist(), b.column(chars).to_pylist()
            cleaned = [clean(t) for t in texts]
            counts = [n if c is t or c == t else len(c) for n, t, c in zip(counts, texts, cleaned, strict=True)]
            columns = list(b.columns)
            columns[at], columns[chars] = pa.array(cleaned, b.column(at).type), pa.array(counts, b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(work, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``."""
    return digest(secret_spans(documents(spark, sf_dir), ["doc_id"]))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """sha256 of the base spans, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
