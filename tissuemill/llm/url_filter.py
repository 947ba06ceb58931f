"""URL filter by association rules.

Known verdicts label URLs: those of listed rules of host and path and, as evidence for the other side, allow for URLs on a
listed host whose path no rule fits. Spark's FP-growth mines the labelled URLs' token sets for combinations that imply a
verdict; rules below the least confidence (taken with both verdicts weighing alike) or support go, and so do rules that a
shorter one with the same verdict and no less confidence covers. A URL that no listed rule fits is judged by the mined rules it
holds, found by an inverted index from each rule's rarest token: the most confident rule decides, blocking on a tie. Without a
rule it is allowed.

Every token of every labelled URL takes part in the counts; FP-growth itself drops those below the support, which is a share of
the labelled URLs and ``LEAST`` URLs at least. Rules are pruned by confidence in Spark; those left go to the driver. Frequent
sets grow with the subsets of tokens that labelled URLs share, not with the table.

Cases: null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed. An empty table, or one
without labelled URLs, mines no rule. Repeated URLs count as often as they stand. Of the table only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT, CONFIDENCE = 0.002, 0.9
#: Labelled URLs that a mined rule rests on at least.
LEAST = 20

# The listed rules, (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

_TOKEN = re.compile(r"[^/._\-?&=#:]+")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest listed rule that fits, as struct(rule, verdict); null where none does. ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def on_listed_host(host: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Whether the host is one of the listed rules' hosts or a subdomain of one."""
    out = F.lit(False)
    for name in sorted({r[1] for r in rules}):
        out = out | (host == name) | host.endswith(f".{name}")
    return out


def tokens_of(host: str, path: str, url: str | None) -> list[str]:
    """Distinct tokens of a URL: labels of the host, its domain, pieces of the path with their kind, and names in the query."""
    labels = [x for x in host.split(".") if x]
    out = [f"host={x}" for x in labels[:-2]] + ([f"domain={'.'.join(labels[-2:])}"] if labels else [])
    for piece in path.split("/"):
        if piece:
            out += [f"path={x}" if not x.isdigit() else "path=#" for x in _TOKEN.findall(piece)]
    query = (url or "").partition("#")[0].partition("?")[2]
    out += [f"query={x.partition('=')[0]}" for x in query.split("&") if x]
    return list(dict.fromkeys(out))


def url_tokens(urls: DataFrame) -> DataFrame:
    """``urls`` (row columns with host, path, url) with tokens."""
    schema = urls.select("*", F.expr("cast(null as array<string>)").alias("tokens")).schema
    h, p, u = (urls.columns.index(c) for c in ("host", "path", "url"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens_of(*x) for x in zip(b.column(h).to_pylist(), b.column(p).to_pylist(), b.column(u).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, "tokens"])

    return urls.mapInArrow(work, schema)


def mine(tokens: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules (tokens, verdict, confidence) from rows (tokens, verdict); pruned, rarest token first."""
    items = tokens.where("tokens is not null").select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    said = F.filter("items", lambda x: x.startswith("verdict="))
    own = sets.where(F.size(said) == 1).where(F.size("items") > 1).select(F.array_except("items", said).alias("own"), F.substring_index(F.get(said, F.lit(0)), "=", -1).alias("verdict"), "freq")
    plain = sets.where(F.size(said) == 0).select(F.col("items").alias("own"), F.col("freq").alias("every"))
    of = tokens.groupBy("verdict").agg(F.count("*").alias("said"))
    rows = tokens.count()
    # confidence with both verdicts weighing alike, whatever their shares
    shares = own.join(plain, "own").join(F.broadcast(of), "verdict").select("own", "verdict", (F.col("freq") / F.col("said")).alias("share"), ((F.col("every") - F.col("freq")) / F.greatest(F.lit(1), F.lit(rows) - F.col("said"))).alias("against"))
    sure = shares.select("own", "verdict", (F.col("share") / (F.col("share") + F.col("against"))).alias("sure")).where(F.col("sure") >= confidence)
    found = [(frozenset(r.own), r.verdict, r.sure) for r in sure.collect()]
    held = sorted({t for r in found for t in r[0]})
    singles = plain.where(F.size("own") == 1).select(F.get("own", F.lit(0)).alias("t"), "every").where(F.col("t").isin(held)).collect()
    rank = {r.t: i for i, r in enumerate(sorted(singles, key=lambda r: (-r.every, r.t)))}
    found.sort(key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    kept: list[tuple[frozenset, str, float]] = []
    by_token: dict[str, list[int]] = {}
    for own, verdict, sure in found:
        shorter = (kept[i] for t in own for i in by_token.get(t, []))
        if not any(k[1] == verdict and k[2] >= sure and k[0] < own for k in shorter):
            for t in own:
                by_token.setdefault(t, []).append(len(kept))
            kept.append((own, verdict, sure))
    return [(tuple(sorted(own, key=lambda t: -rank[t])), verdict, sure) for own, verdict, sure in kept]


def labelled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """tokens, verdict of the rows (host, listed, tokens) from which rules are mined."""
    verdict = F.coalesce(F.col("listed.verdict"), F.when(on_listed_host(F.col("host"), rules), F.lit("allow")))
    return rows.select("tokens", verdict.alias("verdict")).where("verdict is not null")


def judge(tokens: DataFrame, rules: list[tuple[tuple[str, ...], str, float]]) -> DataFrame:
    """``tokens`` with mined: the verdict of the most confident mined rule, or allow."""
    index: dict[str, list[tuple[frozenset, str, float]]] = {}
    for own, verdict, sure in rules:
        index.setdefault(own[0], []).append((frozenset(own), verdict, sure))
    keep = [c for c in tokens.columns if c != "tokens"]
    at = tokens.columns.index("tokens")
    schema = tokens.select(*keep, F.lit("").alias("mined")).schema

    def verdict(own: list[str]) -> str:
        best = (-1.0, False)
        have = set(own)
        for t in have:
            for needed, said, sure in index.get(t, ()):
                if needed <= have:
                    best = max(best, (sure, said == "block"))
        return "block" if best[1] else "allow"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array([verdict(x or []) for x in b.column(at).to_pylist()], pa.string())], names=[*keep, "mined"])

    return tokens.mapInArrow(work, schema)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    work = Workspace(pages.sparkSession, "urls")
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = work.write(url_tokens(rows.withColumn("listed", listed(F.col("host"), F.col("path"), rules))), "tokens")
    known = labelled(rows, rules)
    n = known.count()
    mined = mine(known, min(1.0, max(support, least / n)), confidence) if n else []
    judged = judge(rows.select("page_id", "host", "path", "listed", "tokens"), mined)
    return judged.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "mined").alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the URL of every row of ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
