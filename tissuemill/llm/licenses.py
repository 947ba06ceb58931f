"""License scan by diagonal voting, in DataFrame functions only.

The rolling word k-grams of every text are hashed, and those whose hash occurs in license templates (a fixed table of some
hundred rows) are joined, hash and words, to the template positions. Hits vote for a diagonal (text position less template
position). Neighbouring diagonals, ``DRIFT`` or fewer words apart, are merged, which bridges inserted and deleted words, and
cut where a text gap is longer than the template. A merged span is verified by the share of distinct template positions whose
words it holds and by its length in the text, so that one repeated phrase counts once however often it stands.

The base phrases are templates like the others whose spans must be whole: all grams of the phrase on one diagonal.

Cases: a null or empty text, or one without words, has no places, null positions and score 0. Texts are taken whole. Repeated
rows repeat, also those with equal or null doc_id: rows are told apart by a row number. Further columns are not read.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import documents

K = 2
#: Words between diagonals that are still neighbours; least coverage of a template by a verified span.
DRIFT, COVERAGE = 3, 0.6

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Passages of public license texts, by label.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "lgpl": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "cc": ["this work is licensed under a creative commons attribution 4 0 international license"],
}

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Words of a template, as the scan takes them from texts."""
    lowered = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, list[str]]) -> DataFrame:
    """template number, is_base, label, grams of the template, and position and hash of each gram."""
    rows = [(True, label, words_of(phrase)) for phrase, label in phrases.items()] + [(False, label, words_of(t)) for label, own in templates.items() for t in own]
    if any(len(w) < K for _, _, w in rows):
        raise ValueError(f"a template needs {K} words or more")
    flat = [(n, base, label, len(w) - K + 1, i, *w[i : i + K]) for n, (base, label, w) in enumerate(rows) for i in range(len(w) - K + 1)]
    frame = spark.createDataFrame(flat, f"template int, is_base boolean, label string, grams int, place int, {', '.join(f'w{i} string' for i in range(K))}")
    return frame.withColumn("gram", F.xxhash64(*[f"w{i}" for i in range(K)]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches (array of label, first, last, coverage)."""
    spark = docs.sparkSession
    grams = template_grams(spark, phrases, templates)
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.filter(F.split(lowered, _SPLIT), lambda w: w != "").alias("words"))
    # the templates' distinct hashes, some hundred, as a literal set: only places that may vote leave the array
    known = [r.gram for r in grams.select("gram").distinct().collect()]
    hash_at = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(K)])
    places = F.when(F.size("words") >= K, F.filter(F.sequence(F.lit(0), F.size("words") - K), lambda i: hash_at(i).isin(known)))
    told = F.transform(places, lambda i: F.struct(i.alias("at"), *[F.get("words", i + j).alias(f"w{j}") for j in range(K)]))
    rows = words.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.explode_outer(told).alias("hit")).select("doc_id", "row", "n_words", "hit.*")
    hits = rows.join(F.broadcast(grams.drop("gram")), [f"w{i}" for i in range(K)], "left").select("row", "doc_id", "n_words", "template", "is_base", "label", "grams", "place", "at", (F.col("at") - F.col("place")).alias("diagonal"))
    by_template = Window.partitionBy("row", "template").orderBy("diagonal", "at")
    # a phrase stands on one diagonal; other templates may drift
    step = F.col("diagonal") - F.lag("diagonal").over(by_template)
    runs = hits.withColumn("run", F.sum(F.coalesce(step > F.when(F.col("is_base"), 0).otherwise(DRIFT), F.lit(True)).cast("int")).over(by_template))
    by_run = Window.partitionBy("row", "template", "run").orderBy("at", "place")
    gap = F.col("at") - F.lag("at").over(by_run)
    cut = runs.withColumn("part", F.sum(F.coalesce(gap > F.col("grams"), F.lit(True)).cast("int")).over(by_run))
    # a template position counts once in a span, however often its words stand there
    once = cut.groupBy("row", "doc_id", "n_words", "template", "is_base", "label", "grams", "run", "part", "place").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    spans = once.groupBy("row", "doc_id", "n_words", "template", "is_base", "label", "grams", "run", "part").agg(F.count("place").alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"))
    coverage = F.col("covered") / F.col("grams")
    whole = F.when(F.col("is_base"), F.col("covered") == F.col("grams")).otherwise((coverage >= COVERAGE) & (F.col("high") - F.col("low") < 2 * F.col("grams") + DRIFT))
    checked = spans.select("row", "doc_id", "n_words", "label", "is_base", F.coalesce(whole, F.lit(False)).alias("whole"), coverage.alias("coverage"), F.col("low").cast("long").alias("low"), (F.col("high") + K - 1).cast("long").alias("high"))
    base = F.col("whole") & F.col("is_base")
    line = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(c, F.col("label")))))
    return checked.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).alias("first_word"),
        F.max(F.when(base, F.col("low"))).alias("last_word"),
        line(base).alias("base_labels"),
        line(F.col("whole")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("whole"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("whole"), F.struct("low", "high", "label", "coverage")))).alias("matches"),
    ).drop("row")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of every text of ``documents``."""
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _values(phrases: dict[str, str], templates: dict[str, list[str]]) -> str:
    rows = [("true", label, phrase) for phrase, label in phrases.items()] + [("false", label, one) for label, own in templates.items() for one in own]
    return ", ".join(f"({n}, {base}, '{label}', '{' '.join(words_of(phrase))}')" for n, (base, label, phrase) in enumerate(rows))


#: The same rows by word pairs in place of hashes.
OP8_SQL = rf"""
WITH t(template, is_base, label, phrase) AS (VALUES {_values(PHRASES, TEMPLATES)}),
tw AS (SELECT template, is_base, label, string_split(phrase, ' ') AS w FROM t),
tp AS (SELECT *, len(w) - 1 AS grams, unnest(range(0, len(w) - 1)) AS place FROM tw),
tg AS (SELECT template, is_base, label, grams, place, w[place + 1] AS w0, w[place + 2] AS w1 FROM tp),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
dp AS (SELECT row, words, unnest(range(0, len(words) - 1)) AS pos FROM d WHERE len(words) >= 2),
h AS (SELECT row, template, is_base, label, grams, place, pos, pos - place AS diagonal FROM (SELECT row, pos, words[pos + 1] AS w0, words[pos + 2] AS w1 FROM dp) JOIN tg USING (w0, w1)),
s AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal, pos) AS step FROM h),
r AS (SELECT *, sum(CASE WHEN step IS NULL OR step > (CASE WHEN is_base THEN 0 ELSE {DRIFT} END) THEN 1 ELSE 0 END) OVER (PARTITION BY row, template ORDER BY diagonal, pos) AS run FROM s),
g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY row, template, run ORDER BY pos, place) AS gap FROM r),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > grams THEN 1 ELSE 0 END) OVER (PARTITION BY row, template, run ORDER BY pos, place) AS part FROM g),
p AS (SELECT row, template, is_base, label, grams, run, part, count(DISTINCT place) AS covered, min(pos) AS low, max(pos) AS high FROM c GROUP BY ALL),
f AS (SELECT *, covered / grams AS coverage FROM p WHERE CASE WHEN is_base THEN covered = grams ELSE covered / grams >= {COVERAGE} AND high - low < 2 * grams + {DRIFT} END),
a AS (SELECT row, count(*) FILTER (is_base) AS n_base, min(low) FILTER (is_base) AS first_word, max(low) FILTER (is_base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (row)
"""
