"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition is its target rows over its own rows. Each document draws its count by inverting the Poisson
distribution of that mean at a uniform number taken from a hash of seed and doc_id, is exploded by the count, and all copies
are shuffled globally: dealt to partitions and ordered inside them by a hash of seed, doc_id and copy.

Means over ``PIECE`` are drawn as sums of independent pieces (a sum of Poisson numbers is one), so that the inversion stays
exact for any mean. The rates (a row per source) are broadcast up to ``BROADCAST_SOURCES`` rows; beyond, documents and rates
are joined on a salted key, which splits a hot source.

Cases: null is a source of its own. Rows without doc_id draw by a hash of their columns, which must not be maps then. Rows
with equal doc_id, and equal rows without, draw equal counts. Null, empty and long texts are carried as they are. Sources
without a target weight, or with a null one, have weight 0; several weights of a source add up; negative and infinite ones
raise ValueError. The share of a source that has weight but no rows falls to the others in proportion. Empty tables stay
empty. Further columns are kept; those named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, fresh_name

#: Mean up to which one inversion draws, and terms of the distribution kept (the rest weighs under 1e-17).
PIECE, TERMS = 16.0, 80
#: Rate rows (some 700 bytes each) up to which they are broadcast, and salts beyond.
BROADCAST_SOURCES, SALTS = 10_000, 64


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, by: str = "source", weights: DataFrame | None = None, power: float = 0.5, target_rows: int | None = None) -> DataFrame:
    """source key, pieces, and the cumulative distribution of one piece.

    ``weights`` has columns (``by``, weight); without it a source weighs its rows to the power ``power``. ``target_rows`` is
    the expected number of rows of the mix (as many as in ``docs``).
    """
    sizes = docs.groupBy(F.col(f"`{by}`").alias("key")).agg(F.count("*").alias("n"))
    if weights is not None:
        given = weights.groupBy(F.col(f"`{by}`").alias("wkey")).agg(F.sum(F.col("weight").cast("double")).alias("weight"), F.min(F.col("weight").cast("double")).alias("least"))
        if given.where("least < 0 or isnan(weight) or weight = double('infinity')").limit(1).count():
            raise ValueError("weights must be finite and not negative")
        # null-safe: null is a source like another
        sizes = sizes.join(given.drop("least"), F.col("key").eqNullSafe(F.col("wkey")), "left").select("key", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sizes = sizes.select("key", "n", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))
    sizes = Workspace(docs.sparkSession, "mixing").write(sizes, "sizes")
    total = sizes.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rows = float(target_rows if target_rows is not None else total.n or 0)
    joined = sizes.select("key", (F.col("weight") / F.lit(float(total.weight or 0) or 1.0) * F.lit(rows) / F.col("n")).alias("mean"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("mean") / PIECE)).cast("int")
    one = joined.select("key", "mean", pieces.alias("pieces"), (F.col("mean") / pieces).alias("m"))
    cdf = f"""transform(aggregate(sequence(1, {TERMS - 1}), array(struct(exp(-m) AS p, exp(-m) AS c)),
              (a, k) -> concat(a, array(struct(element_at(a, -1).p * m / k AS p, element_at(a, -1).c + element_at(a, -1).p * m / k AS c)))), x -> x.c)"""
    return one.select("key", "mean", "pieces", F.expr(cdf).alias("cdf"))


def mix(docs: DataFrame, by: str = "source", id_col: str = "doc_id", seed: int = 6, weights: DataFrame | None = None, power: float = 0.5, target_rows: int | None = None) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, plus copy_no (from 0) and shuffle_key, in shuffled order."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy_no", "shuffle_key")])
    rate_col, salt_col, own_col, count_col = (fresh_name(docs, c) for c in ("rate", "salt", "own_salt", "copies"))
    table = Workspace(spark, "mixing").write(rates(docs, by, weights, power, target_rows), "rates")
    rate = table.select(F.struct("key", "pieces", "cdf").alias(rate_col))
    if table.count() <= BROADCAST_SOURCES:
        drawn = docs.join(F.broadcast(rate), F.col(f"`{by}`").eqNullSafe(F.col(f"{rate_col}.key")))
    else:
        salted = rate.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = docs.withColumn(own_col, F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(SALTS)).cast("int"))
        drawn = own.join(salted, F.col(f"`{by}`").eqNullSafe(F.col(f"{rate_col}.key")) & (F.col(own_col) == F.col(salt_col)))
    # rows without an id draw each by its own content, so that they don't stand or fall together
    content = F.concat(F.lit("null:"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).cast("string"))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), content)
    count = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col(f"{rate_col}.pieces")), lambda j: _uniform(str(seed), name, j.cast("string"))),
        F.lit(0),
        lambda n, u: n + F.size(F.filter(F.col(f"{rate_col}.cdf"), lambda c: c <= u)),
    )
    counted = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], count.alias(count_col)).where(F.col(count_col) > 0)
    copies = counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col(count_col) - 1)).alias("copy_no"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), name, F.col("copy_no").cast("string")).cast("binary")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all of ``documents`` so that a source weighs the root of its rows; whole rows with copy_no and shuffle_key."""
    return mix(documents(spark, sf_dir))


OP6_SQL = """
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
means AS (SELECT source, weight / sum(weight) OVER () * (sum(n) OVER ())::DOUBLE / n AS mean FROM sizes),
pieces AS (SELECT source, greatest(1, ceil(mean / 16.0))::INTEGER AS pieces, mean / greatest(1, ceil(mean / 16.0)) AS m FROM means),
terms AS (SELECT source, k, exp(-m + k * ln(m) - sum(CASE WHEN k = 0 THEN 0 ELSE ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p
          FROM pieces, range(0, 80) r(k)),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
draws AS (SELECT d.*, list_sum(list_transform(range(1, p.pieces + 1), lambda j:
            len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('6:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))) AS n
          FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
       md5('6:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no::VARCHAR) AS shuffle_key
FROM draws, LATERAL (SELECT unnest(range(0, n::BIGINT)) AS copy_no)
"""
