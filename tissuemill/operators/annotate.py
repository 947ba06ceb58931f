"""Annotation of cells by marker genes: scores, scalings, argmax with cleanliness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..keys import UNKNOWN
from ..shared import keeper

SCALINGS = ("MinMax", "ZeroMax", "Nmarkers", "Robust", "Rank")
MIN_SCORES = ("Zero", "Quantile", None)


def marker_scores(x: DataFrame, obs: DataFrame, markers: DataFrame, controls: int = 50, bins: int = 25) -> DataFrame:
    """(instance, type, score): mean of the markers less mean of control genes, taken from the markers' bins of mean expression by hash.

    ``markers`` is (gene, type). Genes that aren't in ``x`` are passed over.
    """
    n = obs.select("instance").distinct().count()
    binned = x.groupBy("gene").agg((F.sum("value") / n).alias("mean")).withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))
    own = markers.join(binned.select("gene", "bin"), "gene")
    wanted = own.select("type", "bin").distinct()
    others = wanted.join(binned.select("gene", "bin"), "bin").join(own.select("type", "gene"), ["type", "gene"], "left_anti")
    order = Window.partitionBy("type", "bin").orderBy(F.md5("gene"), "gene")
    control = others.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= controls).select("type", "gene", F.lit(-1.0).alias("w"))
    weights = own.select("type", "gene", F.lit(1.0).alias("w")).unionByName(control)
    each = weights.groupBy("type", "w").agg(F.count("*").alias("k"))
    scaled = weights.join(each, ["type", "w"]).select("type", "gene", (F.col("w") / F.col("k")).alias("w"))
    sums = x.join(F.broadcast(scaled), "gene").groupBy("instance", "type").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    return obs.select("instance").join(F.broadcast(own.select("type").distinct())).join(sums, ["instance", "type"], "left").select("instance", "type", F.coalesce("score", F.lit(0.0)).alias("score"))


def weighted_scores(x: DataFrame, obs: DataFrame, markers: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """(instance, type, score): weighted sum of centred expression over the markers (gene, type, weight); ``means`` (gene, mean) centre."""
    n = obs.select("instance").distinct().count()
    centre = x.groupBy("gene").agg((F.sum("value") / n).alias("mean")) if means is None else means
    shift = markers.join(centre, "gene").groupBy("type").agg(F.sum(F.col("weight") * F.col("mean")).alias("shift"))
    sums = x.join(F.broadcast(markers), "gene").groupBy("instance", "type").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    # zeros aren't stored: the centring of all markers is one number per type
    return obs.select("instance").join(F.broadcast(shift)).join(sums, ["instance", "type"], "left").select("instance", "type", (F.coalesce("s", F.lit(0.0)) - F.col("shift")).alias("score"))


def scale_scores(scores: DataFrame, scaling: str, markers: DataFrame | None = None) -> DataFrame:
    """Scale scores per type: MinMax, ZeroMax, Nmarkers (over the number of markers), Robust (5 % to 95 %), Rank (share of ranks, ties averaged)."""
    s = F.col("score")
    if scaling == "Rank":
        rank, ties, own = Window.partitionBy("type").orderBy("score"), Window.partitionBy("type", "score"), Window.partitionBy("type")
        return scores.select("instance", "type", ((F.rank().over(rank) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(own)).alias("score"))
    if scaling == "Nmarkers":
        bounds = markers.groupBy("type").agg(F.lit(0.0).alias("lo"), F.count("*").cast("double").alias("width"))
    elif scaling in SCALINGS:
        lo, hi = {"MinMax": (F.min(s), F.max(s)), "ZeroMax": (F.lit(0.0), F.max(s)), "Robust": (F.percentile(s, 0.05), F.percentile(s, 0.95))}[scaling]
        bounds = scores.groupBy("type").agg(lo.alias("lo"), hi.alias("hi")).select("type", "lo", (F.col("hi") - F.col("lo")).alias("width"))
    else:
        raise ValueError(f"scaling is one of {SCALINGS}")
    return scores.join(F.broadcast(bounds), "type").select("instance", "type", F.coalesce(F.try_divide(s - F.col("lo"), F.col("width")), F.lit(0.0)).alias("score"))


def annotate(scores: DataFrame, types: Sequence[str], allowed: DataFrame | None = None) -> DataFrame:
    """(instance, annotation, score_max, cleanliness) from (instance, type, score).

    The highest score wins, the first of ``types`` among equals; at most 0, or none allowed, is unknown. Cleanliness is the
    lead over the second score against the mean of both, infinite where the sum is 0; unknown cells have 0. ``allowed``
    (instance, type) restricts which types may win.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type"))
    rows = scores.where(F.col("type").isin(list(types)))
    rows = rows.withColumn("_ok", F.lit(True)) if allowed is None else rows.join(allowed.withColumn("_yes", F.lit(True)), ["instance", "type"], "left").withColumn("_ok", F.coalesce("_yes", F.lit(False)))
    by = rows.groupBy("instance").agg(
        F.max(F.when(F.col("_ok"), F.struct("score", (-place).alias("p"), "type"))).alias("b"),
        F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("top"),
    )
    first, second = F.get("top", F.lit(0)), F.coalesce(F.get("top", F.lit(1)), F.lit(0.0))
    known = F.coalesce(F.col("b.score") > 0, F.lit(False))
    clean = F.when(first + second == 0, F.lit(float("inf"))).otherwise(F.try_divide(first - second, (first + second) / 2))
    return by.select("instance", F.when(known, F.col("b.type")).otherwise(UNKNOWN).alias("annotation"), F.col("b.score").alias("score_max"), F.when(known, clean).otherwise(0.0).alias("cleanliness"))


def score_genes(x: DataFrame, obs: DataFrame, markers: DataFrame, types: Sequence[str]) -> DataFrame:
    """Marker scores and annotation in one."""
    return annotate(marker_scores(x, obs, markers), types)


def allowed_by_minimum(scores: DataFrame, min_score: str | None, q: float = 0.5) -> DataFrame | None:
    """(instance, type) whose score, before scaling, is over 0 (Zero) or over the type's quantile (Quantile); None allows all."""
    if min_score is None:
        return None
    if min_score == "Zero":
        return scores.where("score > 0").select("instance", "type")
    if min_score != "Quantile":
        raise ValueError(f"min_score is one of {MIN_SCORES}")
    least = scores.groupBy("type").agg(F.percentile("score", q).alias("least"))
    return scores.join(F.broadcast(least), "type").where("score > least").select("instance", "type")


def score_genes_iter(x: DataFrame, obs: DataFrame, markers: DataFrame, types: Sequence[str], n_iter: int = 5, stop: float = 0.0005, scaling: str = "Nmarkers", min_score: str | None = "Zero", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score, annotate, and centre anew with the mean of the types' mean expressions, until at most a share ``stop`` of cells changes.

    ``keep`` writes the inputs once and an iteration's annotation, and reads them back (under the shared folder, by default), so
    that plans don't grow and no iteration computes its inputs again.
    """
    keep = keep or keeper(x.sparkSession)
    x, obs, markers = keep(x), keep(obs), keep(markers)
    means, old = None, None
    total = obs.select("instance").distinct().count()
    for _ in range(n_iter):
        scores = weighted_scores(x, obs, markers, means)
        new = keep(annotate(scale_scores(scores, scaling, markers), types, allowed_by_minimum(scores, min_score)))
        if old is not None:
            changed = new.join(old.select("instance", F.col("annotation").alias("_old")), "instance").where("annotation <> _old").count()
            if changed <= stop * total:
                return new
        old = new
        own = new.where(F.col("annotation") != UNKNOWN).select("instance", F.col("annotation").alias("type"))
        n = own.groupBy("type").agg(F.count("*").alias("n"))
        kinds = n.count()
        if not kinds:
            return new
        sums = x.join(own, "instance").groupBy("type", "gene").agg(F.sum("value").alias("s")).join(F.broadcast(n), "type")
        means = keep(sums.groupBy("gene").agg((F.sum(F.col("s") / F.col("n")) / kinds).alias("mean")))
    return old


def merge_types(annotations: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Replace the cell types of each group by the group's name."""
    pairs = [F.lit(v) for name, own in groups.items() for t in own for v in (t, name)]
    return annotations.withColumn("annotation", F.coalesce(F.element_at(F.create_map(*pairs), F.col("annotation")), F.col("annotation"))) if pairs else annotations


def composition_by_cluster(annotations: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, annotation, n, share): composition of each cluster."""
    counts = annotations.join(clusters, "instance").groupBy("cluster", "annotation").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
