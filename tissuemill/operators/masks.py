"""Mask algebra: overlaps of two masks, matching, alignment, merging, filtering and grids. Masks are rows (y, x, instance)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import YX
from .order import numbered

METRICS = ("source_fraction", "reference_fraction", "iou")


def overlap_counts(source: DataFrame, reference: DataFrame, source_ids: Sequence[int] | None = None, reference_ids: Sequence[int] | None = None, on: Sequence[str] = YX) -> DataFrame:
    """(source, reference, n): pixels that two masks share, without background; optional lists of the labels to count."""
    a = source.where("instance <> 0").withColumnRenamed("instance", "source")
    b = reference.where("instance <> 0").withColumnRenamed("instance", "reference")
    a = a if source_ids is None else a.where(F.col("source").isin(list(source_ids)))
    b = b if reference_ids is None else b.where(F.col("reference").isin(list(reference_ids)))
    return a.join(b, list(on)).groupBy("source", "reference").agg(F.count("*").alias("n"))


def _areas(mask: DataFrame, name: str) -> DataFrame:
    return mask.where("instance <> 0").groupBy(F.col("instance").alias(name)).agg(F.count("*").alias(f"{name}_area"))


def _best(rows: DataFrame, score: str, key: str = "source", label: str = "reference") -> DataFrame:
    """The row with the highest score of each key; the smallest label of equals."""
    order = Window.partitionBy(key).orderBy(F.desc(score), label)
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def majority_vote(segmentation: DataFrame, predictions: DataFrame, ids: Sequence[int] | None = None, on: Sequence[str] = YX) -> DataFrame:
    """(source, reference, n): the commonest predicted label of each instance, the smallest of equals."""
    return _best(overlap_counts(segmentation, predictions, ids, on=on), "n")


def match_to_reference(source: DataFrame, references: dict[str, DataFrame], metric: str = "source_fraction", threshold: float = 0.0, on: Sequence[str] = YX) -> DataFrame:
    """(instance, one column per reference): the best reference label of each source label, 0 for none.

    With a threshold over 0, matches whose score isn't above it become 0. Equal scores go to the smaller label.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    areas = _areas(source, "source")
    out = areas.select("source")
    for name, mask in references.items():
        pairs = overlap_counts(source, mask, on=on).join(areas, "source").join(_areas(mask, "reference"), "reference")
        n, s, r = F.col("n"), F.col("source_area"), F.col("reference_area")
        score = {"source_fraction": n / s, "reference_fraction": n / r, "iou": n / (s + r - n)}[metric]
        best = _best(pairs.withColumn("score", score), "score")
        if threshold > 0:
            best = best.where(F.col("score") > threshold)
        out = out.join(best.select("source", F.col("reference").alias(name)), "source", "left")
    return out.select(F.col("source").alias("instance"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in references])


def filter_by_size(mask: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """Labels whose size is within [min_size, max_size] stay, others become 0; labels keep their numbers."""
    if min_size > max_size:
        raise ValueError("min_size is greater than max_size")
    kept = mask.where("instance <> 0").groupBy("instance").agg(F.count("*").alias("n")).where(F.col("n").between(min_size, max_size)).select("instance", F.lit(True).alias("_kept"))
    return mask.join(kept, "instance", "left").withColumn("instance", F.when(F.col("_kept"), F.col("instance")).otherwise(0)).select(mask.columns)


def align_labels(mask: DataFrame, to: DataFrame, threshold: float = 0.5, on: Sequence[str] = YX) -> DataFrame:
    """Give each label of ``mask`` the label of ``to`` that it overlaps most, where that covers at least ``threshold`` of it; else 0."""
    best = _best(overlap_counts(mask, to, on=on), "n").join(_areas(mask, "source"), "source")
    target = best.where(F.col("n") / F.col("source_area") >= threshold).select(F.col("source").alias("instance"), "reference")
    return mask.join(target, "instance", "left").withColumn("instance", F.coalesce("reference", F.lit(0)).cast("long")).select(mask.columns)


def merge_labels(candidate: DataFrame, priority: DataFrame, threshold: float = 0.5, shown: DataFrame | None = None, on: Sequence[str] = YX) -> DataFrame:
    """``priority`` with those labels of ``candidate`` on its empty pixels whose covered share is at most ``threshold``.

    New labels are numbered after the largest priority label in the order of the candidate's. ``shown`` is drawn in place of
    ``candidate`` (expanded nuclei, say, with the same labels); every label that is drawn must be in ``candidate``.
    """
    shown = candidate if shown is None else shown
    covered = overlap_counts(candidate, priority, on=on).groupBy(F.col("source").alias("instance")).agg(F.sum("n").alias("covered"))
    areas = candidate.where("instance <> 0").groupBy("instance").agg(F.count("*").alias("area"))
    accepted = areas.join(covered, "instance", "left").where(F.coalesce("covered", F.lit(0)) <= F.lit(threshold) * F.col("area")).select("instance")
    if shown is not candidate:
        accepted = accepted.join(shown.select("instance").distinct(), "instance", "left_semi")
    largest = priority.agg(F.coalesce(F.max("instance"), F.lit(0)).alias("m")).first()["m"]
    numbered = _numbered(accepted, largest)
    drawn = shown.join(numbered, "instance").select(*on, "new")
    both = priority.withColumnRenamed("instance", "old").join(drawn, list(on), "full_outer")
    return both.select(*on, F.when(F.coalesce("old", F.lit(0)) != 0, F.col("old")).otherwise(F.coalesce("new", F.lit(0))).cast("long").alias("instance"))


def _numbered(ids: DataFrame, after: int) -> DataFrame:
    """(instance, new): ids numbered in their order from ``after`` + 1."""
    return numbered(ids.select("instance"), ["instance"], "new", after)


def merge_nuclei(nuclei: DataFrame, expanded: DataFrame, cells: DataFrame, threshold: float = 0.5, on: Sequence[str] = YX) -> DataFrame:
    """Add expanded nuclei to ``cells`` where the nucleus itself is covered by at most ``threshold``; raises where labels of ``expanded`` aren't in ``nuclei``."""
    extra = expanded.where("instance <> 0").select("instance").distinct().join(nuclei.select("instance").distinct(), "instance", "left_anti")
    if extra.limit(1).count():
        raise ValueError("the expanded nuclei hold labels that the nuclei don't")
    return merge_labels(nuclei, cells, threshold, expanded, on)


def coverage(mask: DataFrame, microns_per_pixel: float = 1.0) -> DataFrame:
    """One row: instances, area, covered area, percentage (0 for an empty mask)."""
    per = microns_per_pixel**2
    cells = F.count_if(F.col("instance") != 0)
    return mask.agg(
        F.count_distinct(F.when(F.col("instance") != 0, F.col("instance"))).alias("n_instances"),
        (F.count("*") * per).alias("area"), (cells * per).alias("covered"), F.coalesce(F.try_divide(100.0 * cells, F.count("*")), F.lit(0.0)).alias("percentage"),
    )


def bounding_box_query(mask: DataFrame, obs: DataFrame, box: tuple[float, float, float, float], region: str) -> tuple[DataFrame, DataFrame]:
    """The mask's pixels in the half-open box (xmin, xmax, ymin, ymax), and the rows of ``obs`` (region, instance, ...) whose instance has pixels there; rows of other regions stay."""
    xmin, xmax, ymin, ymax = box
    cut = mask.where((F.col("x") >= xmin) & (F.col("x") < xmax) & (F.col("y") >= ymin) & (F.col("y") < ymax))
    there = cut.where("instance <> 0").select("instance").distinct()
    own, other = obs.where(F.col("region") == region), obs.where(F.col("region") != region)
    return cut, own.join(there, "instance", "left_semi").select(obs.columns).unionByName(other)


def square_grid(height: int, width: int, size: int, offset: tuple[int, int] = (0, 0)) -> tuple[Column, int]:
    """The label of pixel columns (y, x) in a grid of whole squares, row by row from 1 (0 outside), and the number of squares."""
    rows, cols = (height - offset[0]) // size, (width - offset[1]) // size
    r, c = F.floor((F.col("y") - offset[0]) / size), F.floor((F.col("x") - offset[1]) / size)
    inside = r.between(0, rows - 1) & c.between(0, cols - 1)
    return F.when(inside, r * cols + c + 1).otherwise(0).cast("long"), rows * cols


def hexagon_centers(height: int, width: int, size: int, offset: tuple[int, int] = (0, 0)) -> list[tuple[int, float, float]]:
    """(label, y, x) of pointy-topped hexagons of side ``size`` that fit entirely, row by row from 1."""
    import math

    half, step, out, label, row = math.sqrt(3) * size / 2, 1.5 * size, [], 0, 0
    while offset[0] + size + row * step + size <= height:
        x = offset[1] + half + (half if row % 2 else 0)
        while x + half <= width:
            label += 1
            out.append((label, offset[0] + size + row * step, x))
            x += 2 * half
        row += 1
    return out


def hexagon_grid(pixels: DataFrame, height: int, width: int, size: int, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """``pixels`` (y, x) with the label of the whole hexagon around each pixel's center, 0 outside all, in closed form.

    A pixel is tried against the two hexagons of the row band it may lie in; no join is needed.
    """
    import math

    half, step = math.sqrt(3) * size / 2, 1.5 * size
    rows = max(0, math.floor((height - offset[0] - 2 * size) / step) + 1)
    per = lambda odd: max(0, math.floor((width - offset[1] - 2 * half - (half if odd else 0)) / (2 * half) + 1e-9) + 1)
    even_n, odd_n = per(False), per(True)
    y, x = F.col("y") + 0.5 - offset[0], F.col("x") + 0.5 - offset[1]
    near = F.floor((y - size) / step)
    label = F.lit(0).cast("long")
    for k in (1, 0):
        r = near + k
        odd = F.pmod(r, F.lit(2)) == 1
        shift = F.when(odd, F.lit(half)).otherwise(F.lit(0.0))
        col = F.floor((x - shift) / (2 * half))
        dy, dx = F.abs(y - size - r * step), F.abs(x - half - shift - col * 2 * half)
        n = F.when(odd, F.lit(odd_n)).otherwise(F.lit(even_n))
        inside = (dx <= half) & (dy <= size - dx / math.sqrt(3)) & r.between(0, rows - 1) & (col >= 0) & (col < n)
        before = F.ceil(r / 2) * even_n + F.floor(r / 2) * odd_n
        label = F.when(inside, (before + col + 1).cast("long")).otherwise(label)
    return pixels.withColumn("instance", label)


def mode_per_cell(mask: DataFrame, size: int) -> DataFrame:
    """(gy, gx, instance): the commonest label of each grid cell of ``size`` pixels, the smallest of equals."""
    counts = mask.groupBy(F.floor(F.col("y") / size).alias("gy"), F.floor(F.col("x") / size).alias("gx"), "instance").agg(F.count("*").alias("n"))
    best = counts.groupBy("gy", "gx").agg(F.max(F.struct(F.col("n"), (-F.col("instance")).alias("m"))).alias("b"))
    return best.select("gy", "gx", (-F.col("b.m")).alias("instance"))


def expand_labels(mask: DataFrame, distance: int) -> DataFrame:
    """Grow labels into background pixels (rows with instance 0) up to ``distance``; the nearest label wins, the smallest of equals.

    Labelled border pixels are spread to the pixels within reach and joined to the background; the inside of a label isn't spread.
    """
    offsets = [(dy, dx) for dy in range(-distance, distance + 1) for dx in range(-distance, distance + 1) if 0 < dy * dy + dx * dx <= distance * distance]
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dy * dy + dx * dx).alias("d2")) for dy, dx in offsets])
    ground, cells = mask.where("instance = 0"), mask.where("instance <> 0")
    if not offsets:
        return mask
    sides = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    touching = ground.select("y", "x", sides).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    border = cells.join(touching, ["y", "x"], "left_semi")
    reach = border.select("y", "x", "instance", F.explode(moves).alias("m")).select((F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.struct(F.col("m.d2").alias("d2"), F.col("instance").alias("i")).alias("near"))
    won = reach.groupBy("y", "x").agg(F.min("near").alias("near"))
    return mask.join(won, ["y", "x"], "left").withColumn("instance", F.when(F.col("instance") != 0, F.col("instance")).otherwise(F.coalesce("near.i", F.lit(0))).cast("long")).select(mask.columns)


def rasterize(polygons: DataFrame) -> DataFrame:
    """Polygons (instance, place, ring: array of (x, y)) to pixels (y, x, instance) whose centers are inside; the first place wins.

    Inside is decided by the parity of edges crossed: each edge goes to the rows of pixels that it crosses, and a row's sorted
    crossings are the ends of its spans, so that work grows with the outlines and the pixels inside.
    """
    own = polygons.select("instance", "place", "ring", F.monotonically_increasing_id().alias("_polygon"))
    return _filled(own, ["_polygon", "instance", "place"]).groupBy("y", "x").agg(F.min(F.struct("place", "instance")).alias("m")).select("y", "x", F.col("m.instance").alias("instance"))


def rasterize_rings(rings: DataFrame) -> DataFrame:
    """Rings (instance, ring), as ``vectorize`` gives them, to pixels (y, x, instance): an instance's rings count together, so that those of holes cut them out; the smallest instance wins."""
    return _filled(rings.select("instance", "ring"), ["instance"]).groupBy("y", "x").agg(F.min("instance").alias("instance"))


def _filled(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x): pixels whose centers lie inside the rings of equal keys, by parity."""
    edges = rings.where("instance <> 0").select(*keys, F.explode(F.expr("zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (a, b) -> struct(if(a.y < b.y, a, b) AS a, if(a.y < b.y, b, a) AS b))")).alias("e")).where("e.a.y < e.b.y")
    # rows whose centers the edge crosses, its lower end included; it crosses at the same place in either direction
    rows = edges.withColumn("_y0", F.ceil(F.col("e.a.y") - 0.5)).withColumn("_y1", F.ceil(F.col("e.b.y") - 0.5) - 1).where("_y0 <= _y1").withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    cross = F.expr("e.a.x + (y + 0.5 - e.a.y) / (e.b.y - e.a.y) * (e.b.x - e.a.x)")
    lists = rows.select(*keys, "y", cross.alias("_v")).groupBy(*keys, "y").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    spans = lists.select(*keys, "y", F.explode(F.expr("transform(sequence(0, size(_v) div 2 - 1), i -> struct(ceil(_v[2 * i] - 0.5) AS a, ceil(_v[2 * i + 1] - 0.5) - 1 AS b))")).alias("_s")).where("_s.a <= _s.b")
    return spans.select(*keys, "y", F.explode(F.sequence("_s.a", "_s.b")).alias("x"))


def boundary_edges(mask: DataFrame) -> DataFrame:
    """(instance, y0, x0, y1, x1): directed pixel edges between a label and others, the label on the right hand."""
    cells = mask.where("instance <> 0").select("y", "x", "instance")
    sides = [(-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)]
    spread = cells.withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dy", "dx", "ay", "ax", "by", "bx"), s, strict=True)]) for s in sides])))
    asked = spread.select("instance", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.ay")).alias("y0"), (F.col("x") + F.col("s.ax")).alias("x0"), (F.col("y") + F.col("s.by")).alias("y1"), (F.col("x") + F.col("s.bx")).alias("x1"))
    same = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"), "instance")
    return asked.join(same, ["ny", "nx", "instance"], "left_anti").select("instance", "y0", "x0", "y1", "x1")


def vectorize(mask: DataFrame) -> DataFrame:
    """(instance, ring_id, ring): closed outlines of each label, chained from its edges; a group is one instance."""
    import pandas as pd

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, rings = {}, []
        for e in pdf.sort_values(["y0", "x0", "y1", "x1"]).itertuples():
            out.setdefault((e.y0, e.x0), []).append((e.y1, e.x1))
        for start in sorted(out):
            while out.get(start):
                ring, at, last = [start], start, None
                while True:
                    ways = out[at]
                    # where two rings touch, turn right, so that each stays simple
                    turn = lambda p: (p[0] - at[0]) * (last[1]) - (p[1] - at[1]) * last[0] if last else 0
                    ahead = max(ways, key=turn)
                    ways.remove(ahead)
                    last, at = (ahead[0] - at[0], ahead[1] - at[1]), ahead
                    if at == start:
                        break
                    ring.append(at)
                n = len(ring)
                corners = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0], p[1] - ring[i - 1][1]) != (ring[(i + 1) % n][0] - p[0], ring[(i + 1) % n][1] - p[1])]
                rings.append([{"x": float(x), "y": float(y)} for y, x in corners])
        return pd.DataFrame({"instance": [pdf.instance.iloc[0]] * len(rings), "ring_id": range(len(rings)), "ring": rings})

    edges = boundary_edges(mask).select(F.col("instance").cast("long"), *[F.col(c).cast("long") for c in ("y0", "x0", "y1", "x1")])
    return edges.groupBy("instance").applyInPandas(chain, "instance long, ring_id int, ring array<struct<x: double, y: double>>")
