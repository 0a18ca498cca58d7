"""Operators on pixel tables (y, x, values): neighbours, focal windows, terrain, distance, adjacency."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touching_pairs(pixels: DataFrame, columns: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """One row per pair of pixels that share a side: columns with suffix _a (left or upper) and _b.

    Right and lower neighbours come from windows along rows and columns: no self-join.
    """
    rows = []
    for part, order in ((y, x), (x, y)):
        w = Window.partitionBy(part).orderBy(order)
        ahead = pixels.select(*(F.col(c).alias(f"{c}_a") for c in columns), *(F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(c).over(w)).alias(f"{c}_b") for c in columns), (F.lead(order).over(w) == F.col(order) + 1).alias("_next"))
        rows.append(ahead.where("_next").drop("_next"))
    return rows[0].unionByName(rows[1])


def rms_adjacent(pixels: DataFrame, band: str) -> DataFrame:
    """Root of the mean of squared differences between touching valid pixels; 1 where there is none."""
    d = F.col(f"{band}_a") - F.col(f"{band}_b")
    return touching_pairs(pixels, [band]).agg(F.coalesce(F.nullif(F.sqrt(F.avg(d * d)), F.lit(0.0)), F.lit(1.0)).alias("rms"))


def z_stack(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands standardised over all pixels; the deviation is at least 1e-6."""
    stats = pixels.agg(*(a for b in bands for a in (F.avg(b).alias(f"{b}_mu"), F.greatest(F.stddev_pop(b), F.lit(1e-6)).alias(f"{b}_sd"))))
    return pixels.crossJoin(F.broadcast(stats)).withColumns({b: (F.col(b) - F.col(f"{b}_mu")) / F.col(f"{b}_sd") for b in bands}).drop(*stats.columns)  # one row of statistics


def square(size: int) -> list[tuple[int, int]]:
    """Offsets of an odd square window."""
    if size % 2 == 0:
        raise ValueError("the window's side is odd")
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def disc(radius: float) -> list[tuple[int, int]]:
    r = math.floor(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def focal(pixels: DataFrame, band: str, offsets: Sequence[tuple[int, int]], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of ``v`` over the valid pixels of a window around each pixel of the table.

    Each value is sent to the windows that it lies in and combined there before the shuffle; windows
    are clipped at the edges.
    """
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    sent = pixels.where(F.col(band).isNotNull()).select("y", "x", F.col(band).alias("v"), F.explode(moves).alias("m"))
    sums = sent.select((F.col("y") - F.col("m.dy")).alias("y"), (F.col("x") - F.col("m.dx")).alias("x"), "v").groupBy("y", "x").agg(*aggregates)
    return pixels.select("y", "x").join(sums, ["y", "x"], "left")


def focal_texture(pixels: DataFrame, band: str, size: int = 3) -> DataFrame:
    """Standard deviation and maximum in a square window."""
    return focal(pixels, band, square(size), [F.stddev_pop("v").alias(f"{band}_std"), F.max("v").alias(f"{band}_max")])


def focal_mode(pixels: DataFrame, label: str, size: int = 3) -> DataFrame:
    """Most frequent label in a square window; ties go to the least."""
    return focal(pixels, label, square(size), [F.mode("v", True).alias(label)])


def terrain(pixels: DataFrame, dem: str, scale: float) -> DataFrame:
    """Slope and aspect in degrees by third-order differences over the eight neighbours; null at edges and gaps.

    Aspect is clockwise from north (y grows to the south), 0 where the slope is 0.
    """
    moves = [(dy, dx) for dy, dx in square(3)]
    at = {m: F.col(f"n{i}") for i, m in enumerate(moves)}
    sent = pixels.select("y", "x", F.col(dem).cast("double").alias("v"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(moves)))).alias("m"))
    near = sent.select((F.col("y") - F.col("m.dy")).alias("y"), (F.col("x") - F.col("m.dx")).alias("x"), "m.i", "v").groupBy("y", "x").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"n{i}") for i in range(9)))
    gx = ((at[-1, 1] + 2 * at[0, 1] + at[1, 1]) - (at[-1, -1] + 2 * at[0, -1] + at[1, -1])) / (8 * scale)
    gy = ((at[1, -1] + 2 * at[1, 0] + at[1, 1]) - (at[-1, -1] + 2 * at[-1, 0] + at[-1, 1])) / (8 * scale)
    out = near.where("n4 IS NOT NULL").select("y", "x", gx.alias("gx"), gy.alias("gy"))
    # The direction of steepest descent, east and north.
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360, F.lit(360.0))
    return out.select("y", "x", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"), F.when((F.col("gx") == 0) & (F.col("gy") == 0), 0.0).otherwise(aspect).alias("aspect"))


def distance_transform(pixels: DataFrame, source: Column, scale: float, cap: int) -> DataFrame:
    """Distance of each pixel to the nearest source pixel, at most ``cap`` pixels; null beyond.

    Two passes: each row's nearest source by windows, then along each column the lower envelope of the
    parabolas that stand on those distances, in time linear in the column.  Exact on a full grid.
    """
    import numpy as np
    import pandas as pd

    def envelope(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("y")
        y = frame["y"].to_numpy(np.int64)
        foot = np.flatnonzero(frame["g"].notna().to_numpy())
        if not len(foot):
            return frame.assign(d2=np.nan)[["y", "x", "d2"]]
        at, height = y[foot].astype(float), frame["g"].to_numpy()[foot].astype(float) ** 2
        stack, since = [0], [-np.inf]
        for k in range(1, len(foot)):
            while True:
                j = stack[-1]
                cross = (height[k] + at[k] ** 2 - height[j] - at[j] ** 2) / (2 * (at[k] - at[j]))
                if cross > since[-1]:
                    break
                stack.pop()
                since.pop()
            stack.append(k)
            since.append(cross)
        best = np.array(stack)[np.searchsorted(since, y.astype(float), side="right") - 1]
        return frame.assign(d2=(y - at[best]) ** 2 + height[best])[["y", "x", "d2"]]

    w = Window.partitionBy("y").orderBy("x")
    s = pixels.select("y", "x", F.when(source, F.col("x")).alias("_s"))
    left = F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    g = s.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.least(F.col("x") - left, right - F.col("x")).cast("double").alias("g"))
    near = g.groupBy("x").applyInPandas(lambda f: envelope(f), "y long, x long, d2 double")
    kinds = dict(pixels.dtypes)
    return near.select(F.col("y").cast(kinds["y"]).alias("y"), F.col("x").cast(kinds["x"]).alias("x"), F.when(F.col("d2") <= cap * cap, F.sqrt("d2") * scale).alias("distance"))


def outline(pixels: DataFrame, label: str) -> DataFrame:
    """Pixels with a side towards another label or towards nothing."""
    from .zonal import sides

    edge = [~F.col(s).eqNullSafe(F.col(label)) for s in ("h_before", "h_after", "v_before", "v_after")]
    return sides(pixels, label).where(F.col(label).isNotNull() & (edge[0] | edge[1] | edge[2] | edge[3])).select("y", "x", label)


def adjacency(pixels: DataFrame, label: str) -> DataFrame:
    """(label_i < label_j, n_shared): sides that two units share; diagonals don't count."""
    a, b = f"{label}_a", f"{label}_b"
    return touching_pairs(pixels.where(F.col(label).isNotNull()), [label]).where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("label_i"), F.greatest(a, b).alias("label_j")).agg(F.count("*").alias("n_shared"))


def graph_summary(regions: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Numbers of regions, edges, mean degree and regions without a neighbour."""
    ends = edges.select(F.col("label_i").alias(label)).unionByName(edges.select(F.col("label_j").alias(label)))
    degree = ends.groupBy(label).agg(F.count("*").alias("d"))
    both = regions.select(label).distinct().join(degree, label, "left")
    return both.agg(F.count("*").alias("n_regions"), (F.sum(F.coalesce("d", F.lit(0))) / 2).cast("long").alias("n_edges"), F.avg(F.coalesce("d", F.lit(0))).alias("mean_degree"), F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).alias("n_isolated"))


def morans_i(units: DataFrame, edges: DataFrame, label: str, value: str) -> DataFrame:
    """Spatial autocorrelation over touching units with binary weights; null without variance or edges."""
    valid = units.where(F.col(value).isNotNull()).select(label, F.col(value).cast("double").alias("v"))
    mean = valid.agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    z = valid.crossJoin(F.broadcast(mean)).select(label, (F.col("v") - F.col("m")).alias("z"))  # one row
    pairs = edges.join(z.select(F.col(label).alias("label_i"), F.col("z").alias("zi")), "label_i").join(z.select(F.col(label).alias("label_j"), F.col("z").alias("zj")), "label_j")
    top = pairs.agg(F.sum(F.col("zi") * F.col("zj")).alias("zz"), F.count("*").alias("w"))
    low = z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count("*").alias("n"))
    return top.crossJoin(low).select(F.when((F.col("ss") > 0) & (F.col("w") > 0), F.col("n") / F.col("w") * F.col("zz") / F.col("ss")).alias("morans_i"), F.col("n"), F.col("w").alias("n_edges"))


def pixel_links(pixels: DataFrame, mask: Column, id_: Column, connectivity: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, links (a, b)) of mask pixels that touch, by sides or also by corners."""
    own = pixels.where(mask).select("y", "x", id_.cast("long").alias("node"))
    links = touching_pairs(own, ["node"]).toDF("a", "b")
    if connectivity == 8:
        for dx in (1, -1):
            other = own.select((F.col("y") - 1).alias("y"), (F.col("x") - dx).alias("x"), F.col("node").alias("b"))
            links = links.unionByName(own.join(other, ["y", "x"]).select(F.col("node").alias("a"), "b"))
    return own, links
