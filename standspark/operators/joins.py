"""Joins by place: nearest within reach, ranges, points in polygons and on grids; checked equi-joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _near_cells(points: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Each point once for each of the nine cells around its own."""
    out = points.withColumn("_cy", F.explode(F.expr("array(-1, 0, 1)"))).withColumn("_cx", F.explode(F.expr("array(-1, 0, 1)")))
    return out.withColumn("_cy", F.col("_cy") + F.floor(F.col(y) / cell)).withColumn("_cx", F.col("_cx") + F.floor(F.col(x) / cell))


def within_reach(left: DataFrame, right: DataFrame, reach: float, key: str, other: str, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (key, other, distance) at most ``reach`` apart: an equi-join on cells as wide as the reach."""
    a = left.select(F.col(key), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(y) / reach).alias("_cy"), F.floor(F.col(x) / reach).alias("_cx"))
    b = _near_cells(right.select(F.col(other), F.col(x).alias("_u"), F.col(y).alias("_v")), "_u", "_v", reach)
    d = F.hypot(F.col("_x") - F.col("_u"), F.col("_y") - F.col("_v"))
    return a.join(b, ["_cy", "_cx"]).select(key, other, d.alias("distance")).where(F.col("distance") <= reach)


def nearest_within_reach(left: DataFrame, right: DataFrame, reach: float, key: str, other: str, x: str = "x", y: str = "y") -> DataFrame:
    """Every left point with its nearest right point within reach (ties: the least id); null without one."""
    best = within_reach(left, right, reach, key, other, x, y).groupBy(key).agg(F.min(F.struct("distance", other)).alias("b"))
    return left.select(key).join(best, key, "left").select(key, F.col(f"b.{other}").alias(other), F.col("b.distance").alias("distance"))


def distance_band(left: DataFrame, right: DataFrame, low: float, high: float, key: str, other: str, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs with low <= distance < high."""
    return within_reach(left, right, high, key, other, x, y).where((F.col("distance") >= low) & (F.col("distance") < high))


def disc_mean(points: DataFrame, pixels: DataFrame, radius: float, key: str, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Mean of the valid pixels whose centre lies within a radius of each point; null without one."""
    named = pixels.select(F.struct(y, x, value).alias("_p"), F.col(x).alias(x), F.col(y).alias(y)).where(F.col(f"_p.{value}").isNotNull())
    mean = within_reach(points, named, radius, key, "_p", x, y).groupBy(key).agg(F.avg(f"_p.{value}").alias(f"{value}_mean"), F.count("*").alias("n"))
    return points.select(key).join(mean, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sample_raster(points: DataFrame, pixels: DataFrame, row: Column, col: Column, values: Sequence[str]) -> DataFrame:
    """Values of the pixel that holds each point; null off the raster."""
    return points.withColumns({"y": row, "x": col}).join(pixels.select("y", "x", *values), ["y", "x"], "left")


def ranges(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every interval [low, high) that holds them: an equi-join on buckets of one width."""
    a = points.withColumn("_b", F.floor(F.col(value) / width).cast("long"))
    b = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return a.join(b, "_b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct x, y), by crossings of a ray; points on a side count."""
    turn = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    sides = F.arrays_zip(ring.alias("p"), turn.alias("q"))

    def crosses(s):
        ax, ay, bx, by = s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]
        return ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))

    def on(s):
        ax, ay, bx, by = s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (F.abs(cross) <= 1e-12) & (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))

    odd = F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return odd | F.exists(sides, on)


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, polygon: str, ring: str, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Every point with the least polygon that covers it; null without one.

    Points meet the polygons of their cell alone, by bounding boxes cut into cells.
    """
    # A field of an array of structs is the array of that field.
    ends = {f"_{c}{n}": f(F.col(ring).getField(c)) for c in "xy" for n, f in (("0", F.array_min), ("1", F.array_max))}
    boxed = polygons.withColumns(ends)
    for c in "xy":
        boxed = boxed.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(F.col(f"_{c}0") / cell), F.floor(F.col(f"_{c}1") / cell))))
    own = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py"), F.floor(F.col(x) / cell).alias("_cx"), F.floor(F.col(y) / cell).alias("_cy"))
    hit = own.join(boxed.select(polygon, ring, "_cx", "_cy"), ["_cx", "_cy"]).where(in_ring(F.col("_px"), F.col("_py"), F.col(ring)))
    return points.select(key).join(hit.groupBy(key).agg(F.min(polygon).alias(polygon)), key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """An equi-join whose key must be unique on both sides; raises otherwise."""
    for side in (left, right):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    return left.join(right, key, how)


def stack_bands(*tables: DataFrame, on: Sequence[str] = ("y", "x")) -> DataFrame:
    """Bands of several pixel tables side by side; a band may stand in one table only."""
    names = [c for t in tables for c in t.columns if c not in on]
    if len(names) != len(set(names)):
        raise ValueError("a band stands in several tables")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(on), "full")
    return out


def suffixed(old: DataFrame, new: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_old", "_new")) -> DataFrame:
    """Inner equi-join in which columns of both sides carry a suffix."""
    both = {c for c in old.columns if c in new.columns and c not in on}
    side = lambda t, s: t.select(*on, *(F.col(c).alias(c + s if c in both else c) for c in t.columns if c not in on))
    return side(old, suffixes[0]).join(side(new, suffixes[1]), list(on))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a dictionary; the planner broadcasts it where its size allows."""
    return rows.join(table, key, "left")


def mosaic(parts: Sequence[DataFrame], on: Sequence[str], values: Sequence[str], later_wins: bool = True) -> DataFrame:
    """Parts on one canvas; where several have a pixel, the later (or earlier) one counts."""
    marked = [p.select(*on, F.struct(F.lit(i if later_wins else -i).alias("o"), *values).alias("v")) for i, p in enumerate(parts)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return out.groupBy(*on).agg(F.max_by("v", "v.o").alias("v")).select(*on, *(F.col(f"v.{c}").alias(c) for c in values))


def labels_in_several_parts(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """(label, parts) of labels that stand in more than one part."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(label).distinct().withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(label).agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)


def plot_boxes(points: DataFrame, group: str, margin: float, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding box of each group's points, with a margin."""
    return points.groupBy(group).agg((F.min(x) - margin).alias("x0"), (F.min(y) - margin).alias("y0"), (F.max(x) + margin).alias("x1"), (F.max(y) + margin).alias("y1"))


def utm_span(lon: Sequence[float]) -> int:
    """Number of UTM zones that longitudes span."""
    return len({math.floor((v + 180) / 6) for v in lon})


def left_out(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in another table; a null key is in none."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def remap(rows: DataFrame, column: str, name: str, old: Sequence, new: Sequence, default=None) -> DataFrame:
    """A column's values by a list of old and new ones; the default elsewhere."""
    table = F.create_map(*(F.lit(x) for pair in zip(old, new, strict=True) for x in pair))
    return rows.withColumn(name, F.coalesce(F.element_at(table, F.col(column)), F.lit(default)))
