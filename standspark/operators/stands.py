"""Stands as results: pieces and outlines, coverage, merge diagnostics, scores against field plots."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import keep
from . import compare, grid
from .components import connected


def pieces(pixels: DataFrame, label: str, node: Column, connectivity: int = 4) -> DataFrame:
    """(y, x, label, node, piece): each label's connected pieces, named by their least node."""
    own = pixels.where(F.col(label).isNotNull()).select("y", "x", F.col(label).alias("label"), node.cast("long").alias("node"))
    touch = grid.touching_pairs(own, ["label", "node"]).where("label_a = label_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    if connectivity == 8:
        for dx in (1, -1):
            other = own.select((F.col("y") - 1).alias("y"), (F.col("x") - dx).alias("x"), "label", F.col("node").alias("b"))
            touch = touch.unionByName(own.join(other, ["y", "x", "label"]).select(F.col("node").alias("a"), "b"))
    part = connected(touch)
    return own.join(part.toDF("node", "piece"), "node", "left").select("y", "x", "label", "node", F.coalesce("piece", "node").alias("piece"))


def vectorised(parts: DataFrame) -> DataFrame:
    """One row per piece: label, pixels, mean centre, and its runs of pixels along rows as (y, first x, last x).

    A run begins where the pixel to the left is of another piece; runs are the geometry.
    """
    w = Window.partitionBy("y").orderBy("x")
    fresh = ~(F.lag("piece").over(w).eqNullSafe(F.col("piece")) & (F.lag("x").over(w) == F.col("x") - 1))
    run = parts.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    runs = run.groupBy("label", "piece", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    whole = runs.withColumn("n", F.col("x1") - F.col("x0") + 1).groupBy("label", "piece").agg(
        F.sum("n").alias("n_pixels"), (F.sum(F.col("n") * (F.col("x0") + F.col("x1")) / 2) / F.sum("n")).alias("cx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("cy"),
        F.count("*").alias("n_runs"), F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    return whole


def polygon_counts(shapes: DataFrame, label: str = "label") -> DataFrame:
    """Polygons, stands, stands in several pieces and the most pieces of one."""
    each = shapes.groupBy(label).agg(F.count("*").alias("p"))
    return each.agg(F.sum("p").alias("n_polygons"), F.count("*").alias("n_stands"), F.count_if(F.col("p") > 1).alias("n_split"), F.max("p").alias("max_pieces"))


def split_units(parts: DataFrame) -> DataFrame:
    """Units in several pieces: how many, the share of the largest, and whether some touch by a corner."""
    size = parts.groupBy("label", "piece").agg(F.count("*").alias("n"))
    several = size.groupBy("label").agg(F.count("*").alias("n_pieces"), (F.max("n") / F.sum("n")).alias("largest_share")).where("n_pieces > 1")
    corner = None
    for dx in (1, -1):
        other = parts.select((F.col("y") - 1).alias("y"), (F.col("x") - dx).alias("x"), "label", F.col("piece").alias("p"))
        met = parts.join(other, ["y", "x", "label"]).where("piece <> p").select("label")
        corner = met if corner is None else corner.unionByName(met)
    return several.join(corner.distinct().withColumn("t", F.lit(True)), "label", "left").select("label", "n_pieces", "largest_share", F.coalesce("t", F.lit(False)).alias("touch_by_corner"))


def seeds(land: DataFrame, parts: DataFrame, step: int) -> DataFrame:
    """Nodes that segmentation starts from: grid points on land, and every pixel of a patch that none falls in.

    ``land`` has (node, y, x), ``parts`` (node, component).
    """
    half = step // 2
    on_grid = (F.pmod(F.col("y") - half, F.lit(step)) == 0) & (F.pmod(F.col("x") - half, F.lit(step)) == 0)
    own = land.join(parts.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("on_grid", on_grid)
    held = own.groupBy("component").agg(F.bool_or("on_grid").alias("held"))
    return own.join(held, "component").where("on_grid OR NOT held").select("node", "y", "x", "on_grid")


def coverage(pixels: DataFrame, land: Column, size: Column, label: Column, min_pixels: int, scale: float = 10.0) -> DataFrame:
    """Hectares of kept land, of patches too small to be kept, of kept land without a unit and of units off kept land."""
    kept = land & (size >= min_pixels)
    ha = lambda c: F.round(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)) * (scale * scale / 10000), 4)
    return pixels.agg(ha(kept).alias("kept_ha"), ha(land & (size < min_pixels)).alias("small_patches_ha"), ha(kept & label.isNull()).alias("kept_without_label_ha"), ha(label.isNotNull() & ~F.coalesce(kept, F.lit(False))).alias("label_off_kept_ha"))


def first_round(regions: DataFrame, edges: DataFrame, tolerances: dict[str, float], most_pixels: int, min_defined: int = 2) -> DataFrame:
    """Adjacent pairs before any merge: how many the area bound blocks, how many lack criteria, how many pass.

    Of pairs with any criterion, the share that the gate admits; areas come first, as in the merge.
    """
    side = lambda s, k: regions.select(F.col("i").alias(k), F.col("n_pixels").alias(f"n_{s}"), *(F.col(b).alias(f"{b}_{s}") for b in tolerances))
    both = edges.select("i", "j").join(side("a", "i"), "i").join(side("b", "j"), "j")
    gap = {b: F.abs(F.col(f"{b}_a") - F.col(f"{b}_b")) for b in tolerances}
    defined = sum((gap[b].isNotNull().cast("int") for b in tolerances), F.lit(0))
    passing = F.lit(True)
    for b, t in tolerances.items():
        passing = passing & F.coalesce(gap[b] <= float(t), F.lit(True))
    fits = F.col("n_a") + F.col("n_b") <= most_pixels
    gate = passing & (defined >= min_defined)
    return both.agg(
        F.count("*").alias("n_pairs"), F.count_if(~fits).alias("blocked_by_area"), F.count_if(fits & (defined < min_defined)).alias("blocked_by_undefined"), F.count_if(fits & gate).alias("n_candidates"),
        F.count_if(defined > 0).alias("n_with_criterion"), F.round(100 * F.try_divide(F.count_if(gate), F.count_if(defined > 0)), 2).alias("admitted_pct"))


def floor_quantiles(rows: DataFrame, by: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Per group, the values at places floor(q * n) of the ascending order (the last at most), from one row per distinct value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    r = n.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    place = lambda q: F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
    return r.groupBy(by).agg(F.first("_n").alias("n"), *(F.min(F.when(F.col("_upto") > place(q), F.col(value))).alias(f"p{round(100 * q)}") for q in quantiles))


def merge_diagnostics(merged: DataFrame, min_pixels: int, bands: Sequence[str], min_frac_valid: float = 0.5, scale: float = 10.0) -> DataFrame:
    """Numbers of a merge from merge_regions(): units, stands, merges by kind, undersized stands by cause, incomplete ones."""
    stands = merged.drop("i").dropDuplicates(["stand"])
    low = F.col("n_pixels") < min_pixels
    short = F.lit(False)
    for b in bands:
        short = short | (F.col(f"{b}_frac_valid") < min_frac_valid)
    orphan = lambda why: F.count_if(low & (F.col("below_why") == why)).alias(f"orphans_{why}")
    return stands.agg(
        F.sum("n_superpx").alias("n_units"), F.count("*").alias("n_stands"), F.round(F.sum("n_superpx") / F.count("*"), 3).alias("reduction_factor"), F.sum("n_pass1").alias("merges_first"), F.sum("n_relaxed").alias("merges_relaxed"), F.sum("n_fallback").alias("merges_fallback"),
        F.count_if(low).alias("stands_below_min"), F.round(F.coalesce(F.sum(F.when(low, F.col("n_pixels"))), F.lit(0)) * (scale * scale / 10000), 4).alias("area_below_min_ha"), orphan("isolated"), orphan("area_blocked"), orphan("iteration_cap"), F.count_if(short).alias("stands_incomplete"))


def edge_distance(points: DataFrame, pixels: DataFrame, label: str, reach: float, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Distance of each point to the nearest pixel on a unit's edge, up to a reach; null beyond."""
    from .joins import nearest_within_reach

    edge = grid.outline(pixels, label).select(F.struct("y", "x").alias("_edge"), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    return nearest_within_reach(points, edge, reach, key, "_edge", x, y).select(key, "distance")


def nearest_seed(pixels: DataFrame, points: DataFrame, reach: float, key: str) -> DataFrame:
    """Each pixel with the nearest point (ties: the least), up to a reach: cells around points as a raster."""
    from .joins import nearest_within_reach

    own = pixels.select(F.struct("y", "x").alias("_pixel"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return nearest_within_reach(own, points, reach, "_pixel", key).select("_pixel.y", "_pixel.x", key)


def starts_agreement(labels: DataFrame, unit: str = "unit", start: str = "start", cluster: str = "cluster") -> DataFrame:
    """Median and least adjusted Rand index over all pairs of starts, from their tables of counts.

    Starts are a stated few; units meet themselves by an equi-join.
    """
    a, b = (labels.select(F.col(unit).alias("u"), F.col(start).alias(f"s{k}"), F.col(cluster).alias(k)) for k in "ab")
    table = a.join(b, "u").where("sa < sb").groupBy("sa", "sb", "a", "b").agg(F.count("*").alias("n"))
    each = compare.agreement(compare.pair_counts(table, ["sa", "sb"]), ["sa", "sb"])
    # Two partitions of the same one group, or of single units, agree.
    score = F.coalesce("adjusted_rand", F.lit(1.0))
    return each.agg(F.coalesce(F.median(score), F.lit(1.0)).alias("ari_median"), F.coalesce(F.min(score), F.lit(1.0)).alias("ari_min"), F.count("*").alias("n_pairs"))


def drawing_statistic(plots: DataFrame, field: str, stand: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of field type against stand."""
    return compare.agreement(compare.pair_counts(compare.contingency(plots, field, stand, by), by), by).select(*by, F.col("adjusted_rand").alias("ari_drawing"))


def labelling_statistic(plots: DataFrame, field: str, type_: str, super_group: str) -> DataFrame:
    """Adjusted Rand index of field type against stand type, pooled over super-groups by pair counts."""
    table = compare.contingency(plots.where(F.col(super_group).isNotNull()), field, type_, [super_group])
    return compare.pooled_agreement(compare.pair_counts(table, [super_group])).select(F.col("pooled_ari").alias("ari_labelling"))


def field_scores(plots: DataFrame, key: str, district: str, stand: str, type_: str, field: str, distance: Column, far: float) -> DataFrame:
    """Five scores of a map against field types, over plots in a stand.

    delin_all, delin_multi: adjusted Rand of (district, stand) against field type over all plots, and those
    in stands of several; prec: share of pairs within a stand that are alike; lab_wmean: adjusted Rand of
    stand type against field type by district, weighted by plots; far_gap: among pairs of one district
    farther apart than ``far``, how much more often alike ones share a type than unlike ones.  ``distance``
    is over columns with suffix _a and _b.
    """
    from .inference import plot_pairs

    used = plots.where(F.col(stand).isNotNull()).withColumn("_s", F.concat_ws(":", F.col(district).cast("string"), F.col(stand).cast("string")))
    used = used.withColumn("_m", F.count("*").over(Window.partitionBy("_s")))
    whole = lambda rows, name: drawing_statistic(rows, field, "_s").select(F.col("ari_drawing").alias(name))
    counts = compare.contingency(used, "_s", field)
    pairs = compare.pairs_of(F.col("n")).cast("double")
    alike = counts.agg(F.sum(pairs).alias("t"))
    held = counts.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs).alias("p"))
    prec = alike.crossJoin(held).select(F.try_divide("t", "p").alias("prec"))
    typed = used.where(F.col(type_).isNotNull())
    by = compare.contingency(typed, field, type_, [district])
    sizes = by.groupBy(district).agg(F.sum("n").alias("w"), F.count_distinct("a").alias("k")).where("w >= 2 AND k >= 2")
    each = compare.agreement(compare.pair_counts(by, [district]), [district]).join(sizes, district)
    lab = each.agg(F.try_divide(F.sum(F.col("adjusted_rand") * F.col("w")), F.sum(F.when(F.col("adjusted_rand").isNotNull(), F.col("w")))).alias("lab_wmean"))
    far_apart = plot_pairs(typed, key, [*{c for c in plots.columns if c not in (key, district)}], [district]).where(distance > far)
    same_field, same_type = F.col(f"{field}_a") == F.col(f"{field}_b"), (F.col(f"{type_}_a") == F.col(f"{type_}_b")).cast("double")
    gap = far_apart.agg((F.avg(F.when(same_field, same_type)) - F.avg(F.when(~same_field, same_type))).alias("far_gap"))
    return whole(used, "delin_all").crossJoin(whole(used.where("_m > 1"), "delin_multi")).crossJoin(prec).crossJoin(lab).crossJoin(gap)  # one row each


def type_changes(stands: DataFrame, old: str, new: str) -> DataFrame:
    """Stands whose type another fit would change: by old and new type, and in all."""
    return stands.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("n_changed"))


def mismatches(over: DataFrame, k: int) -> DataFrame:
    """The k largest pairs of units that share pixels without covering the same ones."""
    return over.where((F.col("n") != F.col("na")) | (F.col("n") != F.col("nb"))).orderBy(F.desc("n"), "a", "b").limit(k).select("a", "b", "n")


def add_reports(parts: DataFrame, counts: Sequence[str], means: Sequence[str], weight: str) -> DataFrame:
    """One report from those of parts: counts add up, means are weighted."""
    return parts.agg(*(F.sum(c).alias(c) for c in counts), *(F.try_divide(F.sum(F.when(F.col(weight) > 0, F.col(m) * F.col(weight))), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in means))


def common_pixels(tables: Sequence[DataFrame], values: Sequence[str], on: Sequence[str] = ("y", "x")) -> DataFrame:
    """Pixels that every table has a value for, with the values of all."""
    out = None
    for table, value in zip(tables, values, strict=True):
        own = table.where(F.col(value).isNotNull()).select(*on, value)
        out = own if out is None else out.join(own, list(on))
    return out


def roi_gap(boxes: DataFrame, key: str, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """Least distance between any two parts of a region (its few boxes): closer than two pixels they are worked on as a whole."""
    a, b = (boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in (key, x0, y0, x1, y1))) for s in "ab")
    dx, dy = (F.greatest(F.col(f"{lo}_a") - F.col(f"{hi}_b"), F.col(f"{lo}_b") - F.col(f"{hi}_a"), F.lit(0.0)) for lo, hi in ((x0, x1), (y0, y1)))
    return a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b")).agg(F.min(F.hypot(dx, dy)).alias("gap"), F.count("*").alias("n_pairs"))


def band_summary(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Per band of a layer: valid and missing pixels, least, mean and greatest value."""
    row = pixels.agg(F.count("*").alias("n"), *(f(b).alias(f"{b}_{k}") for b in bands for k, f in (("valid", F.count), ("min", F.min), ("mean", F.avg), ("max", F.max))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"{b}_valid").alias("n_valid"), (F.col("n") - F.col(f"{b}_valid")).alias("n_missing"), *(F.col(f"{b}_{k}").cast("double").alias(k) for k in ("min", "mean", "max"))) for b in bands))).alias("r")).select("r.*")


def named(shapes: DataFrame, renames: dict[str, str], drop: Sequence[str]) -> DataFrame:
    """Attributes under their public names, internal ones left out."""
    return shapes.drop(*drop).withColumnsRenamed(renames)


def torus_counts(grid_: DataFrame, height: int, width: int, group: str | None = None) -> DataFrame:
    """(group, dr, dc, n_same, n): for every cyclic shift of b (row, col, a, b), pixels that both have and where they agree.

    One grid is one task; counts of all its shifts come from Fourier transforms, one for each class, and
    are whole numbers.
    """
    import numpy as np
    import pandas as pd

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        at = (frame["row"].to_numpy(), frame["col"].to_numpy())

        def spectrum(mask):
            table = np.zeros((height, width))
            np.add.at(table, (at[0][mask], at[1][mask]), 1.0)
            return np.fft.rfft2(table)

        def shared(x, y):
            # The pixel (r, c) of a meets (r + dr, c + dc) of b.
            return np.rint(np.fft.irfft2(np.conj(x) * y, s=(height, width))).astype(np.int64)

        has_a, has_b = frame["a"].notna().to_numpy(), frame["b"].notna().to_numpy()
        n = shared(spectrum(has_a), spectrum(has_b))
        same = np.zeros_like(n)
        for v in np.intersect1d(frame["a"].dropna().unique(), frame["b"].dropna().unique()):
            same += shared(spectrum((frame["a"] == v).to_numpy()), spectrum((frame["b"] == v).to_numpy()))
        dr, dc = np.divmod(np.arange(height * width), width)
        return pd.DataFrame({"g": frame["g"].iloc[0], "dr": dr, "dc": dc, "n_same": same.ravel(), "n": n.ravel()})

    rows = grid_.select((F.col(group) if group else F.lit(0)).cast("long").alias("g"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "a", "b")
    return rows.groupBy("g").applyInPandas(solve, "g long, dr int, dc int, n_same long, n long")


def torus_test(counts: DataFrame) -> DataFrame:
    """Per grid: the share of agreeing pixels unshifted, and how many shifts have more, less and as much."""
    s = counts.where("n > 0").withColumn("s", F.col("n_same") / F.col("n"))
    seen = s.where("dr = 0 AND dc = 0").select("g", F.col("s").alias("observed"))
    gap = F.col("s") - F.col("observed")
    out = seen.join(s, "g").where("dr > 0 OR dc > 0").groupBy("g").agg(F.first("observed").alias("observed"), F.count_if(gap > 1e-9).alias("n_greater"), F.count_if(gap < -1e-9).alias("n_less"), F.count_if(F.abs(gap) <= 1e-9).alias("n_equal"))
    return out


def rotation_draws(plots: DataFrame, key: str, group: str, on_region, n: int, seed: int, most_tries: int = 1000, x: str = "x", y: str = "y") -> DataFrame:
    """(draw, group, key, x, y): plots of each group turned and moved as one body, only where all stay in the region.

    ``on_region`` takes arrays of x and y and says which lie in the region.  A group is one task; a group
    that no admissible move is found for within ``most_tries`` tries a draw raises NotEstimable.
    """
    import numpy as np
    import pandas as pd

    from .checks import enough_draws

    kind = dict(plots.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        px, py = frame[x].to_numpy(float), frame[y].to_numpy(float)
        rng = np.random.default_rng([seed, abs(hash(str(frame[group].iloc[0]))) % 2**32 if not isinstance(frame[group].iloc[0], (int, np.integer)) else int(frame[group].iloc[0]) % 2**32])
        cx, cy, span = px.mean(), py.mean(), max(np.ptp(px), np.ptp(py), 1.0)
        out, tried = [], 0
        while len(out) < n:
            enough_draws(len(out), n, tried, n * most_tries)
            tried += 1
            turn, (dx, dy) = rng.uniform(0, 2 * np.pi), rng.uniform(-span, span, 2)
            u, v = px - cx, py - cy
            qx, qy = cx + u * np.cos(turn) - v * np.sin(turn) + dx, cy + u * np.sin(turn) + v * np.cos(turn) + dy
            if np.all(on_region(qx, qy)):
                out.append(pd.DataFrame({"draw": len(out), group: frame[group], key: frame[key], x: qx, y: qy}))
        return pd.concat(out)

    return plots.select(group, key, x, y).groupBy(group).applyInPandas(solve, f"draw long, {group} {kind[group]}, {key} {kind[key]}, {x} double, {y} double")


#: Pairs of a group that one task may hold; larger groups are never gathered.
GATHERED = 1 << 20
#: Classes of a draw's hashes around the place where it should end, and half their width in standard deviations.
CLASSES, REACH = 256, 8
#: Rows that a pass takes at once.
STEP = 1 << 15


def _salts(seed: int, n: int) -> np.ndarray:
    """A number of 64 bits for each draw."""
    return np.frombuffer(b"".join(hashlib.blake2b(f"{seed} {draw}".encode(), digest_size=8).digest() for draw in range(n)), np.uint64)


def _order(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The place of each key in a draw, as a number of 64 bits: a bijection of hashed keys."""
    h = (keys ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _window(ns: int, m: int) -> tuple[int, int]:
    """The first of the classes and their width: the hash of place ns of m lies in them, but for once in some 10^14 draws."""
    middle, spread = 2**64 * ns // m, int(2**64 * REACH * math.sqrt(ns / m * (1 - ns / m) / m)) + 1
    low = max(middle - spread, 0)
    return low, max((min(middle + spread, 2**64) - low) // CLASSES, 1)


def _bounds(cls: int, low: int, width: int) -> tuple[int, int]:
    """First and last hash of a class: 0 is below the window, CLASSES + 1 above it."""
    if cls == 0:
        return 0, low - 1
    first = low + (cls - 1) * width
    return first, first + width - 1 if cls <= CLASSES else 2**64 - 1


def _chunks(batches):
    """Arrays (group, key, value) of some STEP rows of one group."""
    held, n = [], 0

    def arrays():
        g, k, v = (np.concatenate([b[i] for b in held]) for i in range(3))
        for i in np.unique(g):
            own = g == i
            yield int(i), k[own].view(np.uint64), v[own]

    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "k", "v")])
        n += b.num_rows
        if n >= STEP:
            yield from arrays()
            held, n = [], 0
    if n:
        yield from arrays()


def _large_sums(used: DataFrame, sizes: Sequence[tuple[int, int]], n: int, seed: int) -> DataFrame:
    """(g, draw, d) for the groups g of sizes (ns, m), from two passes over the pairs (g, k, v).

    The first counts and sums each draw's hashes below a window and in classes of it; the class in which
    place ns lies is then known, and the second passes on only the rows of that class.
    """
    windows = [_window(*s) for s in sizes]

    def count(batches):
        salts, state = _salts(seed, n), {}
        for g, keys, v in _chunks(batches):
            low, width = windows[g]
            if g not in state:
                state[g] = np.zeros((n, CLASSES + 2), np.int64), np.zeros((n, CLASSES + 2))
            many, total = state[g]
            top = min(low + CLASSES * width, 2**64 - 1)
            finite = np.isfinite(v).all()
            for draw in range(n):
                h = _order(keys, salts[draw])
                below = h < np.uint64(low)
                many[draw, 0] += np.count_nonzero(below)
                total[draw, 0] += below.astype(np.float64) @ v if finite else v[below].sum()
                near = np.flatnonzero((h <= np.uint64(top)) ^ below)
                cls = np.minimum((h[near] - np.uint64(low)) // np.uint64(width) + np.uint64(1), np.uint64(CLASSES + 1)).astype(np.int64)
                many[draw] += np.bincount(cls, minlength=CLASSES + 2)
                total[draw] += np.bincount(cls, v[near], CLASSES + 2)
                many[draw, CLASSES + 1] += len(v) - np.count_nonzero(below) - len(near)
        for g, (many, total) in state.items():
            draw, cls = np.nonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(draw), g, np.int32)), pa.array(draw), pa.array(cls), pa.array(many[draw, cls]), pa.array(total[draw, cls])], ["g", "draw", "cls", "c", "t"])

    counted = keep(used.mapInArrow(count, "g int, draw long, cls long, c long, t double").groupBy("g", "draw", "cls").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    before = Window.partitionBy("g", "draw").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0)), "t0": F.coalesce(F.sum("t").over(before), F.lit(0.0))})
    ns = F.element_at(F.array(*(F.lit(s[0]).cast("long") for s in sizes)), F.col("g") + 1)
    met = keep(counted.where((F.col("c0") < ns) & (F.col("c0") + F.col("c") >= ns)).select("g", "draw", "cls", "t0", (ns - F.col("c0")).alias("left")))
    ends = {(r["g"], r["draw"]): _bounds(r["cls"], *windows[r["g"]]) for r in met.select("g", "draw", "cls").toLocalIterator()}  # one row a group and draw

    def pick(batches):
        salts = _salts(seed, n)
        for g, keys, v in _chunks(batches):
            for draw in range(n):
                first, last = ends[g, draw]
                h = _order(keys, salts[draw])
                own = np.flatnonzero((h >= np.uint64(first)) & (h <= np.uint64(last)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g, np.int32)), pa.array(np.full(len(own), draw, np.int64)), pa.array((h[own] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(v[own])], ["g", "draw", "h", "v"])

    place = F.row_number().over(Window.partitionBy("g", "draw").orderBy("h", "v"))
    last = used.mapInArrow(pick, "g int, draw long, h long, v double").withColumn("_p", place).join(F.broadcast(met), ["g", "draw"]).where(F.col("_p") <= F.col("left"))
    return last.groupBy("g", "draw").agg((F.first("t0") + F.sum("v")).alias("d"))


def shuffle_p(pairs: DataFrame, same: Column, value: str, by: Sequence[str], n: int, seed: int, key: Sequence[str] = ()) -> DataFrame:
    """Per group: difference of means of unlike and alike pairs, and its share among n dealings of the labels.

    Labels are dealt among the pairs of a group; a group without both kinds has no p.  Alike pairs of a draw are the
    first n_same of an order of hashed keys: columns that tell pairs apart, else numbers given to the pairs, which are
    then written once.  Large groups are counted where they are, in classes of hashes; others are gathered, one each.
    """
    number = F.xxhash64(*key) if key else F.xxhash64(F.monotonically_increasing_id())
    used = pairs.where(F.col(value).isNotNull() & same.isNotNull()).select(*by, F.col(value).cast("double").alias("v"), same.cast("int").alias("s"), number.alias("k"))
    used = used if key else keep(used)
    total = keep(used.groupBy(*by).agg(F.sum("s").alias("ns"), F.count("*").alias("m"), F.sum("v").alias("t"), F.sum(F.col("v") * F.col("s")).alias("ts")))
    gap = lambda ts: (F.col("t") - ts) / (F.col("m") - F.col("ns")) - ts / F.col("ns")
    seen = total.where("ns > 0 AND ns < m").withColumn("observed", gap(F.col("ts")))

    def deal(table):
        keys, v, salts = table["k"].to_numpy().view(np.uint64), table["v"].to_numpy(), _salts(seed, n)
        ns = int(table["s"].to_numpy().sum())
        if not 0 < ns < len(v):
            return shown.empty_table()
        d = [v[np.lexsort((v, _order(keys, salt)))[:ns]].sum() for salt in salts]
        return pa.table([pa.concat_arrays([table[c].combine_chunks()[:1]] * n) for c in by] + [pa.array(range(n), pa.int64()), pa.array(d, pa.float64())], shown.names)

    large = seen.where(F.col("m") > GATHERED).select(*by, "ns", "m").orderBy(*by).collect()  # one in 2^20 pairs at most
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    parts = []
    if large:
        groups = pairs.sparkSession.createDataFrame([(*r[: len(by)], i) for i, r in enumerate(large)], T.StructType([*(used.schema[c] for c in by), T.StructField("g", T.IntegerType())]))
        mine = used.join(F.broadcast(groups), list(by)).select("g", "k", "v")
        parts.append(_large_sums(mine, [(r["ns"], r["m"]) for r in large], n, seed).join(F.broadcast(groups), "g").select(*by, "draw", "d"))
        used = used.join(F.broadcast(groups), list(by), "left_anti")
    if not large or not seen.where(F.col("m") <= GATHERED).isEmpty():
        schema = T.StructType([*(used.schema[c] for c in by), T.StructField("draw", T.LongType()), T.StructField("d", T.DoubleType())])
        shown = to_arrow_schema(schema)
        parts.append(used.where(known).groupBy(*by).applyInArrow(deal, schema))
    dealt = reduce(DataFrame.unionByName, parts)
    hit = dealt.join(seen, list(by)).withColumn("_g", gap(F.col("d"))).groupBy(*by).agg(F.count_if(F.col("_g") >= F.col("observed") - 1e-12).alias("hits"))
    return total.join(seen.select(*by, "observed"), list(by), "left").join(hit, list(by), "left").select(*by, F.col("m").alias("n_pairs"), "observed", ((1 + F.col("hits")) / (n + 1)).alias("p"))


def arm_difference(reps: DataFrame, sums: DataFrame, key: str, arm: str, top: str, bottom: str) -> DataFrame:
    """(rep, difference): ratio of sums of the second arm less that of the first, in each resample of groups (rep, slot, key)."""
    each = reps.join(sums, key).groupBy("rep", arm).agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("r"))
    return each.groupBy("rep").agg((F.max_by("r", arm) - F.min_by("r", arm)).alias("difference"))


def synthetic_plots(spark, n: int, groups: int, effect: float, seed: int) -> DataFrame:
    """Plots with a planted effect: place, group, super-group, field type, attributes whose mean follows the type.

    Everything is a hash of the seed and the plot's number, the same on every run and cluster.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "plot", F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    gauss = lambda k: F.sqrt(-2 * F.log(u(k))) * F.cos(2 * F.pi() * u(k + 1))
    rows = spark.range(n).withColumnRenamed("id", "plot").withColumn("grp", F.pmod("plot", F.lit(groups))).withColumn("super", F.pmod("grp", F.lit(4)))
    rows = rows.withColumn("x", F.col("grp") % 5 * 1000 + u(1) * 800).withColumn("y", F.floor(F.col("grp") / 5) * 1000 + u(2) * 800)
    rows = rows.withColumn("field_type", F.least(F.floor(u(3) * 5), F.lit(4)).cast("int"))
    return rows.withColumns({f"a{k}": F.lit(effect) * F.col("field_type") + gauss(10 + 2 * k) for k in range(4)})
