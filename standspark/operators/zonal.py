"""Grouped reductions by unit label: means, profiles, shares, geometry, explained variance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running


def area_by_key(pixels: DataFrame, key: str, area: str) -> DataFrame:
    return pixels.groupBy(key).agg(F.sum(area).alias("area"))


def shares(table: DataFrame, within: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Each row's share of the sum in its group; null where the sum is 0."""
    return table.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*within))))


def pooled_share(table: DataFrame, area: str, share: str) -> DataFrame:
    """Area-weighted mean of shares."""
    return table.agg(F.try_divide(F.sum(F.col(area) * F.col(share)), F.sum(area)).alias("pooled_share"))


def unit_means(pixels: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Mean over the valid pixels of each band, their number, and all pixels; one pass for all bands."""
    aggs = [a for b in bands for a in (F.avg(b).alias(b), F.count(b).alias(f"{b}_valid"))]
    return pixels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_pixels"), *aggs)


def means_on_pixels(pixels: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Every pixel gets its unit's means.  Units are aggregated first and joined, so a large unit isn't one task."""
    means = pixels.groupBy(label).agg(*(F.avg(b).alias(f"{b}_unit") for b in bands))
    return pixels.join(means, label, "left")


def profiles(rows: DataFrame, cluster: str, bands: Sequence[str], hectares: float = 0.01) -> DataFrame:
    """Per cluster: count, area, and mean, p25, p50, p75 of every band, in one pass."""
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    aggs = [a for b in bands for a in (F.avg(b).alias(f"{b}_mean"), F.percentile(F.col(b).cast("double"), q).alias(f"_{b}"))]
    out = rows.groupBy(cluster).agg(F.count("*").alias("n"), (F.count("*") * F.lit(hectares)).alias("ha"), *aggs)
    flat = [c for b in bands for c in (F.col(f"{b}_mean"), *(F.col(f"_{b}")[i].alias(f"{b}_p{p}") for i, p in enumerate((25, 50, 75))))]
    return out.select(cluster, "n", "ha", *flat)


def distribution(rows: DataFrame, cluster: str, hectares: float = 0.01) -> DataFrame:
    """Count, hectares and percent of each cluster."""
    n = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.select(cluster, "n", (F.col("n") * F.lit(hectares)).alias("ha"), (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def group_mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group; ties go to the least."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).count()
    return n.groupBy(group).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("mode"))


def histogram(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


class ComponentSizeError(ValueError):
    """A unit is larger than the bound."""


def assert_sizes_fit(rows: DataFrame, label: str, most: int) -> int:
    """Pixels of the largest unit; raises if over the bound."""
    largest = histogram(rows, label).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ComponentSizeError(f"the largest unit has {largest} pixels; the bound is {most}")
    return largest


def units_lost(in_habitat, with_centre, rows) -> dict:
    """Units lost for want of a centre and for want of a value."""
    return {"no_centre": F.greatest(in_habitat - with_centre, F.lit(0)), "no_row": F.greatest(with_centre - rows, F.lit(0))}


def stratified_sample(rows: DataFrame, cls: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per class, chosen by a hash of the key: the same on every run."""
    w = Window.partitionBy(cls).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sides(pixels: DataFrame, label: str, y: str = "y", x: str = "x") -> DataFrame:
    """The four neighbours' labels of every pixel (null where absent), by windows along rows and columns."""
    out = pixels
    for name, part, order in (("h", y, x), ("v", x, y)):
        w = Window.partitionBy(part).orderBy(order)
        for side, f, step in (("before", F.lag, -1), ("after", F.lead, 1)):
            out = out.withColumn(f"{name}_{side}", F.when(f(order).over(w) == F.col(order) + step, f(label).over(w)))
    return out


def geometry(pixels: DataFrame, label: str, scale: float = 10.0) -> DataFrame:
    """Area, perimeter along pixel sides (a side without a neighbour counts) and compactness of each unit."""
    edges = sum(F.when(F.col(s).eqNullSafe(F.col(label)), 0).otherwise(1) for s in ("h_before", "h_after", "v_before", "v_after"))
    out = sides(pixels, label).where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_pixels"), F.sum(edges).alias("_e"))
    area, perimeter = F.col("n_pixels") * F.lit(scale**2), F.col("_e") * F.lit(scale)
    return out.select(label, "n_pixels", area.alias("area_m2"), perimeter.alias("perimeter_m"), (F.lit(4 * math.pi) * area / (perimeter * perimeter)).alias("compactness"))


def geometry_summary(units: DataFrame, area: str, least: float) -> DataFrame:
    """Least, tenth, median, ninetieth (by floor index), largest, mean; number and share below the bound; share of the largest decile.

    Ranks come from one row per distinct area, so no task holds all units.
    """
    n = units.where(F.col(area).isNotNull()).groupBy(area).agg(F.count("*").alias("c"))
    r = running(n, [F.col(area)], "c", "upto").crossJoin(F.broadcast(n.agg(F.sum("c").alias("n"))))  # one row
    start = F.col("upto") - F.col("c")
    at = lambda p: F.max(F.when((start <= F.floor(F.col("n") * p)) & (F.floor(F.col("n") * p) < F.col("upto")), F.col(area)))
    top = F.greatest(F.lit(0), F.col("upto") - F.greatest(start, F.floor(F.col("n") * 0.9))) * F.col(area)
    return r.agg(F.min(area).alias("min"), at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max(area).alias("max"), (F.sum(F.col(area) * F.col("c")) / F.sum("c")).alias("mean"), F.sum(F.when(F.col(area) < least, F.col("c")).otherwise(0)).alias("n_below"), (F.sum(F.when(F.col(area) < least, F.col("c")).otherwise(0)) / F.sum("c")).alias("share_below"), (F.sum(top) / F.sum(F.col(area) * F.col("c"))).alias("largest_decile_share"))


def explained_variance(pixels: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """R2 of each band by unit over pixels valid in all bands: 1 - within / total; a constant band is null.

    Deviations are taken from means computed first, which keeps small variances exact.
    """
    valid = pixels.where(F.col(label).isNotNull()).dropna(subset=list(bands)).select(label, *bands)
    total = valid.agg(*(F.avg(b).alias(f"{b}_all") for b in bands))
    unit = valid.groupBy(label).agg(*(F.avg(b).alias(f"{b}_unit") for b in bands))
    both = valid.join(unit, label).crossJoin(F.broadcast(total))  # one row of means
    out = both.agg(F.count("*").alias("n"), *(F.sum(F.pow(F.col(b) - F.col(f"{b}_{k}"), F.lit(2.0))).alias(f"{b}_ss_{k}") for b in bands for k in ("unit", "all")))
    cols = [c for b in bands for c in (F.when(F.col(f"{b}_ss_all") > 0, 1 - F.col(f"{b}_ss_unit") / F.col(f"{b}_ss_all")).alias(f"{b}_r2"), (F.col(f"{b}_ss_unit") / F.col("n")).alias(f"{b}_within_variance"))]
    return out.select("n", *cols)


def r2_detail(rows: DataFrame, group: str, value: str) -> DataFrame:
    """R2 over groups of two or more, adjusted R2, and the R2 expected of a random grouping.

    Always one row; without such a group its numbers are 0 and its statistics null.
    """
    sized = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("c"), F.sum(value).alias("s"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("c >= 2")
    a = sized.agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.col("v")).alias("ssw"), F.sum("s").alias("s"))
    a = a.select(F.coalesce("n", F.lit(0)).alias("n"), "k", "ssw", F.try_divide("s", "n").alias("mu"))
    between = sized.crossJoin(F.broadcast(a.select("mu"))).agg(F.sum(F.col("c") * F.pow(F.col("m") - F.col("mu"), F.lit(2.0))).alias("ssb"))  # one row of means
    out = a.crossJoin(between)
    r2 = F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw"))
    return out.select("n", "k", r2.alias("r2"), (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - F.col("k"))).alias("r2_adjusted"), F.try_divide(F.col("k") - 1, F.col("n") - 1).alias("r2_expected"))


def separation(profile: DataFrame, weight: str, mean: str, p25: str, p75: str) -> DataFrame:
    """Spread between clusters over the sum of spreads between and within (within: IQR / 1.349)."""
    w = F.col(weight) / F.sum(weight).over(Window.partitionBy())
    t = profile.select(w.alias("w"), F.col(mean).alias("m"), ((F.col(p75) - F.col(p25)) / 1.349).alias("s"))
    t = t.withColumn("mbar", F.sum(F.col("w") * F.col("m")).over(Window.partitionBy()))
    between = F.sqrt(F.sum(F.col("w") * F.pow(F.col("m") - F.col("mbar"), F.lit(2.0))))
    return t.agg((between / (between + F.sum(F.col("w") * F.col("s")) + 1e-9)).alias("separation"))


def z_scored(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns standardised over the rows; a constant one becomes 0."""
    w = Window.partitionBy()
    sd = lambda c: F.stddev_pop(c).over(w)
    return profile.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / F.when(sd(c) == 0, 1.0).otherwise(sd(c)) for c in columns})
