"""Reducers of dated observations per pixel: filters, masks, composites, votes, trends, seasonal fits.

Tables are long: one row per pixel and date.  A masked value is null, and every reducer skips nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands as B

PERCENTILE = {"median": 0.5, "p25": 0.25, "p50": 0.5, "p75": 0.75}


def within_dates(obs: DataFrame, ts: str, start: str, end: str, end_inclusive: bool = True) -> DataFrame:
    """Rows from start to the end of ``end`` (or up to it): a range predicate that reaches the scan."""
    upper = F.date_add(F.lit(end).cast("date"), 1 if end_inclusive else 0).cast("timestamp")
    return obs.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < upper))


def within_months(obs: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    return obs.where(F.month(ts).between(first, last))


def with_metadata(obs: DataFrame, at_most: dict | None = None, equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows whose metadata meet every bound, equality and list membership."""
    tests = [F.col(k) <= v for k, v in (at_most or {}).items()] + [F.col(k) == v for k, v in (equal or {}).items()]
    tests += [F.array_contains(k, x) for k, xs in (contains or {}).items() for x in xs]
    return obs.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def mask_classes(obs: DataFrame, bands: Sequence[str], cls: str, drop: Sequence) -> DataFrame:
    """Bands become null where the class is one of ``drop``."""
    return obs.withColumns({b: F.when(~F.coalesce(F.col(cls).isin(*drop), F.lit(False)), F.col(b)) for b in bands})


def composite(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], reducer: str = "median") -> DataFrame:
    """Exact percentile of each band per pixel; names take the reducer as suffix."""
    return obs.groupBy(*pixel).agg(*(F.percentile(F.col(b).cast("double"), PERCENTILE[reducer]).alias(f"{b}_{reducer}") for b in bands))


def percentile_set(requested: Sequence[int], spread: bool = True, contrast: bool = True) -> list[int]:
    """Percentiles to compute: those asked for, 10 and 90 for the spread, 50 for the contrast."""
    return sorted({*requested, *((10, 90) if spread else ()), *((50,) if contrast else ())})


def percentiles(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], requested: Sequence[int] = (10, 50, 90)) -> DataFrame:
    """All percentiles of a band in one sorted pass, then the spread p90 - p10 of each band."""
    wanted = percentile_set(requested)
    shares = F.array(*(F.lit(p / 100) for p in wanted))
    out = obs.groupBy(*pixel).agg(*(F.percentile(F.col(b).cast("double"), shares).alias(b) for b in bands))
    flat = [F.col(b)[i].alias(f"{b}_p{p}") for b in bands for i, p in enumerate(wanted)]
    out = out.select(*pixel, *flat)
    return out.withColumns({f"{b}_iqr": F.col(f"{b}_p90") - F.col(f"{b}_p10") for b in bands})


def contrast(frame: DataFrame, a: str, b: str, name: str = "contrast") -> DataFrame:
    """Difference of the medians of two bands."""
    return frame.withColumn(name, F.col(f"{a}_p50") - F.col(f"{b}_p50"))


def collapse_years(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], how: str = "mean") -> DataFrame:
    """Mean or median of each band over the years."""
    f = F.avg if how == "mean" else F.median
    return obs.groupBy(*pixel).agg(*(f(b).alias(b) for b in bands))


def climatology(obs: DataFrame, pixel: Sequence[str], band: str, first_year: int, last_year: int) -> DataFrame:
    """Sum over the window divided by its number of years."""
    return obs.groupBy(*pixel).agg((F.sum(band) / F.lit(float(last_year - first_year + 1))).alias(f"{band}_per_year"))


def counts(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    return obs.groupBy(*pixel).agg(*(F.count(b).alias(f"{b}_obs_count") for b in bands))


def majority_vote(years: DataFrame, pixel: Sequence[str], year: str, flag: str) -> DataFrame:
    """1 if more usable years say 1 than 0; on a tie the latest usable year decides; null without one."""
    votes, n = F.sum(flag), F.count(flag)
    latest = F.max_by(flag, F.when(F.col(flag).isNotNull(), F.col(year)))
    return years.groupBy(*pixel).agg(n.alias("n_years"), votes.alias("n_votes"), F.when(2 * votes > n, 1).when(2 * votes < n, 0).otherwise(latest).cast("int").alias("habitat"))


def habitat_with_fallback(voted: DataFrame, pixel: Sequence[str], fallback: DataFrame, flag: str) -> DataFrame:
    """The vote where there is one, else the fallback's class; source is 1, 2, or 0 without either."""
    both = voted.join(fallback.select(*pixel, F.col(flag).alias("_fallback")), list(pixel), "full")
    source = F.when(F.col("habitat").isNotNull(), 1).when(F.col("_fallback").isNotNull(), 2).otherwise(0)
    return both.select(*pixel, F.coalesce("habitat", "_fallback").alias("habitat"), source.alias("source"))


def latest_valid(obs: DataFrame, pixel: Sequence[str], ts: str, bands: Sequence[str]) -> DataFrame:
    """Each band's last value that isn't null."""
    return obs.groupBy(*pixel).agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), F.struct(ts, b))).alias(b) for b in bands))


def quality_mosaic(obs: DataFrame, pixel: Sequence[str], quality: str, bands: Sequence[str]) -> DataFrame:
    """The bands of the observation with the greatest quality (ties: the greatest values)."""
    best = obs.where(F.col(quality).isNotNull()).groupBy(*pixel).agg(F.max(F.struct(quality, *bands)).alias("m"))
    return best.select(*pixel, F.col(f"m.{quality}").alias(quality), *(F.col(f"m.{b}").alias(b) for b in bands))


def variance(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str]) -> DataFrame:
    return obs.groupBy(*pixel).agg(*(F.var_pop(b).alias(f"{b}_variance") for b in bands))


def trend(obs: DataFrame, pixel: Sequence[str], band: str, t: str) -> DataFrame:
    """Slope of the least-squares line over time; null under two times."""
    return obs.groupBy(*pixel).agg(F.regr_slope(band, t).alias(f"{band}_trend"))


def standardised_anomaly(obs: DataFrame, pixel: Sequence[str], year: str, band: str, this_year: int) -> DataFrame:
    """(this year's mean - mean of yearly means) / their standard deviation; null if that is 0."""
    yearly = obs.groupBy(*pixel, year).agg(F.avg(band).alias("m"))
    out = yearly.groupBy(*pixel).agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"), F.max(F.when(F.col(year) == this_year, F.col("m"))).alias("now"))
    return out.select(*pixel, F.try_divide(F.col("now") - F.col("mu"), "sd").alias(f"{band}_anomaly"))


def final_run(obs: DataFrame, pixel: Sequence[str], ts: str, flag: str) -> DataFrame:
    """Length of the run of true flags that ends at the last date: dates after the last false one."""
    last_false = F.max(F.when(~F.col(flag), F.col(ts))).over(Window.partitionBy(*pixel))
    return obs.withColumn("_f", last_false).groupBy(*pixel).agg(F.count(F.when(F.col("_f").isNull() | (F.col(ts) > F.col("_f")), 1)).alias("run"))


def months_with_event(obs: DataFrame, pixel: Sequence[str], ts: str, event) -> DataFrame:
    return obs.groupBy(*pixel).agg(F.count_distinct(F.when(event, F.month(ts))).alias("n_months"))


def last_event_age(obs: DataFrame, pixel: Sequence[str], year: str, event, reference: int) -> DataFrame:
    """Years from the last event to a reference year; null without one."""
    return obs.groupBy(*pixel).agg((F.lit(reference) - F.max(F.when(event, F.col(year)))).alias("age"))


def monthly_median(obs: DataFrame, pixel: Sequence[str], ts: str, band: str, start: str, end: str) -> DataFrame:
    """One row per pixel and month of the window; null where the month has no observation."""
    months = f"explode(sequence(date'{start}', date'{end}', interval 1 month)) AS month"
    grid = obs.select(*pixel).distinct().selectExpr(*pixel, months)
    have = obs.groupBy(*pixel, F.trunc(ts, "month").alias("month")).agg(F.median(band).alias(f"{band}_median"))
    return grid.join(have, [*pixel, "month"], "left")


def seasonal_mean(monthly: DataFrame, pixel: Sequence[str], band: str, months: Sequence[int]) -> DataFrame:
    return monthly.groupBy(*pixel).agg(F.avg(F.when(F.month("month").isin(*months), F.col(band))).alias("season_mean"))


def class_stability(obs: DataFrame, pixel: Sequence[str], cls: str, probability: str) -> DataFrame:
    """Mean and spread of a probability, and the modal class (ties: the least)."""
    return obs.groupBy(*pixel).agg(F.avg(probability).alias("p_mean"), F.stddev_pop(probability).alias("p_std"), F.mode(cls, True).alias("modal_class"))


def steady_mean(column: str) -> Column:
    """Mean that is the same in every order of the rows, for comparisons with a threshold that means may meet.

    A value is a multiple of 2^-20, of which sums are exact to 2^33, and a rest, of which sums are good to some 2^-70.
    Twelve decimals are kept: decimal fractions aren't exact as doubles, and their mean may exceed its own by the last bit.
    """
    x = F.col(column).cast("double")
    high = F.when(F.abs(x) < 2.0**31, F.rint(x * 2.0**20) / 2.0**20).otherwise(x)
    rest = F.when(F.abs(x) < 2.0**31, x - high).otherwise(F.when(x.isNotNull(), 0.0))
    return F.round(F.try_divide(F.sum(high) + F.sum(rest), F.count(x)), 12)


def annual_share_above(obs: DataFrame, pixel: Sequence[str], year: str, probability: str, least: float) -> DataFrame:
    return obs.groupBy(*pixel, year).agg((steady_mean(probability) > least).alias("above"))


def merge_collections(*parts: DataFrame) -> DataFrame:
    """Union by name of several sensors' observations; absent bands are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _names(k: int) -> list[str]:
    return [f"_c{i}" for i in range(k)]


def least_squares(obs: DataFrame, keys: Sequence[str], y: str, terms: dict) -> DataFrame:
    """Coefficients of y on the terms per key, with n, and RMS residual; null where the system is singular.

    Sums of products are aggregated in one pass; the k by k system is then eliminated by column
    expressions, one projection per step, so the whole fit stays in the JVM.
    """
    k = len(terms)
    rows = obs.where(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(terms.values())))
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"b{i}") for i in range(k)]
    fit = rows.groupBy(*keys).agg(*sums, F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.count("*").alias("n"))
    first = {f"a{i}_{j}": F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)}
    fit = fit.withColumns(first | {f"r{i}": F.col(f"b{i}") for i in range(k)})
    for p in range(k):
        small = F.abs(F.col(f"a{p}_{p}")) <= F.lit(1e-10) * F.abs(F.col(f"s{p}_{p}"))
        fit = fit.withColumn(f"_p{p}", F.when(~small, F.col(f"a{p}_{p}")))
        factor = {i: F.col(f"a{i}_{p}") / F.col(f"_p{p}") for i in range(p + 1, k)}
        fit = fit.withColumns({f"_f{i}": f for i, f in factor.items()}) if factor else fit
        step = {f"a{i}_{j}": F.col(f"a{i}_{j}") - F.col(f"_f{i}") * F.col(f"a{p}_{j}") for i in factor for j in range(p + 1, k)}
        fit = fit.withColumns(step | {f"r{i}": F.col(f"r{i}") - F.col(f"_f{i}") * F.col(f"r{p}") for i in factor}) if factor else fit
    for p in range(k - 1, -1, -1):
        known = reduce(lambda a, b: a + b, [F.col(f"a{p}_{j}") * F.col(f"_c{j}") for j in range(p + 1, k)], F.lit(0.0))
        fit = fit.withColumn(f"_c{p}", (F.col(f"r{p}") - known) / F.col(f"_p{p}"))
    quad = reduce(lambda a, b: a + b, [F.col(f"_c{i}") * F.col(f"_c{j}") * F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    rss = F.col("_yy") - 2 * reduce(lambda a, b: a + b, [F.col(f"_c{i}") * F.col(f"b{i}") for i in range(k)]) + quad
    solved = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in _names(k)])
    return fit.select(*keys, *(F.when(solved, F.col(f"_c{i}")).alias(name) for i, name in enumerate(terms)), F.when(solved, F.greatest(rss, F.lit(0.0)) / F.col("n")).alias("residual_variance"), "n")


def harmonic(obs: DataFrame, pixel: Sequence[str], ts: str, band: str, dual: bool = False, trend: bool = True, reference: str = "2017-01-01", mean_over: tuple[float, float] | None = None) -> DataFrame:
    """Seasonal fit per pixel: mean, amplitude, phase, trend, residual variance, number of observations."""
    terms = B.harmonic_terms(B.years_since(ts, reference), dual, trend)
    fit = least_squares(obs, pixel, band, terms)
    weights = B.window_mean_weights(*mean_over, dual, trend) if mean_over else [1.0] + [0.0] * (len(terms) - 1)
    mean = reduce(lambda a, b: a + b, [F.lit(w) * F.col(n) for w, n in zip(weights, terms, strict=True) if w])
    out = {f"{band}_mean": mean}
    for name in ("annual", "semi")[: 1 + dual]:
        out |= {f"{band}_amplitude_{name}": B.amplitude(f"cos_{name}", f"sin_{name}"), f"{band}_phase_{name}": B.phase(f"cos_{name}", f"sin_{name}")}
    out |= ({f"{band}_trend": F.col("time")} if trend else {}) | {f"{band}_residual_variance": F.col("residual_variance"), f"{band}_obs_count": F.col("n")}
    return fit.select(*pixel, *(c.alias(n) for n, c in out.items()))


def embedding(obs: DataFrame, pixel: Sequence[str], bands: Sequence[str], year: str, first: int, last: int, how: str = "mean") -> DataFrame:
    """Bands of one year as they are, of several years their mean or median per pixel."""
    used = obs.where(F.col(year).between(first, last))
    return used.select(*pixel, *bands) if first == last else collapse_years(used, pixel, bands, how)


def whole_rows(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Rows that have a value, and not NaN, in every band."""
    return obs.dropna(subset=list(bands))
