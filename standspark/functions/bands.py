"""Column expressions over pixels and rows: indices, seasonal terms, codes, scalings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a year in fractional-year time.
DAYS_PER_YEAR = 365.2425


def ratio(top, bottom) -> Column:
    """Quotient; null where the divisor is 0."""
    return F.try_divide(top, bottom)


def normalised_difference(a: str, b: str) -> Column:
    """(a - b) / (a + b); NDVI with near infrared and red, NBR, NDMI, NDRE likewise."""
    return ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))


def nirv(nir: str, red: str, scale: float = 10000.0) -> Column:
    """Near-infrared reflectance of vegetation: scaled near infrared times NDVI."""
    return F.col(nir) / F.lit(scale) * normalised_difference(nir, red)


def years_since(ts: str, reference: str = "2017-01-01") -> Column:
    """Fractional years between a reference date and a timestamp."""
    start = F.unix_micros(F.to_timestamp(F.lit(reference)))
    return (F.unix_micros(F.col(ts).cast("timestamp")) - start) / F.lit(DAYS_PER_YEAR * 86400e6)


def harmonic_terms(t: Column, dual: bool = False, trend: bool = False) -> dict[str, Column]:
    """Regressors in order: constant, annual pair, semi-annual pair if dual, time if trend."""
    terms = {"constant": F.lit(1.0)}
    for name, cycles in (("annual", 1), ("semi", 2))[: 1 + dual]:
        w = t * F.lit(2 * math.pi * cycles)
        terms |= {f"cos_{name}": F.cos(w), f"sin_{name}": F.sin(w)}
    return terms | ({"time": t} if trend else {})


def window_mean_weights(t0: float, t1: float, dual: bool = False, trend: bool = False) -> list[float]:
    """Means of the regressors over [t0, t1]: weights of the coefficients for the curve's mean there."""
    span = t1 - t0
    if span <= 0:
        raise ValueError("the window is empty")
    weights = [1.0]
    for cycles in (1, 2)[: 1 + dual]:
        w = 2 * math.pi * cycles
        weights += [(math.sin(w * t1) - math.sin(w * t0)) / (w * span), (math.cos(w * t0) - math.cos(w * t1)) / (w * span)]
    return weights + ([(t0 + t1) / 2] if trend else [])


def amplitude(cos: str, sin: str) -> Column:
    return F.hypot(cos, sin)


def phase(cos: str, sin: str) -> Column:
    return F.atan2(sin, cos)


def cyclic(column: str, degrees: bool = False) -> tuple[Column, Column]:
    """Sine and cosine of an angle."""
    angle = F.radians(column) if degrees else F.col(column)
    return F.sin(angle), F.cos(angle)


def aspect_pair(aspect: str, slope: str) -> tuple[Column, Column]:
    """Sine and cosine of an aspect in degrees; (0, 0) on flat cells."""
    sin, cos = cyclic(aspect, degrees=True)
    flat = F.col(slope) == 0
    return F.when(flat, 0.0).otherwise(sin), F.when(flat, 0.0).otherwise(cos)


def remap(column: str, table: Mapping, default=None) -> Column:
    """Code of a class by a small table; ``default`` for others."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(default))


def first_of(*columns: str) -> Column:
    """Fallback chain: the first that isn't null."""
    return F.coalesce(*columns)


def class_flag(column: str, classes: Sequence) -> Column:
    """1 where the class is one of those named, 0 elsewhere and where it is null."""
    return F.coalesce(F.col(column).isin(list(classes)), F.lit(False)).cast("int")


def threshold_flag(column: str, least: float) -> Column:
    """1 where the value reaches the threshold, 0 elsewhere and where it is null."""
    return F.coalesce(F.col(column) >= least, F.lit(False)).cast("int")


def priority_class(latest: str, classes: Sequence[int], water: Column, water_code: int = 80) -> Column:
    """The latest class where it is one of those named, 0 elsewhere; water lies on top."""
    return F.when(F.coalesce(water, F.lit(False)), water_code).when(F.col(latest).isin(list(classes)), F.col(latest)).otherwise(0).cast("int")


def provenance_key(disagree: str, source: str, reason: str) -> Column:
    return 100 * F.col(disagree) + 10 * F.col(source) + F.col(reason)


def provenance_parts(key: str) -> dict[str, Column]:
    """Inverse of provenance_key."""
    k = F.col(key)
    return {"disagree": F.floor(k / 100).cast("int"), "source": F.pmod(F.floor(k / 10), F.lit(10)).cast("int"), "reason": F.pmod(k, F.lit(10)).cast("int")}


def merge_kind(fallback: str, relaxed: str, first_pass: str) -> Column:
    """The weakest merge that made a stand: 3 fallback, 2 relaxed, 1 first pass, 0 none."""
    return F.when(F.col(fallback) > 0, 3).when(F.col(relaxed) > 0, 2).when(F.col(first_pass) > 0, 1).otherwise(0)


def utm_epsg(lon: str, lat: str) -> Column:
    """EPSG code of the UTM zone; null outside 80 S to 84 N and 180 W to 180 E."""
    zone = F.least(F.floor((F.col(lon) + 180) / 6) + 1, F.lit(60)).cast("int")
    code = F.when(F.col(lat) >= 0, 32600 + zone).otherwise(32700 + zone)
    return F.when(F.col(lat).between(-80, 84) & F.col(lon).between(-180, 180), code)


def row_col(x: str, y: str, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """Row and column of a point on a grid whose upper left corner is (x0, y0)."""
    return F.floor((F.lit(y0) - F.col(y)) / size).cast("int"), F.floor((F.col(x) - F.lit(x0)) / size).cast("int")


def pixel_area(lat: str, dlat: float, dlon: float, radius: float = 6371007.2) -> Column:
    """Area in square metres of a cell centred at a latitude, on the sphere of equal area."""
    upper, lower = F.radians(F.col(lat) + dlat / 2), F.radians(F.col(lat) - dlat / 2)
    return F.lit(radius**2 * math.radians(dlon)) * F.abs(F.sin(upper) - F.sin(lower))


def pixel_area_ellipsoid(lat: str, dlat: float, dlon: float, major: float = 6378137.0, flattening: float = 1 / 298.257223563) -> Column:
    """The same on the WGS84 ellipsoid: the zone between two latitudes, in closed form."""
    e2 = flattening * (2 - flattening)
    e, minor2 = math.sqrt(e2), major**2 * (1 - e2)

    def zone(degrees: Column) -> Column:
        s = F.sin(F.radians(degrees))
        return s / (1 - e2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return F.lit(minor2 / 2 * math.radians(dlon)) * F.abs(zone(F.col(lat) + dlat / 2) - zone(F.col(lat) - dlat / 2))


def rigid_move(x: str, y: str, cx: Column, cy: Column, angle: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point turned about (cx, cy) and then shifted."""
    u, v = F.col(x) - cx, F.col(y) - cy
    return cx + u * F.cos(angle) - v * F.sin(angle) + dx, cy + u * F.sin(angle) + v * F.cos(angle) + dy


def oriented(row: str, col: str, height: int, width: int, orientation: str) -> tuple[Column, Column]:
    """Row and column after identity, rot180, flip_rows or flip_cols."""
    r, c = F.col(row), F.col(col)
    flip_r, flip_c = F.lit(height - 1) - r, F.lit(width - 1) - c
    return {"identity": (r, c), "rot180": (flip_r, flip_c), "flip_rows": (flip_r, c), "flip_cols": (r, flip_c)}[orientation]


def condensed_index(i: str, j: str, n: int) -> Column:
    """Place of the pair i < j in an upper triangle stored row by row."""
    lo, hi = F.least(i, j).cast("long"), F.greatest(i, j).cast("long")
    return n * lo - F.expr(f"CAST(least({i}, {j}) AS BIGINT) * (CAST(least({i}, {j}) AS BIGINT) + 1) DIV 2") + hi - lo - 1


def claim_code(stand_a: Column, stand_b: Column, type_a: Column, type_b: Column, super_a: Column | None = None, super_b: Column | None = None) -> Column:
    """Claim of two groupings about a pair: -1 none, 0 same stand, 1 same type, 2 different type, 3 type unknown.

    Types are numbered anew in each super-group, so across super-groups (or without one) they can't be compared.
    """
    apart = F.lit(False) if super_a is None else ~F.coalesce(super_a == super_b, F.lit(False))
    return (
        F.when(stand_a.isNull() | stand_b.isNull(), -1)
        .when(stand_a == stand_b, 0)
        .when(type_a.isNull() | type_b.isNull() | apart, 3)
        .when(type_a == type_b, 1)
        .otherwise(2)
    )


def stand_dissimilarity(claim: str) -> Column:
    """0 within one stand, 1 between stands, null without a claim."""
    return F.when(F.col(claim) == 0, 0.0).when(F.col(claim) > 0, 1.0)


def type_dissimilarity(claim: str) -> Column:
    """0 for one type (or one stand), 1 for different types, null where unknown."""
    return F.when(F.col(claim).isin(0, 1), 0.0).when(F.col(claim) == 2, 1.0)


def band_index(value: str, edges: Sequence[float]) -> Column:
    """Number of the half-open band [edge, next) that holds a value; -1 outside or null."""
    out = F.when(F.col(value).isNull() | (F.col(value) < edges[0]), -1)
    for i, upper in enumerate(edges[1:]):
        out = out.when(F.col(value) < upper, i)
    return out.otherwise(-1)


def bin_right_closed(value: str, edges: Sequence[float]) -> Column:
    """Number of the bin (edge, next] that holds a value; null outside."""
    out = F.when(F.col(value) <= edges[0], None)
    for i, upper in enumerate(edges[1:]):
        out = out.when(F.col(value) <= upper, i)
    return out


def equality_tolerance(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def fold_name(column: str) -> Column:
    """Genus and species of a scientific name: spaces and case folded, the first two words."""
    words = F.split(F.lower(F.trim(F.regexp_replace(column, r"[\s_]+", " "))), " ")
    return F.array_join(F.slice(words, 1, 2), " ")


def crown_midpoint(column: str) -> Column:
    """Midpoint of a cover band such as "6-10"; bands that were read as dates (2023-11-15) count as 11-15."""
    text = F.regexp_replace(F.trim(F.col(column)), r"^\d{4}-(\d{1,2})-(\d{1,2})( .*)?$", "$1-$2")
    lo, hi = (F.regexp_extract(text, r"^(\d+)\s*-\s*(\d+)$", g) for g in (1, 2))
    return F.when(lo != "", (lo.try_cast("double") + hi.try_cast("double")) / 2).otherwise(text.try_cast("double"))


def plot_key(lat: str, lon: str, digits: int = 6) -> Column:
    return F.concat_ws("_", *(F.format_string(f"%.{digits}f", F.round(c, digits)) for c in (lat, lon)))


def basal_area(dbh: str) -> Column:
    """Area of the cross-section of a trunk of this diameter."""
    return F.lit(math.pi) * F.pow(F.col(dbh) / 2, F.lit(2.0))


def id_text(column: str) -> Column:
    """One text for 17, 17.0 and "17"; null for NaN and for what isn't a whole number within 1e-6."""
    value = F.col(column).cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value - F.round(value)) < 1e-6), F.round(value).cast("long").cast("string"))
