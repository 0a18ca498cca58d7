"""Checks of inputs as aggregates: each raises with what is wrong, and gives the table back otherwise.

Each is one pass that returns a row of counts, whatever the size of the table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotEstimable(ValueError):
    """A null model can't be drawn: too few draws are admissible."""


def _refuse(found: dict[str, int]) -> None:
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(", ".join(f"{v} rows: {k}" for k, v in bad.items()))


def code_faults(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, and those that aren't whole numbers of at least -1."""
    wrong = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("double") != F.floor(F.col(c).cast("double"))) | (F.col(c) < -1))
    counts = frame.agg(F.count("*").alias("n"), *(wrong(c).alias(c) for c in columns))
    return counts.select("n", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "n_wrong"))


def codes(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integer codes, -1 for missing."""
    _refuse({f"{r['column']} is not a code": r["n_wrong"] for r in code_faults(frame, columns).collect()})
    return frame


def coordinates(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Both coordinates there and finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    _refuse({"no finite place": frame.agg(F.count_if(bad(x) | bad(y)).alias("n")).first()["n"]})
    return frame


def finite(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """No infinite value; null and NaN are missing."""
    row = frame.agg(*(F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in columns)).first()
    _refuse({f"{c} is infinite": row[c] for c in columns})
    return frame


def equal_lengths(tables: dict[str, DataFrame]) -> int:
    """The number of rows that all tables have."""
    sizes = {k: t.count() for k, t in tables.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"different numbers of rows: {sizes}")
    return next(iter(sizes.values()), 0)


def band_edges(edges: Sequence[float]) -> list[float]:
    """Ascending edges from 0 or above; only the last may be infinite."""
    out = [float(e) for e in edges]
    if len(out) < 2 or any(math.isnan(e) for e in out) or out[0] < 0 or any(a >= b for a, b in zip(out, out[1:])) or any(math.isinf(e) for e in out[:-1]):
        raise ValueError(f"edges {edges} must ascend from 0 or above")
    return out


def band_name(name: str) -> str:
    """Letters, digits and underlines, not beginning with a digit."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} can't name a band")
    return name


def distances(pairs: DataFrame, a: str, b: str, distance: str, strata: str | None = None) -> DataFrame:
    """Symmetric distances without negative ones, zero from a row to itself; with strata, none missing within one."""
    d = F.col(distance)
    twice = pairs.groupBy(F.least(a, b), F.greatest(a, b)).agg((F.max(d) - F.min(d)).alias("gap")).agg(F.count_if(F.col("gap") > 0).alias("n")).first()["n"]
    missing = d.isNull() | F.isnan(d)
    row = pairs.agg(F.count_if(d < 0).alias("negative"), F.count_if((F.col(a) == F.col(b)) & (d != 0)).alias("own"), F.count_if(missing & F.col(strata).isNotNull() if strata else F.lit(False)).alias("missing")).first()
    _refuse({"negative": row["negative"], "not 0 to itself": row["own"], "not symmetric": twice, "no distance within a stratum": row["missing"]})
    return pairs


def draws(frame: DataFrame, key: str, plots: DataFrame) -> DataFrame:
    """Every draw has each plot once."""
    n = plots.select(key).distinct().count()
    each = frame.groupBy("draw").agg(F.count("*").alias("n"), F.count_distinct(key).alias("k"))
    _refuse({"draws without each plot once": each.where((F.col("n") != n) | (F.col("k") != n)).count()})
    return frame


def unique_ids(frame: DataFrame, group: str, local: str, name: str) -> DataFrame:
    """Ids that are unique over all groups, from ids that restart in each."""
    from .ranking import dense_ids

    return dense_ids(frame, [group, local], name)


def enough_draws(accepted: int, wanted: int, tried: int, most_tries: int) -> int:
    """Raises where rejection has used up its tries."""
    if accepted < wanted and tried >= most_tries:
        raise NotEstimable(f"{accepted} of {wanted} draws after {tried} tries")
    return accepted


def kept_land(land: DataFrame, what: str = "kept land") -> DataFrame:
    """Raises in plain words where nothing is left to work on."""
    if land.limit(1).count() == 0:
        raise ValueError(f"there is no {what}: check the mask and the least patch size")
    return land


def metadata(rows: list[dict], needed: Sequence[str]) -> dict[str, list]:
    """Fields of metadata rows by name; raises where one lacks a field."""
    if not rows:
        raise ValueError("no metadata")
    for r in rows:
        if lacking := [k for k in needed if r.get(k) is None]:
            raise ValueError(f"metadata lacks {', '.join(lacking)}")
    return {k: [r[k] for r in rows] for k in needed}


def warnings_of(diagnostics: dict, coverage: dict | None = None) -> list[str]:
    """What a reader should know of a merge, as sentences."""
    out = []
    if n := diagnostics.get("stands_below_min"):
        out.append(f"{n} stands are below the least area ({diagnostics.get('orphans_isolated', 0)} without a neighbour, {diagnostics.get('orphans_area_blocked', 0)} with neighbours too large).")
    if n := diagnostics.get("stands_incomplete"):
        out.append(f"{n} stands lack a criterion for most of their area.")
    if (n := diagnostics.get("orphans_iteration_cap")) and n > 0:
        out.append(f"{n} stands were left when the sweeps ended.")
    for key, words in (("kept_without_label_ha", "ha of kept land have no unit"), ("label_off_kept_ha", "ha of units lie off kept land")):
        if coverage and coverage.get(key):
            out.append(f"{coverage[key]:g} {words}.")
    return out


def split_warning(counts: dict) -> str | None:
    """A sentence where stands lie in several pieces."""
    return f"{counts['n_polygons']} polygons for {counts['n_stands']} stands: {counts['n_split']} lie in up to {counts['max_pieces']} pieces." if counts.get("n_split") else None


def pages(frame: DataFrame, size: int = 2500) -> Iterator[list]:
    """Rows in pages, a partition of the table at a time on the driver."""
    page = []
    for row in frame.toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page
