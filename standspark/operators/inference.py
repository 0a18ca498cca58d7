"""Pair statistics and permutation tests over plots.

Pairs are formed within a group or for a stated set of plots; tests take a long table of draws
(draw, plot, unit, type), so that all draws are one grouped computation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import bands as B
from .ranking import average_ranks, numbered, running

#: Plots of a tile of Bray-Curtis distances, and distances made at once.
TILE, ROWS = 4096, 1 << 16


def plot_pairs(plots: DataFrame, key: str, columns: Sequence[str], by: Sequence[str] = (), shares: int = 1) -> DataFrame:
    """Pairs (key_a < key_b) of one group (by), each column with suffix _a and _b.

    With ``shares``, the first plots of a group are dealt over so many tasks, each of which gets the group's second ones.
    """
    side = lambda s: plots.select(*by, F.col(key).alias(f"{key}_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    a, b = side("a"), side("b")
    less = F.col(f"{key}_a") < F.col(f"{key}_b")
    if by and shares > 1:
        a = a.withColumn("_share", F.pmod(F.xxhash64(f"{key}_a"), F.lit(shares)).cast("int"))
        b = b.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        tasks = 4 * shares  # stated, so that small rows with many pairs aren't put together
        a, b = (t.repartition(tasks, *by, "_share") for t in (a, b))
        return a.join(b, [*by, "_share"]).where(less).drop("_share")
    if by:
        return a.join(b, list(by)).where(less)
    return a.join(b, less)


def planar_distance(x: str, y: str) -> Column:
    return F.hypot(F.col(f"{x}_a") - F.col(f"{x}_b"), F.col(f"{y}_a") - F.col(f"{y}_b"))


def great_circle(lat: str, lon: str, radius: float = 6371008.8) -> Column:
    """Haversine distance in metres."""
    la, lb = F.radians(f"{lat}_a"), F.radians(f"{lat}_b")
    h = F.pow(F.sin((lb - la) / 2), F.lit(2.0)) + F.cos(la) * F.cos(lb) * F.pow(F.sin((F.radians(f"{lon}_b") - F.radians(f"{lon}_a")) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def field_distance(columns: Sequence[str]) -> Column:
    """Euclidean distance over columns; null where either row lacks one."""
    return F.sqrt(sum((F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), F.lit(2.0)) for c in columns), F.lit(0.0)))


def with_claims(pairs: DataFrame, unit: str, type_: str, super_group: str | None = None) -> DataFrame:
    """Pairs with their claim code; ``super_group`` is a column of both (with suffixes) or one that they share."""
    of = [super_group] * 2 if super_group in pairs.columns else [f"{super_group}_{s}" for s in "ab"]
    return pairs.withColumn("claim", B.claim_code(*(F.col(f"{c}_{s}") for c in (unit, type_) for s in "ab"), *(map(F.col, of) if super_group else ())))


def pair_contrast(pairs: DataFrame, value: str, upper: Column, strata: Sequence[str]) -> dict[str, DataFrame]:
    """Mean difference of a distance between upper and lower pairs, per stratum and pooled.

    A stratum weighs n_lo * n_hi / (n_lo + n_hi); one without either side has no effect.
    """
    used = pairs.where(F.col(value).isNotNull() & upper.isNotNull()).withColumn("_u", upper.cast("int"))
    each = used.groupBy(*strata).agg(F.sum("_u").alias("n_hi"), F.sum(1 - F.col("_u")).alias("n_lo"), F.avg(F.when(F.col("_u") == 1, F.col(value))).alias("mean_hi"), F.avg(F.when(F.col("_u") == 0, F.col(value))).alias("mean_lo"))
    each = each.withColumn("effect", F.col("mean_hi") - F.col("mean_lo")).withColumn("weight", F.try_divide(F.col("n_lo") * F.col("n_hi"), F.col("n_lo") + F.col("n_hi")))
    pool = lambda by: each.where("effect IS NOT NULL").groupBy(*by).agg(F.try_divide(F.sum(F.col("weight") * F.col("effect")), F.sum("weight")).alias("effect"), F.sum("n_lo").alias("n_lo"), F.sum("n_hi").alias("n_hi"), F.count("*").alias("n_strata"))
    crude = used.agg((F.avg(F.when(F.col("_u") == 1, F.col(value))) - F.avg(F.when(F.col("_u") == 0, F.col(value)))).alias("effect"))
    return {"strata": each, "pooled": pool([]), "crude": crude} | {f"by_{c}": pool([c]) for c in strata}


def mantel(pairs: DataFrame, x: str, y: str, by: Sequence[str] = (), ranks: bool = False) -> DataFrame:
    """Correlation of two distances over complete pairs; null under three pairs or without variation."""
    used = pairs.dropna(subset=[x, y])
    if ranks:
        for c in (x, y):
            used = average_ranks(used, c, "_rank", by).drop(c).withColumnRenamed("_rank", c)
    ok = (F.count("*") >= 3) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return used.groupBy(*by).agg(F.when(ok, F.greatest(F.least(F.corr(x, y), F.lit(1.0)), F.lit(-1.0))).alias("r"), F.count("*").alias("n_pairs"))


def partial_mantel(pairs: DataFrame, x: str, y: str, z: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y with z held fixed; null where z explains either wholly."""
    used = pairs.dropna(subset=[x, y, z])
    r = used.groupBy(*by).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"), F.count("*").alias("n_pairs"))
    left = (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)
    value = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left)
    return r.select(*by, F.when((left > 1e-12) & (F.col("n_pairs") >= 3), F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))).alias("r"), "n_pairs")


def anosim(pairs: DataFrame, distance: str, same: Column, strata: Sequence[str] = ()) -> DataFrame:
    """(mean rank between - mean rank within) / (pairs / 2) per stratum; null without either kind of pair."""
    ranked = average_ranks(pairs.where(F.col(distance).isNotNull() & same.isNotNull()).withColumn("_s", same).select(*strata, distance, "_s"), distance, "_r", strata)
    out = ranked.groupBy(*strata).agg(F.avg(F.when(~F.col("_s"), F.col("_r"))).alias("between"), F.avg(F.when(F.col("_s"), F.col("_r"))).alias("within"), F.count("*").alias("n_pairs"))
    return out.select(*strata, "within", "between", "n_pairs", ((F.col("between") - F.col("within")) / (F.col("n_pairs") / 2)).alias("r"))


def pooled_anosim(pairs: DataFrame, distance: str, same: Column, strata: Sequence[str], equal: bool = False) -> DataFrame:
    """R over strata that have both kinds of pair, weighted by n_within * n_between / n_pairs, or equally."""
    ranked = average_ranks(pairs.where(F.col(distance).isNotNull() & same.isNotNull()).withColumn("_s", same).select(*strata, distance, "_s"), distance, "_r", strata)
    each = ranked.groupBy(*strata).agg(F.avg(F.when(~F.col("_s"), F.col("_r"))).alias("b"), F.avg(F.when(F.col("_s"), F.col("_r"))).alias("w"), F.count_if("_s").alias("nw"), F.count("*").alias("n")).where("nw > 0 AND nw < n")
    r, weight = (F.col("b") - F.col("w")) / (F.col("n") / 2), F.lit(1.0) if equal else F.col("nw") * (F.col("n") - F.col("nw")) / F.col("n")
    return each.agg(F.try_divide(F.sum(weight * r), F.sum(weight)).alias("r"), F.count("*").alias("n_strata"))


def nested_permanova(plots: DataFrame, pairs: DataFrame, key: str, distance: str, group: str, stratum: str) -> DataFrame:
    """Pseudo-F and R2 of groups nested in strata: a difference between strata is never one between groups.

    ``pairs`` are those within a stratum, with (key_a, key_b, group_a, group_b, stratum, distance).
    """
    used = plots.where(F.col(group).isNotNull() & F.col(stratum).isNotNull())
    d2 = F.col(distance) * F.col(distance)
    inside = pairs.where(F.col(f"{group}_a").isNotNull() & F.col(f"{group}_b").isNotNull())
    n_s, n_c = used.groupBy(stratum).agg(F.count("*").alias("n")), used.groupBy(stratum, F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    total = n_s.join(inside.groupBy(stratum).agg(F.sum(d2).alias("s")), stratum, "left").agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("sst"), F.sum("n").alias("n"), F.count("*").alias("k"))
    cell = inside.where(F.col(f"{group}_a") == F.col(f"{group}_b")).groupBy(stratum, F.col(f"{group}_a").alias("_g")).agg(F.sum(d2).alias("s"))
    within = n_c.join(cell, [stratum, "_g"], "left").agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ssw"), F.count("*").alias("a"))
    t = total.crossJoin(within)  # one row each
    ssa, df_a, df_w = F.col("sst") - F.col("ssw"), F.col("a") - F.col("k"), F.col("n") - F.col("a")
    f = F.when((df_a > 0) & (df_w > 0), F.try_divide(ssa / df_a, F.col("ssw") / df_w))
    return t.select(f.alias("pseudo_f"), F.try_divide(ssa, F.col("sst")).alias("r2"), df_a.alias("df_among"), df_w.alias("df_within"))


def permanova(pairs: DataFrame, distance: str, group: str) -> DataFrame:
    """Pseudo-F and R2 from squared distances of all pairs of plots (group_a, group_b)."""
    d2 = F.col(distance) * F.col(distance)
    a, b = F.col(f"{group}_a"), F.col(f"{group}_b")
    # A group of n has n (n - 1) / 2 pairs within it, which gives n; all pairs give the number of plots.
    inner = pairs.where(a == b).groupBy(a.alias("g")).agg(F.sum(d2).alias("s"), F.count("*").alias("m"))
    size = lambda m: (1 + F.sqrt(1 + 8 * m)) / 2
    within = inner.agg(F.sum(F.col("s") / size(F.col("m"))).alias("ssw"))
    total = pairs.agg(F.sum(d2).alias("s"), F.count("*").alias("m")).select((F.col("s") / size(F.col("m"))).alias("sst"), size(F.col("m")).alias("n"))
    names = pairs.select(a.alias("g")).union(pairs.select(b.alias("g"))).distinct().agg(F.count("*").alias("k"))
    t = total.crossJoin(names).crossJoin(within)
    ssw = F.coalesce("ssw", F.lit(0.0))
    return t.select(F.try_divide((F.col("sst") - ssw) / (F.col("k") - 1), F.try_divide(ssw, F.col("n") - F.col("k"))).alias("pseudo_f"), (1 - F.try_divide(ssw, F.col("sst"))).alias("r2"))


def permanova_fields(plots: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """permanova() for Euclidean distances over columns, without pairs: half the mean squared distance within a set of
    plots is its variance, so sums of squares come from means.  Plots that lack a column or the group are left out."""
    used = plots.dropna(subset=[group, *columns]).select(F.col(group).alias("_g"), *columns)
    squares = lambda: sum((F.var_pop(c) for c in columns), F.lit(0.0)) * F.count("*")
    cells = used.groupBy("_g").agg(squares().alias("s")).agg(F.sum("s").alias("ssw"), F.count("*").alias("k"))
    t = used.agg(squares().alias("sst"), F.count("*").alias("n")).crossJoin(cells)  # one row each
    return t.select(F.try_divide((F.col("sst") - F.col("ssw")) / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).alias("pseudo_f"), (1 - F.try_divide("ssw", "sst")).alias("r2"))


def bray_curtis(amounts: DataFrame, plot: str, species: str, amount: str) -> DataFrame:
    """(plot_a < plot_b, distance): sum |a - b| / sum (a + b) of all pairs; amounts have one row per plot and species.

    sum |a - b| = sum a + sum b - 2 sum min(a, b), and only shared species have a minimum over 0; a pair that
    shares none has distance 1, one without amounts NaN.  Plots in their order are cut into tiles, each pair of
    tiles is one task's, and its distances leave as they are made: what moves is each plot once for every tile.
    """
    each = amounts.where(F.col(plot).isNotNull()).groupBy(F.col(plot).alias("plot")).agg(F.sum(amount).cast("double").alias("t"), F.collect_list(F.when(F.col(species).isNotNull(), F.struct(F.col(species).alias("s"), F.col(amount).cast("double").alias("q")))).alias("have"))
    placed = numbered(each, [F.col("plot")], "_at", 0)
    n = placed.count()
    size = max(min(-(-n // 12), TILE), 1)
    tiles = -(-n // size)
    own = placed.select("plot", "t", "_at", F.transform("have", lambda h: h["s"]).alias("s"), F.transform("have", lambda h: h["q"]).alias("q"), F.expr(f"CAST(_at DIV {size} AS INT)").alias("_t"))
    first = own.select("*", F.explode(F.sequence("_t", F.lit(max(tiles - 1, 0)))).alias("j")).select(F.col("_t").alias("i"), "j", F.lit(0).alias("side"), "_at", "plot", "t", "s", "q")
    last = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("i")).select("i", F.col("_t").alias("j"), F.lit(1).alias("side"), "_at", "plot", "t", "s", "q")
    kind = placed.schema["plot"].dataType
    out = T.StructType([T.StructField("plot_a", kind), T.StructField("plot_b", kind), T.StructField("distance", T.DoubleType())])
    names = to_arrow_schema(out).names

    def run(batches):
        now, held = None, []
        for batch in batches:
            ends = np.flatnonzero(np.diff(batch["i"].to_numpy() * tiles + batch["j"].to_numpy())) + 1
            for start, stop in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if held and (part["i"][0].as_py(), part["j"][0].as_py()) != now:
                    yield from _tile_pairs(pa.Table.from_batches(held), names)
                    held = []
                now = part["i"][0].as_py(), part["j"][0].as_py()
                held.append(part)
        if held:
            yield from _tile_pairs(pa.Table.from_batches(held), names)

    # A stated number of partitions: few bytes go in and many pairs come out.
    met = first.unionByName(last).repartition(max(tiles * (tiles + 1) // 2, 1), "i", "j").sortWithinPartitions("i", "j", "side", "_at")
    return met.mapInArrow(run, out)


def _minima(ia, u, ub, ib, v, vb, out):
    """Add min(a, b) where both have a row: amounts u, v at places ia, ib; ub and vb tell missing amounts, which yield to the other."""
    m = np.fmin(u[:, None], v[None, :])  # NaN is the greatest, as in SQL
    if ub.any() or vb.any():
        m = np.where(ub[:, None], np.where(vb[None, :], 0.0, v[None, :]), np.where(vb[None, :], u[:, None], m))
    out[np.ix_(ia, ib)] += m


def _tile_pairs(table, names):
    """Batches (plot_a, plot_b, distance) of two tiles, or of one that meets itself."""
    sides = [table.filter(pc.equal(table["side"], s)).combine_chunks() for s in (0, 1)]
    (a, b), same = sides, table["i"][0].as_py() == table["j"][0].as_py()
    n, m = len(a), len(b)
    flat = []
    for t in sides:
        s = t["s"].combine_chunks() if t["s"].num_chunks != 1 else t["s"].chunk(0)
        q = t["q"].combine_chunks() if t["q"].num_chunks != 1 else t["q"].chunk(0)
        flat.append((s.flatten(), q.flatten(), pc.list_parent_indices(s).to_numpy()))
    codes = pa.concat_arrays([f[0] for f in flat]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    lists = []
    for (_, q, at), code in zip(flat, (codes[: len(flat[0][0])], codes[len(flat[0][0]) :]), strict=True):
        none, q = q.is_null().to_numpy(zero_copy_only=False), q.fill_null(0.0).to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        lists.append({int(code[o[0]]): (at[o], q[o], none[o]) for o in np.split(order, cuts) if len(o)})
    shared = []
    for c in lists[0].keys() & lists[1].keys():
        (ia, u, ub), (ib, v, vb) = lists[0][c], lists[1][c]
        full = None
        if not ub.any() and not vb.any() and (u >= 0).all() and (v >= 0).all() and 2 * len(ia) > n and 2 * len(ib) > m:
            full = np.zeros(n), np.zeros(m)  # a species that is absent has minimum 0
            full[0][ia], full[1][ib] = u, v
        shared.append((ia, u, ub, ib, v, vb, full))
    ta, tb = (t["t"].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for t in sides)
    na, nb = (t["t"].is_null().combine_chunks().to_numpy(zero_copy_only=False) for t in sides)
    pa_, pb_ = (t["plot"].combine_chunks() for t in sides)
    step = max(1, ROWS // max(m, 1))
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        c, room = np.zeros((hi - lo, m)), np.empty((hi - lo, m))
        for ia, u, ub, ib, v, vb, full in shared:
            if full:
                np.minimum(full[0][lo:hi, None], full[1][None, :], out=room)
                c += room
            else:
                x, y = np.searchsorted(ia, (lo, hi))
                _minima(ia[x:y] - lo, u[x:y], ub[x:y], ib, v, vb, c)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - 2 * c / (ta[lo:hi, None] + tb[None, :])
        i, j = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(m)[None, :]) if same else (np.repeat(np.arange(hi - lo), m), np.tile(np.arange(m), hi - lo))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa_.take(pa.array(i + lo)), pb_.take(pa.array(j)), pa.array(d[i, j] if same else d.ravel(), mask=(na[i + lo] | nb[j]) if na.any() or nb.any() else None)], names)


def null_draws(plots: DataFrame, key: str, columns: Sequence[str], n: int, seed: int, within: str | None = None) -> DataFrame:
    """(draw, plot, columns): in each draw the columns are dealt anew among the plots, or those of one group.

    Receiver and giver are matched by place: plots in order of key, labels in order of a hash of
    (seed, draw, key), so that a draw is the same on every run.
    """
    by = [within] if within else []
    spark = plots.sparkSession
    many = plots.crossJoin(spark.range(n).select(F.col("id").alias("draw")))  # n draws of a stated plot set
    shuffled = F.row_number().over(Window.partitionBy("draw", *by).orderBy(F.xxhash64(F.lit(seed), "draw", key), key))
    straight = F.row_number().over(Window.partitionBy("draw", *by).orderBy(key))
    return many.select("draw", *by, key, straight.alias("_p")).join(many.select("draw", *by, *columns, shuffled.alias("_p")), ["draw", *by, "_p"]).drop("_p")


def torus_draws(plots: DataFrame, row: str, col: str, height: int, width: int, shifts: DataFrame) -> DataFrame:
    """(draw, plot columns): rows and columns after each cyclic shift (draw, dr, dc)."""
    moved = plots.crossJoin(shifts)  # a stated set of plots and shifts
    return moved.withColumn(row, F.pmod(F.col(row) - F.col("dr"), F.lit(height))).withColumn(col, F.pmod(F.col(col) - F.col("dc"), F.lit(width))).drop("dr", "dc")


def exhaustive_torus(grid: DataFrame, other: DataFrame, height: int, width: int, statistic: Column) -> DataFrame:
    """How often, over all shifts of ``other`` (row, col, b) against ``grid`` (row, col, a), the statistic is greater, less, equal to that unshifted."""
    spark = grid.sparkSession
    shifts = spark.range(height * width).select(F.col("id").alias("shift"), F.floor(F.col("id") / width).cast("int").alias("dr"), (F.col("id") % width).cast("int").alias("dc"))
    met = torus_draws(other, "row", "col", height, width, shifts).join(grid, ["row", "col"])
    each = met.groupBy("shift").agg(statistic.alias("s"))
    seen = each.where("shift = 0").select(F.col("s").alias("observed"))
    near = 1e-12 + 1e-9 * F.abs("observed")
    return each.where("shift > 0").crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), F.sum((F.col("s") > F.col("observed") + near).cast("long")).alias("n_greater"), F.sum((F.col("s") < F.col("observed") - near).cast("long")).alias("n_less"), F.sum((F.abs(F.col("s") - F.col("observed")) <= near).cast("long")).alias("n_equal"))


def accepted(draws: DataFrame, on_unit: Column) -> DataFrame:
    """Draws in which every plot stays on a unit."""
    return draws.groupBy("draw").agg(F.bool_and(on_unit).alias("ok")).where("ok").select("draw")


def permutation_p(null: DataFrame, observed: str, value: str, by: Sequence[str] = (), alternative: str = "greater") -> DataFrame:
    """(1 + number at least as extreme) / (1 + n), the observed value counted; null without a valid draw."""
    tol = 1e-12 + 1e-9 * F.abs(observed)
    hit = {"greater": F.col(value) >= F.col(observed) - tol, "less": F.col(value) <= F.col(observed) + tol, "two-sided": F.abs(value) >= F.abs(observed) - tol}[alternative]
    ok = null.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*by, observed).agg(((1 + F.sum(hit.cast("long"))) / (1 + F.count("*"))).alias("p"), F.count("*").alias("n_valid"), F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.percentile(F.col(value), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q")).select(*by, observed, "p", "n_valid", "null_mean", "null_sd", *(F.col("_q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


def run_tests(observed: DataFrame, null: DataFrame, n_draws: int, least_valid: float = 0.9, alternative: str = "greater") -> DataFrame:
    """One row per statistic; p is null where too few draws gave a value.  observed: (statistic, observed); null: (statistic, draw, value)."""
    t = permutation_p(null.join(observed, "statistic"), "observed", "value", ["statistic"], alternative)
    return t.withColumn("p", F.when(F.col("n_valid") >= least_valid * n_draws, F.col("p")))


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p values; a missing one stays missing and isn't counted."""
    real = numbered(tests.where(F.col(p).isNotNull() & ~F.isnan(p)).select(key, p), [F.col(p), F.col(key)], "_k")
    step = real.crossJoin(F.broadcast(real.agg(F.count("*").alias("_m")))).withColumn("_s", F.col(p) * (F.col("_m") - F.col("_k") + 1))  # one row
    run = running(step.select(key, "_k", "_s"), [F.col("_k")], "_s", "_top", "max")
    return tests.join(run.select(key, F.least("_top", F.lit(1.0)).alias("p_holm")), key, "left")


def null_percentile(null: DataFrame, observed: str, value: str, least: int = 100) -> DataFrame:
    """Mid-rank percentile of the observed value among the null ones; null with too few."""
    below, equal = F.sum((F.col(value) < F.col(observed)).cast("long")), F.sum((F.col(value) == F.col(observed)).cast("long"))
    return null.where(F.col(value).isNotNull()).groupBy(observed).agg(F.when(F.count("*") >= least, 100 * (below + 0.5 * equal) / F.count("*")).alias("percentile"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the score interval of a proportion."""
    p = F.try_divide(hits, n)
    mid, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - width) / (1 + z * z / n), (mid + width) / (1 + z * z / n)


def bootstrap_groups(groups: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(rep, slot, group): groups drawn with replacement, as many as there are; slots tell copies apart."""
    numbered = groups.select(key).distinct().select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("_i"))
    k = F.count("*").over(Window.partitionBy())
    slots = numbered.select(F.col("_i").alias("slot"), k.alias("k")).crossJoin(groups.sparkSession.range(n).select(F.col("id").alias("rep")))
    drawn = slots.select("rep", "slot", F.pmod(F.xxhash64(F.lit(seed), "rep", "slot"), F.col("k")).alias("_i"))
    return drawn.join(numbered, "_i").select("rep", "slot", key)


def jackknife(sums: DataFrame, top: str, bottom: str) -> DataFrame:
    """Leave-one-out ratio of sums for each group, from totals alone."""
    whole = sums.agg(F.sum(top).alias("_top"), F.sum(bottom).alias("_bottom"))
    return sums.crossJoin(F.broadcast(whole)).withColumn("without", F.try_divide(F.col("_top") - F.col(top), F.col("_bottom") - F.col(bottom))).drop("_top", "_bottom")  # one row


def rank_test(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """Mann-Whitney U of the true group, with the tie-corrected normal score.

    Ranks come from one row per distinct value, so equal values cost one row.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(group.cast("long")).alias("a"), F.count("*").alias("c"))
    r = running(n, [F.col(value)], "c", "_upto").withColumn("mid", F.col("_upto") - (F.col("c") - 1) / 2)
    t = r.agg(F.sum(F.col("a") * F.col("mid")).alias("ra"), F.sum("a").alias("na"), F.sum("c").alias("n"), F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"))
    na, nb = F.col("na"), F.col("n") - F.col("na")
    u = F.col("ra") - na * (na + 1) / 2
    var = na * nb / 12.0 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    return t.select(u.alias("u"), F.try_divide(u - na * nb / 2.0, F.sqrt(var)).alias("z"))


def pair_regression(pairs: DataFrame, y: str, terms: dict[str, Column], site: str) -> DataFrame:
    """Least squares of a distance on terms with an intercept per site, by centring within sites first."""
    from .collection import least_squares

    rows = pairs.select(site, F.col(y).alias("_y"), *(c.cast("double").alias(k) for k, c in terms.items())).dropna()
    means = rows.groupBy(site).agg(*(F.avg(c).alias(f"{c}__m") for c in ("_y", *terms)))
    centred = rows.join(means, site).select(F.lit(1).alias("all"), *((F.col(c) - F.col(f"{c}__m")).alias(c) for c in ("_y", *terms)))
    return least_squares(centred, ["all"], "_y", {k: F.col(k) for k in terms}).drop("all")


def spread_share(effect: float, noise: float = 1.5) -> float:
    """Share of variance that a planted effect explains."""
    return effect**2 / (effect**2 + noise) if math.isfinite(effect) else float("nan")
