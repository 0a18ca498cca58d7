"""Comparison of two groupings: contingency, pair counts, Rand, overlays, overlaps, changes.

All statistics start from the table of counts (a, b, n), made with one grouped sum; pairs are counted,
never formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, n) over rows that both label."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def pairs_of(n: Column) -> Column:
    n = n.cast("decimal(38,0)")
    return (n * (n - 1) / 2).cast("decimal(38,0)")


def pair_counts(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, pairs, t, p, q): all pairs, pairs together in both, in a, in b; exact decimals."""
    by = list(by)
    both = table.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(pairs_of(F.col("n"))).alias("t"))
    one = lambda c, name: table.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(pairs_of(F.col("m"))).alias(name))
    out = both
    for side in (one("a", "p"), one("b", "q")):
        out = out.join(side, by) if by else out.crossJoin(side)  # one row each without groups
    return out.select(*by, "rows", pairs_of(F.col("rows")).alias("pairs"), "t", "p", "q")


def agreement(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs both, a_only, b_only, neither; Rand and adjusted Rand; the ceiling that the margins allow."""
    n, t, p, q = (F.col(c).cast("double") for c in ("pairs", "t", "p", "q"))
    ari = F.try_divide(2 * (t * n - p * q), n * (p + q) - 2 * p * q)
    low = F.least(p, q)
    ceiling = F.try_divide(2 * (low * n - p * q), n * (p + q) - 2 * p * q)
    whole = lambda c: c.cast("long")
    return counts.select(*by, whole(F.col("pairs")).alias("pairs"), whole(F.col("t")).alias("both"), whole(F.col("p") - F.col("t")).alias("a_only"), whole(F.col("q") - F.col("t")).alias("b_only"), whole(F.col("pairs") - F.col("p") - F.col("q") + F.col("t")).alias("neither"), F.try_divide(n - p - q + 2 * t, n).alias("rand"), ari.alias("adjusted_rand"), ceiling.alias("ari_ceiling"))


def pooled_agreement(counts: DataFrame) -> DataFrame:
    """Adjusted Rand pooled over strata: sums of t - pq/N over sums of (p + q)/2 - pq/N."""
    n, t, p, q = (F.col(c).cast("double") for c in ("pairs", "t", "p", "q"))
    used = counts.where("pairs > 0")
    return used.agg(F.try_divide(F.sum(t - p * q / n), F.sum((p + q) / 2 - p * q / n)).alias("pooled_ari"), F.try_divide(F.sum(n - p - q + 2 * t), F.sum(n)).alias("pooled_rand"), F.count("*").alias("n_strata"))


def _margins(table: DataFrame) -> DataFrame:
    a = table.groupBy("a").agg(F.sum("n").alias("na"))
    b = table.groupBy("b").agg(F.sum("n").alias("nb"))
    return table.join(a, "a").join(b, "b").crossJoin(F.broadcast(table.agg(F.sum("n").alias("total"))))  # one row


def normalised_information(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of the entropies (1 where both are 0)."""
    m = _margins(table)
    mi = m.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    total = table.agg(F.sum("n").alias("total"))
    ent = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("k")).crossJoin(F.broadcast(total)).agg((-F.sum(F.col("k") / F.col("total") * F.log(F.col("k") / F.col("total")))).alias(name))
    out = mi.crossJoin(ent("a", "ha")).crossJoin(ent("b", "hb"))
    return out.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.greatest(F.col("mi"), F.lit(0.0)) / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def cramers_v(table: DataFrame) -> DataFrame:
    """Chi-square without correction, Cramer's V, number of cells expected under five.

    Cells that don't occur add their expected count, which the margins give in closed form: chi-square
    is total * (sum n^2 / (na nb) - 1).
    """
    m = _margins(table)
    s = m.agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.first("total").alias("total"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    a = table.groupBy("a").agg(F.sum("n").alias("na")).groupBy("na").agg(F.count("*").alias("ca"))
    b = table.groupBy("b").agg(F.sum("n").alias("nb")).groupBy("nb").agg(F.count("*").alias("cb"))
    total = table.agg(F.sum("n").alias("tt"))
    low = a.crossJoin(b).crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.when(F.col("na") * F.col("nb") < 5 * F.col("tt"), F.col("ca") * F.col("cb"))), F.lit(0)).alias("n_low"))
    chi = F.col("total") * (F.col("s") - 1)
    return s.crossJoin(low).select(chi.alias("chi2"), F.sqrt(F.try_divide(chi, F.col("total") * (F.least("ka", "kb") - 1))).alias("cramers_v"), "n_low")


def agreement_share(rows: DataFrame, unit: str, a: str, b: str, confident: float = 0.8) -> DataFrame:
    """Per unit: share of pixels where two (renumbered) label layers agree; whether it is confident."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(unit).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement")).withColumn("confident", F.col("agreement") >= confident)


def pair_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of "together in a" as a prediction of "together in b"."""
    n, t, p, q = (F.col(c).cast("double") for c in ("pairs", "t", "p", "q"))
    precision, recall = F.try_divide(t, p), F.try_divide(t, q)
    return counts.select(F.try_divide(n - p - q + 2 * t, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * t, p + q).alias("f1"), F.try_divide(p, n).alias("base_a"), F.try_divide(q, n).alias("base_b"))


def overlay(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, na, nb, iou) of units that overlap; sizes count pixels that the other layer doesn't label, too."""
    table = contingency(rows, a, b)
    na = rows.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("a")).agg(F.count("*").alias("na"))
    nb = rows.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("b")).agg(F.count("*").alias("nb"))
    return table.join(na, "a").join(nb, "b").withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))


def best_match(over: DataFrame, owner: str, other: str) -> DataFrame:
    """For each unit, the unit of the other layer that overlaps it most; ties go to the least."""
    return over.groupBy(owner).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(other).alias("o"), F.col("iou").alias("iou"), F.col("na").alias("na"), F.col("nb").alias("nb"))).alias("best")).select(owner, F.col("best.o").alias(other), (-F.col("best.m")).alias("n"), "best.iou", "best.na", "best.nb")


def overlap_agreement(over: DataFrame) -> DataFrame:
    """Mean over units of a: largest share of the unit, of its match, IoU, and shares of units with IoU over 0.5 and 0.7."""
    m = best_match(over, "a", "b")
    top = over.groupBy("a").agg(F.max("iou").alias("iou"))
    one = m.agg(F.avg(F.col("n") / F.col("na")).alias("olo"), F.avg(F.col("n") / F.col("nb")).alias("olu"))
    two = top.agg(F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") > 0.5).cast("double")).alias("iou_50"), F.avg((F.col("iou") > 0.7).cast("double")).alias("iou_70"), F.count("*").alias("n_units"))
    return one.crossJoin(two)


def segmentation_accuracy(over: DataFrame) -> DataFrame:
    """Over- and under-segmentation and their root mean square for pairs where either covers half of the other."""
    used = over.where((2 * F.col("n") > F.col("na")) | (2 * F.col("n") > F.col("nb")))
    o, u = 1 - F.col("n") / F.col("nb"), 1 - F.col("n") / F.col("na")
    return used.agg(F.avg(o).alias("over_segmentation"), F.avg(u).alias("under_segmentation"), F.avg(F.sqrt((o * o + u * u) / 2)).alias("distance"), F.count("*").alias("n_pairs"))


def matched_units(pixels: DataFrame, reference: str, unit: str, least_share: float = 0.0) -> DataFrame:
    """(a: reference, b: unit, n, na, nb, over, under, d) of pairs that overlap and match.

    A pair matches if the centre pixel of either lies in the other, or the overlap is more than half of
    either; its share of the smaller must be over ``least_share``.
    """
    over = overlay(pixels, reference, unit)

    def centre(own: str, other: str, name: str):
        mid = pixels.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("_o")).agg(F.floor(F.avg("y") + 0.5).alias("y"), F.floor(F.avg("x") + 0.5).alias("x"))
        return mid.join(pixels.where(F.col(other).isNotNull()).select("y", "x", F.col(other).alias(name)), ["y", "x"]).select(F.col("_o"), name)

    in_b = centre(reference, unit, "b").select(F.col("_o").alias("a"), "b", F.lit(True).alias("_p"))
    in_a = centre(unit, reference, "a").select("a", F.col("_o").alias("b"), F.lit(True).alias("_q"))
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    used = over.join(in_b, ["a", "b"], "left").join(in_a, ["a", "b"], "left").where((F.col("_p").isNotNull() | F.col("_q").isNotNull() | (2 * n > nb) | (2 * n > na)) & (n / F.least(na, nb) > least_share))
    o, u = 1 - n / na, 1 - n / nb
    return used.select("a", "b", "n", "na", "nb", o.alias("over"), u.alias("under"), F.sqrt((o * o + u * u) / 2).alias("d"))


def accuracy_summary(pixels: DataFrame, matched: DataFrame, reference: str, unit: str) -> DataFrame:
    """Means of over, under and d over all pairs, over references, and over references by area; counts.

    A reference without a match counts as over = 1 and has no under and d.
    """
    sizes = pixels.where(F.col(reference).isNotNull()).groupBy(F.col(reference).alias("a")).agg(F.count("*").alias("w"))
    names = ("over", "under", "d")
    each = sizes.join(matched.groupBy("a").agg(*(F.avg(c).alias(c) for c in names)), "a", "left").withColumn("hit", F.col("over").isNotNull()).withColumn("over", F.coalesce("over", F.lit(1.0)))
    all_ = matched.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("n_pairs"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum(F.when(F.col(c).isNotNull(), F.col("w"))))
    per = each.agg(*(F.avg(c).alias(f"{c}_per_reference") for c in names), *(mean(c).alias(f"{c}_area_weighted") for c in names), F.count("*").alias("n_references"), F.count_if(~F.col("hit")).alias("n_unmatched_references"))
    units = pixels.agg(F.count_distinct(unit).alias("n_stands"))
    out = all_.crossJoin(per).crossJoin(units)  # one row each
    none = F.col("n_pairs") == 0
    return out.select(*(F.when(~none, F.col(c)).alias(c) for c in (*names, *(f"{x}_{k}" for x in names for k in ("per_reference", "area_weighted")))), "n_references", "n_stands", "n_pairs", "n_unmatched_references")


def change_report(over: DataFrame) -> DataFrame:
    """Units with one and the same outline, and area-weighted IoU of best matches both ways."""
    same = over.agg(F.sum(((F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))).cast("long")).alias("unchanged"))
    a = best_match(over, "a", "b").agg((F.sum(F.col("na") * F.col("iou")) / F.sum("na")).alias("iou_forward"))
    b = best_match(over, "b", "a").agg((F.sum(F.col("nb") * F.col("iou")) / F.sum("nb")).alias("iou_backward"))
    return same.crossJoin(a).crossJoin(b)


def same_partition(table: DataFrame) -> DataFrame:
    """Whether two labellings are one partition under other names."""
    return table.agg(((F.count("*") == F.count_distinct("a")) & (F.count("*") == F.count_distinct("b"))).alias("same"))


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of least cost (rows at most columns): shortest augmenting paths.

    For confusion matrices of a few dozen classes, on the driver.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    row_price, col_price, owner = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        reach, back, done = [float("inf")] * m, [-1] * m, [False] * m
        row, col = start, -1
        while True:
            best = -1
            for j in range(m):
                if not done[j]:
                    d = cost[row][j] - row_price[row] - col_price[j]
                    d += reach[col] if col >= 0 else 0.0
                    if d < reach[j]:
                        reach[j], back[j] = d, col
                    if best < 0 or reach[j] < reach[best]:
                        best = j
            done[best], col = True, best
            if owner[col] < 0:
                break
            row = owner[col]
        end = reach[col]
        for j in range(m):
            if done[j] and j != col:
                row_price[owner[j]] += end - reach[j]
                col_price[j] -= end - reach[j]
        row_price[start] += end
        while col >= 0:
            owner[col] = owner[back[col]] if back[col] >= 0 else start
            col = back[col]
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def correspondence(table: DataFrame, most: int = 1000) -> dict:
    """One-to-one renumbering of a's classes to b's with the most common rows; raises over ``most`` classes a side."""
    rows = table.limit(most * most + 1).collect()  # k by k classes
    if max(len({r[c] for r in rows}) for c in "ab") > most if rows else False:
        raise ValueError(f"more than {most} classes")
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    n = {(r["a"], r["b"]): r["n"] for r in rows}
    if len(a) > len(b):
        cols = assignment([[-n.get((x, y), 0) for x in a] for y in b])
        return {a[c]: b[r] for r, c in enumerate(cols)}
    return {a[r]: b[c] for r, c in enumerate(assignment([[-n.get((x, y), 0) for y in b] for x in a]))}


def boundary_match(rows: DataFrame, a: str, b: str, tolerance: int) -> DataFrame:
    """Precision, recall and F of a's boundary pixels against b's, within so many pixels."""
    from .grid import disc, outline

    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(tolerance)))

    def near(one: DataFrame, other: DataFrame) -> DataFrame:
        wide = other.select(F.explode(moves).alias("m"), "y", "x").select((F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).distinct()
        return one.join(wide.withColumn("hit", F.lit(1)), ["y", "x"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"))

    ea, eb = (outline(rows.where(F.col(c).isNotNull()), c).select("y", "x") for c in (a, b))
    out = near(ea, eb).withColumnRenamed("share", "precision").crossJoin(near(eb, ea).withColumnRenamed("share", "recall"))
    return out.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def global_score(candidates: DataFrame, variance: str, moran: str) -> DataFrame:
    """Sum of min-max normalised within variance and autocorrelation over candidate segmentations; flat ones are 0."""
    w = Window.partitionBy()
    flat = lambda c: (F.max(c).over(w) - F.min(c).over(w)) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(F.max(c).over(w)), F.abs(F.min(c).over(w))), F.lit(1e-12))
    unit = lambda c: F.when(flat(c), 0.0).otherwise(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)))
    return candidates.withColumn("global_score", unit(variance) + unit(moran))


def difference(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Largest difference, number of unequal values and of keys that one side lacks or masks."""
    both = a.select(*key, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), list(key), "full")
    return both.agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_abs"), F.sum(F.coalesce((F.col("va") != F.col("vb")).cast("long"), F.lit(0))).alias("n_unequal"), F.sum((F.col("va").isNull() != F.col("vb").isNull()).cast("long")).alias("n_mask"))
