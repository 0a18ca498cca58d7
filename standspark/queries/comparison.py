"""Queries of the comparison and inference operators, of codes and of field-table text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import compare as C
from ..operators import fieldtables as T
from ..operators import inference as I
from .base import observations, plots, query, raster, read


def _two_layers(s, d):
    """Documents' quality and toxicity as two labellings, the language as stratum."""
    lab = read(s, d, "labels").select("doc_id", "quality", "toxic")
    return lab.join(read(s, d, "documents").select("doc_id", "lang"), "doc_id")


_LAB = "lab AS (SELECT doc_id, quality AS a, toxic AS b, lang FROM labels JOIN documents USING (doc_id))"


@query("contingency", f"WITH {_LAB} SELECT lang, a, b, count(*) AS n FROM lab GROUP BY ALL")
def _(s, d):
    return C.contingency(_two_layers(s, d), "quality", "toxic", ["lang"])


def _pair_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"ct AS (SELECT {keys}a, b, count(*) AS n FROM lab GROUP BY ALL), tt AS (SELECT {keys}CAST(sum(n) AS DOUBLE) AS r, sum(n * (n - 1.0) / 2) AS t FROM ct {group}), pp AS (SELECT {keys}sum(n * (n - 1.0) / 2) AS p FROM (SELECT {keys}a, sum(n) AS n FROM ct GROUP BY ALL) {group}), qq AS (SELECT {keys}sum(n * (n - 1.0) / 2) AS q FROM (SELECT {keys}b, sum(n) AS n FROM ct GROUP BY ALL) {group}), pc AS (SELECT {keys}CAST(r * (r - 1) / 2 AS DOUBLE) AS n, CAST(t AS DOUBLE) AS t, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM tt JOIN pp {join} JOIN qq {join})"


_AGREE = "CAST(n AS BIGINT) AS pairs, CAST(t AS BIGINT) AS \"both\", CAST(p - t AS BIGINT) AS a_only, CAST(q - t AS BIGINT) AS b_only, CAST(n - p - q + t AS BIGINT) AS neither, (n - p - q + 2 * t) / nullif(n, 0) AS rand, 2 * (t * n - p * q) / nullif(n * (p + q) - 2 * p * q, 0) AS adjusted_rand, 2 * (least(p, q) * n - p * q) / nullif(n * (p + q) - 2 * p * q, 0) AS ari_ceiling"


@query("adjusted_rand", f"WITH {_LAB}, {_pair_sql('')} SELECT {_AGREE} FROM pc", "rand adjusted_rand ari_ceiling")
def _(s, d):
    return C.agreement(C.pair_counts(C.contingency(_two_layers(s, d), "quality", "toxic")))


@query("stratified_rand", f"WITH {_LAB}, {_pair_sql('lang')} SELECT lang, {_AGREE} FROM pc", "rand adjusted_rand ari_ceiling")
def _(s, d):
    return C.agreement(C.pair_counts(C.contingency(_two_layers(s, d), "quality", "toxic", ["lang"]), ["lang"]), ["lang"])


@query("pooled_ari", f"WITH {_LAB}, {_pair_sql('lang')} SELECT sum(t - p * q / n) / sum((p + q) / 2 - p * q / n) AS pooled_ari, sum(n - p - q + 2 * t) / sum(n) AS pooled_rand, count(*) AS n_strata FROM pc WHERE n > 0", "pooled_ari pooled_rand")
def _(s, d):
    return C.pooled_agreement(C.pair_counts(C.contingency(_two_layers(s, d), "quality", "toxic", ["lang"]), ["lang"]))


@query("pair_scores", f"WITH {_LAB}, {_pair_sql('')} SELECT (n - p - q + 2 * t) / n AS accuracy, t / p AS precision, t / q AS recall, 2 * t / (p + q) AS f1, p / n AS base_a, q / n AS base_b FROM pc", "accuracy precision recall f1 base_a base_b")
def _(s, d):
    return C.pair_scores(C.pair_counts(C.contingency(_two_layers(s, d), "quality", "toxic")))


_MARGIN = "ct AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT kind AS a, m AS b FROM raster) GROUP BY ALL), mg AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM ct)"


@query("normalised_information", f"WITH {_MARGIN} SELECT 2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM mg) / ((SELECT -sum(na / t * ln(na / t)) FROM (SELECT DISTINCT a, na, t FROM mg)) + (SELECT -sum(nb / t * ln(nb / t)) FROM (SELECT DISTINCT b, nb, t FROM mg))) AS nmi", "nmi", 8)
def _(s, d):
    return C.normalised_information(C.contingency(raster(s, d), "kind", "m"))


@query("cramers_v", f"WITH {_MARGIN}, e AS (SELECT x.a, y.b, x.na * y.nb / x.t AS e FROM (SELECT DISTINCT a, na, t FROM mg) x, (SELECT DISTINCT b, nb FROM mg) y), c AS (SELECT sum((coalesce(n, 0) - e) ** 2 / e) AS chi2, count(CASE WHEN e < 5 THEN 1 END) AS n_low FROM e LEFT JOIN ct USING (a, b)) SELECT chi2, sqrt(chi2 / ((SELECT sum(n) FROM ct) * (least((SELECT count(DISTINCT a) FROM ct), (SELECT count(DISTINCT b) FROM ct)) - 1))) AS cramers_v, n_low FROM c", "chi2 cramers_v", 5)
def _(s, d):
    return C.cramers_v(C.contingency(raster(s, d), "kind", "m"))


@query("agreement_share", "SELECT label, avg(CASE WHEN kind = m - 1 THEN 1.0 ELSE 0 END) AS agreement, avg(CASE WHEN kind = m - 1 THEN 1.0 ELSE 0 END) >= 0.8 AS confident FROM raster GROUP BY label", "agreement")
def _(s, d):
    return C.agreement_share(raster(s, d).withColumn("o", F.col("m") - 1), "label", "kind", "o")


_OVER = "lay AS (SELECT y, x, label AS a, CASE WHEN kind > 0 THEN (y // 11) * 100 + x // 9 END AS b FROM raster), ov AS (SELECT c.a, c.b, c.n, s.na, u.nb, c.n / (s.na + u.nb - c.n) AS iou FROM (SELECT a, b, count(*) AS n FROM lay WHERE b IS NOT NULL GROUP BY ALL) c JOIN (SELECT a, count(*) AS na FROM lay GROUP BY a) s USING (a) JOIN (SELECT b, count(*) AS nb FROM lay WHERE b IS NOT NULL GROUP BY b) u USING (b))"


def _over(s, d):
    r = raster(s, d).withColumn("other", F.when(F.col("kind") > 0, F.expr("(y DIV 11) * 100 + x DIV 9")))
    return C.overlay(r, "label", "other")


@query("layer_overlay", f"WITH {_OVER} SELECT * FROM ov", "iou")
def _(s, d):
    return _over(s, d)


@query("best_match", f"WITH {_OVER} SELECT a, b, n, iou, na, nb FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM ov) WHERE r = 1", "iou")
def _(s, d):
    return C.best_match(_over(s, d), "a", "b")


@query("overlap_agreement", f"WITH {_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r, max(iou) OVER (PARTITION BY a) AS top FROM ov) SELECT avg(n / na) AS olo, avg(n / nb) AS olu, avg(top) AS mean_iou, avg(CASE WHEN top > 0.5 THEN 1.0 ELSE 0 END) AS iou_50, avg(CASE WHEN top > 0.7 THEN 1.0 ELSE 0 END) AS iou_70, count(*) AS n_units FROM r WHERE r = 1", "olo olu mean_iou iou_50 iou_70")
def _(s, d):
    return C.overlap_agreement(_over(s, d))


@query("segmentation_accuracy", f"WITH {_OVER} SELECT avg(1 - n / nb) AS over_segmentation, avg(1 - n / na) AS under_segmentation, avg(sqrt(((1 - n / nb) ** 2 + (1 - n / na) ** 2) / 2)) AS distance, count(*) AS n_pairs FROM ov WHERE 2 * n > na OR 2 * n > nb", "over_segmentation under_segmentation distance")
def _(s, d):
    return C.segmentation_accuracy(_over(s, d))


@query("change_report", f"WITH {_OVER} SELECT CAST((SELECT count(*) FROM ov WHERE n = na AND n = nb) AS BIGINT) AS unchanged, (SELECT sum(na * iou) / sum(na) FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM ov) WHERE r = 1) AS iou_forward, (SELECT sum(nb * iou) / sum(nb) FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS r FROM ov) WHERE r = 1) AS iou_backward", "iou_forward iou_backward")
def _(s, d):
    return C.change_report(_over(s, d))


@query("same_partition", "SELECT count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS same FROM (SELECT DISTINCT label AS a, label * 3 + 1 AS b FROM raster)")
def _(s, d):
    return C.same_partition(C.contingency(raster(s, d).withColumn("o", F.col("label") * 3 + 1), "label", "o"))


@query("table_difference", "WITH a AS (SELECT y, x, v FROM raster WHERE kind <> 6), b AS (SELECT y, x, v + CASE WHEN x = 3 THEN 1 ELSE 0 END AS v FROM raster WHERE kind <> 0) SELECT max(abs(a.v - b.v)) AS max_abs, CAST(count(CASE WHEN a.v <> b.v THEN 1 END) AS BIGINT) AS n_unequal, CAST(count(CASE WHEN (a.v IS NULL) <> (b.v IS NULL) THEN 1 END) AS BIGINT) AS n_mask FROM a FULL JOIN b USING (y, x)", "max_abs")
def _(s, d):
    r = raster(s, d)
    return C.difference(r.where("kind <> 6"), r.where("kind <> 0").withColumn("v", F.col("v") + F.when(F.col("x") == 3, 1.0).otherwise(0.0)), ["y", "x"], "v")


@query("global_score", "WITH c AS (SELECT kind, var_pop(v) AS wv, avg(m) AS mi FROM raster GROUP BY kind) SELECT kind, wv, mi, (wv - min(wv) OVER ()) / (max(wv) OVER () - min(wv) OVER ()) + (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER ()) AS global_score FROM c", "wv mi global_score", 3)
def _(s, d):
    return C.global_score(raster(s, d).groupBy("kind").agg(F.var_pop("v").alias("wv"), F.avg("m").alias("mi")), "wv", "mi")


_PAIR = "pr AS (SELECT a.grp, a.plot AS plot_a, b.plot AS plot_b, a.h AS h_a, b.h AS h_b, a.unit AS unit_a, b.unit AS unit_b, a.typ AS typ_a, b.typ AS typ_b, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS dist, abs(a.h - b.h) AS fd, CAST(CASE WHEN a.unit IS NULL OR b.unit IS NULL THEN -1 WHEN a.unit = b.unit THEN 0 WHEN a.typ IS NULL OR b.typ IS NULL THEN 3 WHEN a.typ = b.typ THEN 1 ELSE 2 END AS INTEGER) AS claim FROM plots a JOIN plots b ON a.grp = b.grp AND a.plot < b.plot), bd AS (SELECT *, CAST(CASE WHEN dist < 0 THEN -1 WHEN dist < 400 THEN 0 WHEN dist < 700 THEN 1 ELSE -1 END AS INTEGER) AS band FROM pr)"


def _pairs(s, d, shares=1):
    p = I.plot_pairs(plots(s, d), "plot", ["h", "px", "py", "unit", "typ"], ["grp"], shares)
    p = p.withColumn("dist", I.planar_distance("px", "py")).withColumn("fd", I.field_distance(["h"]))
    return I.with_claims(p, "unit", "typ").withColumn("band", B.band_index("dist", [0, 400, 700]))


@query("pair_claims", f"WITH {_PAIR} SELECT grp, plot_a, plot_b, dist, fd, claim, band FROM bd", "dist fd")
def _(s, d):
    return _pairs(s, d).select("grp", "plot_a", "plot_b", "dist", "fd", "claim", "band")


_STRATA = "st AS (SELECT grp, band, sum(CASE WHEN claim > 0 THEN 1 ELSE 0 END) AS hi, sum(CASE WHEN claim = 0 THEN 1 ELSE 0 END) AS lo, avg(CASE WHEN claim > 0 THEN fd END) - avg(CASE WHEN claim = 0 THEN fd END) AS effect FROM bd WHERE claim >= 0 AND band >= 0 GROUP BY ALL)"


def _contrast(s, d):
    used = _pairs(s, d).where("claim >= 0 AND band >= 0")
    return I.pair_contrast(used, "fd", F.col("claim") > 0, ["grp", "band"])


@query("pair_contrast_pooled", f"WITH {_PAIR}, {_STRATA} SELECT sum(hi * lo / (hi + lo) * effect) / sum(hi * lo / (hi + lo)) AS effect, CAST(sum(lo) AS BIGINT) AS n_lo, CAST(sum(hi) AS BIGINT) AS n_hi, count(*) AS n_strata FROM st WHERE effect IS NOT NULL", "effect", 4)
def _(s, d):
    return _contrast(s, d)["pooled"]


@query("pair_contrast_by_band", f"WITH {_PAIR}, {_STRATA} SELECT band, sum(hi * lo / (hi + lo) * effect) / sum(hi * lo / (hi + lo)) AS effect, CAST(sum(lo) AS BIGINT) AS n_lo, CAST(sum(hi) AS BIGINT) AS n_hi, count(*) AS n_strata FROM st WHERE effect IS NOT NULL GROUP BY band", "effect", 4)
def _(s, d):
    return _contrast(s, d)["by_band"]


@query("mantel", f"WITH {_PAIR} SELECT CASE WHEN count(*) >= 3 THEN corr(dist, fd) END AS r, count(*) AS n_pairs FROM pr", "r")
def _(s, d):
    return I.mantel(_pairs(s, d), "dist", "fd")


@query("mantel_ranks", f"WITH {_PAIR}, rk AS (SELECT rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2 AS x, rank() OVER (ORDER BY fd) + (count(*) OVER (PARTITION BY fd) - 1) / 2 AS y FROM pr) SELECT corr(x, y) AS r, count(*) AS n_pairs FROM rk", "r")
def _(s, d):
    return I.mantel(_pairs(s, d), "dist", "fd", ranks=True)


@query("partial_mantel", f"WITH {_PAIR}, c AS (SELECT corr(dist, fd) AS xy, corr(dist, z) AS xz, corr(fd, z) AS yz, count(*) AS n FROM (SELECT *, abs(plot_a - plot_b) AS z FROM pr)) SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r, n AS n_pairs FROM c", "r")
def _(s, d):
    return I.partial_mantel(_pairs(s, d).withColumn("z", F.abs(F.col("plot_a") - F.col("plot_b")).cast("double")), "dist", "fd", "z")


@query("anosim", f"WITH {_PAIR}, rk AS (SELECT claim, rank() OVER (ORDER BY fd) + (count(*) OVER (PARTITION BY fd) - 1) / 2 AS r FROM pr WHERE claim >= 0) SELECT avg(CASE WHEN claim = 0 THEN r END) AS within, avg(CASE WHEN claim <> 0 THEN r END) AS \"between\", count(*) AS n_pairs, (avg(CASE WHEN claim <> 0 THEN r END) - avg(CASE WHEN claim = 0 THEN r END)) / (count(*) / 2) AS r FROM rk", "within \"between\" r")
def _(s, d):
    return I.anosim(_pairs(s, d).where("claim >= 0"), "fd", F.col("claim") == 0)


_PERM = "pl AS (SELECT plot, grp, h FROM plots), gr AS (SELECT grp, count(*) AS n, sum((h - gm) ** 2) AS w FROM (SELECT *, avg(h) OVER (PARTITION BY grp) AS gm FROM pl) GROUP BY grp), al AS (SELECT count(*) AS n, count(DISTINCT grp) AS k, var_pop(h) * count(*) AS t FROM pl)"


@query("permanova", f"WITH {_PERM} SELECT ((t - w) / (k - 1)) / (w / (n - k)) AS pseudo_f, 1 - w / t AS r2 FROM al, (SELECT sum(w) AS w FROM gr)", "pseudo_f r2", 5)
def _(s, d):
    return I.permanova_fields(plots(s, d), ["h"], "grp")


@query("permanova_pairs", f"WITH {_PERM} SELECT ((t - w) / (k - 1)) / (w / (n - k)) AS pseudo_f, 1 - w / t AS r2 FROM al, (SELECT sum(w) AS w FROM gr)", "pseudo_f r2", 5)
def _(s, d):
    """The same from the distances of all pairs of a plot set, as other distances need it."""
    return I.permanova(I.plot_pairs(plots(s, d), "plot", ["h", "grp"]).withColumn("fd", I.field_distance(["h"])), "fd", "grp")


@query("bray_curtis", "WITH a AS (SELECT pixel, flag || ln AS sp, sum(qty) AS q FROM obs GROUP BY ALL), t AS (SELECT pixel, sum(q) AS t FROM a GROUP BY pixel), c AS (SELECT x.pixel AS plot_a, y.pixel AS plot_b, sum(least(x.q, y.q)) AS c FROM a x JOIN a y ON x.sp = y.sp AND x.pixel < y.pixel GROUP BY ALL) SELECT u.pixel AS plot_a, v.pixel AS plot_b, 1 - 2 * coalesce(c, 0) / (u.t + v.t) AS distance FROM t u JOIN t v ON u.pixel < v.pixel LEFT JOIN c ON c.plot_a = u.pixel AND c.plot_b = v.pixel", "distance")
def _(s, d):
    return _bray_curtis(observations(s, d))


def _bray_curtis(o):
    return I.bray_curtis(o.withColumn("sp", F.concat("flag", "ln")).groupBy("pixel", "sp").agg(F.sum("qty").alias("q")), "pixel", "sp", "q")


@query("null_draws")
def _(s, d):
    return I.null_draws(plots(s, d), "plot", ["unit", "typ"], 20, 7, "grp")


@query("permutation_tests")
def _(s, d):
    """Adjusted Rand of unit and group under 99 shuffles within nothing."""
    p = plots(s, d).where("unit IS NOT NULL")
    t = C.contingency(p, "grp", "unit")
    seen = C.agreement(C.pair_counts(t)).select(F.lit("ari").alias("statistic"), F.col("adjusted_rand").alias("observed"))
    draws = I.null_draws(p, "plot", ["unit"], 99, 3).join(p.select("plot", "grp"), "plot")
    null = C.agreement(C.pair_counts(C.contingency(draws, "grp", "unit", ["draw"]), ["draw"]), ["draw"]).select(F.lit("ari").alias("statistic"), "draw", F.col("adjusted_rand").alias("value"))
    return I.run_tests(seen, null, 99)


@query("holm", "WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 5000.0 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p) SELECT id, CAST(p AS DOUBLE) AS p, least(1, max(p * (m - k + 1)) OVER (ORDER BY k)) AS p_holm FROM r", "p p_holm")
def _(s, d):
    return _holm(read(s, d, "supplier"))


def _holm(suppliers):
    return I.holm(suppliers.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 101 / 5000.0).alias("p")), "p", "id")


@query("null_percentile", "SELECT 50.0 AS o, CASE WHEN count(*) >= 100 THEN 100 * (count(CASE WHEN qty < 25 THEN 1 END) + 0.5 * count(CASE WHEN qty = 25 THEN 1 END)) / count(*) END AS percentile FROM obs".replace("50.0 AS o", "CAST(25 AS DOUBLE) AS o"), "o percentile")
def _(s, d):
    return I.null_percentile(observations(s, d).withColumn("o", F.lit(25.0)), "o", "qty")


@query("wilson_interval", "WITH c AS (SELECT flag, CAST(count(CASE WHEN qty > 40 THEN 1 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY flag), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM c) SELECT flag, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS lo, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS hi FROM z", "lo hi")
def _(s, d):
    c = observations(s, d).groupBy("flag").agg(F.sum((F.col("qty") > 40).cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = I.wilson(F.col("k"), F.col("n"))
    return c.select("flag", lo.alias("lo"), hi.alias("hi"))


@query("bootstrap_groups")
def _(s, d):
    return I.bootstrap_groups(plots(s, d), "grp", 20, 5)


@query("jackknife", "WITH g AS (SELECT grp, sum(h) AS a, count(*) AS b FROM plots GROUP BY grp) SELECT grp, (sum(a) OVER () - a) / (sum(b) OVER () - b) AS without FROM g", "without", 4)
def _(s, d):
    g = plots(s, d).groupBy("grp").agg(F.sum("h").alias("a"), F.count("*").alias("b"))
    return I.jackknife(g, "a", "b").select("grp", "without")


@query("rank_test", "WITH r AS (SELECT flag = 'A' AS g, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS r, count(*) OVER (PARTITION BY qty) AS c FROM obs), t AS (SELECT sum(CASE WHEN g THEN r END) AS ra, CAST(count(CASE WHEN g THEN 1 END) AS DOUBLE) AS na, CAST(count(*) AS DOUBLE) AS n, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM r) SELECT ra - na * (na + 1) / 2 AS u, (ra - na * (na + 1) / 2 - na * (n - na) / 2) / sqrt(na * (n - na) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM t", "u z", 4)
def _(s, d):
    return I.rank_test(observations(s, d), "qty", F.col("flag") == "A")


@query("pair_regression", f"WITH {_PAIR}, c AS (SELECT fd - avg(fd) OVER (PARTITION BY grp) AS y, dist - avg(dist) OVER (PARTITION BY grp) AS x FROM pr) SELECT sum(x * y) / sum(x * x) AS dist, (sum(y * y) - sum(x * y) ** 2 / sum(x * x)) / count(*) AS residual_variance, count(*) AS n FROM c HAVING count(*) > 0", "dist residual_variance", 4)
def _(s, d):
    return I.pair_regression(_pairs(s, d), "fd", {"dist": F.col("dist")}, "grp")


@query("one_type_per_unit", "SELECT unit, count(DISTINCT typ) AS n_types FROM plots GROUP BY unit HAVING count(DISTINCT typ) > 1")
def _(s, d):
    return T.one_type_per_unit(plots(s, d), "unit", "typ")


@query("event_metadata", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def _(s, d):
    e = read(s, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
