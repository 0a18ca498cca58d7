"""Queries of stands as results, of codes and texts, of checks and rankings, and of scores against field plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import checks
from ..operators import collection as L
from ..operators import compare as C
from ..operators import components as K
from ..operators import fieldtables as T
from ..operators import grid as G
from ..operators import inference as I
from ..operators import joins as J
from ..operators import merging as M
from ..operators import ranking as R
from ..operators import stands as S
from ..operators import units as U
from ..operators import zonal as Z
from .base import observations, plots, query, raster, read
from .comparison import _OVER, _PAIR, _over, _pairs
from .spatial import _ADJ, RULES, _graph


def _node():
    return F.col("y") * 100 + F.col("x")


def _reach(rows: str, label: str = "") -> str:
    """SQL of components: nd (node, y, x, l) and cp (node, component) over rows that touch by a side with the same l."""
    return f"nd AS (SELECT y * 100 + x AS node, y, x, {label or 0} AS l FROM {rows}), lk AS (SELECT a.node AS a, b.node AS b FROM nd a JOIN nd b ON a.l = b.l AND ((b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1))), rc AS (SELECT node AS a, node AS b FROM nd UNION SELECT rc.a, lk.b FROM rc JOIN lk ON rc.b = lk.a), cp AS (SELECT a AS node, min(b) AS component FROM rc GROUP BY a)"


_LAND_SQL = _reach("raster WHERE kind < 3")


def _land(s, d):
    return G.pixel_links(raster(s, d), F.col("kind") < 3, _node())


@query("patches", f"WITH RECURSIVE {_LAND_SQL} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM cp")
def _(s, d):
    return K.patches(*_land(s, d)).select("node", "component", "size")


@query("kept_land", f"WITH RECURSIVE {_LAND_SQL}, sz AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM cp) SELECT * FROM sz WHERE size >= 20")
def _(s, d):
    return K.kept_land(*_land(s, d), 20).select("node", "component", "size")


@query("patches_capped", f"WITH RECURSIVE {_LAND_SQL} SELECT node, component, least(count(*) OVER (PARTITION BY component), 16) AS size FROM cp")
def _(s, d):
    return K.patches(*_land(s, d), cap=16).select("node", "component", F.col("size").cast("long").alias("size"))


@query("land_coverage", f"WITH RECURSIVE {_LAND_SQL}, sz AS (SELECT node, count(*) OVER (PARTITION BY component) AS size FROM cp), px AS (SELECT r.kind < 3 AS land, size, CASE WHEN (y + x) % 5 > 0 THEN label END AS l FROM raster r LEFT JOIN sz ON sz.node = r.y * 100 + r.x) SELECT round(count(CASE WHEN land AND size >= 20 THEN 1 END) * CAST(0.01 AS DOUBLE), 4) AS kept_ha, round(count(CASE WHEN land AND size < 20 THEN 1 END) * CAST(0.01 AS DOUBLE), 4) AS small_patches_ha, round(count(CASE WHEN land AND size >= 20 AND l IS NULL THEN 1 END) * CAST(0.01 AS DOUBLE), 4) AS kept_without_label_ha, round(count(CASE WHEN l IS NOT NULL AND NOT (land AND coalesce(size, 0) >= 20) THEN 1 END) * CAST(0.01 AS DOUBLE), 4) AS label_off_kept_ha FROM px", "kept_ha small_patches_ha kept_without_label_ha label_off_kept_ha")
def _(s, d):
    size = K.patches(*_land(s, d)).select("node", "size")
    px = raster(s, d).withColumn("node", _node()).join(size, "node", "left").withColumn("l", F.when((F.col("y") + F.col("x")) % 5 > 0, F.col("label")))
    return S.coverage(px, F.col("kind") < 3, F.col("size"), F.col("l"), 20)


@query("segmentation_seeds", f"WITH RECURSIVE {_LAND_SQL}, g AS (SELECT node, y, x, component, (y - 2) % 4 = 0 AND (x - 2) % 4 = 0 AS on_grid FROM nd JOIN cp USING (node)) SELECT node, y, x, on_grid FROM (SELECT *, bool_or(on_grid) OVER (PARTITION BY component) AS held FROM g) WHERE on_grid OR NOT held")
def _(s, d):
    land, links = _land(s, d)
    return S.seeds(land, K.patches(land, links).select("node", "component"), 4)


_PIECES = _reach("raster", "kind")


@query("vectorised_pieces", f"WITH RECURSIVE {_PIECES}, p AS (SELECT l AS label, component AS piece, node, y, x FROM nd JOIN cp USING (node)) SELECT label, piece, count(*) AS n_pixels, avg(x) AS cx, avg(y) AS cy, count(CASE WHEN NOT EXISTS (SELECT 1 FROM p q WHERE q.piece = p.piece AND q.y = p.y AND q.x = p.x - 1) THEN 1 END) AS n_runs FROM p GROUP BY label, piece", "cx cy")
def _(s, d):
    return S.vectorised(S.pieces(raster(s, d), "kind", _node())).drop("runs").select("label", "piece", F.col("n_pixels").cast("long").alias("n_pixels"), "cx", "cy", "n_runs")


@query("polygon_counts", f"WITH RECURSIVE {_PIECES}, p AS (SELECT l, count(DISTINCT component) AS p FROM nd JOIN cp USING (node) GROUP BY l) SELECT CAST(sum(p) AS BIGINT) AS n_polygons, count(*) AS n_stands, count(CASE WHEN p > 1 THEN 1 END) AS n_split, max(p) AS max_pieces FROM p")
def _(s, d):
    return S.polygon_counts(S.vectorised(S.pieces(raster(s, d), "kind", _node())))


@query("split_units", f"WITH RECURSIVE {_PIECES}, p AS (SELECT l AS label, component AS piece, y, x FROM nd JOIN cp USING (node)), z AS (SELECT label, piece, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT DISTINCT a.label FROM p a JOIN p b ON a.label = b.label AND a.piece <> b.piece AND abs(a.y - b.y) = 1 AND abs(a.x - b.x) = 1) SELECT label, count(*) AS n_pieces, max(n) / sum(n) AS largest_share, label IN (SELECT label FROM c) AS touch_by_corner FROM z GROUP BY label HAVING count(*) > 1", "largest_share")
def _(s, d):
    return S.split_units(S.pieces(raster(s, d), "kind", _node()))


@query("stands_renumbered", "SELECT label, avg(y) AS y, row_number() OVER (ORDER BY avg(x) + 1e6 * avg(y), label) AS stand_id FROM raster GROUP BY label", "y")
def _(s, d):
    units = raster(s, d).groupBy("label").agg(F.avg("x").alias("lon"), (-F.avg("y")).alias("lat"))
    return R.renumber(units, "lat", "lon", "label").select("label", (-F.col("lat")).alias("y"), "stand_id")


@query("dense_ids", "SELECT y, x, dense_rank() OVER (ORDER BY label) - 1 AS id FROM raster")
def _(s, d):
    return R.dense_ids(raster(s, d), ["label"], "id").select("y", "x", "id")


@query("encoded_labels", "SELECT plot, CASE WHEN unit IS NULL OR unit = 1 THEN -1 ELSE dense_rank() OVER (ORDER BY unit IS NULL OR unit = 1, unit) - 1 END AS code FROM plots")
def _(s, d):
    return R.encode(plots(s, d), "unit", "code", [1]).select("plot", "code")


@query("combined_labels", "SELECT plot, CASE WHEN unit IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY unit IS NULL, grp, unit) - 1 END AS code FROM plots")
def _(s, d):
    return checks.unique_ids(plots(s, d), "grp", "unit", "code").select("plot", "code")


@query("code_faults", "SELECT 'unit' AS \"column\", count(*) AS n, count(CASE WHEN unit IS NULL OR unit < -1 THEN 1 END) AS n_wrong FROM plots UNION ALL SELECT 'h', count(*), count(CASE WHEN h IS NULL OR h <> floor(h) OR h < -1 THEN 1 END) FROM plots")
def _(s, d):
    return checks.code_faults(plots(s, d), ["unit", "h"])


_GATE = f"{_ADJ}, u AS (SELECT label, count(*) AS n, avg(CASE WHEN kind < 6 THEN v END) AS v, CASE WHEN label % 5 > 0 THEN avg(m) END AS m FROM raster GROUP BY label), g AS (SELECT a.n + b.n AS n, abs(a.v - b.v) AS dv, abs(a.m - b.m) AS dm FROM adj JOIN u a ON a.label = label_i JOIN u b ON b.label = label_j), f AS (SELECT n <= 127 AS fits, CAST(dv IS NOT NULL AS INTEGER) + CAST(dm IS NOT NULL AS INTEGER) AS k, coalesce(dv <= 20000, TRUE) AND coalesce(dm <= 1.5, TRUE) AS pass FROM g)"


def _gaps(s, d):
    r = raster(s, d)
    units = r.groupBy("label").agg(F.count("*").alias("n_pixels"), F.avg(F.when(F.col("kind") < 6, F.col("v"))).alias("v"), F.avg("m").alias("m")).withColumn("m", F.when(F.col("label") % 5 > 0, F.col("m")))
    return units.withColumnRenamed("label", "i"), G.adjacency(r, "label").toDF("i", "j", "n_shared")


@query("merge_first_round", f"WITH {_GATE} SELECT count(*) AS n_pairs, count(CASE WHEN NOT fits THEN 1 END) AS blocked_by_area, count(CASE WHEN fits AND k < 2 THEN 1 END) AS blocked_by_undefined, count(CASE WHEN fits AND pass AND k >= 2 THEN 1 END) AS n_candidates, count(CASE WHEN k > 0 THEN 1 END) AS n_with_criterion, round(100.0 * count(CASE WHEN pass AND k >= 2 THEN 1 END) / nullif(count(CASE WHEN k > 0 THEN 1 END), 0), 2) AS admitted_pct FROM f", "admitted_pct")
def _(s, d):
    return S.first_round(*_gaps(s, d), {"v": 20000.0, "m": 1.5}, 127)


@query("merge_diagnostics")
def _(s, d):
    return S.merge_diagnostics(M.merge_regions(*_graph(s, d), RULES), RULES.pixels(RULES.min_area_ha), list(RULES.tolerances))


@query("rasterised_seeds", "WITH p AS (SELECT plot, px / 10 + 0.137 AS x, py / 10 + 0.291 AS y FROM plots), j AS (SELECT r.y, r.x, plot, row_number() OVER (PARTITION BY r.y, r.x ORDER BY sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2), plot) AS k FROM raster r JOIN p ON (p.x - r.x) ** 2 + (p.y - r.y) ** 2 <= 144) SELECT y, x, plot FROM raster LEFT JOIN (SELECT * FROM j WHERE k = 1) USING (y, x)")
def _(s, d):
    p = plots(s, d).select("plot", (F.col("px") / 10 + 0.137).alias("x"), (F.col("py") / 10 + 0.291).alias("y"))
    return S.nearest_seed(raster(s, d), p, 12.0, "plot")


@query("rasterised_boxes", "WITH b AS (SELECT * FROM (VALUES (1, 0, 0, 40, 40), (2, 30, 30, 80, 70), (3, 90, 0, 100, 90)) t(id, x0, y0, x1, y1)) SELECT y, x, CAST(min(id) AS INTEGER) AS poly FROM raster LEFT JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY y, x")
def _(s, d):
    ring = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    boxes = s.createDataFrame([(1, ring(0, 0, 40, 40)), (2, ring(30, 30, 80, 70)), (3, ring(90, 0, 100, 90))], "poly int, ring array<struct<x: double, y: double>>")
    px = raster(s, d).select(F.struct("y", "x").alias("p"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return J.points_in_polygons(px, boxes, "p", "poly", "ring", 25.0).select("p.y", "p.x", "poly")


@query("edge_distance", "WITH o AS (SELECT DISTINCT a.y, a.x FROM raster a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) LEFT JOIN raster b ON b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE b.label IS NULL OR b.label <> a.label) SELECT plot, sqrt(min((px / 10 - x) ** 2 + (py / 10 - y) ** 2)) AS distance FROM plots LEFT JOIN o ON (px / 10 - x) ** 2 + (py / 10 - y) ** 2 <= 400 GROUP BY plot", "distance")
def _(s, d):
    return S.edge_distance(plots(s, d).select("plot", (F.col("px") / 10).alias("x"), (F.col("py") / 10).alias("y")), raster(s, d), "label", 20.0, "plot")


def _ari(src: str, a: str, b: str) -> str:
    pairs = lambda by: f"(SELECT coalesce(sum(c * (c - 1) / 2.0), 0) FROM (SELECT count(*) AS c FROM {src} GROUP BY {by}))"
    return f"(SELECT 2 * (t * n - p * q) / nullif(n * (p + q) - 2 * p * q, 0) FROM (SELECT {pairs(f'{a}, {b}')} AS t, {pairs(a)} AS p, {pairs(b)} AS q, (SELECT count(*) * (count(*) - 1) / 2.0 FROM {src}) AS n))"


_STARTS = ", ".join(f"s{k} AS (SELECT DISTINCT label AS u, (label * {k + 2} + {k}) % {3 + k % 2} AS c FROM raster)" for k in range(4))
_BOTH = ", ".join(f"b{i}{j} AS (SELECT x.c AS a, y.c AS b FROM s{i} x JOIN s{j} y USING (u))" for i in range(4) for j in range(i + 1, 4))


@query("starts_agreement", f"WITH {_STARTS}, {_BOTH}, r AS (" + " UNION ALL ".join(f"SELECT {_ari(f'b{i}{j}', 'a', 'b')} AS v" for i in range(4) for j in range(i + 1, 4)) + ") SELECT median(v) AS ari_median, min(v) AS ari_min, count(*) AS n_pairs FROM r", "ari_median ari_min")
def _(s, d):
    units = raster(s, d).select(F.col("label").alias("unit")).distinct()
    return S.starts_agreement(units.select("unit", F.explode(F.array(*(F.struct(F.lit(k).alias("start"), ((F.col("unit") * (k + 2) + k) % (3 + k % 2)).alias("cluster")) for k in range(4)))).alias("e")).select("unit", "e.*"))


_FIELD = "fp AS (SELECT plot, grp % 4 AS district, unit, typ, (plot * 7 % 5 + coalesce(unit, 0)) % 3 AS field, px, py FROM plots)"


def _field(s, d):
    return plots(s, d).select("plot", (F.col("grp") % 4).alias("district"), "unit", "typ", ((F.col("plot") * 7 % 5 + F.coalesce("unit", F.lit(0))) % 3).alias("field"), "px", "py")


@query("drawing_statistic", f"WITH {_FIELD}, u AS (SELECT field AS a, unit AS b FROM fp WHERE unit IS NOT NULL) SELECT {_ari('u', 'a', 'b')} AS ari_drawing", "ari_drawing")
def _(s, d):
    return S.drawing_statistic(_field(s, d), "field", "unit")


@query("labelling_statistic", f"WITH {_FIELD}, u AS (SELECT district, field AS a, typ AS b FROM fp WHERE typ IS NOT NULL), t AS (SELECT district, sum(c * (c - 1) / 2.0) AS t FROM (SELECT district, count(*) AS c FROM u GROUP BY district, a, b) GROUP BY district), p AS (SELECT district, sum(c * (c - 1) / 2.0) AS p FROM (SELECT district, count(*) AS c FROM u GROUP BY district, a) GROUP BY district), q AS (SELECT district, sum(c * (c - 1) / 2.0) AS q FROM (SELECT district, count(*) AS c FROM u GROUP BY district, b) GROUP BY district), n AS (SELECT district, count(*) * (count(*) - 1) / 2.0 AS n FROM u GROUP BY district) SELECT sum(t - p * q / n) / nullif(sum((p + q) / 2 - p * q / n), 0) AS ari_labelling FROM t JOIN p USING (district) JOIN q USING (district) JOIN n USING (district) WHERE n > 0", "ari_labelling")
def _(s, d):
    return S.labelling_statistic(_field(s, d), "field", "typ", "district")


_DISTRICT = " UNION ALL ".join(f"SELECT {_ari(f't{k}', 'a', 'b')} AS v, (SELECT count(*) FROM t{k}) AS w, (SELECT count(DISTINCT a) FROM t{k}) AS k" for k in range(4))


@query("field_scores", f"WITH {_FIELD}, u AS (SELECT *, district * 1000 + unit AS sk FROM fp WHERE unit IS NOT NULL), m AS (SELECT * FROM u WHERE sk IN (SELECT sk FROM u GROUP BY sk HAVING count(*) > 1)), " + ", ".join(f"t{k} AS (SELECT field AS a, typ AS b FROM u WHERE typ IS NOT NULL AND district = {k})" for k in range(4)) + f", dd AS ({_DISTRICT}), far AS (SELECT x.field = y.field AS sf, CASE WHEN x.typ = y.typ THEN 1.0 ELSE 0 END AS st FROM u x JOIN u y ON x.district = y.district AND x.plot < y.plot AND x.typ IS NOT NULL AND y.typ IS NOT NULL AND sqrt((x.px - y.px) ** 2 + (x.py - y.py) ** 2) > 300) SELECT {_ari('u', 'sk', 'field')} AS delin_all, {_ari('m', 'sk', 'field')} AS delin_multi, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM u GROUP BY sk, field)) / (SELECT nullif(sum(c * (c - 1) / 2.0), 0) FROM (SELECT count(*) AS c FROM u GROUP BY sk)) AS prec, (SELECT sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) FROM dd WHERE w >= 2 AND k >= 2) AS lab_wmean, (SELECT avg(CASE WHEN sf THEN st END) - avg(CASE WHEN NOT sf THEN st END) FROM far) AS far_gap", "delin_all delin_multi prec lab_wmean far_gap")
def _(s, d):
    return S.field_scores(_field(s, d), "plot", "district", "unit", "typ", "field", I.planar_distance("px", "py"), 300.0)


@query("label_shuffle")
def _(s, d):
    return S.shuffle_p(_pairs(s, d, 16).where("claim >= 0 AND band >= 0"), F.col("claim") == 0, "fd", ["band"], 99, 11, ["plot_a", "plot_b"])


@query("rotation_draws")
def _(s, d):
    return S.rotation_draws(plots(s, d).withColumnsRenamed({"px": "x", "py": "y"}), "plot", "grp", lambda x, y: (x > -2000) & (x < 3000) & (y > -2000) & (y < 3000), 5, 3)


@query("synthetic_plots")
def _(s, d):
    return S.synthetic_plots(s, 267, 20, 1.0, 5)


@query("arm_difference")
def _(s, d):
    p = plots(s, d).where("unit IS NOT NULL").withColumn("arm", F.col("unit") % 2)
    sums = p.groupBy("grp", "arm").agg(F.sum("h").alias("a"), F.count("*").alias("b"))
    return S.arm_difference(I.bootstrap_groups(p, "grp", 20, 5), sums, "grp", "arm", "a", "b")


_SUPER = "sp AS (SELECT a.plot AS plot_a, b.plot AS plot_b, CAST(CASE WHEN a.unit IS NULL OR b.unit IS NULL THEN -1 WHEN a.unit = b.unit THEN 0 WHEN a.typ IS NULL OR b.typ IS NULL OR a.grp % 3 <> b.grp % 3 THEN 3 WHEN a.typ = b.typ THEN 1 ELSE 2 END AS INTEGER) AS claim FROM plots a JOIN plots b ON a.plot < b.plot)"


def _super(s, d):
    p = I.plot_pairs(plots(s, d).withColumn("sup", F.col("grp") % 3), "plot", ["unit", "typ", "sup"])
    return I.with_claims(p, "unit", "typ", "sup")


@query("pair_claims_super", f"WITH {_SUPER} SELECT * FROM sp")
def _(s, d):
    return _super(s, d).select("plot_a", "plot_b", "claim")


@query("claim_dissimilarity", f"WITH {_SUPER} SELECT plot_a, plot_b, CAST(CASE WHEN claim = 0 THEN 0 WHEN claim > 0 THEN 1 END AS DOUBLE) AS stand, CAST(CASE WHEN claim IN (0, 1) THEN 0 WHEN claim = 2 THEN 1 END AS DOUBLE) AS type FROM sp", "stand type")
def _(s, d):
    return _super(s, d).select("plot_a", "plot_b", B.stand_dissimilarity("claim").alias("stand"), B.type_dissimilarity("claim").alias("type"))


@query("pooled_anosim", f"WITH {_PAIR}, rk AS (SELECT grp, claim = 0 AS s, rank() OVER (PARTITION BY grp ORDER BY fd) + (count(*) OVER (PARTITION BY grp, fd) - 1) / 2 AS r FROM pr WHERE claim >= 0), e AS (SELECT grp, avg(CASE WHEN NOT s THEN r END) - avg(CASE WHEN s THEN r END) AS gap, count(CASE WHEN s THEN 1 END) AS w, count(*) AS n FROM rk GROUP BY grp HAVING count(CASE WHEN s THEN 1 END) BETWEEN 1 AND count(*) - 1) SELECT sum(w * (n - w) / n * gap / (n / 2)) / sum(w * (n - w) / n) AS r, count(*) AS n_strata FROM e", "r")
def _(s, d):
    return I.pooled_anosim(_pairs(s, d).where("claim >= 0"), "fd", F.col("claim") == 0, ["grp"])


@query("nested_permanova", "WITH u AS (SELECT grp, unit, h FROM plots WHERE unit IS NOT NULL), s AS (SELECT sum(v) AS sst, sum(n) AS n, count(*) AS k FROM (SELECT var_pop(h) * count(*) AS v, count(*) AS n FROM u GROUP BY grp)), c AS (SELECT sum(v) AS ssw, count(*) AS a FROM (SELECT var_pop(h) * count(*) AS v FROM u GROUP BY grp, unit)) SELECT CASE WHEN a > k AND n > a THEN ((sst - ssw) / (a - k)) / nullif(ssw / (n - a), 0) END AS pseudo_f, (sst - ssw) / nullif(sst, 0) AS r2, CAST(a - k AS BIGINT) AS df_among, CAST(n - a AS BIGINT) AS df_within FROM s, c", "pseudo_f r2", 5)
def _(s, d):
    p = plots(s, d)
    pairs = I.plot_pairs(p, "plot", ["h", "unit"], ["grp"]).withColumn("fd", I.field_distance(["h"]))
    return I.nested_permanova(p, pairs, "plot", "fd", "unit", "grp")


_MATCH = "lay AS (SELECT y, x, label AS a, CASE WHEN kind > 0 THEN (y // 11) * 100 + x // 9 END AS b FROM raster), na AS (SELECT a, count(*) AS na, CAST(floor(avg(y) + 0.5) AS BIGINT) AS y, CAST(floor(avg(x) + 0.5) AS BIGINT) AS x FROM lay GROUP BY a), nb AS (SELECT b, count(*) AS nb, CAST(floor(avg(y) + 0.5) AS BIGINT) AS y, CAST(floor(avg(x) + 0.5) AS BIGINT) AS x FROM lay WHERE b IS NOT NULL GROUP BY b), ca AS (SELECT na.a, lay.b FROM na JOIN lay USING (y, x) WHERE lay.b IS NOT NULL), cb AS (SELECT lay.a, nb.b FROM nb JOIN lay USING (y, x)), mt AS (SELECT c.a, c.b, n, na, nb, 1 - n / na AS o, 1 - n / nb AS u FROM (SELECT a, b, count(*) AS n FROM lay WHERE b IS NOT NULL GROUP BY ALL) c JOIN na USING (a) JOIN nb USING (b) WHERE 2 * n > na OR 2 * n > nb OR (c.a, c.b) IN (SELECT (a, b) FROM ca) OR (c.a, c.b) IN (SELECT (a, b) FROM cb)), md AS (SELECT *, sqrt((o * o + u * u) / 2) AS dd FROM mt)"


def _layers(s, d):
    return raster(s, d).withColumn("other", F.when(F.col("kind") > 0, F.expr("(y DIV 11) * 100 + x DIV 9")))


@query("matched_units", f"WITH {_MATCH} SELECT a, b, n, na, nb, o AS \"over\", u AS under, dd AS d FROM md", "\"over\" under d")
def _(s, d):
    return C.matched_units(_layers(s, d), "label", "other")


@query("accuracy_summary", f"WITH {_MATCH}, r AS (SELECT a, na AS w, coalesce(o, 1) AS o, u, dd, o IS NULL AS miss FROM na LEFT JOIN (SELECT a, avg(o) AS o, avg(u) AS u, avg(dd) AS dd FROM md GROUP BY a) USING (a)), z AS (SELECT avg(o) AS \"over\", avg(u) AS under, avg(dd) AS d, count(*) AS n_pairs FROM md), y AS (SELECT avg(o) AS over_per_reference, sum(o * w) / sum(w) AS over_area_weighted, avg(u) AS under_per_reference, sum(u * w) / sum(CASE WHEN u IS NOT NULL THEN w END) AS under_area_weighted, avg(dd) AS d_per_reference, sum(dd * w) / sum(CASE WHEN dd IS NOT NULL THEN w END) AS d_area_weighted, count(*) AS n_references, count(CASE WHEN miss THEN 1 END) AS n_unmatched_references FROM r) SELECT z.*, y.*, (SELECT count(DISTINCT b) FROM lay) AS n_stands FROM z, y", "\"over\" under d over_per_reference over_area_weighted under_per_reference under_area_weighted d_per_reference d_area_weighted")
def _(s, d):
    px = _layers(s, d)
    return C.accuracy_summary(px, C.matched_units(px, "label", "other"), "label", "other")


_EDGES = "ea AS (SELECT DISTINCT a.y, a.x FROM lay a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) LEFT JOIN lay b ON b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE b.{0} IS NULL OR b.{0} <> a.{0})"


@query("boundary_match", f"WITH lay AS (SELECT y, x, label AS a, (y // 9) * 100 + x // 8 AS b FROM raster), {_EDGES.format('a')}, {_EDGES.format('b').replace('ea AS', 'eb AS', 1)}, s AS (SELECT (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM eb WHERE (eb.y - ea.y) ** 2 + (eb.x - ea.x) ** 2 <= 1) THEN 1.0 ELSE 0 END) FROM ea) AS precision, (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM ea WHERE (eb.y - ea.y) ** 2 + (eb.x - ea.x) ** 2 <= 1) THEN 1.0 ELSE 0 END) FROM eb) AS recall) SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f FROM s".replace("EXISTS (SELECT 1 FROM eb WHERE (eb.y - ea.y) ** 2 + (eb.x - ea.x) ** 2 <= 1)", "(ea.y, ea.x) IN (SELECT (eb.y + m.dy, eb.x + m.dx) FROM eb, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) m(dy, dx))").replace("EXISTS (SELECT 1 FROM ea WHERE (eb.y - ea.y) ** 2 + (eb.x - ea.x) ** 2 <= 1)", "(eb.y, eb.x) IN (SELECT (ea.y + m.dy, ea.x + m.dx) FROM ea, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) m(dy, dx))"), "precision recall f")
def _(s, d):
    r = raster(s, d).withColumn("other", F.expr("(y DIV 9) * 100 + x DIV 8"))
    return C.boundary_match(r, "label", "other", 1)


@query("type_changes", "SELECT label % 3 AS old, label * 2 % 3 AS new, count(*) AS n, count(CASE WHEN label % 3 <> label * 2 % 3 THEN 1 END) AS n_changed FROM (SELECT DISTINCT label FROM raster) GROUP BY ALL")
def _(s, d):
    return S.type_changes(raster(s, d).select("label").distinct().select((F.col("label") % 3).alias("o"), (F.col("label") * 2 % 3).alias("n")), "o", "n")


@query("mismatch_examples", f"WITH {_OVER} SELECT a, b, n FROM ov WHERE n <> na OR n <> nb ORDER BY n DESC, a, b LIMIT 20")
def _(s, d):
    return S.mismatches(_over(s, d), 20)


@query("added_reports", "WITH p AS (SELECT kind, count(*) AS n_pixels, count(DISTINCT label) AS n_old, avg(m) AS iou FROM raster GROUP BY kind) SELECT CAST(sum(n_pixels) AS BIGINT) AS n_pixels, CAST(sum(n_old) AS BIGINT) AS n_old, sum(iou * n_pixels) / sum(n_pixels) AS iou FROM p", "iou")
def _(s, d):
    p = raster(s, d).groupBy("kind").agg(F.count("*").alias("n_pixels"), F.count_distinct("label").alias("n_old"), F.avg("m").alias("iou"))
    return S.add_reports(p, ["n_pixels", "n_old"], ["iou"], "n_pixels")


@query("common_pixels", "SELECT y, x, label AS a, kind AS b, m AS c FROM raster WHERE kind < 5 AND m > 2 AND (y + x) % 3 > 0", "c")
def _(s, d):
    r = raster(s, d)
    one = lambda test, value, name: r.select("y", "x", F.when(test, F.col(value)).alias(name))
    return S.common_pixels([one(F.col("kind") < 5, "label", "a"), one(F.col("m") > 2, "kind", "b"), one((F.col("y") + F.col("x")) % 3 > 0, "m", "c")], ["a", "b", "c"])


@query("part_gaps", "WITH b AS (SELECT plot % 6 AS part, min(px) AS x0, min(py) AS y0, min(px) + 3 AS x1, min(py) + 3 AS y1 FROM plots GROUP BY ALL) SELECT min(sqrt(greatest(p.x0 - q.x1, q.x0 - p.x1, 0) ** 2 + greatest(p.y0 - q.y1, q.y0 - p.y1, 0) ** 2)) AS gap, count(*) AS n_pairs FROM b p JOIN b q ON p.part < q.part", "gap")
def _(s, d):
    b = plots(s, d).groupBy((F.col("plot") % 6).alias("part")).agg(F.min("px").alias("x0"), F.min("py").alias("y0"), (F.min("px") + 3).alias("x1"), (F.min("py") + 3).alias("y1"))
    return S.roi_gap(b, "part")


@query("band_summary", "SELECT 'v' AS band, count(v) AS n_valid, count(*) - count(v) AS n_missing, min(v) AS min, avg(v) AS mean, max(v) AS max FROM raster UNION ALL SELECT 'odd', count(o), count(*) - count(o), min(o), avg(o), max(o) FROM (SELECT CASE WHEN kind % 2 = 1 THEN CAST(m AS DOUBLE) END AS o FROM raster)", "min mean max", 4)
def _(s, d):
    return S.band_summary(raster(s, d).withColumn("odd", F.when(F.col("kind") % 2 == 1, F.col("m"))), ["v", "odd"])


@query("named_attributes", "SELECT label AS stand_lbl, CAST(count(*) AS BIGINT) AS n_pixels, avg(x) AS centroid_lon FROM raster GROUP BY label", "centroid_lon")
def _(s, d):
    u = raster(s, d).groupBy("label").agg(F.count("*").alias("count"), F.avg("x").alias("lon"), F.max("kind").alias("_sort_key"))
    return S.named(u, {"label": "stand_lbl", "count": "n_pixels", "lon": "centroid_lon"}, ["_sort_key"])


@query("exhaustive_torus", "WITH g AS (SELECT y, x, kind FROM raster), z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM g), t AS (SELECT (q.y - p.y + h) % h AS dr, (q.x - p.x + w) % w AS dc, avg(CASE WHEN p.kind = q.kind THEN 1.0 ELSE 0 END) AS s FROM g p, g q, z GROUP BY 1, 2), o AS (SELECT s AS observed FROM t WHERE dr = 0 AND dc = 0) SELECT CAST(0 AS BIGINT) AS g, observed, count(CASE WHEN s > observed + 1e-9 THEN 1 END) AS n_greater, count(CASE WHEN s < observed - 1e-9 THEN 1 END) AS n_less, count(CASE WHEN abs(s - observed) <= 1e-9 THEN 1 END) AS n_equal FROM t, o WHERE dr > 0 OR dc > 0 GROUP BY observed", "observed")
def _(s, d):
    g = raster(s, d)
    height, width = g.agg(F.max("y") + 1, F.max("x") + 1).first()
    return S.torus_test(S.torus_counts(g.select(F.col("y").alias("row"), F.col("x").alias("col"), F.col("kind").alias("a"), F.col("kind").alias("b")), int(height or 0), int(width or 0)))


@query("focal_percentiles", "SELECT a.y, a.x, quantile_cont(b.v, 0.25) AS p25, quantile_cont(b.v, 0.75) AS p75 FROM raster a JOIN raster b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4 GROUP BY ALL", "p25 p75", 4)
def _(s, d):
    return G.focal(raster(s, d), "v", G.disc(2), [F.percentile("v", F.lit(0.25)).alias("p25"), F.percentile("v", F.lit(0.75)).alias("p75")])


@query("great_circle", "WITH p AS (SELECT plot, grp, radians(py / 20 - 25) AS la, radians(px / 10 - 50) AS lo FROM plots) SELECT a.plot AS plot_a, b.plot AS plot_b, 2 * 6371008.8 * asin(sqrt(sin((b.la - a.la) / 2) ** 2 + cos(a.la) * cos(b.la) * sin((b.lo - a.lo) / 2) ** 2)) AS metres FROM p a JOIN p b ON a.grp = b.grp AND a.plot < b.plot", "metres", 2)
def _(s, d):
    p = plots(s, d).select("plot", "grp", (F.col("py") / 20 - 25).alias("lat"), (F.col("px") / 10 - 50).alias("lon"))
    return I.plot_pairs(p, "plot", ["lat", "lon"], ["grp"]).select("plot_a", "plot_b", I.great_circle("lat", "lon").alias("metres"))


@query("priority_class", "SELECT y, x, CAST(CASE WHEN m = 12 THEN 80 WHEN kind IN (2, 3, 5) THEN kind ELSE 0 END AS INTEGER) AS c FROM raster")
def _(s, d):
    return raster(s, d).select("y", "x", B.priority_class("kind", [2, 3, 5], F.col("m") == 12).alias("c"))


@query("tree_structure", "WITH t AS (SELECT pixel, sum(qty * price) / sum(price) AS h, sum(price) AS a, count(*) AS n FROM obs WHERE flag = 'A' AND pixel % 7 > 0 GROUP BY pixel) SELECT DISTINCT pixel, coalesce(h, 0) AS tree_height, coalesce(a, 0) AS tree_area, coalesce(n, 0) AS n_tree_rows FROM obs LEFT JOIN t USING (pixel)", "tree_height tree_area", 4)
def _(s, d):
    o = observations(s, d).withColumn("habit", F.when((F.col("flag") == "A") & (F.col("pixel") % 7 > 0), " Tree").otherwise("shrub"))
    return T.tree_structure(o, o, "pixel", "habit", "qty", "price")


@query("suffixed_join", "SELECT a.label, a.v AS v_old, b.v AS v_new, b.n FROM (SELECT label, avg(v) AS v FROM raster GROUP BY label) a JOIN (SELECT label, max(v) AS v, count(*) AS n FROM raster WHERE kind < 3 GROUP BY label) b USING (label)", "v_old v_new", 4)
def _(s, d):
    r = raster(s, d)
    return J.suffixed(r.groupBy("label").agg(F.avg("v").alias("v")), r.where("kind < 3").groupBy("label").agg(F.max("v").alias("v"), F.count("*").alias("n")), ["label"])


@query("log10_deskew", "WITH t AS (SELECT c_custkey AS id, exp(c_acctbal / 1500) AS a, c_acctbal AS b, exp(c_acctbal / 1500) AS c FROM customer) SELECT id, log10(greatest(a, 0) + 1) AS a, b, c FROM t", "a b c", 5)
def _(s, d):
    t = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.exp(F.col("c_acctbal") / 1500).alias("a"), F.col("c_acctbal").alias("b"), F.exp(F.col("c_acctbal") / 1500).alias("c"))
    return U.log10_deskew(t, ["a", "b", "c"], ["c"])


@query("log10_named", "SELECT c_custkey AS id, c_acctbal AS a, CASE WHEN c_acctbal + 0.001 > 0 THEN log10(c_acctbal + 0.001) END AS a_log FROM customer", "a a_log")
def _(s, d):
    return U.log10_shifted(read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a")), ["a"])


@query("class_composition", "SELECT label, kind, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY label), 1) AS percent FROM raster GROUP BY label, kind", "percent")
def _(s, d):
    return U.class_composition(raster(s, d), "label", "kind")


@query("cluster_count_score", "SELECT CAST(kind AS BIGINT) AS k, (var_samp(v / 1000) + var_samp(m)) / 2 AS score FROM raster GROUP BY kind", "score", 4)
def _(s, d):
    return U.cluster_count_score(raster(s, d).select(F.col("kind").alias("k"), (F.col("v") / 1000).alias("v"), "m"), "k", ["v", "m"])


@query("merge_kinds", "SELECT y, x, CAST(CASE WHEN kind % 2 > 0 THEN 3 WHEN kind % 3 > 0 THEN 2 WHEN m > 6 THEN 1 ELSE 0 END AS INTEGER) AS k FROM raster")
def _(s, d):
    return raster(s, d).select("y", "x", (F.col("kind") % 2).alias("f"), (F.col("kind") % 3).alias("r"), (F.col("m") > 6).cast("int").alias("p")).select("y", "x", B.merge_kind("f", "r", "p").alias("k"))


@query("moved_plots", "WITH p AS (SELECT plot, px, py, CAST(floor((1000 - py) / 30) AS INTEGER) AS \"row\", CAST(floor((px - 5) / 30) AS INTEGER) AS col FROM plots) SELECT plot, \"row\", col, 33 - \"row\" AS flip_row, 500 + (px - 500) * cos(0.3) - (py - 400) * sin(0.3) + 7 AS mx, 400 + (px - 500) * sin(0.3) + (py - 400) * cos(0.3) - 2 AS my FROM p", "mx my")
def _(s, d):
    row, col = B.row_col("px", "py", 5.0, 1000.0, 30.0)
    p = plots(s, d).select("plot", "px", "py", row.alias("row"), col.alias("col"))
    x, y = B.rigid_move("px", "py", F.lit(500.0), F.lit(400.0), F.lit(0.3), F.lit(7.0), F.lit(-2.0))
    return p.select("plot", "row", "col", B.oriented("row", "col", 34, 34, "flip_rows")[0].alias("flip_row"), x.alias("mx"), y.alias("my"))


@query("condensed_places", "SELECT a.plot AS plot_a, b.plot AS plot_b, 1000 * a.plot - a.plot * (a.plot + 1) // 2 + b.plot - a.plot - 1 AS k FROM plots a JOIN plots b ON a.grp = b.grp AND a.plot < b.plot")
def _(s, d):
    return I.plot_pairs(plots(s, d), "plot", [], ["grp"]).select("plot_a", "plot_b", B.condensed_index("plot_a", "plot_b", 1000).alias("k"))


@query("field_texts", "SELECT p_partkey AS id, array_to_string(list_slice(string_split(regexp_replace(lower(trim(p_type || '  _ ' || p_brand)), '[\\s_]+', ' ', 'g'), ' '), 1, 2), ' ') AS name, CASE WHEN p_size % 3 = 0 THEN 13.0 WHEN p_size % 3 = 1 THEN (p_size + p_size + 4) / 2.0 ELSE p_size END AS cover, 3.141592653589793 * (p_retailprice / 2) ** 2 AS area, CAST(p_size AS VARCHAR) AS id_text FROM part", "cover area", 4)
def _(s, d):
    p = read(s, d, "part").withColumn("t", F.concat("p_type", F.lit("  _ "), "p_brand"))
    p = p.withColumn("c", F.when(F.col("p_size") % 3 == 0, "2023-11-15 00:00:00").when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 4).cast("string"))).otherwise(F.col("p_size").cast("string")))
    p = p.withColumn("n", F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return p.select(F.col("p_partkey").alias("id"), B.fold_name("t").alias("name"), B.crown_midpoint("c").alias("cover"), B.basal_area("p_retailprice").alias("area"), B.id_text("n").alias("id_text"))


@query("plot_keys", "SELECT plot, printf('%.3f_%.3f', round(px / 8, 3), round(py / 8, 3)) AS key FROM plots")
def _(s, d):
    return plots(s, d).select("plot", (F.col("px") / 8).alias("a"), (F.col("py") / 8).alias("b")).select("plot", B.plot_key("a", "b", 3).alias("key"))


@query("clean_records", "SELECT ok, ln, qty FROM obs WHERE qty <= 20", "qty")
def _(s, d):
    return T.clean_trees(observations(s, d), "qty").select("ok", "ln", "qty")


@query("weighted_means", "SELECT pixel, sum(price * qty) / sum(qty) AS m FROM obs GROUP BY pixel", "m", 3)
def _(s, d):
    return observations(s, d).groupBy("pixel").agg(T.weighted_mean("price", "qty").alias("m"))


@query("one_to_one", "SELECT plot, h, unit FROM plots", "h")
def _(s, d):
    p = plots(s, d)
    return J.one_to_one(p.select("plot", "h"), p.select("plot", "unit"), "plot")


@query("lookup_names", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(s, d):
    names = read(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.lookup(read(s, d, "supplier"), names, "s_nationkey").select("s_suppkey", "n_name")


@query("merged_collections", "SELECT pixel, ts, qty, NULL AS tax FROM obs WHERE flag = 'A' UNION ALL SELECT pixel, ts, qty, tax FROM obs WHERE flag = 'R'", "qty tax")
def _(s, d):
    o = observations(s, d)
    return L.merge_collections(o.where("flag = 'A'").select("pixel", "ts", "qty"), o.where("flag = 'R'").select("pixel", "ts", "qty", "tax")).select("pixel", "ts", "qty", "tax")


@query("units_lost", "SELECT label, greatest(count(*) - count(CASE WHEN kind < 5 THEN 1 END), 0) AS no_centre, greatest(count(CASE WHEN kind < 5 THEN 1 END) - count(CASE WHEN kind < 3 THEN 1 END), 0) AS no_row FROM raster GROUP BY label")
def _(s, d):
    u = raster(s, d).groupBy("label").agg(F.count("*").alias("a"), F.count_if(F.col("kind") < 5).alias("b"), F.count_if(F.col("kind") < 3).alias("c"))
    return u.select("label", *(c.alias(k) for k, c in Z.units_lost(F.col("a"), F.col("b"), F.col("c")).items()))


@query("class_indicator", "SELECT pixel, avg(CASE WHEN flag IN ('A', 'R') THEN 1.0 ELSE 0 END) AS share, count(qty) AS n FROM obs GROUP BY pixel", "share")
def _(s, d):
    return observations(s, d).groupBy("pixel").agg(F.avg(B.class_flag("flag", ["A", "R"])).alias("share"), F.count("qty").alias("n"))


@query("robust_spread", "SELECT coalesce(nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), nullif(stddev_samp(v), 0), 1) AS v, coalesce(nullif(quantile_cont(o, 0.75) - quantile_cont(o, 0.25), 0), nullif(stddev_samp(o), 0), 1) AS o, CAST(1 AS DOUBLE) AS flat FROM (SELECT v, CASE WHEN kind = 0 AND m < 3 THEN 1.0 ELSE 0 END AS o FROM raster)", "v o flat", 4)
def _(s, d):
    return U.robust_spread(raster(s, d).select("v", F.when((F.col("kind") == 0) & (F.col("m") < 3), 1.0).otherwise(0.0).alias("o"), F.lit(3.0).alias("flat")), ["v", "o", "flat"])
