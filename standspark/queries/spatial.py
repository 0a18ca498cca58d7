"""Queries of the grid, graph, merging, segmentation and unit-table operators, and of joins by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import components as K
from ..operators import grid as G
from ..operators import joins as J
from ..operators import merging as M
from ..operators import segment as S
from ..operators import units as U
from .base import observations, plots, query, raster, read

_TOUCH = "t AS (SELECT a.label AS la, b.label AS lb, a.v AS va, b.v AS vb, a.kind AS ka, b.kind AS kb, a.y * 100 + a.x AS ia, b.y * 100 + b.x AS ib FROM raster a JOIN raster b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))"
_ADJ = f"{_TOUCH}, adj AS (SELECT least(la, lb) AS label_i, greatest(la, lb) AS label_j, count(*) AS n_shared FROM t WHERE la <> lb GROUP BY ALL)"


@query("region_adjacency", f"WITH {_ADJ} SELECT * FROM adj")
def _(s, d):
    return G.adjacency(raster(s, d), "label")


@query("graph_summary", f"WITH {_ADJ}, e AS (SELECT label_i AS l FROM adj UNION ALL SELECT label_j FROM adj), g AS (SELECT label, (SELECT count(*) FROM e WHERE e.l = r.label) AS d FROM (SELECT DISTINCT label FROM raster) r) SELECT count(*) AS n_regions, CAST(sum(d) / 2 AS BIGINT) AS n_edges, avg(d) AS mean_degree, count(CASE WHEN d = 0 THEN 1 END) AS n_isolated FROM g", "mean_degree")
def _(s, d):
    r = raster(s, d)
    return G.graph_summary(r.select("label"), G.adjacency(r, "label"), "label")


@query("rms_adjacent", f"WITH {_TOUCH} SELECT sqrt(avg((va - vb) ** 2)) AS rms FROM t", "rms", 4)
def _(s, d):
    return G.rms_adjacent(raster(s, d), "v")


@query("z_stack", "SELECT y, x, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v FROM raster", "v")
def _(s, d):
    return G.z_stack(raster(s, d).select("y", "x", "v"), ["v"])


@query("focal_texture", "SELECT a.y, a.x, stddev_pop(b.m) AS m_std, max(b.m) AS m_max FROM raster a JOIN raster b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL", "m_std m_max", 5)
def _(s, d):
    return G.focal_texture(raster(s, d), "m")


@query("focal_disc_mean", "SELECT a.y, a.x, avg(b.v) AS v, count(b.v) AS n FROM raster a JOIN raster b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4 GROUP BY ALL", "v", 4)
def _(s, d):
    return G.focal(raster(s, d), "v", G.disc(2), [F.avg("v").alias("v"), F.count("v").alias("n")])


@query("focal_mode", "WITH c AS (SELECT a.y, a.x, b.kind, count(*) AS n FROM raster a JOIN raster b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL) SELECT y, x, kind FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, kind) AS r FROM c) WHERE r = 1")
def _(s, d):
    return G.focal_mode(raster(s, d), "kind")


_HORN = "g AS (SELECT y, x, v / 1000 AS v FROM raster), n AS (SELECT c.y, c.x, nw.v AS a, n.v AS b, ne.v AS c_, w.v AS d, e.v AS f, sw.v AS g, s.v AS h, se.v AS i FROM g c LEFT JOIN g nw ON nw.y = c.y - 1 AND nw.x = c.x - 1 LEFT JOIN g n ON n.y = c.y - 1 AND n.x = c.x LEFT JOIN g ne ON ne.y = c.y - 1 AND ne.x = c.x + 1 LEFT JOIN g w ON w.y = c.y AND w.x = c.x - 1 LEFT JOIN g e ON e.y = c.y AND e.x = c.x + 1 LEFT JOIN g sw ON sw.y = c.y + 1 AND sw.x = c.x - 1 LEFT JOIN g s ON s.y = c.y + 1 AND s.x = c.x LEFT JOIN g se ON se.y = c.y + 1 AND se.x = c.x + 1), k AS (SELECT y, x, ((c_ + 2 * f + i) - (a + 2 * d + g)) / 80.0 AS gx, ((g + 2 * h + i) - (a + 2 * b + c_)) / 80.0 AS gy FROM n)"


@query("terrain", f"WITH {_HORN} SELECT y, x, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE (degrees(atan2(-gx, gy)) + 360) % 360 END AS aspect FROM k", "slope aspect", 5)
def _(s, d):
    return G.terrain(raster(s, d).withColumn("h", F.col("v") / 1000), "h", 10.0)


@query("distance_transform", "SELECT a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) * 10 AS distance FROM raster a LEFT JOIN (SELECT * FROM raster WHERE kind = 0 AND m = 5) b ON abs(a.y - b.y) <= 6 AND abs(a.x - b.x) <= 6 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 36 GROUP BY ALL", "distance")
def _(s, d):
    return G.distance_transform(raster(s, d), (F.col("kind") == 0) & (F.col("m") == 5), 10.0, 6)


@query("outline", "SELECT DISTINCT a.y, a.x, a.label FROM raster a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) LEFT JOIN raster b ON b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE b.label IS NULL OR b.label <> a.label")
def _(s, d):
    return G.outline(raster(s, d), "label")


@query("morans_i", f"WITH {_ADJ}, u AS (SELECT label, avg(v) - avg(avg(v)) OVER () AS z FROM raster GROUP BY label) SELECT (SELECT count(*) FROM u) / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM u) AS morans_i, (SELECT count(*) FROM u) AS n, count(*) AS n_edges FROM adj JOIN u a ON a.label = label_i JOIN u b ON b.label = label_j", "morans_i")
def _(s, d):
    r = raster(s, d)
    return G.morans_i(r.groupBy("label").agg(F.avg("v").alias("v")), G.adjacency(r, "label"), "label", "v")



def _land(s, d, connectivity=4):
    return G.pixel_links(raster(s, d), F.col("kind") < 3, F.col("y") * 100 + F.col("x"), connectivity)


@query("patches_8_capped")
def _(s, d):
    return K.patches(*_land(s, d, 8), cap=256).select("node", "component", F.col("size").cast("long").alias("size"))


RULES = M.Rules({"v": 20000.0, "m": 1.5}, min_area_ha="0.8", max_area_ha="5")


def _graph(s, d):
    r = raster(s, d)
    units = r.groupBy("label").agg(F.count("*").alias("n_pixels"), F.avg("x").alias("lon"), (-F.avg("y")).alias("lat"), F.avg("v").alias("v"), F.count("v").alias("v_valid"), F.avg("m").alias("m"), F.count("m").alias("m_valid"))
    return units.withColumnRenamed("label", "i"), G.adjacency(r, "label").toDF("i", "j", "n_shared")


@query("region_merge")
def _(s, d):
    return M.merge_regions(*_graph(s, d), RULES)


@query("merge_calibration", f"WITH {_ADJ}, u AS (SELECT label, avg(v) AS v, avg(m) AS m FROM raster GROUP BY label), e AS (SELECT abs(a.v - b.v) AS v, abs(a.m - b.m) AS m FROM adj JOIN u a ON a.label = label_i JOIN u b ON b.label = label_j), l AS (SELECT 'v' AS band, v AS d, 20000.0 AS t FROM e UNION ALL SELECT 'm', m, 1.5 FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY band) AS n FROM l) SELECT band, CAST(max(t) AS DOUBLE) AS tolerance, n, round(100 * avg(CASE WHEN d <= t THEN 1.0 ELSE 0 END), 2) AS percentile_of_tolerance, " + ", ".join(f"max(CASE WHEN r = least(CAST(floor({q} * n) AS BIGINT), n - 1) THEN d END) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9)) + " FROM o GROUP BY band, n", "tolerance percentile_of_tolerance p25 p50 p75 p90", 4)
def _(s, d):
    return M.calibrate(*_graph(s, d), RULES)


@query("merge_rule_change")
def _(s, d):
    return M.change_of_rules(*_graph(s, d), RULES, M.Rules({"v": 10000.0, "m": 0.75}, min_area_ha="0.8", max_area_ha="5"))


@query("superpixels")
def _(s, d):
    return S.superpixels(G.z_stack(raster(s, d), ["v", "m"]), ["v", "m"], 8)


@query("nearest_within_reach", "WITH a AS (SELECT plot AS k, px AS x, py AS y FROM plots WHERE plot % 2 = 0), b AS (SELECT plot AS o, px AS x, py AS y FROM plots WHERE plot % 2 = 1), j AS (SELECT k, o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dd FROM a JOIN b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 40000), m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dd, o) AS r FROM j) SELECT a.k, m.o, m.dd AS distance FROM a LEFT JOIN m ON m.k = a.k AND r = 1", "distance")
def _(s, d):
    p = plots(s, d).select("plot", F.col("px").alias("x"), F.col("py").alias("y"))
    return J.nearest_within_reach(p.where("plot % 2 = 0").withColumnRenamed("plot", "k"), p.where("plot % 2 = 1").withColumnRenamed("plot", "o"), 200.0, "k", "o")


@query("distance_band_pairs", "WITH a AS (SELECT plot AS k, px AS x, py AS y FROM plots WHERE plot % 2 = 0), b AS (SELECT plot AS o, px AS x, py AS y FROM plots WHERE plot % 2 = 1) SELECT k, o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM a JOIN b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= 100 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 250", "distance")
def _(s, d):
    p = plots(s, d).select("plot", F.col("px").alias("x"), F.col("py").alias("y"))
    return J.distance_band(p.where("plot % 2 = 0").withColumnRenamed("plot", "k"), p.where("plot % 2 = 1").withColumnRenamed("plot", "o"), 100.0, 250.0, "k", "o")


@query("disc_mean", "WITH p AS (SELECT plot, px / 10 AS x, py / 10 AS y FROM plots) SELECT p.plot, avg(v) AS v_mean, count(v) AS n FROM p LEFT JOIN raster r ON (p.x - r.x) ** 2 + (p.y - r.y) ** 2 <= 9 GROUP BY p.plot", "v_mean", 4)
def _(s, d):
    p = plots(s, d).select("plot", (F.col("px") / 10).alias("x"), (F.col("py") / 10).alias("y"))
    return J.disc_mean(p, raster(s, d).select(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "v"), 3.0, "plot", "v")


@query("point_sample", "SELECT plot, r.label, r.v FROM plots LEFT JOIN raster r ON r.y = CAST(floor(py / 10) AS BIGINT) AND r.x = CAST(floor(px / 10) AS BIGINT)", "v")
def _(s, d):
    return J.sample_raster(plots(s, d).select("plot", "px", "py"), raster(s, d), F.floor(F.col("py") / 10), F.floor(F.col("px") / 10), ["label", "v"]).select("plot", "label", "v")


@query("points_in_boxes", "WITH b AS (SELECT * FROM (VALUES (1, 0, 0, 400, 400), (2, 300, 300, 800, 700), (3, 900, 0, 1000, 900)) t(id, x0, y0, x1, y1)) SELECT plot, CAST(min(id) AS INTEGER) AS poly FROM plots LEFT JOIN b ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY plot")
def _(s, d):
    ring = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    boxes = s.createDataFrame([(1, ring(0, 0, 400, 400)), (2, ring(300, 300, 800, 700)), (3, ring(900, 0, 1000, 900))], "poly int, ring array<struct<x: double, y: double>>")
    return J.points_in_polygons(plots(s, d).select("plot", F.col("px").alias("x"), F.col("py").alias("y")), boxes, "plot", "poly", "ring", 250.0)


@query("interval_join", "WITH i AS (SELECT c_custkey AS id, c_acctbal AS lo, c_acctbal + 40 AS hi FROM customer) SELECT s_suppkey, count(*) AS n FROM supplier JOIN i ON s_acctbal >= lo AND s_acctbal < hi GROUP BY s_suppkey")
def _(s, d):
    return _in_intervals(s, d, read(s, d, "customer"))


def _in_intervals(s, d, customers):
    i = customers.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 40).alias("hi"))
    return J.ranges(read(s, d, "supplier").select("s_suppkey", "s_acctbal"), i, "s_acctbal", "lo", "hi", 40.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("mosaic_of_parts", "WITH a AS (SELECT y, x, v FROM raster WHERE y < 100), b AS (SELECT y, x, -v AS v FROM raster WHERE y >= 80) SELECT y, x, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (y, x)", "v")
def _(s, d):
    r = raster(s, d).select("y", "x", "v")
    return J.mosaic([r.where("y < 100"), r.where("y >= 80").withColumn("v", -F.col("v"))], ["y", "x"], ["v"])


@query("stacked_bands", "SELECT y, x, a.v, b.m FROM (SELECT y, x, v FROM raster WHERE kind < 5) a FULL JOIN (SELECT y, x, m FROM raster WHERE kind > 1) b USING (y, x)", "v m")
def _(s, d):
    r = raster(s, d)
    return J.stack_bands(r.where("kind < 5").select("y", "x", "v"), r.where("kind > 1").select("y", "x", "m"))


@query("labels_in_several_parts", "SELECT label, array_to_string(list_sort(list(DISTINCT p)), ',') AS parts FROM (SELECT label, 0 AS p FROM raster WHERE y < 100 UNION ALL SELECT label, 1 FROM raster WHERE y >= 90) GROUP BY label HAVING count(DISTINCT p) > 1")
def _(s, d):
    r = raster(s, d)
    return J.labels_in_several_parts([r.where("y < 100"), r.where("y >= 90")], "label").select("label", F.array_join("parts", ",").alias("parts"))


@query("group_boxes", "SELECT grp, min(px) - 5 AS x0, min(py) - 5 AS y0, max(px) + 5 AS x1, max(py) + 5 AS y1 FROM plots GROUP BY grp", "x0 y0 x1 y1")
def _(s, d):
    return J.plot_boxes(plots(s, d), "grp", 5.0, "px", "py")


_SKEW = "(avg({0} ** 3) - 3 * avg({0}) * avg({0} ** 2) + 2 * avg({0}) ** 3) / (avg({0} ** 2) - avg({0}) ** 2) ** 1.5"


@query("skewness", f"WITH t AS (SELECT pixel, qty / 50 AS a, qty * qty / 2500 AS b FROM obs) SELECT pixel, {_SKEW.format('a')} AS a_skew, {_SKEW.format('b')} AS b_skew FROM t GROUP BY pixel", "a_skew b_skew", 4)
def _(s, d):
    t = observations(s, d).select("pixel", (F.col("qty") / 50).alias("a"), (F.col("qty") * F.col("qty") / 2500).alias("b"))
    return t.groupBy("pixel").agg(U.skew("a").alias("a_skew"), U.skew("b").alias("b_skew"))


def _units(s, d):
    return raster(s, d).groupBy("label").agg(F.avg("v").alias("v"), F.avg("m").alias("m"), F.max("v").alias("top"))


@query("robust_scale", "WITH u AS (SELECT label, avg(v) AS v, avg(m) AS m FROM raster GROUP BY label), q AS (SELECT quantile_cont(v, 0.25) AS v1, quantile_cont(v, 0.5) AS v2, quantile_cont(v, 0.75) AS v3, quantile_cont(m, 0.25) AS m1, quantile_cont(m, 0.5) AS m2, quantile_cont(m, 0.75) AS m3 FROM u) SELECT label, (v - v2) / (v3 - v1) AS v, (m - m2) / (m3 - m1) AS m FROM u, q", "v m")
def _(s, d):
    return U.robust_scale(_units(s, d).select("label", "v", "m"), ["v", "m"])


@query("preprocess_abs_skew", "WITH t AS (SELECT p_partkey AS id, p_retailprice ** 3 AS a FROM part), u AS (SELECT id, ln(a - (SELECT min(a) FROM t) + 1e-3) AS a FROM t), q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.5) AS a2, quantile_cont(a, 0.75) AS a3 FROM u) SELECT id, (a - a2) / (a3 - a1) AS a FROM u, q", "a", 5)
def _(s, d):
    t = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.pow("p_retailprice", F.lit(3.0)).alias("a"))
    return U.preprocess(t, ["a"], "abs_skew", 0.0)[0]


@query("preprocess_right_skew", "WITH t AS (SELECT c_custkey AS id, exp(c_acctbal / 2000) AS a, 1.0 AS flat FROM customer), q AS (SELECT min(a) AS lo, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS w FROM t), u AS (SELECT id, ln(1 + (a - lo) / w) AS a FROM t, q), z AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.5) AS a2, quantile_cont(a, 0.75) AS a3 FROM u) SELECT id, (a - a2) / (a3 - a1) AS a FROM u, z", "a", 5)
def _(s, d):
    t = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.exp(F.col("c_acctbal") / 2000).alias("a"), F.lit(1.0).alias("flat"))
    return U.preprocess(t, ["a", "flat"], "right_skew", 0.5)[0]


@query("nearest_centre", "WITH c AS (SELECT * FROM (VALUES (0, 100000.0, 5.0), (1, 150000.0, 7.0), (2, 250000.0, 6.0)) t(i, a, b)), u AS (SELECT label, avg(v) AS v, avg(m) AS m FROM raster GROUP BY label), k AS (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY (v - a) ** 2 + (m - b) ** 2, i) AS r FROM u, c) SELECT label, CAST(i AS INTEGER) AS cluster FROM k WHERE r = 1")
def _(s, d):
    return U.nearest_centre(_units(s, d), ["v", "m"], [(100000.0, 5.0), (150000.0, 7.0), (250000.0, 6.0)]).select("label", "cluster")


@query("elbow_knee", "WITH p AS (SELECT CAST(s_suppkey AS INTEGER) + 2 AS k, 100.0 / (s_suppkey + 1) AS wcss FROM supplier), n AS (SELECT *, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS u, (wcss - min(wcss) OVER ()) / (max(wcss) OVER () - min(wcss) OVER ()) AS v FROM p), e AS (SELECT *, first_value(v) OVER (ORDER BY k) AS v0, last_value(v) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1 FROM n), dd AS (SELECT k, CAST(wcss AS DOUBLE) AS wcss, abs((v1 - v0) * u - v + v0) / sqrt(1 + (v1 - v0) ** 2) AS distance FROM e) SELECT *, row_number() OVER (ORDER BY round(distance, 12) DESC, k) = 1 AS is_knee FROM dd", "wcss distance")
def _(s, d):
    return _knee(read(s, d, "supplier"))


def _knee(suppliers):
    return U.knee(suppliers.select((F.col("s_suppkey").cast("int") + 2).alias("k"), (100.0 / (F.col("s_suppkey") + 1)).alias("wcss")))


@query("elbow_sweep")
def _(s, d):
    return U.elbow(U.robust_scale(_units(s, d), ["v", "m"]), ["v", "m"], 2, 5, 2)


@query("kmeans_types")
def _(s, d):
    u = U.robust_scale(_units(s, d), ["v", "m"])
    model, costs = U.kmeans_starts(u, ["v", "m"], 4, 3)
    return U.nearest_centre(u, ["v", "m"], [c.tolist() for c in model.clusterCenters()]).select("label", "cluster")


#: All components of the vectors, as bands.
_DIMS = [f"c{k}" for k in range(64)]
_VEC = "e AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(_DIMS)) + " FROM embeddings)"


def _vec(s, d):
    return read(s, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(_DIMS)))


def _squares(one: str, other: str) -> str:
    """SQL of the squared distance; {} stands for a component."""
    return " + ".join(f"({one.format(c)} - {other.format(c)}) ** 2" for c in _DIMS)


_MEANS = "t AS (SELECT *, " + ", ".join(f"avg({c}) OVER (PARTITION BY label) AS m{c}, avg({c}) OVER () AS a{c}" for c in _DIMS) + " FROM e)"


@query("calinski_harabasz", f"WITH {_VEC}, {_MEANS} SELECT (sum({_squares('m{}', 'a{}')}) / (count(DISTINCT label) - 1)) / (sum({_squares('{}', 'm{}')}) / (count(*) - count(DISTINCT label))) AS calinski_harabasz FROM t", "calinski_harabasz")
def _(s, d):
    return U.calinski_harabasz(_vec(s, d), "label", _DIMS)


@query("davies_bouldin", f"WITH {_VEC}, {_MEANS}, c AS (SELECT label, {', '.join(f'any_value(m{c}) AS {c}' for c in _DIMS)}, avg(sqrt({_squares('{}', 'm{}')})) AS s FROM t GROUP BY label), r AS (SELECT p.label, max((p.s + q.s) / sqrt({_squares('p.{}', 'q.{}')})) AS r FROM c p JOIN c q ON p.label <> q.label GROUP BY p.label) SELECT avg(r) AS davies_bouldin FROM r", "davies_bouldin", 4)
def _(s, d):
    return U.davies_bouldin(_vec(s, d), "label", _DIMS)


@query("silhouette", f"WITH {_VEC}, m AS (SELECT p.vec_id, p.label AS c, q.label AS o, avg(sqrt({_squares('p.{}', 'q.{}')})) AS dd FROM e p JOIN e q ON p.vec_id <> q.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN c = o THEN dd END) AS i, min(CASE WHEN c <> o THEN dd END) AS x FROM m GROUP BY vec_id) SELECT avg(CASE WHEN i IS NULL THEN 0 ELSE (x - i) / greatest(x, i) END) AS silhouette FROM s", "silhouette")
def _(s, d):
    return U.silhouette(_vec(s, d), "vec_id", "label", _DIMS)


@query("principal_components")
def _(s, d):
    return U.principal_components(_vec(s, d), _DIMS, 2).select("vec_id", F.round(F.abs(F.col("components")[0]), 5).alias("c0"))


@query("pixel_area", "SELECT c_custkey, 6371007.2 ** 2 * radians(0.01) * abs(sin(radians(c_acctbal / 120 + 0.005)) - sin(radians(c_acctbal / 120 - 0.005))) AS area FROM customer", "area", 2)
def _(s, d):
    return read(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 120).alias("lat")).select("c_custkey", B.pixel_area("lat", 0.01, 0.01).alias("area"))


_ZONE = "(sin(radians({0})) / (1 - e2 * sin(radians({0})) ** 2) + ln((1 + sqrt(e2) * sin(radians({0}))) / (1 - sqrt(e2) * sin(radians({0})))) / (2 * sqrt(e2)))"


@query("pixel_area_ellipsoid", f"WITH c AS (SELECT c_custkey, c_acctbal / 120 AS lat, (2 - 1 / 298.257223563) / 298.257223563 AS e2 FROM customer) SELECT c_custkey, 6378137.0 ** 2 * (1 - e2) / 2 * radians(0.01) * abs({_ZONE.format('(lat + 0.005)')} - {_ZONE.format('(lat - 0.005)')}) AS area FROM c", "area", 1)
def _(s, d):
    return read(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 120).alias("lat")).select("c_custkey", B.pixel_area_ellipsoid("lat", 0.01, 0.01).alias("area"))
