"""Queries of the collection and zonal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import collection as C
from ..operators import fieldtables as T
from ..operators import zonal as Z
from .base import observations, plots, query, raster, read

P = ["pixel"]


@query("filter_dates_months", "SELECT pixel, count(*) AS n FROM obs WHERE ts >= DATE '1997-01-01' AND ts < DATE '2000-01-01' AND month(ts) BETWEEN 2 AND 4 GROUP BY pixel")
def _(s, d):
    return C.within_months(C.within_dates(observations(s, d), "ts", "1997-01-01", "1999-12-31"), "ts", 2, 4).groupBy("pixel").agg(F.count("*").alias("n"))


@query("filter_metadata", "SELECT flag, count(*) AS n FROM obs WHERE discount <= 0.05 AND ln = 2 GROUP BY flag")
def _(s, d):
    return C.with_metadata(observations(s, d), {"discount": 0.05}, {"ln": 2}).groupBy("flag").agg(F.count("*").alias("n"))


@query("mask_classes", "SELECT pixel, count(*) AS n, count(CASE WHEN flag NOT IN ('R') THEN price END) AS n_valid, avg(CASE WHEN flag NOT IN ('R') THEN price END) AS price FROM obs GROUP BY pixel", "price")
def _(s, d):
    return C.mask_classes(observations(s, d), ["price"], "flag", ["R"]).groupBy("pixel").agg(F.count("*").alias("n"), F.count("price").alias("n_valid"), F.avg("price").alias("price"))


@query("composite_median", "SELECT pixel, quantile_cont(price, 0.5) AS price_median, quantile_cont(tax, 0.5) AS tax_median FROM obs GROUP BY pixel", "price_median tax_median")
def _(s, d):
    return C.composite(observations(s, d), P, ["price", "tax"])


@query("composite_p25", "SELECT pixel, quantile_cont(price, 0.25) AS price_p25 FROM obs GROUP BY pixel", "price_p25")
def _(s, d):
    return C.composite(observations(s, d), P, ["price"], "p25")


@query("percentiles_contrast", "WITH q AS (SELECT pixel, quantile_cont(qty, 0.1) AS qty_p10, quantile_cont(qty, 0.5) AS qty_p50, quantile_cont(qty, 0.9) AS qty_p90, quantile_cont(tax, 0.1) AS tax_p10, quantile_cont(tax, 0.5) AS tax_p50, quantile_cont(tax, 0.9) AS tax_p90 FROM obs GROUP BY pixel) SELECT *, qty_p90 - qty_p10 AS qty_iqr, tax_p90 - tax_p10 AS tax_iqr, qty_p50 - tax_p50 AS contrast FROM q", "qty_p10 qty_p50 qty_p90 tax_p10 tax_p50 tax_p90 qty_iqr tax_iqr contrast")
def _(s, d):
    return C.contrast(C.percentiles(observations(s, d), P, ["qty", "tax"]), "qty", "tax")


@query("years_mean", "SELECT pixel, avg(m) AS price FROM (SELECT pixel, year, avg(price) AS m FROM obs GROUP BY pixel, year) GROUP BY pixel", "price")
def _(s, d):
    yearly = observations(s, d).groupBy("pixel", "year").agg(F.avg("price").alias("price"))
    return C.collapse_years(yearly, P, ["price"])


@query("climatology", "SELECT pixel, sum(qty) / 6.0 AS qty_per_year FROM obs WHERE ts >= DATE '1995-01-01' AND ts < DATE '2000-12-31' GROUP BY pixel", "qty_per_year")
def _(s, d):
    return C.climatology(C.within_dates(observations(s, d), "ts", "1995-01-01", "2000-12-31", end_inclusive=False), P, "qty", 1995, 2000)


@query("observation_counts", "SELECT pixel, count(CASE WHEN flag <> 'N' THEN price END) AS price_obs_count FROM obs GROUP BY pixel")
def _(s, d):
    return C.counts(C.mask_classes(observations(s, d), ["price"], "flag", ["N"]), P, ["price"])


_YEARS = "y AS (SELECT pixel, year, CAST(CASE WHEN count(*) < 20 AND year % 3 = 0 THEN NULL ELSE avg(discount) > 0.05 END AS INTEGER) AS h FROM obs GROUP BY pixel, year)"


def _yearly_flags(s, d):
    return observations(s, d).groupBy("pixel", "year").agg(F.when((F.count("*") < 20) & (F.col("year") % 3 == 0), None).otherwise((C.steady_mean("discount") > 0.05).cast("int")).alias("h"))


@query("majority_vote", f"WITH {_YEARS} SELECT pixel, count(h) AS n_years, CAST(sum(h) AS BIGINT) AS n_votes, CAST(CASE WHEN 2 * sum(h) > count(h) THEN 1 WHEN 2 * sum(h) < count(h) THEN 0 ELSE arg_max(h, year) FILTER (h IS NOT NULL) END AS INTEGER) AS habitat FROM y GROUP BY pixel")
def _(s, d):
    return C.majority_vote(_yearly_flags(s, d), P, "year", "h")


@query("vote_with_fallback", f"WITH {_YEARS}, v AS (SELECT pixel, CASE WHEN 2 * sum(h) > count(h) THEN 1 WHEN 2 * sum(h) < count(h) THEN 0 ELSE arg_max(h, year) FILTER (h IS NOT NULL) END AS habitat FROM y WHERE pixel % 5 > 0 GROUP BY pixel), f AS (SELECT s_suppkey AS pixel, CAST(s_nationkey < 12 AS INTEGER) AS flag FROM supplier WHERE s_suppkey % 7 > 0) SELECT pixel, CAST(coalesce(habitat, flag) AS INTEGER) AS habitat, CAST(CASE WHEN habitat IS NOT NULL THEN 1 WHEN flag IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS source FROM v FULL JOIN f USING (pixel)")
def _(s, d):
    voted = C.majority_vote(_yearly_flags(s, d).where("pixel % 5 > 0"), P, "year", "h")
    back = read(s, d, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("pixel"), (F.col("s_nationkey") < 12).cast("int").alias("flag"))
    return C.habitat_with_fallback(voted, P, back, "flag")


@query("latest_valid", "SELECT pixel, max(struct_pack(ts := ts, price := price)).price AS price FROM obs WHERE flag <> 'N' GROUP BY pixel", "price")
def _(s, d):
    return C.latest_valid(C.mask_classes(observations(s, d), ["price"], "flag", ["N"]), P, "ts", ["price"]).where("price IS NOT NULL")


@query("quality_mosaic", "SELECT pixel, max(qty) AS qty, max(struct_pack(q := qty, p := price)).p AS price FROM obs GROUP BY pixel", "qty price")
def _(s, d):
    return C.quality_mosaic(observations(s, d), P, "qty", ["price"])


@query("band_variance", "SELECT pixel, var_pop(tax) AS tax_variance FROM obs GROUP BY pixel", "tax_variance", 8)
def _(s, d):
    return C.variance(observations(s, d), P, ["tax"])


@query("linear_trend", "SELECT pixel, regr_slope(qty, (epoch_us(ts) - epoch_us(TIMESTAMP '1995-01-01')) / (365.2425 * 86400e6)) AS qty_trend FROM obs GROUP BY pixel", "qty_trend")
def _(s, d):
    return C.trend(observations(s, d).withColumn("t", B.years_since("ts", "1995-01-01")), P, "qty", "t")


@query("standardised_anomaly", "WITH a AS (SELECT pixel, year, avg(qty) AS m FROM obs GROUP BY pixel, year) SELECT pixel, (max(CASE WHEN year = 1999 THEN m END) - avg(m)) / nullif(stddev_pop(m), 0) AS qty_anomaly FROM a GROUP BY pixel", "qty_anomaly", 5)
def _(s, d):
    return C.standardised_anomaly(observations(s, d), P, "year", "qty", 1999)


@query("final_run", "WITH f AS (SELECT pixel, ts, qty > 10 AS ok, max(CASE WHEN NOT (qty > 10) THEN ts END) OVER (PARTITION BY pixel) AS l FROM obs) SELECT pixel, count(CASE WHEN l IS NULL OR ts > l THEN 1 END) AS run FROM f GROUP BY pixel")
def _(s, d):
    return C.final_run(observations(s, d).withColumn("ok", F.col("qty") > 10), P, "ts", "ok")


@query("months_with_event", "SELECT pixel, count(DISTINCT CASE WHEN discount > 0.09 THEN month(ts) END) AS n_months FROM obs GROUP BY pixel")
def _(s, d):
    return C.months_with_event(observations(s, d), P, "ts", F.col("discount") > 0.09)


@query("last_event_age", "SELECT pixel, CAST(2002 - max(CASE WHEN qty = 50 THEN year END) AS INTEGER) AS age FROM obs GROUP BY pixel")
def _(s, d):
    return C.last_event_age(observations(s, d), P, "year", F.col("qty") == 50, 2002)


_MONTHLY = "g AS (SELECT p.pixel, CAST(u.m AS DATE) AS month FROM (SELECT DISTINCT pixel FROM obs) p, (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS m) u), h AS (SELECT pixel, CAST(date_trunc('month', ts) AS DATE) AS month, median(qty) AS qty_median FROM obs WHERE ln = 4 GROUP BY ALL), k AS (SELECT pixel, month, qty_median FROM g LEFT JOIN h USING (pixel, month))"


@query("monthly_median", f"WITH {_MONTHLY} SELECT pixel, CAST(month AS VARCHAR) AS month, qty_median FROM k", "qty_median")
def _(s, d):
    o = observations(s, d)
    have = o.select("pixel").distinct().join(o.where("ln = 4"), "pixel", "left")
    return C.monthly_median(have, P, "ts", "qty", "1998-01-01", "1998-12-01").withColumn("month", F.col("month").cast("string"))


@query("seasonal_mean", f"WITH {_MONTHLY} SELECT pixel, avg(CASE WHEN month(month) IN (8, 9, 10) THEN qty_median END) AS season_mean FROM k GROUP BY pixel", "season_mean")
def _(s, d):
    o = observations(s, d)
    have = o.select("pixel").distinct().join(o.where("ln = 4"), "pixel", "left")
    return C.seasonal_mean(C.monthly_median(have, P, "ts", "qty", "1998-01-01", "1998-12-01"), P, "qty_median", [8, 9, 10])


@query("class_stability", "WITH c AS (SELECT pixel, flag, count(*) AS n FROM obs GROUP BY ALL), m AS (SELECT pixel, flag, row_number() OVER (PARTITION BY pixel ORDER BY n DESC, flag) AS r FROM c) SELECT pixel, p_mean, p_std, flag AS modal_class FROM (SELECT pixel, avg(discount) AS p_mean, stddev_pop(discount) AS p_std FROM obs GROUP BY pixel) JOIN m USING (pixel) WHERE r = 1", "p_mean p_std")
def _(s, d):
    return C.class_stability(observations(s, d), P, "flag", "discount")


@query("annual_share_above", "SELECT pixel, year, avg(discount) > 0.05 AS above FROM obs GROUP BY pixel, year")
def _(s, d):
    return C.annual_share_above(observations(s, d), P, "year", "discount", 0.05)


_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '1995-01-01')) / (365.2425 * 86400e6)"


@query(
    "harmonic_single",
    f"""WITH t AS (SELECT pixel, discount AS y, cos(2 * pi() * {_T}) AS c, sin(2 * pi() * {_T}) AS s FROM obs),
    q AS (SELECT pixel, count(*) AS n, sum(c) AS sc, sum(s) AS ss, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS s2, sum(y) AS sy, sum(c * y) AS cy, sum(s * y) AS s_y, sum(y * y) AS yy FROM t GROUP BY pixel),
    z AS (SELECT *, n * (cc * s2 - cs * cs) - sc * (sc * s2 - cs * ss) + ss * (sc * cs - cc * ss) AS det FROM q),
    k AS (SELECT *, (sy * (cc * s2 - cs * cs) - sc * (cy * s2 - cs * s_y) + ss * (cy * cs - cc * s_y)) / det AS b0,
          (n * (cy * s2 - cs * s_y) - sy * (sc * s2 - cs * ss) + ss * (sc * s_y - cy * ss)) / det AS b1,
          (n * (cc * s_y - cy * cs) - sc * (sc * s_y - cy * ss) + sy * (sc * cs - cc * ss)) / det AS b2 FROM z)
    SELECT pixel, b0 AS discount_mean, sqrt(b1 * b1 + b2 * b2) AS discount_amplitude_annual, atan2(b2, b1) AS discount_phase_annual,
           greatest(yy - b0 * sy - b1 * cy - b2 * s_y, 0) / n AS discount_residual_variance, n AS discount_obs_count FROM k""",
    "discount_mean discount_amplitude_annual discount_phase_annual discount_residual_variance",
)
def _(s, d):
    return C.harmonic(observations(s, d), P, "ts", "discount", trend=False, reference="1995-01-01")


@query("harmonic_dual_trend")
def _(s, d):
    return C.harmonic(observations(s, d), P, "ts", "discount", dual=True, trend=True, reference="1995-01-01", mean_over=(1.0, 3.5))


@query("windowed_composite", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS \"end\", count(value) AS n, avg(value) AS mean, min(value) AS least, max(value) AS largest FROM events GROUP BY ALL", "mean least largest")
def _(s, d):
    from ..streaming.windows import windowed_composite

    return windowed_composite(read(s, d, "events"), "ts", ["user_id"], "value")


@query("band_indices", "SELECT ok, ln, try_cast(CASE WHEN price + tax <> 0 THEN (price - tax) / (price + tax) END AS DOUBLE) AS ndvi, price / 10000 * CASE WHEN price + tax <> 0 THEN (price - tax) / (price + tax) END AS nirv FROM obs", "ndvi nirv")
def _(s, d):
    return observations(s, d).select("ok", "ln", B.normalised_difference("price", "tax").alias("ndvi"), B.nirv("price", "tax").alias("nirv"))


@query("cyclic_parts", "SELECT y, x, sin(radians(m * 30)) AS s, cos(radians(m * 30)) AS c, CASE WHEN kind = 0 THEN 0 ELSE sin(radians(m * 30)) END AS aspect_sin, CASE WHEN kind = 0 THEN 0 ELSE cos(radians(m * 30)) END AS aspect_cos FROM raster", "s c aspect_sin aspect_cos")
def _(s, d):
    r = raster(s, d).withColumn("a", F.col("m") * 30)
    sn, cs = B.cyclic("a", True)
    a, b = B.aspect_pair("a", "kind")
    return r.select("y", "x", sn.alias("s"), cs.alias("c"), a.alias("aspect_sin"), b.alias("aspect_cos"))


@query("remap_reason", "SELECT kind, CAST(CASE kind WHEN 5 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 5 END AS INTEGER) AS reason, CAST(coalesce(kind >= 3, FALSE) AS INTEGER) AS flag, count(*) AS n FROM raster GROUP BY ALL")
def _(s, d):
    return raster(s, d).select("kind", B.remap("kind", {5: 2, 1: 3, 2: 4, 3: 4}, 5).alias("reason"), B.threshold_flag("kind", 3).alias("flag")).groupBy("kind", "reason", "flag").agg(F.count("*").alias("n"))


@query("provenance_tabulation", "WITH k AS (SELECT CAST(100 * (y % 2) + 10 * (x % 3) + kind AS INTEGER) AS key, v AS area FROM raster), a AS (SELECT key, sum(area) AS area FROM k GROUP BY key) SELECT CAST(key // 100 AS INTEGER) AS disagree, CAST(key // 10 % 10 AS INTEGER) AS source, CAST(key % 10 AS INTEGER) AS reason, area, area / sum(area) OVER (PARTITION BY key // 10 % 10) AS share FROM a", "area share", 4)
def _(s, d):
    r = raster(s, d).select((F.col("y") % 2).alias("a"), (F.col("x") % 3).alias("b"), "kind", "v").withColumn("key", B.provenance_key("a", "b", "kind").cast("int"))
    parts = B.provenance_parts("key")
    area = Z.area_by_key(r, "key", "v").select(*(c.alias(n) for n, c in parts.items()), "area")
    return Z.shares(area.withColumn("reason", F.col("reason").cast("int")), ["source"], "area")


@query("utm_zone", "SELECT c_custkey, CASE WHEN c_acctbal / 60 BETWEEN -80 AND 84 AND c_acctbal / 30 - 100 BETWEEN -180 AND 180 THEN CAST((CASE WHEN c_acctbal / 60 >= 0 THEN 32600 ELSE 32700 END) + least(floor((c_acctbal / 30 + 80) / 6) + 1, 60) AS INTEGER) END AS epsg FROM customer")
def _(s, d):
    c = read(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 30 - 100).alias("lon"), (F.col("c_acctbal") / 60).alias("lat"))
    return c.select("c_custkey", B.utm_epsg("lon", "lat").alias("epsg"))


@query("unit_means", "SELECT label, count(*) AS n_pixels, avg(v) AS v, count(v) AS v_valid, avg(CASE WHEN kind > 0 THEN m END) AS m, count(CASE WHEN kind > 0 THEN m END) AS m_valid FROM raster GROUP BY label", "v m")
def _(s, d):
    return Z.unit_means(raster(s, d).withColumn("m", F.when(F.col("kind") > 0, F.col("m"))), "label", ["v", "m"])


@query("means_on_pixels", "SELECT y, x, v - avg(v) OVER (PARTITION BY label) AS residual FROM raster", "residual", 4)
def _(s, d):
    return Z.means_on_pixels(raster(s, d), "label", ["v"]).select("y", "x", (F.col("v") - F.col("v_unit")).alias("residual"))


ZONAL_PROFILE = "SELECT kind, count(*) AS n, CAST(count(*) * 0.01 AS DOUBLE) AS ha, avg(v) AS v_mean, quantile_cont(v, 0.25) AS v_p25, quantile_cont(v, 0.5) AS v_p50, quantile_cont(v, 0.75) AS v_p75, avg(m) AS m_mean, quantile_cont(m, 0.25) AS m_p25, quantile_cont(m, 0.5) AS m_p50, quantile_cont(m, 0.75) AS m_p75 FROM raster GROUP BY kind"


@query("zonal_profile", ZONAL_PROFILE, "ha v_mean v_p25 v_p50 v_p75 m_mean m_p25 m_p50 m_p75")
def zonal_profile(s, d):
    return Z.profiles(raster(s, d), "kind", ["v", "m"])


@query("cluster_distribution", "SELECT kind, count(*) AS n, CAST(count(*) * 0.01 AS DOUBLE) AS ha, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM raster GROUP BY kind", "ha percent")
def _(s, d):
    return Z.distribution(raster(s, d), "kind")


@query("group_mode", "WITH c AS (SELECT label, kind, count(*) AS n FROM raster GROUP BY ALL) SELECT label, kind AS mode FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, kind) AS r FROM c) WHERE r = 1")
def _(s, d):
    return Z.group_mode(raster(s, d), "label", "kind")


@query("label_histogram", "SELECT label, count(*) AS n FROM raster GROUP BY label HAVING count(*) >= 60")
def _(s, d):
    return Z.histogram(raster(s, d), "label").where("n >= 60")


_EDGES = "n AS (SELECT y, x, label, lag(label) OVER h AS hb, lag(x) OVER h AS hx, lead(label) OVER h AS ha, lead(x) OVER h AS hn, lag(label) OVER w AS vb, lag(y) OVER w AS vy, lead(label) OVER w AS va, lead(y) OVER w AS vn FROM raster WINDOW h AS (PARTITION BY y ORDER BY x), w AS (PARTITION BY x ORDER BY y)), e AS (SELECT label, CASE WHEN hx = x - 1 AND hb = label THEN 0 ELSE 1 END + CASE WHEN hn = x + 1 AND ha = label THEN 0 ELSE 1 END + CASE WHEN vy = y - 1 AND vb = label THEN 0 ELSE 1 END + CASE WHEN vn = y + 1 AND va = label THEN 0 ELSE 1 END AS s FROM n), geo AS (SELECT label, count(*) AS n_pixels, count(*) * 100.0 AS area_m2, sum(s) * 10.0 AS perimeter_m FROM e GROUP BY label)"


@query("unit_geometry", f"WITH {_EDGES} SELECT label, n_pixels, CAST(area_m2 AS DOUBLE) AS area_m2, CAST(perimeter_m AS DOUBLE) AS perimeter_m, 4 * pi() * area_m2 / (perimeter_m * perimeter_m) AS compactness FROM geo", "area_m2 perimeter_m compactness")
def _(s, d):
    return Z.geometry(raster(s, d), "label")


@query("geometry_summary", "WITH u AS (SELECT c_custkey AS id, CAST(floor(c_acctbal / 100) AS DOUBLE) AS a FROM customer), r AS (SELECT a, row_number() OVER (ORDER BY a, id) - 1 AS i, count(*) OVER () AS n FROM u) SELECT min(a) AS min, max(CASE WHEN i = CAST(floor(n * 0.1) AS BIGINT) THEN a END) AS p10, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN a END) AS median, max(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN a END) AS p90, max(a) AS max, avg(a) AS mean, count(CASE WHEN a < 20 THEN 1 END) AS n_below, count(CASE WHEN a < 20 THEN 1 END) / count(*) AS share_below, sum(CASE WHEN i >= floor(n * 0.9) THEN a END) / sum(a) AS largest_decile_share FROM r", "min p10 median p90 max mean share_below largest_decile_share")
def _(s, d):
    return Z.geometry_summary(read(s, d, "customer").select(F.floor(F.col("c_acctbal") / 100).cast("double").alias("a")), "a", 20.0)


@query("explained_variance", "WITH t AS (SELECT v, m, avg(v) OVER (PARTITION BY label) AS vu, avg(m) OVER (PARTITION BY label) AS mu, avg(v) OVER () AS va, avg(m) OVER () AS ma FROM raster) SELECT count(*) AS n, 1 - sum((v - vu) ** 2) / sum((v - va) ** 2) AS v_r2, sum((v - vu) ** 2) / count(*) AS v_within_variance, 1 - sum((m - mu) ** 2) / sum((m - ma) ** 2) AS m_r2, sum((m - mu) ** 2) / count(*) AS m_within_variance FROM t", "v_r2 v_within_variance m_r2 m_within_variance", 4)
def _(s, d):
    return Z.explained_variance(raster(s, d), "label", ["v", "m"])


@query("r2_detail", "WITH g AS (SELECT s_nationkey AS g, s_acctbal AS v, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier), t AS (SELECT *, avg(v) OVER (PARTITION BY g) AS gm, avg(v) OVER () AS am FROM g WHERE c >= 2), a AS (SELECT count(*) AS n, count(DISTINCT g) AS k, sum((v - gm) ** 2) AS w, sum((v - am) ** 2) AS t FROM t) SELECT n, k, 1 - w / t AS r2, 1 - (w / t) * (n - 1) / (n - k) AS r2_adjusted, (k - 1) / (n - 1) AS r2_expected FROM a", "r2 r2_adjusted r2_expected")
def _(s, d):
    return Z.r2_detail(read(s, d, "supplier"), "s_nationkey", "s_acctbal")


@query("separation_ratio", f"WITH p AS ({ZONAL_PROFILE}), t AS (SELECT n / sum(n) OVER () AS w, v_mean AS m, (v_p75 - v_p25) / 1.349 AS s FROM p), u AS (SELECT *, sum(w * m) OVER () AS b FROM t) SELECT sqrt(sum(w * (m - b) ** 2)) / (sqrt(sum(w * (m - b) ** 2)) + sum(w * s) + 1e-9) AS separation FROM u", "separation")
def _(s, d):
    return Z.separation(zonal_profile(s, d), "n", "v_mean", "v_p25", "v_p75")


@query("z_scored_profiles", "WITH p AS (SELECT kind, avg(v) AS v_mean FROM raster GROUP BY kind) SELECT kind, (v_mean - avg(v_mean) OVER ()) / stddev_pop(v_mean) OVER () AS v_mean_z FROM p", "v_mean_z")
def _(s, d):
    return Z.z_scored(zonal_profile(s, d), ["v_mean"]).select("kind", "v_mean_z")


@query("pooled_share", "WITH u AS (SELECT label, sum(v) AS area, avg(CASE WHEN kind = 1 THEN 1.0 ELSE 0 END) AS share FROM raster GROUP BY label) SELECT sum(area * share) / sum(area) AS pooled_share FROM u", "pooled_share")
def _(s, d):
    u = raster(s, d).groupBy("label").agg(F.sum("v").alias("area"), F.avg((F.col("kind") == 1).cast("double")).alias("share"))
    return Z.pooled_share(u, "area", "share")


@query("loreys_height", "SELECT ok, sum(qty * price) / sum(price) AS loreys_height FROM obs GROUP BY ok", "loreys_height")
def _(s, d):
    return T.loreys_height(observations(s, d), "ok", "qty", "price")


@query("top5_mean", "WITH r AS (SELECT pixel, price, row_number() OVER (PARTITION BY pixel ORDER BY price DESC) AS k FROM obs) SELECT pixel, avg(price) AS top5_mean FROM r WHERE k <= 5 GROUP BY pixel", "top5_mean")
def _(s, d):
    return T.top_mean(observations(s, d), "pixel", "price")


@query("dominant_value", "WITH c AS (SELECT ok, flag, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY n DESC, flag) AS k, sum(n) OVER (PARTITION BY ok) AS t, count(*) OVER (PARTITION BY ok) AS kinds FROM c) SELECT ok, flag AS dominant, n / t AS dominance, kinds AS n_values FROM r WHERE k = 1", "dominance")
def _(s, d):
    return T.dominant(observations(s, d), "ok", "flag")


@query("plot_table", "SELECT ok, count(*) AS n_rows, avg(qty) AS value_mean, max(qty) AS value_max, median(qty) AS value_median, avg(price) AS size_mean, sum(price) AS size_sum, count(DISTINCT flag) AS n_kinds FROM obs GROUP BY ok", "value_mean value_max value_median size_mean size_sum", 4)
def _(s, d):
    return T.plot_table(observations(s, d), "ok", "qty", "price", "flag")


@query("composition", "WITH c AS (SELECT pixel, flag, sum(price) AS amount FROM obs GROUP BY ALL) SELECT pixel, flag, amount, amount / sum(amount) OVER (PARTITION BY pixel) AS share FROM c", "amount share", 4)
def _(s, d):
    return T.composition(observations(s, d), "pixel", "flag", "price")


@query("composition_json_round_trip", "WITH c AS (SELECT pixel, flag AS kind, sum(qty) AS amount FROM obs GROUP BY ALL) SELECT pixel, kind, amount, amount / sum(amount) OVER (PARTITION BY pixel) AS share FROM c", "amount share")
def _(s, d):
    return T.composition_of_map(T.composition_map(observations(s, d), "pixel", "flag", "qty"), "pixel", "amounts_json")


@query("kind_fraction", "SELECT pixel, sum(CASE WHEN flag = 'A' THEN price ELSE 0 END) / sum(price) AS fraction FROM obs GROUP BY pixel", "fraction")
def _(s, d):
    return T.kind_fraction(observations(s, d), "pixel", "flag", "price", "A")


@query("retention", "SELECT flag, count(*) AS n, count(CASE WHEN qty <= 20 THEN 1 END) AS n_kept, avg(CASE WHEN qty <= 20 THEN 1.0 ELSE 0 END) AS share FROM obs GROUP BY flag", "share")
def _(s, d):
    return T.retention(observations(s, d).withColumn("k", F.col("qty") <= 20), "flag", "k")


@query("binned_bias", "WITH b AS (SELECT CAST(CASE WHEN qty <= 0 THEN NULL WHEN qty <= 10 THEN 0 WHEN qty <= 25 THEN 1 WHEN qty <= 40 THEN 2 END AS INTEGER) AS bin, qty AS x, price / 1000 AS y FROM obs) SELECT bin, count(*) AS n, avg(x) AS x_mean, avg(y) AS y_mean, avg(y - x) AS bias FROM b WHERE bin IS NOT NULL GROUP BY bin", "x_mean y_mean bias")
def _(s, d):
    return T.binned_bias(observations(s, d).withColumn("yk", F.col("price") / 1000), "qty", "yk", [0, 10, 25, 40])


@query("quartile_classes", "WITH q AS (SELECT list_sort(list_distinct([quantile_cont(qty, 0), quantile_cont(qty, 0.25), quantile_cont(qty, 0.5), quantile_cont(qty, 0.75), quantile_cont(qty, 1)])) AS e FROM obs) SELECT CAST(greatest(len(list_filter(e, lambda z: z < qty)) - 1, 0) AS INTEGER) AS quarter, count(*) AS n, min(qty) AS lo, max(qty) AS hi FROM obs, q GROUP BY 1", "lo hi")
def _(s, d):
    return T.quartile_class(observations(s, d), "qty").groupBy("quarter").agg(F.count("*").alias("n"), F.min("qty").alias("lo"), F.max("qty").alias("hi"))


@query("fit_statistics", "SELECT flag, count(*) AS n, corr(qty, price / 1000) AS r, corr(qty, price / 1000) ** 2 AS r2, regr_slope(price / 1000, qty) AS slope, sqrt(avg((price / 1000 - qty) ** 2)) AS rmse, avg(price / 1000 - qty) AS bias FROM obs GROUP BY flag", "r r2 slope rmse bias")
def _(s, d):
    return T.fit_statistics(observations(s, d).withColumn("yk", F.col("price") / 1000), "qty", "yk", ["flag"])


@query("leave_one_out_r2")
def _(s, d):
    return T.leave_one_out(observations(s, d), "price", ["qty", "tax", "discount"])


@query("keep_first", "SELECT ok, ln, price FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY price DESC, ln) AS r FROM obs) WHERE r = 1", "price")
def _(s, d):
    return T.keep_first(observations(s, d), "ok", [F.desc("price"), "ln"]).select("ok", "ln", "price")


@query("large_groups", "SELECT plot, unit FROM plots WHERE unit IN (SELECT unit FROM plots GROUP BY unit HAVING count(*) >= 2)")
def _(s, d):
    return T.in_large_groups(plots(s, d), "unit").select("plot", "unit")


@query("group_totals_with_all", "SELECT coalesce(flag, 'all') AS flag, count(*) AS n, sum(qty) AS qty FROM obs GROUP BY ROLLUP (flag)", "qty")
def _(s, d):
    return observations(s, d).rollup("flag").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")).select(F.coalesce("flag", F.lit("all")).alias("flag"), "n", "qty")
