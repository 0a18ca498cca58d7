"""Queries of scans and sinks, settings, stages and draws: what is written to the shared folder reads back as SQL has it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import polyline
from ..operators import collection as L
from ..operators import compare as C
from ..operators import fieldtables as T
from ..operators import inference as I
from ..operators import joins as J
from ..operators import units as U
from ..operators import zonal as Z
from ..plans import config, stages
from ..plans.storage import shared_folder
from ..sources import sinks, tables
from .base import observations, plots, query, raster, read


def _place(s, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("scan_dated", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' AND l_quantity BETWEEN 5 AND 30 AND l_discount <= 0.05 AND l_linestatus = 'O'", "l_quantity")
def _(s, d):
    return tables.dated(s, f"{d}/lineitem.parquet", "l_shipdate", "1996-01-01", "1997-06-30", {"l_quantity": (5, 30)}, {"l_discount": 0.05}, {"l_linestatus": "O"}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_radar", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND (l_returnflag = 'A' OR l_linestatus = 'A') AND (l_returnflag = 'O' OR l_linestatus = 'O')")
def _(s, d):
    path = _place(s, "radar")
    read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.array("l_returnflag", "l_linestatus").alias("channels")).write.parquet(path)
    return tables.dated(s, path, "l_shipdate", "1998-01-01", "1998-12-31", contains={"channels": ["A", "O"]}).select("l_orderkey", "l_linenumber")


@query("scan_years", "SELECT year, pixel, count(*) AS n FROM obs WHERE year BETWEEN 1996 AND 1998 GROUP BY year, pixel")
def _(s, d):
    path, o = _place(s, "cover"), observations(s, d).select("year", "pixel")
    for y in range(1995, 2000):
        o.where(F.col("year") == y).select("pixel").write.parquet(f"{path}/layer_{y}_{y + 1}")
    return tables.yearly(s, path, 1996, 1998, r"layer_(\d{4})_(\d{4})/part").groupBy("year", "pixel").agg(F.count("*").alias("n"))


@query("scan_embedding", "SELECT 'one' AS span, pixel, avg(qty) AS qty FROM obs WHERE year = 1997 GROUP BY pixel UNION ALL SELECT 'several', pixel, avg(q) FROM (SELECT pixel, year, avg(qty) AS q FROM obs WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL) GROUP BY pixel", "qty")
def _(s, d):
    yearly = observations(s, d).groupBy("pixel", "year").agg(F.avg("qty").alias("qty"))
    one, several = (L.embedding(yearly, ["pixel"], ["qty"], "year", *span) for span in ((1997, 1997), (1996, 1999)))
    return one.withColumn("span", F.lit("one")).unionByName(several.withColumn("span", F.lit("several")))


@query("scan_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", "s_acctbal", 9)
def _(s, d):
    path = sinks.csv_parts(read(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), _place(s, "rows"))
    return tables.csv(s, path, "s_suppkey long, s_name string, s_acctbal double")


@query("scan_points", "SELECT 'p' || s_suppkey AS id, CAST(s_suppkey AS DOUBLE) * 0.37 % 180 AS lon, CAST(s_suppkey AS DOUBLE) * 0.11 % 80 AS lat FROM supplier", "lon lat")
def _(s, d):
    rows = read(s, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") * 0.37 % 180).alias("lon"), (F.col("s_suppkey") * 0.11 % 80).alias("lat"))
    return tables.points(s, sinks.csv_parts(rows, _place(s, "points")), "id", "lon", "lat")


@query("scan_vector", "WITH b AS (SELECT grp, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM plots GROUP BY grp) SELECT CAST(grp AS VARCHAR) AS grp, CAST(5 AS INTEGER) AS n_points, x0, y1, (x1 - x0) * (y1 - y0) AS area FROM b", "x0 y1 area", 4)
def _(s, d):
    """Boxes written as features, gathered as one collection and read again."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = J.plot_boxes(plots(s, d), "grp", 0.0, "px", "py").withColumn("ring", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")))
    lines = s.read.text(sinks.geojson_lines(boxes, "ring", ["grp"], _place(s, "features")))
    whole = lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    whole.write.text(path := _place(s, "collection"))
    r = tables.geojson(s, path, ["grp"])
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return r.select("grp", F.size("ring").alias("n_points"), F.array_min(x).alias("x0"), F.array_max(y).alias("y1"), ((F.array_max(x) - F.array_min(x)) * (F.array_max(y) - F.array_min(y))).alias("area"))


@query("sink_parquet", "SELECT kind, count(*) AS n, sum(v) AS v FROM raster GROUP BY kind", "v", 2)
def _(s, d):
    path = sinks.parquet(raster(s, d), _place(s, "asset"), ["kind"])
    assert stages.exists(s, path)
    return s.read.parquet(path).groupBy(F.col("kind").cast("long").alias("kind")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("sink_layers", "SELECT y, x, CAST(label AS INTEGER) AS label, v, v / 1000 AS z, CAST(kind AS INTEGER) AS kind FROM raster", "v z")
def _(s, d):
    px = raster(s, d).withColumn("z", F.col("v") / 1000)
    a, b, c = (s.read.parquet(p) for p in sinks.layers(px, _place(s, "layers"), "label", ["v"], ["z"], "kind"))
    # Layers of runs are small as files and large in memory: they aren't broadcast, whatever their files' size.
    return a.join(b.hint("merge"), ["y", "x"]).join(c.hint("merge"), ["y", "x"]).select("y", "x", "label", "v", "z", "kind")


@query("sink_full_precision", "SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS lost FROM lineitem", "lost", 12)
def _(s, d):
    """Values divided unevenly, as text and back: none is lost."""
    o = read(s, d, "lineitem").select((F.col("l_extendedprice") / 7).alias("v"))
    back = sinks.full_precision(o).select(F.col("v").cast("double").alias("v"))
    lost = o.exceptAll(back).agg(F.count("*").cast("double").alias("lost"))
    return back.agg(F.count("*").alias("n")).crossJoin(lost)  # one row each


@query("input_record", "SELECT count(DISTINCT event_type) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS ids FROM events")
def _(s, d):
    r = tables.record_of_inputs(read(s, d, "events"), "event_type")
    return s.createDataFrame([(r["n"], ",".join(r["ids"]))], "n long, ids string")


@query("encoded_polylines", "SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY plot) - 1 AS i, round(py / 20 - 25, 6) AS lat, round(px / 10 - 50, 6) AS lon FROM plots", "lat lon", 5)
def _(s, d):
    def there_and_back(frame):
        import pandas as pd

        frame = frame.sort_values("plot")
        points = polyline.decode(polyline.encode(list(zip(frame["lat"], frame["lon"], strict=True))))
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "i": range(len(points)), "lat": [p[0] for p in points], "lon": [p[1] for p in points]})

    p = plots(s, d).select("grp", "plot", (F.col("py") / 20 - 25).alias("lat"), (F.col("px") / 10 - 50).alias("lon"))
    return p.groupBy("grp").applyInPandas(there_and_back, "grp long, i long, lat double, lon double")


#: A configuration that sets something in every block, and what is then set besides the defaults.
SETTINGS = {
    "roi": {"name": "site", "roi_file": "site.geojson"}, "dates": {k: {"start": "2020-01-01", "end": "2021-12-31"} for k in ("phenology", "radar", "optical_composite")}, "cloud_mask": {"max_cloud_pct": 35}, "data_load": {"orbit": "DESCENDING"},
    "features_optical": {"index": "nirv", "harmonic": "dual"}, "features_radar": {"contrast": False}, "features_structure": {"kernel": 5}, "features_static": {"cap": True}, "features_embedding": {"collapse": "median"}, "masking": {"first_year": 2018}, "segmentation": {"connectivity": 4},
    "merge": {"max_area_ha": 6}, "clustering": {"k": 8, "off_engine": True}, "normalization": {"method": "robust"}, "k_elbow": {"k_max": 9}, "export": {"min_pixels": 9}, "metrics": {"n_pairs": 500},
}
_WINDOW = '{"end":"2021-12-31","start":"2020-01-01"}'
_SET = [
    ("roi", "name", '"site"'), ("roi", "roi_file", '"site.geojson"'), *(("dates", k, _WINDOW) for k in ("phenology", "radar", "optical_composite")), ("cloud_mask", "max_cloud_pct", "35"), ("data_load", "orbit", '"DESCENDING"'), ("features_optical", "index", '"nirv"'),
    ("features_optical", "harmonic", '"dual"'), ("features_radar", "contrast", "false"), ("features_structure", "kernel", "5"), ("features_static", "cap", "true"), ("features_embedding", "collapse", '"median"'), ("masking", "first_year", "2018"), ("segmentation", "connectivity", "4"),
    ("merge", "max_area_ha", "6"), ("clustering", "k", "8"), ("clustering", "off_engine", "true"), ("k_elbow", "k_max", "9"), ("export", "min_pixels", "9"), ("metrics", "n_pairs", "500"),
]


@query("config_settings", "SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{n}', '{v}')" for b, n, v in _SET) + ") t(block, name, value)")
def _(s, d):
    """Values of all blocks that differ from their defaults, after the text of a configuration is read."""
    c = config.build(config.Config, json.loads(json.dumps(SETTINGS)))
    rows = [(b, n, stages.canonical(v)) for b in SETTINGS for n, v in config.without_defaults(getattr(c, b)).items()]
    return s.createDataFrame(rows, "block string, name string, value string")


#: Defaults by block, as the configuration's users know them.
_DEFAULTS = [
    ("dates", "climate", '{"end":"2020-12-31","start":"1991-01-01"}'), ("cloud_mask", "drop_classes", "[3,8,9,10]"), ("data_load", "polarizations", '["VV","VH"]'), ("data_load", "mode", '"IW"'), ("data_load", "composite_reducer", '"median"'), ("features_optical", "trend", "true"),
    ("features_optical", "time_reference", '"2017-01-01"'), ("features_radar", "percentiles", "[10,50,90]"), ("features_radar", "iqr", "true"), ("features_structure", "neighbourhood_stats", "true"), ("features_static", "max_distance_px", "1000"), ("features_static", "climate", "true"),
    ("features_embedding", "bands", "null"), ("masking", "habitat_classes", "[6,12]"), ("masking", "fallback_classes", "[10,20,30]"), ("masking", "water_threshold", "50"), ("segmentation", "size", "10"), ("segmentation", "compactness", "0.5"), ("segmentation", "neighbourhood", "128"),
    ("merge", "relax_factor", "1.75"), ("merge", "min_area_ha", "1"), ("merge", "min_defined", "2"), ("merge", "min_frac_valid", "0.5"), ("merge", "max_sweeps", "60"), ("merge", "max_regions", "50000"), ("clustering", "seed", "42"), ("clustering", "log_rule", '"abs_skew"'),
    ("k_elbow", "k_min", "2"), ("k_elbow", "n_init", "25"), ("export", "geotiff", "true"), ("export", "vector_formats", '["shp","geojson"]'), ("metrics", "per_cluster", "833"), ("metrics", "held_out", "[]"),
]


@query("config_defaults", "SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{n}', '{v}')" for b, n, v in _DEFAULTS) + ") t(block, name, value)")
def _(s, d):
    import dataclasses

    c = config.build(config.Config, json.loads(json.dumps(SETTINGS)))
    plain = lambda v: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v
    return s.createDataFrame([(b, n, stages.canonical(plain(getattr(getattr(c, b), n)))) for b, n, _ in _DEFAULTS], "block string, name string, value string")


#: Configurations that contradict themselves.
_REFUSED = [
    ("roi", {"name": "x"}), ("dates", {k: {"start": "2021-01-02", "end": "2021-01-01"} for k in ("phenology", "radar", "optical_composite")}), ("data_load", {"orbit": "UP"}), ("features_optical", {"index": "evi"}), ("features_structure", {"kernel": 4}), ("features_embedding", {"collapse": "sum"}),
    ("segmentation", {"connectivity": 6}), ("merge", {"min_area_ha": 9, "max_area_ha": 3}), ("clustering", {"k": 1}), ("normalization", {"method": "none"}), ("k_elbow", {"k_min": 5, "k_max": 6}), ("export", {"colour": 1}), ("metrics", {"held_out": ["canopy"]}), ("cloud_mask", {"cloudy": 1}), ("features_radar", {"x": 1}), ("features_static", {"y": 2}), ("masking", {"z": 3}),
]


@query("config_refusals", f"SELECT {len(_REFUSED)} AS n_tried, {len(_REFUSED)} AS n_refused, 0 AS n_refused_without")
def _(s, d):
    refused = 0
    for block, values in _REFUSED:
        try:
            config.build(config.Config, SETTINGS | {block: values})
        except config.ConfigError:
            refused += 1
    config.build(config.Config, SETTINGS)
    return s.createDataFrame([(len(_REFUSED), refused, 0)], "n_tried int, n_refused int, n_refused_without int")


def _registry(s, d) -> stages.Registry:
    r = stages.Registry()
    r.add(stages.Stage("load", lambda s_, c, k: {"pixels": raster(s, d)}, (), ("pixels",), ("roi", "dates")))
    r.add(stages.Stage("mask", lambda s_, c, k: {"land": c["pixels"].where("kind < 3")}, ("pixels",), ("land",), ("masking",)))
    r.add(stages.Stage("means", lambda s_, c, k: {"units": Z.unit_means(c["land"], "label", ["v"]), "sizes": Z.histogram(c["land"], "label")}, ("land",), ("units", "sizes"), ("segmentation",)))
    r.add(stages.Stage("spare", lambda s_, c, k: {"unused": c["pixels"]}, ("pixels",), ("unused",), ()))
    return r


_STAGED = "SELECT run, pos, stage, n_cached FROM (VALUES ('first', 0, 'load', 0), ('first', 1, 'mask', 0), ('first', 2, 'means', 0), ('again', 0, 'load', 1), ('again', 1, 'mask', 1), ('again', 2, 'means', 2), ('changed', 0, 'load', 1), ('changed', 1, 'mask', 0), ('changed', 2, 'means', 0)) t(run, pos, stage, n_cached)"


@query("staged_runs", _STAGED)
def _(s, d):
    """Stages that wanted tables need, in order, and tables that each takes from the cache: at first, again, and after a mask setting changes."""
    cache, r = _place(s, "cache"), _registry(s, d)
    one = config.build(config.Config, SETTINGS)
    two = config.build(config.Config, SETTINGS | {"masking": {"first_year": 2019}})
    rows = []
    for name, c in (("first", one), ("again", one), ("changed", two)):
        _, manifest = stages.run(s, r, ["units", "sizes"], c, cache=cache)
        rows += [(name, k, x["stage"], len(x["cached"])) for k, x in enumerate(manifest["stages"])]
    return s.createDataFrame(rows, "run string, pos int, stage string, n_cached int")


@query("staged_result", "SELECT r.label, count(*) AS n_pixels, avg(v) AS v, count(v) AS v_valid FROM raster r WHERE kind < 3 GROUP BY r.label", "v", 2)
def _(s, d):
    context, _ = stages.run(s, _registry(s, d), ["units"], config.build(config.Config, SETTINGS), cache=_place(s, "cache"))
    return context["units"].select("label", "n_pixels", "v", "v_valid")


@query("staged_layouts", "SELECT * FROM (VALUES ('by_stage', 1, TRUE), ('flat', 1, TRUE)) t(layout, n_cached, in_place)")
def _(s, d):
    """A table is found again where its layout puts it."""
    c, r, rows = config.build(config.Config, SETTINGS), _registry(s, d), []
    for layout in ("flat", "by_stage"):
        cache = _place(s, layout)
        stages.run(s, r, ["pixels"], c, cache=cache, layout=layout)
        _, again = stages.run(s, r, ["pixels"], c, cache=cache, layout=layout)
        key = stages.step_keys(r.closure(["pixels"]), c)["load"]
        rows.append((layout, len(again["stages"][0]["cached"]), stages.exists(s, f"{cache}/load/pixels__s{key}" if layout == "by_stage" else f"{cache}/pixels__s{key}")))
    return s.createDataFrame(rows, "layout string, n_cached int, in_place boolean")


@query("harmonic_dual_normal", "SELECT pixel, count(*) AS n, TRUE AS solved FROM obs GROUP BY pixel HAVING count(*) >= 30")
def _(s, d):
    """The dual fit with a trend leaves residuals at right angles to each of its six regressors."""
    o = observations(s, d)
    terms = B.harmonic_terms(B.years_since("ts", "1995-01-01"), True, True)
    fit = L.least_squares(o, ["pixel"], "discount", terms).select("pixel", *(F.col(k).alias(f"_{k}") for k in terms))
    met = o.join(fit, "pixel").withColumns({f"x_{k}": c for k, c in terms.items()})
    fitted = sum((F.col(f"_{k}") * F.col(f"x_{k}") for k in terms), F.lit(0.0))
    met = met.withColumn("rest", F.col("discount") - fitted)
    right = F.lit(True)
    for k in terms:
        right = right & (F.abs(F.sum(F.col("rest") * F.col(f"x_{k}"))) <= 1e-8 * F.sum(F.abs("discount") * F.greatest(F.abs(f"x_{k}"), F.lit(1.0))))
    return met.groupBy("pixel").agg(F.count("*").alias("n"), right.alias("solved")).where("n >= 30")


@query("feature_importances", "SELECT CAST(1 AS DOUBLE) AS total, 'a' AS first, TRUE AS clear", "total")
def _(s, d):
    """A class that one band decides: its importance is by far the largest."""
    u = raster(s, d).select((F.col("v") > 100000).cast("int").alias("cls"), F.col("v").alias("a"), (F.col("x") % 7).cast("double").alias("b"))
    found = U.feature_importances(u, ["a", "b"], "cls", 10)
    return s.createDataFrame([(sum(i for _, i in found), found[0][0], found[0][1] > 0.8)], "total double, first string, clear boolean")


@query("step_keys", "SELECT * FROM (VALUES ('dates', 'load,mask,means'), ('masking', 'mask,means'), ('segmentation', 'means'), ('export', '')) t(block, changed)")
def _(s, d):
    """Stages whose keys change with a block of the configuration: those that read it, and those after them."""
    order = _registry(s, d).closure(["units"])
    keys = lambda **change: stages.step_keys(order, config.build(config.Config, SETTINGS | change))
    window = {"start": "2019-01-01", "end": "2021-12-31"}
    rows = []
    for block, values in (("dates", {k: window for k in ("phenology", "radar", "optical_composite")}), ("masking", {"first_year": 2010}), ("segmentation", {"size": 12}), ("export", {"min_pixels": 2})):
        before, after = keys(), keys(**{block: values})
        rows.append((block, ",".join(x.name for x in order if before[x.name] != after[x.name])))
    return s.createDataFrame(rows, "block string, changed string")


@query("stage_costs", "WITH st AS (SELECT * FROM (VALUES ('load', TIMESTAMP '2024-01-03'), ('mask', TIMESTAMP '2024-01-10'), ('means', TIMESTAMP '2024-01-20')) t(stage, b)), e AS (SELECT *, lead(b) OVER (ORDER BY b) AS z FROM st) SELECT stage, count(event_id) AS n_tasks, sum(value) AS cost FROM events LEFT JOIN e ON ts >= b AND (z IS NULL OR ts < z) GROUP BY stage", "cost", 3)
def _(s, d):
    spans = s.createDataFrame([("load", "2024-01-03"), ("mask", "2024-01-10"), ("means", "2024-01-20")], "stage string, b string").withColumn("b", F.col("b").cast("timestamp"))
    return stages.cost_by_stage(read(s, d, "events"), "event_id", "ts", "value", spans, "stage", "b")


@query("left_out", "SELECT plot, h FROM plots WHERE plot NOT IN (SELECT plot FROM plots WHERE unit = 1)", "h")
def _(s, d):
    p = plots(s, d)
    return J.left_out(p, p.where("unit = 1"), "plot").select("plot", "h")


@query("whole_rows", "SELECT plot, unit, typ FROM plots WHERE unit IS NOT NULL AND typ IS NOT NULL")
def _(s, d):
    return L.whole_rows(plots(s, d), ["unit", "typ"]).select("plot", "unit", "typ")


@query("remapped", "SELECT y, x, CAST(CASE kind WHEN 0 THEN 10 WHEN 2 THEN 30 WHEN 5 THEN 20 ELSE -1 END AS INTEGER) AS code FROM raster")
def _(s, d):
    return J.remap(raster(s, d).withColumn("kind", F.col("kind").cast("int")), "kind", "code", [0, 2, 5], [10, 30, 20], -1).select("y", "x", "code")


@query("sample_sizes", "SELECT kind, least(count(*), 25) AS n FROM raster GROUP BY kind UNION ALL SELECT -1, least(count(*), 40) FROM raster")
def _(s, d):
    r = raster(s, d).withColumn("key", F.col("y") * 100 + F.col("x"))
    both = Z.stratified_sample(r, "kind", "key", 25).groupBy("kind").agg(F.count_distinct("key").alias("n"))
    return both.unionByName(Z.random_sample(r, "key", 40).agg(F.lit(-1).cast("long").alias("kind"), F.count_distinct("key").alias("n")))


@query("largest_unit", "SELECT max(n) AS n FROM (SELECT count(*) AS n FROM raster GROUP BY label)")
def _(s, d):
    return s.createDataFrame([(Z.assert_sizes_fit(raster(s, d), "label", 1000),)], "n long")


@query("null_draw_counts", "SELECT draw, grp, unit, count(*) AS n FROM plots, range(6) r(draw) GROUP BY ALL")
def _(s, d):
    """Within groups each draw has every label as often as the plots have it."""
    return I.null_draws(plots(s, d), "plot", ["unit"], 6, 7, "grp").groupBy("draw", "grp", "unit").agg(F.count("*").alias("n"))


@query("bootstrap_counts", "SELECT rep, (SELECT count(DISTINCT grp) FROM plots) AS n_slots, TRUE AS within FROM range(8) r(rep) WHERE EXISTS (SELECT 1 FROM plots)")
def _(s, d):
    p = plots(s, d)
    b = I.bootstrap_groups(p, "grp", 8, 5).join(p.select("grp", F.lit(True).alias("k")).distinct(), "grp", "left")
    return b.groupBy("rep").agg(F.count_distinct("slot").alias("n_slots"), F.bool_and(F.coalesce("k", F.lit(False))).alias("within"))


@query("torus_draws", "SELECT draw, plot, (CAST(floor(py / 100) AS BIGINT) - dr + 10) % 10 AS r, (CAST(floor(px / 100) AS BIGINT) - dc + 11) % 11 AS c FROM plots, (VALUES (0, 0, 0), (1, 3, 7), (2, 9, 1)) s(draw, dr, dc)")
def _(s, d):
    shifts = s.createDataFrame([(0, 0, 0), (1, 3, 7), (2, 9, 1)], "draw int, dr int, dc int")
    p = plots(s, d).select("plot", F.floor(F.col("py") / 100).alias("r"), F.floor(F.col("px") / 100).alias("c"))
    return I.torus_draws(p, "r", "c", 10, 11, shifts).select("draw", "plot", "r", "c")


@query("accepted_draws", "SELECT draw FROM (SELECT draw, bool_and((plot * 31 + draw * 17) % 97 > 0) AS ok FROM plots, range(40) r(draw) GROUP BY draw) WHERE ok")
def _(s, d):
    many = plots(s, d).select("plot").crossJoin(s.range(40).toDF("draw"))
    return I.accepted(many, (F.col("plot") * 31 + F.col("draw") * 17) % 97 > 0)


_NULL = "SELECT flag, 30.0 AS o, qty FROM obs"


@query("permutation_p", f"WITH t AS ({_NULL}) SELECT flag, (1.0 + count(CASE WHEN qty >= 30 THEN 1 END)) / (1 + count(*)) AS p, count(*) AS n_valid, avg(qty) AS null_mean, stddev_samp(qty) AS null_sd, quantile_cont(qty, 0.05) AS q05, quantile_cont(qty, 0.5) AS q50, quantile_cont(qty, 0.95) AS q95 FROM t GROUP BY flag", "p null_mean null_sd q05 q50 q95")
def _(s, d):
    return I.permutation_p(observations(s, d).withColumn("o", F.lit(30.0)), "o", "qty", ["flag"]).drop("o")


@query("tests_run", "WITH t AS (SELECT flag, 30.0 AS o, qty FROM obs WHERE ok % 2 = 0), n AS (SELECT flag, count(*) AS n, (1.0 + count(CASE WHEN qty >= 30 THEN 1 END)) / (1 + count(*)) AS p FROM t GROUP BY flag) SELECT flag AS statistic, CASE WHEN n >= 0.9 * (SELECT max(n) FROM n) THEN p END AS p, n AS n_valid FROM n", "p")
def _(s, d):
    o = observations(s, d).where("ok % 2 = 0").select(F.col("flag").alias("statistic"), F.col("qty").alias("value"), F.lit(0).alias("draw"))
    most = o.groupBy("statistic").count().agg(F.max("count")).first()[0] or 0
    return I.run_tests(o.select("statistic").distinct().withColumn("observed", F.lit(30.0)), o, most).select("statistic", "p", "n_valid")


@query("class_correspondence", "SELECT DISTINCT kind AS a, (kind * 3 + 2) % 7 AS b FROM raster")
def _(s, d):
    t = C.contingency(raster(s, d).withColumn("o", (F.col("kind") * 3 + 2) % 7), "kind", "o")
    return s.createDataFrame(sorted(C.correspondence(t).items()), "a long, b long")


@query("kmeans_separated", "SELECT count(DISTINCT label) AS n_units, least(4, count(DISTINCT label)) AS n_clusters, least(4, count(DISTINCT label)) AS n_cells FROM raster")
def _(s, d):
    """Units around four far centres: every start finds the four."""
    u = raster(s, d).select("label").distinct().withColumn("g", F.col("label") % 4)
    u = u.withColumn("a", F.when(F.col("g") < 2, 0.0).otherwise(1000.0) + F.col("label") % 3).withColumn("b", F.when(F.col("g") % 2 == 0, 0.0).otherwise(1000.0) + F.col("label") % 5)
    model, _ = U.kmeans_starts(u, ["a", "b"], 4, 3)
    t = U.nearest_centre(u, ["a", "b"], [c.tolist() for c in model.clusterCenters()])
    return t.agg(F.count("*").alias("n_units"), F.count_distinct("cluster").cast("long").alias("n_clusters"), F.count_distinct("g", "cluster").alias("n_cells"))


@query("principal_axis", "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), t AS (SELECT 0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) AS w FROM e) SELECT vec_id, abs(a * cos(w) + b * sin(w)) AS c0 FROM e, t", "c0", 5)
def _(s, d):
    e = read(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return U.principal_components(e, ["a", "b"], 2).select("vec_id", F.abs(F.col("components")[0]).alias("c0"))


@query("leave_one_out_line", "WITH t AS (SELECT price AS y, qty AS x FROM obs), m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM t) SELECT n, 1 - sum(((y - a - b * x) / (1 - 1.0 / n - (x - mx) ** 2 / sxx)) ** 2) / sum((y - my) ** 2) AS loo_r2 FROM t, m GROUP BY n", "loo_r2", 5)
def _(s, d):
    return T.leave_one_out(observations(s, d), "price", ["qty"])


@query("window_mean_weights", "WITH w AS (SELECT * FROM (VALUES (0.25, 1.75), (1.0, 3.5)) t(t0, t1)), k AS (SELECT t0, t1, 2 * pi() AS u, 4 * pi() AS v, t1 - t0 AS s FROM w) SELECT CAST(t0 AS DOUBLE) AS t0, (sin(u * t1) - sin(u * t0)) / (u * s) AS c1, (cos(u * t0) - cos(u * t1)) / (u * s) AS s1, (sin(v * t1) - sin(v * t0)) / (v * s) AS c2, (cos(v * t0) - cos(v * t1)) / (v * s) AS s2, CAST((t0 + t1) / 2 AS DOUBLE) AS trend FROM k", "t0 c1 s1 c2 s2 trend")
def _(s, d):
    rows = [(t0, *B.window_mean_weights(t0, t1, dual=True, trend=True)[1:]) for t0, t1 in ((0.25, 1.75), (1.0, 3.5))]
    return s.createDataFrame(rows, "t0 double, c1 double, s1 double, c2 double, s2 double, trend double")
