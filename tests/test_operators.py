"""Operators on hand-worked cases, edge cases and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from standspark.functions import bands as B
from standspark.functions import polyline
from standspark.operators import collection, compare, components, grid, inference, joins, merging, segment, units, zonal
from standspark.plans import config, stages
from standspark.streaming import windows


def one(frame):
    return frame.first().asDict()


@pytest.mark.parametrize("values,expected", [([1, 2, 3, 10], 1.0182337649086284), ([0.5, 0.7, 0.1, 4.0, 2.2, 9.5, 0.3], 1.4438591652297939), ([3, 3, 3], 0.0), ([5], 0.0)])
def test_skew(spark, values, expected):
    t = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert t.agg(units.skew("v").alias("s")).first()["s"] == pytest.approx(expected, abs=1e-12)


def test_two_groupings(spark):
    t = spark.createDataFrame(list(zip(range(4), [0, 0, 1, 1], [0, 0, 1, 2], strict=True)), "plot int, a int, b int")
    r = one(compare.agreement(compare.pair_counts(compare.contingency(t, "a", "b"))))
    assert (r["pairs"], r["both"], r["a_only"], r["b_only"], r["neither"]) == (6, 1, 1, 0, 4)
    assert r["rand"] == pytest.approx(5 / 6) and r["adjusted_rand"] == pytest.approx(4 / 7) and r["ari_ceiling"] == pytest.approx(4 / 7)


def test_agreement_of_nothing_is_null(spark):
    t = spark.createDataFrame([], "a int, b int")
    r = compare.agreement(compare.pair_counts(compare.contingency(t, "a", "b"))).collect()
    assert all(x["adjusted_rand"] is None for x in r)


def test_explained_variance(spark):
    t = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 3.0), (1, 0, 1, 5.0), (1, 1, 1, 7.0), (2, 0, None, 9.0)], "y int, x int, label int, v double")
    r = one(zonal.explained_variance(t, "label", ["v"]))
    assert r["v_r2"] == pytest.approx(0.8) and r["v_within_variance"] == pytest.approx(1.0)
    flat = one(zonal.explained_variance(t.withColumn("v", F.lit(2.0)), "label", ["v"]))
    assert flat["v_r2"] is None


def test_checkerboard_is_minus_one(spark):
    t = spark.createDataFrame([(y, x, y * 8 + x, float((y + x) % 2)) for y in range(8) for x in range(8)], "y int, x int, label int, v double")
    assert one(grid.morans_i(t.select("label", "v"), grid.adjacency(t, "label"), "label", "v"))["morans_i"] == pytest.approx(-1.0)


@pytest.mark.parametrize("groups,expected", [([0, 0, 1, 1], 1.0), ([0, 1, 0, 1], -0.5)])
def test_anosim(spark, groups, expected):
    pairs = [(0, 1, 1.0), (0, 2, 3.0), (0, 3, 4.0), (1, 2, 5.0), (1, 3, 6.0), (2, 3, 2.0)]
    t = spark.createDataFrame([(d, groups[i] == groups[j]) for i, j, d in pairs], "d double, same boolean")
    assert one(inference.anosim(t, "d", F.col("same")))["r"] == pytest.approx(expected)


def test_holm_keeps_gaps(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "id int, p double")
    got = {r["id"]: r["p_holm"] for r in inference.holm(t, "p", "id").collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: None, 4: pytest.approx(0.06)}


def test_permutation_p_counts_the_observed(spark):
    t = spark.createDataFrame([(1.0, float(v)) for v in range(-4, 5)], "o double, v double")
    assert one(inference.permutation_p(t, "o", "v"))["p"] == pytest.approx(5 / 10)


def test_null_draws_rearrange(spark):
    t = spark.createDataFrame([(i, i % 3, i * 10) for i in range(12)], "plot int, g int, unit int")
    rows = inference.null_draws(t, "plot", ["unit"], 5, 1, "g").collect()
    for draw in range(5):
        for g in range(3):
            assert sorted(r["unit"] for r in rows if r["draw"] == draw and r["g"] == g) == [i * 10 for i in range(12) if i % 3 == g]


def _regions(spark, pixels, means, edges, rules):
    band = list(rules.tolerances)
    rows = [(i, n, float(i), 0.0, *(x for m in ms for x in (m, n if m is not None else 0))) for i, (n, ms) in enumerate(zip(pixels, means, strict=True))]
    table = spark.createDataFrame(rows, "i long, n_pixels long, lon double, lat double, " + ", ".join(f"{b} double, {b}_valid long" for b in band))
    links = spark.createDataFrame(edges, "i long, j long, n_shared long")
    return {r["i"]: r for r in merging.merge_regions(table, links, rules).collect()}


RULES = merging.Rules({"ch": 2.0, "amp": 0.03})


def test_close_regions_merge_in_the_first_pass(spark):
    got = _regions(spark, [200, 200], [(10.0, 0.1), (11.0, 0.11)], [(0, 1, 5)], RULES)
    assert got[0]["stand"] == got[1]["stand"] == 0 and got[0]["n_pass1"] == 1 and got[0]["merge_kind"] == 1


def test_equal_to_the_tolerance_and_bound_passes(spark):
    got = _regions(spark, [500, 500], [(10.0, 0.5), (12.0, 0.5)], [(0, 1, 5)], RULES)
    assert got[1]["stand"] == 0 and got[0]["n_pixels"] == 1000
    over = _regions(spark, [500, 501], [(10.0, 0.5), (12.0, 0.5)], [(0, 1, 5)], RULES)
    assert over[1]["stand"] == 1


def test_undefined_band_falls_back_to_the_longest_edge(spark):
    got = _regions(spark, [20, 200], [(None, 0.1), (12.0, 0.1)], [(0, 1, 10)], RULES)
    assert got[0]["stand"] == 1 and got[0]["n_pass1"] == 0 and got[0]["n_fallback"] == 1 and got[0]["merge_kind"] == 3
    loose = _regions(spark, [20, 200], [(None, 0.1), (12.0, 0.1)], [(0, 1, 10)], merging.Rules({"ch": 2.0, "amp": 0.03}, min_defined=1))
    assert loose[0]["n_pass1"] == 1 and loose[0]["n_fallback"] == 0


def test_merged_mean_is_over_valid_pixels(spark):
    got = _regions(spark, [100, 300], [(None, 0.1), (12.0, 0.1)], [(0, 1, 10)], merging.Rules({"ch": 2.0, "amp": 0.03}, min_defined=1))
    assert got[0]["ch"] == pytest.approx(12.0) and got[0]["ch_frac_valid"] == pytest.approx(0.75)


def test_undersized_and_alone(spark):
    got = _regions(spark, [20, 200, 200], [(1.0, 0.1), (50.0, 0.1), (50.5, 0.1)], [(1, 2, 3)], RULES)
    assert got[0]["below_why"] == "isolated" and got[1]["stand"] == 1


def test_components_against_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]} | {k: v for k, v in got.items() if k not in {n for e in edges for n in e}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_superpixels_are_connected(spark, connectivity):
    random.seed(1)
    t = spark.createDataFrame([(y, x, random.random() if (y * x) % 17 else None) for y in range(40) for x in range(40)], "y int, x int, v double")
    rows = segment.superpixels(t, ["v"], 8, 0.5, connectivity, tile=32).collect()
    label = {(r["y"], r["x"]): r["label"] for r in rows}
    assert len(label) == t.where("v IS NOT NULL").count()
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    for k in set(label.values()):
        own = {p for p, q in label.items() if q == k}
        seen, todo = set(), [next(iter(own))]
        while todo:
            p = todo.pop()
            if p in own and p not in seen:
                seen.add(p)
                todo += [(p[0] + a, p[1] + b) for a, b in steps]
        assert seen == own
    again = {(r["y"], r["x"]): r["label"] for r in segment.superpixels(t, ["v"], 8, 0.5, connectivity, tile=32).collect()}
    assert again == label


def test_harmonic_finds_a_planted_season(spark):
    rows = [(1, f"2017-{m:02d}-{d:02d}", None) for m in range(1, 13) for d in (1, 15)]
    t = spark.createDataFrame(rows, "pixel int, day string, v double").withColumn("ts", F.col("day").cast("timestamp")).withColumn("t", B.years_since("ts"))
    t = t.withColumn("v", 0.5 + 0.2 * F.cos(2 * math.pi * F.col("t") - 1.0) + 0.1 * F.col("t"))
    r = one(collection.harmonic(t, ["pixel"], "ts", "v"))
    assert r["v_mean"] == pytest.approx(0.5) and r["v_amplitude_annual"] == pytest.approx(0.2) and r["v_phase_annual"] == pytest.approx(1.0)
    assert r["v_trend"] == pytest.approx(0.1) and r["v_residual_variance"] == pytest.approx(0.0, abs=1e-12) and r["v_obs_count"] == 24


def test_singular_fit_is_null(spark):
    t = spark.createDataFrame([(1, "2017-01-01", 0.3), (1, "2017-01-01", 0.4)], "pixel int, day string, v double").withColumn("ts", F.col("day").cast("timestamp"))
    assert one(collection.harmonic(t, ["pixel"], "ts", "v"))["v_mean"] is None


def test_vote_ties_and_gaps(spark):
    t = spark.createDataFrame([(1, 2000, 1), (1, 2001, 0), (1, 2002, None), (2, 2000, None), (3, 2000, 1), (3, 2001, 1), (3, 2002, 0)], "pixel int, year int, h int")
    got = {r["pixel"]: r["habitat"] for r in collection.majority_vote(t, ["pixel"], "year", "h").collect()}
    assert got == {1: 0, 2: None, 3: 1}


def test_claims_and_bands(spark):
    t = spark.createDataFrame([(None, 1, 1, 1), (1, 1, None, None), (1, 2, 5, 5), (1, 2, 5, 6), (1, 2, None, 6)], "a int, b int, ta int, tb int")
    assert [r[0] for r in t.select(B.claim_code(*(F.col(c) for c in ("a", "b", "ta", "tb")))).collect()] == [-1, 0, 1, 2, 3]
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 9.9, 10.0, 30.0, None)], "v double")
    assert [r[0] for r in v.select(B.band_index("v", [0, 10, 30])).collect()] == [-1, 0, 0, 1, -1, -1]


def test_text_codes(spark):
    t = spark.createDataFrame([("6-10",), ("2023-11-15 00:00:00",), ("25",), (None,), ("x",)], "c string")
    assert [r[0] for r in t.select(B.crown_midpoint("c")).collect()] == [8.0, 13.0, 25.0, None, None]
    ids = spark.createDataFrame([("17",), ("17.0",), ("NaN",), ("17.3",), (None,)], "i string")
    assert [r[0] for r in ids.select(B.id_text("i")).collect()] == ["17", "17", None, None, None]
    names = spark.createDataFrame([("  Shorea_robusta  Gaertn",)], "n string")
    assert names.select(B.fold_name("n")).first()[0] == "shorea robusta"


def test_condensed_index(spark):
    t = spark.createDataFrame([(i, j) for i in range(5) for j in range(i + 1, 5)], "i int, j int")
    assert [r[0] for r in t.select(B.condensed_index("i", "j", 5)).collect()] == list(range(10))


def test_assignment_is_optimal():
    import itertools

    random.seed(7)
    for n in range(1, 6):
        cost = [[random.randrange(20) for _ in range(n + 1)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n + 1), n))
        got = compare.assignment(cost)
        assert len(set(got)) == n and sum(cost[i][j] for i, j in enumerate(got)) == best


def test_points_in_polygons_cover_edges(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    poly = spark.createDataFrame([(7, ring), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "p int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 0.5, 0.5), (4, 4.0, 2.0), (5, 9.0, 9.0)], "k int, x double, y double")
    assert {r["k"]: r["p"] for r in joins.points_in_polygons(pts, poly, "k", "p", "ring", 1.5).collect()} == {1: 7, 2: None, 3: 3, 4: 7, 5: None}


def test_one_to_one_refuses_repeats(spark):
    t = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        joins.one_to_one(t, t, "k")


def test_knee(spark):
    t = spark.createDataFrame([(2, 100.0), (3, 40.0), (4, 30.0), (5, 25.0)], "k int, wcss double")
    assert [r["k"] for r in units.knee(t).where("is_knee").collect()] == [3]
    assert units.knee(t.limit(2)).where("is_knee").count() == 0
    assert units.knee(t.withColumn("wcss", F.lit(1.0))).where("is_knee").count() == 0


def test_preprocess_drops_constants(spark):
    t = spark.createDataFrame([(i, float(i), 5.0, float(2**i)) for i in range(12)], "label int, a double, flat double, right double")
    out, record = units.preprocess(t, ["a", "flat", "right"], "right_skew")
    assert record["dropped"] == ["flat"] and record["logged"] == ["right"] and "flat" not in out.columns
    with pytest.raises(ValueError):
        units.check_units(t.withColumn("label", F.lit(1)), "label", ["a"])


def test_polyline_round_trip():
    random.seed(3)
    points = [(round(random.uniform(-90, 90), 6), round(random.uniform(-180, 180), 6)) for _ in range(50)]
    assert polyline.decode(polyline.encode(points)) == points
    assert polyline.encode([]) == ""


BASE = {"roi": {"name": "a", "roi_file": "a.json"}, "dates": {k: {"start": "2020-01-01", "end": "2020-12-31"} for k in ("phenology", "radar", "optical_composite")}}


@pytest.mark.parametrize("change", [{"colour": 1}, {"clustering": {"k": 1}}, {"clustering": {"log_rule": "right_skew"}}, {"roi": {"name": "a"}}, {"features_structure": {"kernel": 4}}, {"clustering": {"exclude_undersized_from_fit": True}}, {"k_elbow": {"k_min": 2, "k_max": 3}}])
def test_config_refuses(change):
    with pytest.raises(config.ConfigError):
        config.build(config.Config, BASE | change)


def test_run_with_cache(spark, tmp_path):
    c, registry, ran = config.build(config.Config, BASE), stages.Registry(), []

    def make(name, needs):
        def work(spark, context, config):
            ran.append(name)
            return {name: context[needs[0]].withColumn(name, F.lit(1)) if needs else spark.range(3)}

        return registry.add(stages.Stage(name, work, needs, (name,), ("clustering",) if name == "b" else ()))

    make("a", ())
    make("b", ("a",))
    make("unused", ("a",))
    context, manifest = stages.run(spark, registry, ["b"], c, cache=str(tmp_path))
    assert ran == ["a", "b"] and context["b"].count() == 3 and [s["stage"] for s in manifest["stages"]] == ["a", "b"]
    stages.run(spark, registry, ["b"], c, cache=str(tmp_path))
    assert ran == ["a", "b"]
    other = config.build(config.Config, BASE | {"clustering": {"k": 4}})
    stages.run(spark, registry, ["b"], other, cache=str(tmp_path))
    assert ran == ["a", "b", "b"]
    assert stages.fingerprint(c) == stages.fingerprint(config.build(config.Config, BASE | {"clustering": {"k": 6}}))
    with pytest.raises(stages.StageError):
        context.put("a", context["a"])
    with pytest.raises(stages.StageError):
        registry.closure(["nothing"])


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = windows.windowed_composite(spark.read.parquet(source), "ts", ["user_id"], "value")
    folder = tmp_path / "in"
    spark.read.parquet(source).coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(source).schema
    stream = windows.windowed_composite(spark.readStream.schema(schema).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "value")
    windows.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = got.agg(F.max("end")).first()[0]
    assert last is not None and got.count() == batch.where(F.col("end").cast("timestamp") <= F.lit(last)).count()


@pytest.mark.parametrize("schema", ["y int, x int, label int, v double"])
def test_empty_tables(spark, schema):
    t = spark.createDataFrame([], schema)
    assert zonal.geometry(t, "label").count() == 0 and grid.adjacency(t, "label").count() == 0 and grid.focal_texture(t, "v").count() == 0
    assert zonal.profiles(t, "label", ["v"]).count() == 0 and grid.terrain(t, "v", 10.0).count() == 0
    assert one(grid.rms_adjacent(t, "v"))["rms"] == 1.0
    assert segment.superpixels(t, ["v"]).count() == 0


def test_bray_curtis_of_tiles(spark, monkeypatch):
    """all pairs over several tiles, with species that few have, amounts that are missing or below 0, plots without any."""
    import duckdb

    from standspark.operators import inference

    monkeypatch.setattr(inference, "TILE", 7)
    monkeypatch.setattr(inference, "ROWS", 20)
    rows = [(p, f"s{k}", None if (p + k) % 19 == 0 else float(p * k % 13) - (k == 4)) for p in range(60) for k in range(6) if (p * 7 + k * 5) % (k + 2) < 2]
    rows += [(None, "s1", 2.0), (70, None, 3.0), (71, "s1", None), (72, "s9", 0.0), (73, "s8", 0.0), (74, "s9", 2.0)]
    got = inference.bray_curtis(spark.createDataFrame(rows, "plot long, sp string, q double").repartition(4), "plot", "sp", "q").collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE a (pixel BIGINT, sp VARCHAR, q DOUBLE)")
    con.executemany("INSERT INTO a VALUES (?, ?, ?)", rows)
    want = con.sql("WITH t AS (SELECT pixel, sum(q) AS t FROM a GROUP BY pixel), c AS (SELECT x.pixel AS plot_a, y.pixel AS plot_b, sum(least(x.q, y.q)) AS c FROM a x JOIN a y ON x.sp = y.sp AND x.pixel < y.pixel GROUP BY ALL) SELECT u.pixel AS plot_a, v.pixel AS plot_b, 1 - 2 * coalesce(c, 0) / (u.t + v.t) AS distance FROM t u JOIN t v ON u.pixel < v.pixel LEFT JOIN c ON c.plot_a = u.pixel AND c.plot_b = v.pixel").fetchall()
    show = lambda t: sorted((a, b, str(d) if d is None or d != d else round(d, 9)) for a, b, d in t)
    assert [r for r in show(map(tuple, got))] == show(want)


def test_bray_curtis_moves_no_pairs(spark):
    """no row of a pair is dealt or sorted."""
    from standspark.operators import inference

    t = spark.createDataFrame([(p, "s", 1.0) for p in range(100)], "plot long, sp string, q double")
    frame = inference.bray_curtis(t, "plot", "sp", "q")
    assert frame.count() == 4950 and "Join" not in frame._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "MapInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("repeated", [False, True])
def test_silhouette_of_tiles(spark, monkeypatch, repeated):
    """copies, near copies, rows alone, without a cluster or a value, over several tiles."""
    import duckdb

    from standspark.operators import units

    monkeypatch.setattr(units, "TILE", 20)
    monkeypatch.setattr(units, "BLOCK", 7)
    rows = [(i, i % 3, float(i % 7) + 1e-7 * (i % 2) + 1000, float(i * i % 11) + i % 3) for i in range(150)]
    rows += [(200, 9, 1.0, 2.0), (201, None, 1.0, 2.0), (202, 1, None, 2.0), (None, 1, 5.0, 2.0)] + [(0, 0, 4.0, 4.0)] * repeated
    con = duckdb.connect()
    con.sql("CREATE TABLE e (vec_id BIGINT, label INTEGER, c0 DOUBLE, c1 DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    want = con.sql("WITH m AS (SELECT p.vec_id, p.label AS c, q.label AS o, avg(sqrt((p.c0 - q.c0) ** 2 + (p.c1 - q.c1) ** 2)) AS dd FROM e p JOIN e q ON p.vec_id <> q.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN c = o THEN dd END) AS i, min(CASE WHEN c <> o THEN dd END) AS x FROM m GROUP BY vec_id) SELECT avg(CASE WHEN i IS NULL THEN 0 ELSE (x - i) / greatest(x, i) END) FROM s").fetchall()[0][0]
    frame = units.silhouette(spark.createDataFrame(rows, "k long, c int, c0 double, c1 double").repartition(3), "k", "c", ["c0", "c1"])
    assert frame.first()[0] == pytest.approx(want, abs=1e-9)
    assert repeated or "Arrow" in frame._jdf.queryExecution().optimizedPlan().toString()
