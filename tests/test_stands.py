"""Stands, rankings, checks and sources against hand-worked cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from standspark.functions import bands as B
from standspark.operators import checks, inference, ranking, stands
from standspark.operators import compare as C
from standspark.operators import merging as M
from standspark.sources import sinks, tables


def test_numbers_over_many_ranges(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 1000, None if i % 50 == 0 else f"g{i % 13:02d}") for i in range(1000)], "id long, v long, g string")
    got = {r["id"]: r["n"] for r in ranking.numbered(rows, [F.col("v"), F.col("id")], "n").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: ((i * 7919) % 1000, i)) and sorted(got.values()) == list(range(1, 1001))
    codes = {r["g"]: r["c"] for r in ranking.encode(rows, "g", "c", ["g03"]).collect()}
    assert codes[None] == codes["g03"] == -1 and sorted(v for v in codes.values() if v >= 0) == list(range(12)) and codes["g02"] == 2 and codes["g04"] == 3
    assert ranking.numbered(rows.limit(0), [F.col("v")], "n").count() == 0


def test_renumbering_goes_from_north_to_south_then_west_to_east(spark):
    rows = [(7, 20.0, 85.2), (3, 21.0, 85.1), (5, 20.0, 85.1), (9, 20.0, 85.1)]
    got = ranking.renumber(spark.createDataFrame(rows, "k long, lat double, lon double"), "lat", "lon", "k").orderBy("stand_id").collect()
    assert [r["k"] for r in got] == [3, 5, 9, 7] and [r["stand_id"] for r in got] == [1, 2, 3, 4]


def test_claims_across_super_groups_are_unknown(spark):
    rows = [(1, 1, 5, 0), (2, 2, 5, 0), (3, 3, 5, 1), (4, 4, None, 0), (5, 1, 5, 1), (6, None, 5, 0), (7, 7, 6, 0), (8, 8, 5, None)]
    p = inference.plot_pairs(spark.createDataFrame(rows, "plot long, unit long, typ long, sup long"), "plot", ["unit", "typ", "sup"])
    got = {(r["plot_a"], r["plot_b"]): r["claim"] for r in inference.with_claims(p, "unit", "typ", "sup").collect()}
    assert (got[1, 2], got[1, 3], got[1, 4], got[1, 5], got[1, 6], got[1, 7], got[1, 8]) == (1, 3, 3, 0, -1, 2, 3)
    without = {(r["plot_a"], r["plot_b"]): r["claim"] for r in inference.with_claims(p, "unit", "typ").collect()}
    assert without[1, 3] == 1


def test_pieces_runs_and_split_stands(spark):
    grid = ["aab", "bba", "ccc"]
    px = spark.createDataFrame([(y, x, c) for y, row in enumerate(grid) for x, c in enumerate(row)], "y long, x long, l string")
    parts = stands.pieces(px, "l", F.col("y") * 3 + F.col("x"))
    got = {(r["label"], r["piece"]): (r["n_pixels"], r["cx"], r["cy"], [tuple(x) for x in r["runs"]]) for r in stands.vectorised(parts).collect()}
    assert got == {("a", 0): (2, 0.5, 0.0, [(0, 0, 1)]), ("b", 2): (1, 2.0, 0.0, [(0, 2, 2)]), ("b", 3): (2, 0.5, 1.0, [(1, 0, 1)]), ("a", 5): (1, 2.0, 1.0, [(1, 2, 2)]), ("c", 6): (3, 1.0, 2.0, [(2, 0, 2)])}
    counts = stands.polygon_counts(stands.vectorised(parts)).first().asDict()
    assert counts == {"n_polygons": 5, "n_stands": 3, "n_split": 2, "max_pieces": 2} and "2 lie in up to 2 pieces" in checks.split_warning(counts)
    touch = {r["label"]: (r["n_pieces"], r["touch_by_corner"]) for r in stands.split_units(parts).collect()}
    assert touch == {"a": (2, True), "b": (2, True)}
    joined = {r["piece"] for r in stands.pieces(px, "l", F.col("y") * 3 + F.col("x"), 8).collect()}
    assert joined == {0, 2, 6}


@pytest.mark.parametrize("held, finish", [(1 << 18, 1 << 19), (4, 1 << 19), (4, 3), (1 << 18, 0)])
def test_components_by_every_path(spark, monkeypatch, held, finish):
    """Chains, stars, rings and single links, contracted by tasks, by one task or in rounds."""
    import random

    from standspark.operators import components

    monkeypatch.setattr(components, "HELD_LINKS", held)
    monkeypatch.setattr(components, "FINISH_LINKS", finish)
    random.seed(4)
    groups = [list(range(100 * g, 100 * g + n)) for g, n in enumerate([2, 3, 40, 17, 90, 1])]
    links = [(m[k], m[k + 1]) for m in groups[:3] for k in range(len(m) - 1)] + [(groups[3][0], x) for x in groups[3][1:]] + [(groups[4][k], groups[4][(k * 7 + 7) % 90]) for k in range(90)] + [(groups[4][k], groups[4][k + 1]) for k in range(89)] + [(500, 500)]
    links = [random.choice([(a, b), (b, a)]) for a, b in links] * 2
    random.shuffle(links)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: m[0] for m in groups[:5] for x in m}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from standspark.plans import storage

    def session(master, folder=None, checkpoint=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))

    assert storage.shared_folder(session("yarn", "s3a://b/c")) == "s3a://b/c" and storage.shared_folder(session("yarn", None, "hdfs:/x")) == "hdfs:/x"
    assert "standspark-" in storage.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_folder(session(master))


def test_distances_equal_brute_force(spark):
    from standspark.operators import grid

    rng = np.random.default_rng(3)
    for share, cap in ((0.02, 1000), (0.2, 3), (0.0, 5)):
        mask = rng.random((30, 23)) < share
        px = spark.createDataFrame([(y, x, bool(mask[y, x])) for y in range(30) for x in range(23)], "y int, x int, m boolean")
        got = {(r["y"], r["x"]): r["distance"] for r in grid.distance_transform(px, F.col("m"), 10.0, cap).collect()}
        at = np.argwhere(mask)
        for (y, x), d in got.items():
            best = min(((a - y) ** 2 + (b - x) ** 2 for a, b in at), default=None)
            assert d is None if best is None or best > cap * cap else d == pytest.approx(10 * best**0.5)


def test_seeds_cover_every_patch(spark):
    land = spark.createDataFrame([(10 * y + x, y, x) for y, x in [(2, 2), (2, 3), (0, 5), (0, 6)]], "node long, y long, x long")
    parts = spark.createDataFrame([(22, 22), (23, 22), (5, 5), (6, 5)], "node long, component long")
    assert {(r["y"], r["x"], r["on_grid"]) for r in stands.seeds(land, parts, 4).collect()} == {(2, 2, True), (0, 5, False), (0, 6, False)}


def test_diagnostics_name_the_causes(spark):
    regions = [(0, 200, 0.0, 0.0, 10.0, 200), (1, 20, 1.0, 0.0, 90.0, 20), (2, 50, 9.0, 9.0, 5.0, 50), (3, 990, 3.0, 0.0, 50.0, 990), (4, 30, 4.0, 0.0, 500.0, 10)]
    r = spark.createDataFrame(regions, "i int, n_pixels int, lon double, lat double, v double, v_valid int")
    e = spark.createDataFrame([(0, 1, 5), (3, 4, 7)], "i int, j int, n_shared int")
    rules = M.Rules({"v": 5.0}, min_area_ha=1, max_area_ha=10, min_defined=1)
    got = stands.merge_diagnostics(M.merge_regions(r, e, rules), rules.pixels(1), ["v"]).first().asDict()
    assert (got["n_units"], got["n_stands"], got["merges_fallback"], got["stands_below_min"], got["orphans_isolated"], got["orphans_area_blocked"], got["orphans_iteration_cap"]) == (5, 4, 1, 2, 1, 1, 0)
    assert got["area_below_min_ha"] == 0.8 and got["stands_incomplete"] == 1
    said = checks.warnings_of(got | {"stands_below_min": 2}, {"kept_without_label_ha": 1.5})
    assert len(said) == 3 and said[0].startswith("2 stands") and said[-1].startswith("1.5 ha")
    first = stands.first_round(r, e, {"v": 5.0}, rules.pixels(10), 1).first().asDict()
    assert first["n_pairs"] == 2 and first["blocked_by_area"] == 1 and first["n_candidates"] == 0


def test_matches_by_centre_and_share(spark):
    a, b = ["xxxxyy", "xxxxyy"], ["ppqqqq", "ppqqqq"]
    px = spark.createDataFrame([(y, x, a[y][x], b[y][x]) for y in range(2) for x in range(6)], "y long, x long, a string, b string")
    got = {(r["a"], r["b"]): (r["over"], r["under"]) for r in C.matched_units(px, "a", "b").collect()}
    assert got == {("x", "p"): (0.5, 0.0), ("x", "q"): (0.5, 0.5), ("y", "q"): (0.0, 0.5)}
    s = C.accuracy_summary(px, C.matched_units(px, "a", "b"), "a", "b").first().asDict()
    assert s["over"] == pytest.approx(1 / 3) and s["over_per_reference"] == 0.25 and s["over_area_weighted"] == pytest.approx(4 / 12) and s["n_unmatched_references"] == 0 and s["n_stands"] == 2
    none = C.accuracy_summary(px, C.matched_units(px, "a", "b").limit(0), "a", "b").first().asDict()
    assert none["over"] is None and none["over_per_reference"] is None and none["n_unmatched_references"] == 2


def test_rotation_stays_in_the_region_or_says_so(spark):
    p = spark.createDataFrame([(k, k % 2, float(k), 0.0) for k in range(8)], "plot long, grp long, x double, y double")
    draws = stands.rotation_draws(p, "plot", "grp", lambda x, y: np.hypot(x - 3, y) < 9, 6, 1).toPandas()
    assert len(draws) == 48 and (np.hypot(draws["x"] - 3, draws["y"]) < 9).all()
    gaps = draws.sort_values(["draw", "grp", "plot"]).groupby(["draw", "grp"])[["x", "y"]].apply(lambda t: np.hypot(np.diff(t["x"]), np.diff(t["y"])))
    assert all(np.allclose(g, 2.0) for g in gaps)
    with pytest.raises(Exception, match="0 of 2 draws"):
        stands.rotation_draws(p, "plot", "grp", lambda x, y: x < -1e9, 2, 1, most_tries=5).count()


def test_shuffle_finds_a_planted_difference(spark):
    rows = [(b, i % 2 == 0, float(i % 7) + (0.0 if i % 2 == 0 else 5.0) * (b == 0)) for b in (0, 1) for i in range(60)] + [(2, True, float(i)) for i in range(5)]
    got = {r["band"]: r for r in stands.shuffle_p(spark.createDataFrame(rows, "band int, same boolean, v double"), F.col("same"), "v", ["band"], 99, 3).collect()}
    assert got[0]["p"] == 0.01 and got[1]["p"] > 0.05 and got[2]["p"] is None and got[2]["observed"] is None and got[2]["n_pairs"] == 5


def test_arm_difference_and_synthetic_plots(spark):
    reps = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 1)], "rep long, slot long, g long")
    sums = spark.createDataFrame([(1, 0, 2.0, 2.0), (1, 1, 6.0, 2.0), (2, 0, 4.0, 2.0), (2, 1, 2.0, 2.0)], "g long, arm long, a double, b double")
    assert {r["rep"]: r["difference"] for r in stands.arm_difference(reps, sums, "g", "arm", "a", "b").collect()} == {0: 0.5, 1: 2.0}
    p = stands.synthetic_plots(spark, 4000, 20, 2.0, 9).toPandas()
    share = p.groupby("field_type")["a1"].mean().reindex(p["field_type"]).var(ddof=0) / p["a1"].var(ddof=0)
    assert share == pytest.approx(8 / 9, abs=0.02) and stands.synthetic_plots(spark, 4000, 20, 2.0, 9).toPandas().equals(p)


def test_checks_refuse(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    good = make([(1, 0.5), (-1, 2.0)], "c int, x double")
    assert checks.codes(good, ["c"]) is good and checks.coordinates(good, "x", "x") is good and checks.finite(good, ["x"]) is good
    for call, words in [
        (lambda: checks.codes(make([(-2,), (None,)], "c int"), ["c"]), "2 rows: c is not a code"), (lambda: checks.codes(good, ["x"]), "1 rows"),
        (lambda: checks.coordinates(make([(float("inf"),), (None,)], "x double"), "x", "x"), "2 rows"), (lambda: checks.finite(make([(float("-inf"),)], "x double"), ["x"]), "infinite"),
        (lambda: checks.equal_lengths({"a": good, "b": good.limit(1)}), "different numbers"), (lambda: checks.band_edges([0, 5, 5]), "ascend"), (lambda: checks.band_edges([-1, 5]), "ascend"), (lambda: checks.band_edges([0, float("inf"), 9]), "ascend"),
        (lambda: checks.band_name("2x"), "name a band"), (lambda: checks.distances(make([(1, 2, 1.0), (2, 1, 2.0)], "a int, b int, d double"), "a", "b", "d"), "not symmetric"),
        (lambda: checks.distances(make([(1, 1, 1.0)], "a int, b int, d double"), "a", "b", "d"), "not 0 to itself"), (lambda: checks.distances(make([(1, 2, None, 1)], "a int, b int, d double, s int"), "a", "b", "d", "s"), "within a stratum"),
        (lambda: checks.draws(make([(0, 1), (0, 1)], "draw int, p int"), "p", make([(1,), (2,)], "p int")), "draws without"), (lambda: checks.kept_land(good.limit(0)), "no kept land"), (lambda: checks.metadata([], ["a"]), "no metadata"), (lambda: checks.metadata([{"a": 1}], ["a", "b"]), "lacks b"),
    ]:
        with pytest.raises(ValueError, match=words):
            call()
    assert checks.band_edges([0, 100, float("inf")])[-1] == float("inf") and checks.metadata([{"a": 1}, {"a": 2}], ["a"]) == {"a": [1, 2]}
    assert checks.distances(make([(1, 2, 1.0), (2, 1, 1.0), (1, 1, 0.0)], "a int, b int, d double"), "a", "b", "d").count() == 3
    assert [len(p) for p in checks.pages(spark.range(7), 3)] == [3, 3, 1] and checks.equal_lengths({"a": good, "b": good}) == 2
    assert checks.enough_draws(1, 2, 3, 4) == 1


def test_overlay_and_class_flags(spark):
    t = spark.createDataFrame([(1, 2, True), (2, 2, None), (3, 9, False), (4, None, False)], "i int, c int, w boolean")
    got = t.orderBy("i").select(B.priority_class("c", [2, 3], F.col("w")).alias("p"), B.class_flag("c", [9]).alias("f")).collect()
    assert [tuple(r) for r in got] == [(80, 0), (2, 0), (0, 1), (0, 0)]


def test_run_logs_and_layouts(tmp_path):
    from standspark.plans import stages

    log = stages.run_log(str(tmp_path), "r1")
    log.info("began")
    assert stages.run_log(str(tmp_path), "r1") is log and "INFO began" in (tmp_path / "r1" / "run.log").read_text()
    assert stages.place_of("s3a://b/c/", "load", "px", "k1") == "s3a://b/c/px__sk1" and stages.place_of("/c", "load", "px", "k1", "by_stage") == "/c/load/px__sk1"
    with pytest.raises(stages.StageError, match="flat"):
        stages.place_of("/c", "load", "px", "k1", "deep")


def test_settings_and_rasters(spark, tmp_path):
    (tmp_path / ".env").write_text("# comment\nPLACE=here # why\nexport NAME=\"a # b\"\nEMPTY=\nbroken line\n")
    assert tables.settings(str(tmp_path / ".env"), {"PLACE": "there"}) == {"PLACE": "there", "NAME": "a # b", "EMPTY": ""}
    values = np.arange(24, dtype="<f4").reshape(3, 4, 2)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 2), (279, 4, 1, 96), (339, 3, 1, 3)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", *t[:3]) + struct.pack("<I", t[3]) for t in tags) + bytes(4)
    (tmp_path / "a.tif").write_bytes(b"II" + struct.pack("<HI", 42, 104) + values.tobytes() + body)
    got = tables.raster(spark, str(tmp_path / "a.tif"), ["p", "q"]).orderBy("y", "x").collect()
    assert [(r["y"], r["x"], r["p"], r["q"]) for r in got] == [(y, x, float(values[y, x, 0]), float(values[y, x, 1])) for y in range(3) for x in range(4)]
    with pytest.raises(ValueError, match="not a TIFF"):
        tables.tiff_bands(b"nothing here")
    px = spark.createDataFrame([(0, 0, 5, 1.5, 0.1, 2)], "y long, x long, l long, v double, z double, c long")
    paths = sinks.layers(px, str(tmp_path / "out"), "l", ["v"], ["z"], "c")
    assert [spark.read.parquet(p).columns for p in paths] == [["y", "x", "l"], ["y", "x", "v"], ["y", "x", "z", "c"]]


@pytest.mark.parametrize("gathered", [1 << 20, 10])
def test_shuffle_deals_exactly(spark, monkeypatch, gathered):
    """every draw has the first n_same of its order, gathered or counted in classes; no pair is left out."""
    import numpy as np

    monkeypatch.setattr(stands, "GATHERED", gathered)
    rows = [(b, i, i % 5 == 0, float(i * i % 101) + 20 * (b == 0 and i % 5 > 0)) for b in (0, 1, None) for i in range(400)] + [(2, i, True, 1.0) for i in range(5)]
    t = spark.createDataFrame(rows, "band int, i long, same boolean, v double").repartition(5)
    got = {r["band"]: r for r in stands.shuffle_p(t, F.col("same"), "v", ["band"], 99, 3, ["band", "i"]).collect()}
    keys = {(r["band"], r["i"]): r["k"] for r in t.select("band", "i", F.xxhash64("band", "i").alias("k")).collect()}
    for band in (0, 1):
        own = [r for r in rows if r[0] == band]
        k, v, s = np.array([keys[r[:2]] for r in own]).view(np.uint64), np.array([r[3] for r in own]), np.array([r[2] for r in own])
        gap = lambda d: (v.sum() - d) / (~s).sum() - d / s.sum()
        hits = sum(gap(v[np.argsort(stands._order(k, salt))[: s.sum()]].sum()) >= gap(v[s].sum()) - 1e-12 for salt in stands._salts(3, 99))
        assert got[band]["p"] == pytest.approx((1 + hits) / 100) and got[band]["n_pairs"] == 400
    assert got[0]["p"] == 0.01 < got[1]["p"] and got[2]["p"] is None and got[None]["p"] is None and len(got) == 4


def test_shares_of_pairs(spark):
    from standspark.operators import inference

    t = spark.createDataFrame([(k, k % 3) for k in range(40)], "plot long, grp long")
    assert sorted(inference.plot_pairs(t, "plot", [], ["grp"], 4).collect()) == sorted(inference.plot_pairs(t, "plot", [], ["grp"]).collect())
