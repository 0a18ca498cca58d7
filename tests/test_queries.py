"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from standspark.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def plain(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same_kind(rows):
    """Integers that one side shows as floats (columns with nulls) compare equal."""
    return sorted(tuple(f"{float(v):.6g}" if v and v.replace(".", "", 1).replace("-", "", 1).replace("e", "", 1).replace("+", "", 1).isdigit() else v for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert same_kind(plain(got)) == same_kind(plain(expected))


#: What queries without SQL return on the small tables: rows, and a test of them all.
WITHOUT_SQL = {
    "harmonic_dual_trend": lambda t: len(t) > 0 and t["pixel"].is_unique and t.drop(columns="pixel").notna().any().any(),
    "leave_one_out_r2": lambda t: len(t) == 1 and t.iloc[0].dropna().between(-1e6, 1).any(),
    "null_draws": lambda t: t.groupby("draw")["plot"].nunique().eq(t["plot"].nunique()).all() and t["draw"].nunique() == 20,
    "permutation_tests": lambda t: len(t) == 1 and (t["p"].isna() | t["p"].between(0.01, 1)).all(),
    "bootstrap_groups": lambda t: t.groupby("rep")["slot"].nunique().eq(t["slot"].nunique()).all() and t["rep"].nunique() == 20,
    "arm_difference": lambda t: t["rep"].is_unique,
    "patches_8_capped": lambda t: t["size"].between(1, 256).all() and (t["component"] <= t["node"]).all(),
    "region_merge": lambda t: t["i"].is_unique and t.groupby("stand")["n_pixels"].nunique().eq(1).all() and (t.groupby("stand")["i"].count() == t.groupby("stand")["n_superpx"].first()).all(),
    "merge_rule_change": lambda t: t["i"].is_unique and t[["stand_one", "stand_two"]].notna().all().all(),
    "merge_diagnostics": lambda t: len(t) == 1 and (t["n_units"] - t["n_stands"] == t["merges_first"] + t["merges_relaxed"] + t["merges_fallback"]).all(),
    "superpixels": lambda t: len(t) > 0 and not t.duplicated(["y", "x"]).any(),
    "elbow_sweep": lambda t: t.sort_values("k")["wcss"].is_monotonic_decreasing and t["is_knee"].sum() == 1,
    "kmeans_types": lambda t: t["cluster"].between(0, 3).all() and t["label"].is_unique,
    "principal_components": lambda t: t["vec_id"].is_unique and t["c0"].ge(0).all(),
    "label_shuffle": lambda t: (t["p"].isna() | t["p"].between(0.01, 1)).all(),
    "rotation_draws": lambda t: t.groupby("draw")["plot"].nunique().eq(t["plot"].nunique()).all() and t["x"].between(-2000, 3000).all(),
    "synthetic_plots": lambda t: len(t) == 267 and t["grp"].nunique() == 20 and t["field_type"].between(0, 4).all() and t.groupby("field_type")["a0"].mean().is_monotonic_increasing,
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, name):
    """Twice the same rows, which meet what the operator promises."""
    first, second = (QUERIES[name](spark, FOLDER).toPandas() for _ in range(2))
    assert WITHOUT_SQL[name](first), first.head()
    assert plain(first) == plain(second)


def orders(spark, folder, keys):
    """A raster of its own: keys 100 * y + x with kinds in a pattern."""
    rows = [(k, 1.5 * k, k * k % 11, pd.Timestamp("2020-01-05").date()) for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_custkey long, o_orderdate date").write.parquet(f"{folder}/orders.parquet")


def test_boundary_match_reads_every_row(spark, tmp_path):
    from standspark.operators import compare
    from standspark.queries.base import raster

    orders(spark, tmp_path, range(39000, 42000))
    r = raster(spark, str(tmp_path)).withColumn("other", F.expr("(y DIV 9) * 100 + x DIV 8"))
    expected = plain(compare.boundary_match(r, "label", "other", 1).toPandas())
    assert plain(QUERIES["boundary_match"](spark, str(tmp_path)).toPandas()) == expected


def test_torus_shifts_the_whole_raster(spark, tmp_path):
    grid = {(k // 100, k % 100): k * k % 11 % 7 for y in range(3) for x in range(12) if (k := 100 * y + x) != 7}
    orders(spark, tmp_path, [100 * y + x for y, x in grid])
    share = {}
    for dy in range(3):
        for dx in range(12):
            met = [grid[p] == kind for (y, x), kind in grid.items() if (p := ((y + dy) % 3, (x + dx) % 12)) in grid]
            share[dy, dx] = sum(met) / len(met)
    seen = share.pop((0, 0))
    got = QUERIES["exhaustive_torus"](spark, str(tmp_path)).first()
    assert (got["observed"], got["n_greater"], got["n_less"], got["n_equal"]) == (seen, 0, sum(s < seen - 1e-9 for s in share.values()), sum(abs(s - seen) <= 1e-9 for s in share.values()))


@pytest.mark.parametrize("name", "silhouette permanova bray_curtis interval_join holm elbow_knee boundary_match exhaustive_torus".split())
def test_whole_tables_equal_sql(spark, name):
    """Once cut to a part of their tables; now all of the larger ones."""
    con, folder = duckdb.connect(), FOLDER.replace("sf0.001", "sf0.01")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, expected = QUERIES[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    assert same_kind(plain(got)) == same_kind(plain(expected))


#: Discounts whose mean is 0.05, and whose plain sum depends on their order.
EVEN = [0.01, 0.09, 0.02, 0.08, 0.03, 0.07, 0.04, 0.06, 0.05, 0.05, 0.0, 0.1, 0.03, 0.03, 0.09]


def ties(folder):
    """Pixels with means that meet the threshold, rows in other orders; one without a pixel, one without dates."""
    import random

    deal = random.Random(3)
    rows = [(p, pd.Timestamp(f"{year}-03-01"), x) for p in [*range(1, 60), None] for year in (1995, 1996) for x in deal.sample(EVEN, len(EVEN)) * 2]
    rows += [(60, None, 0.07)] * 3
    pd.DataFrame({"s_suppkey": range(1, 62), "s_name": "s", "s_nationkey": [k % 25 for k in range(61)], "s_acctbal": 1.0}).to_parquet(f"{folder}/supplier.parquet")
    (folder / "lineitem.parquet").mkdir()
    t = pd.DataFrame([(i, 1, p, 1, 1.0, 1.0, x, 0.0, "A", "O", day) for i, (p, day, x) in enumerate(deal.sample(rows, len(rows)))], columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    t = t.astype({"l_suppkey": "Int64", "l_linenumber": "int32", "l_shipdate": "datetime64[us]"})
    for k in range(7):
        t[k::7].to_parquet(f"{folder}/lineitem.parquet/{k}.parquet")
    con = duckdb.connect(config={"threads": 1})
    # As decimals, the SQL's means are exact.
    con.sql(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(l_discount AS DECIMAL(18, 2)) AS l_discount) FROM '{folder}/lineitem.parquet/*.parquet'")
    con.sql(f"CREATE VIEW supplier AS FROM '{folder}/supplier.parquet'")
    return con


def test_means_that_meet_a_threshold(spark, tmp_path):
    """F5"""
    con = ties(tmp_path)
    got = QUERIES["annual_share_above"](spark, str(tmp_path)).toPandas()
    assert not got["above"][got["pixel"] != 60].any() and got["pixel"].isna().sum() == 2
    assert same_kind(plain(got)) == same_kind(plain(con.sql(SQL["annual_share_above"]).df()))


def test_votes_by_means_that_meet_a_threshold(spark, tmp_path):
    """F6; the pixel whose only rows have no date votes, as in the SQL."""
    con = ties(tmp_path)
    got = QUERIES["majority_vote"](spark, str(tmp_path)).toPandas()
    assert not got["habitat"][got["pixel"] != 60].any() and got.set_index("pixel").loc[60, "n_votes"] == 1
    assert same_kind(plain(got)) == same_kind(plain(con.sql(SQL["majority_vote"]).df()))


def test_fallback_of_votes_by_means_that_meet_a_threshold(spark, tmp_path):
    """F7"""
    con = ties(tmp_path)
    got = QUERIES["vote_with_fallback"](spark, str(tmp_path)).toPandas()
    assert not got["habitat"][got["source"] == 1].any() and (got["source"] == 1).sum() == 48
    assert same_kind(plain(got)) == same_kind(plain(con.sql(SQL["vote_with_fallback"]).df()))


def test_layers_are_not_broadcast(spark):
    """their files are small, the tables may not be."""
    frame = QUERIES["sink_layers"](spark, FOLDER)
    assert frame.count() == 1500
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
