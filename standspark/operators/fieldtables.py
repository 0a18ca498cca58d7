"""Field tables: tree records to plots, weighted and top-n aggregates, bins, fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands as B


def clean_trees(records: DataFrame, accuracy: str, most: float = 20.0) -> DataFrame:
    return records.where(F.col(accuracy) <= most)


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of products over the sum of weights of rows that have both; null if that is 0."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(value) * F.col(weight))), F.sum(F.when(both, F.col(weight))))


def tree_structure(records: DataFrame, plots: DataFrame, plot: str, habit: str, height: str, area: str) -> DataFrame:
    """Every plot with Lorey's height, trunk area and number of its tree rows; 0 for a plot without a tree."""
    trees = records.where(F.lower(F.trim(F.col(habit).cast("string"))) == "tree").groupBy(plot).agg(weighted_mean(height, area).alias("tree_height"), F.sum(area).alias("tree_area"), F.count("*").alias("n_tree_rows"))
    return plots.select(plot).distinct().join(trees, plot, "left").fillna(0, ["tree_height", "tree_area", "n_tree_rows"])


def loreys_height(trees: DataFrame, plot: str, height: str, area: str) -> DataFrame:
    return trees.groupBy(plot).agg(weighted_mean(height, area).alias("loreys_height"))


def top_mean(rows: DataFrame, group: str, value: str, n: int = 5) -> DataFrame:
    """Mean of the n largest values of each group; groups are cut to n before they meet."""
    w = Window.partitionBy(group).orderBy(F.desc(value))
    return rows.where(F.col(value).isNotNull()).select(group, value, F.row_number().over(w).alias("_r")).where(F.col("_r") <= n).groupBy(group).agg(F.avg(value).alias(f"top{n}_mean"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group (ties: the least), its share of the rows, and number of values."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return n.groupBy(group).agg(best.alias("b"), F.sum("n").alias("t"), F.count(value).alias("n_values")).select(group, F.col("b.v").alias("dominant"), (-F.col("b.m") / F.col("t")).alias("dominance"), "n_values")


def plot_table(rows: DataFrame, plot: str, value: str, size: str, kind: str) -> DataFrame:
    """Rows, mean, largest, median of a value, mean and sum of a size, number of kinds, per plot."""
    return rows.groupBy(plot).agg(F.count("*").alias("n_rows"), F.avg(value).alias("value_mean"), F.max(value).alias("value_max"), F.median(value).alias("value_median"), F.avg(size).alias("size_mean"), F.sum(size).alias("size_sum"), F.count_distinct(kind).alias("n_kinds"))


def composition(rows: DataFrame, plot: str, kind: str, amount: str) -> DataFrame:
    """(plot, kind, amount, share)."""
    s = rows.groupBy(plot, kind).agg(F.sum(amount).alias("amount"))
    total = s.groupBy(plot).agg(F.sum("amount").alias("_t"))
    return s.join(total, plot).select(plot, kind, "amount", F.try_divide("amount", "_t").alias("share"))


def composition_map(rows: DataFrame, plot: str, kind: str, amount: str) -> DataFrame:
    """Per plot, the amounts by kind as JSON with sorted keys."""
    s = rows.groupBy(plot, kind).agg(F.sum(amount).alias("amount"))
    return s.groupBy(plot).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "amount"))))).alias("amounts_json"))


def composition_of_map(plots: DataFrame, plot: str, json: str) -> DataFrame:
    """The rows back from JSON, with shares."""
    e = plots.select(plot, F.explode(F.from_json(json, "map<string,double>")).alias("kind", "amount"))
    total = e.groupBy(plot).agg(F.sum("amount").alias("_t"))
    return e.join(total, plot).select(plot, "kind", "amount", F.try_divide("amount", "_t").alias("share"))


def kind_fraction(rows: DataFrame, plot: str, kind: str, amount: str, which) -> DataFrame:
    return rows.groupBy(plot).agg(F.try_divide(F.sum(F.when(F.col(kind) == which, F.col(amount)).otherwise(0)), F.sum(amount)).alias("fraction"))


def retention(rows: DataFrame, by: str, kept: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(kept).cast("int")).alias("n_kept"), F.avg(F.col(kept).cast("double")).alias("share"))


def binned_bias(rows: DataFrame, x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Per right-closed bin of x: n, means and bias y - x."""
    return rows.withColumn("bin", B.bin_right_closed(x, edges)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.avg(F.col(y) - F.col(x)).alias("bias"))


def quartile_class(rows: DataFrame, value: str) -> DataFrame:
    """Quarter (0 to 3) of each value by right-closed quartile edges; equal edges are merged."""
    q = F.percentile(F.col(value).cast("double"), F.array(*(F.lit(p / 4) for p in range(5))))
    edges = rows.agg(q.alias("q")).select(F.array_sort(F.array_distinct("q")).alias("_q"))
    place = F.size(F.filter("_q", lambda e: e < F.col(value))) - 1
    return rows.crossJoin(F.broadcast(edges)).withColumn("quarter", F.when(F.col(value).isNotNull(), F.greatest(place, F.lit(0)))).drop("_q")  # one row of edges


def fit_statistics(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """n, r, R2, slope, RMSE and bias of y against x; r and slope are null for too few rows or no variance."""
    used = rows.dropna(subset=[x, y])
    ok = (F.count("*") >= least) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    d = F.col(y) - F.col(x)
    r = F.when(ok, F.corr(x, y))
    return used.groupBy(*by).agg(F.count("*").alias("n"), r.alias("r"), (r * r).alias("r2"), F.when(ok, F.regr_slope(y, x)).alias("slope"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))


def leave_one_out(rows: DataFrame, y: str, xs: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """R2 of predictions that leave each row out, by the hat matrix on sufficient statistics.

    The (k + 1)^2 sums come to the driver; the rows are visited once more as column expressions.
    """
    import numpy as np

    used = rows.dropna(subset=[y, *xs])
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(terms)
    got = used.agg(*(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(terms[i] * F.col(y)).alias(f"b{i}") for i in range(k)), F.avg(y).alias("mean")).first()
    if got["mean"] is None:
        return rows.sparkSession.createDataFrame([(0, None)], "n long, loo_r2 double")
    s = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float) + ridge * np.eye(k)
    inverse = np.linalg.pinv(s)
    c = inverse @ np.array([got[f"b{i}"] for i in range(k)], dtype=float)
    fitted = sum((float(c[i]) * terms[i] for i in range(k)), F.lit(0.0))
    hat = sum((float(inverse[i, j]) * terms[i] * terms[j] for i in range(k) for j in range(k)), F.lit(0.0))
    left = (F.col(y) - fitted) / (1 - hat)
    about = F.col(y) - F.lit(float(got["mean"]))
    return used.agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(left * left), F.sum(about * about))).alias("loo_r2"))


def keep_first(rows: DataFrame, key: str, order: Sequence) -> DataFrame:
    """One row per key: the first in a stated order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def in_large_groups(rows: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Rows whose group has at least so many rows."""
    return rows.join(rows.groupBy(group).count().where(F.col("count") >= least).select(group), group, "left_semi")


def one_type_per_unit(rows: DataFrame, unit: str, type_: str) -> DataFrame:
    """Units that carry several types: empty for a valid table."""
    return rows.groupBy(unit).agg(F.count_distinct(type_).alias("n_types")).where("n_types > 1")
