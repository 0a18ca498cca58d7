"""Numbers from an order over a whole table, without one task that holds it.

Rows are dealt by ranges of their order; a task numbers its own range, and the sizes of the ranges
before it (one row for each range) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import keep


def numbered(frame: DataFrame, order: Sequence[Column], name: str, first: int = 1) -> DataFrame:
    """The table with places first, first + 1 ... in the order; rows that tie are in no order, so name a last key."""
    dealt = keep(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(before, "_range").withColumn(name, F.col("_before") + F.col("_place") + F.lit(first - 1)).drop("_range", "_n", "_before", "_place")


def running(frame: DataFrame, order: Sequence[Column], value: str, name: str, kind: str = "sum") -> DataFrame:
    """The table with the sum (or max) of a column up to each row in the order; name a last key against ties."""
    total = {"sum": F.sum, "max": F.max}[kind]
    dealt = keep(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range").agg(total(value).alias("_t"))
    before = ends.select("_range", total("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = dealt.withColumn("_own", total(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    both = F.coalesce("_before", F.lit(0)) + F.col("_own") if kind == "sum" else F.greatest("_before", "_own")
    return own.join(before, "_range").withColumn(name, both).drop("_range", "_before", "_own")


def average_ranks(frame: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The table with ranks from 1, ties averaged, within groups or over all rows.

    Over all rows, ranks come from one row for each distinct value, in ranges of them.
    """
    if by:
        w = Window.partitionBy(*by)
        return frame.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)
    counts = frame.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    upto = running(counts, [F.col("_value")], "_c", "_upto").select("_value", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return frame.join(upto, frame[value].eqNullSafe(F.col("_value"))).drop("_value")


def dense_ids(frame: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The table with 0..k-1 for the distinct combinations of columns in their order; -1 where one is null or NaN."""
    whole = F.lit(True)
    for c, kind in frame.select(*columns).dtypes:
        whole = whole & F.col(c).isNotNull() & (~F.isnan(c) if kind in ("double", "float") else F.lit(True))
    codes = numbered(frame.where(whole).select(*columns).distinct(), [F.col(c) for c in columns], name, 0)
    return frame.join(codes, list(columns), "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("long"))


def encode(frame: DataFrame, column: str, name: str, missing: Sequence = ()) -> DataFrame:
    """The table with codes 0..k-1 of a label in its order; -1 for null, NaN and the values listed as missing."""
    shown = F.when(~F.col(column).isin(list(missing)), F.col(column)) if missing else F.col(column)
    return dense_ids(frame.withColumn("_label", shown), ["_label"], name).drop("_label")


def renumber(stands: DataFrame, lat: str, lon: str, key: str, name: str = "stand_id", weight: float = 1e6) -> DataFrame:
    """Ids 1..N from north to south, then west to east: by lon - weight * lat, ties by the key."""
    return numbered(stands, [F.col(lon) - weight * F.col(lat), F.col(key)], name)
