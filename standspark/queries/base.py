"""Registry of queries with their SQL, and the tables that stand in for rasters, collections and plots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6

#: The stand-ins as SQL; every query's SQL may use them.
INPUTS = """
raster AS (SELECT CAST(o_orderkey // 100 AS BIGINT) AS y, CAST(o_orderkey % 100 AS BIGINT) AS x,
                  CAST((o_orderkey // 800) * 13 + (o_orderkey % 100) // 8 AS BIGINT) AS label,
                  o_totalprice AS v, CAST(o_custkey % 7 AS BIGINT) AS kind, CAST(month(o_orderdate) AS DOUBLE) AS m FROM orders),
obs AS (SELECT l_suppkey AS pixel, l_shipdate AS ts, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS price, l_tax AS tax,
               l_discount AS discount, l_quantity AS qty, l_returnflag AS flag, l_orderkey AS ok, l_linenumber AS ln FROM lineitem),
plots AS (SELECT s_suppkey AS plot, CAST(s_nationkey AS BIGINT) AS grp, s_acctbal AS h, CAST(s_suppkey * 37 % 1009 AS DOUBLE) AS px, CAST(s_suppkey * 91 % 997 AS DOUBLE) AS py,
                 CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 3 END AS unit, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 THEN NULL ELSE (s_suppkey % 3) % 2 END AS typ FROM supplier)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (y, x) with a label, a value, a kind and a second band."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.expr("o_orderkey DIV 100").alias("y"), (k % 100).alias("x"), F.expr("(o_orderkey DIV 800) * 13 + (o_orderkey % 100) DIV 8").alias("label"), F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 7).alias("kind"), F.month("o_orderdate").cast("double").alias("m"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated observations per pixel with four bands and a class."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("ts"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots with a group, a height, a place, a unit and a type; some without."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("plot"), F.col("s_nationkey").cast("long").alias("grp"), F.col("s_acctbal").alias("h"), (k * 37 % 1009).cast("double").alias("px"), (k * 91 % 997).cast("double").alias("py"), F.when(k % 11 != 0, k % 3).alias("unit"), F.when((k % 11 != 0) & (k % 13 != 0), (k % 3) % 2).alias("typ"))


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to some decimals, without negative zeros."""
    return frame.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query; its SQL has the same columns, ``doubles`` named for rounding."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            change = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            body = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {INPUTS} {sql}"
            if sql.lstrip().startswith("WITH RECURSIVE"):
                body = f"WITH RECURSIVE {INPUTS}, {sql.lstrip()[15:]}"
            elif sql.lstrip().startswith("WITH"):
                body = f"WITH {INPUTS}, {sql.lstrip()[4:]}"
            SQL[name] = f"SELECT * {f'REPLACE ({change})' if change else ''} FROM ({body})"
        return f

    return put
