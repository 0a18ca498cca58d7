"""Streaming forms of the collection reducers (an extension): tumbling windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_composite(stream: DataFrame, ts: str, pixel: Sequence[str], band: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Count, mean, least and largest value per pixel and tumbling window.

    The state of a window is one row of sums per pixel; the watermark closes windows and drops what
    comes later than ``lateness``.  Works on batches, too.
    """
    late = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    out = late.groupBy(F.window(ts, width).alias("w"), *pixel).agg(F.count(band).alias("n"), F.avg(band).alias("mean"), F.min(band).alias("least"), F.max(band).alias("largest"))
    return out.select(*pixel, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "least", "largest")


def sessions(stream: DataFrame, ts: str, pixel: Sequence[str], gap: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Runs of observations of a pixel without a gap that long."""
    late = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    out = late.groupBy(F.session_window(ts, gap).alias("w"), *pixel).agg(F.count("*").alias("n"))
    return out.select(*pixel, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append closed windows to a folder, exactly once; with ``once``, stop when all input is read."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
