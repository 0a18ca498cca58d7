"""Sinks: parquet, CSV with full precision, GeoJSON, manifests with digests."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def full_precision(frame: DataFrame) -> DataFrame:
    """Doubles as text with 17 significant digits, which read back to the same value."""
    return frame.select(*(F.format_string("%.17g", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes))


def layers(pixels: DataFrame, path: str, labels: str, raw: Sequence[str], scaled: Sequence[str], cluster: str) -> list[str]:
    """Three raster layers as pixel tables: labels as whole numbers, raw bands, scaled bands with the cluster."""
    whole = pixels.select("y", "x", F.col(labels).cast("int").alias(labels))
    parts = {"labels": whole, "features": pixels.select("y", "x", *raw), "scaled": pixels.select("y", "x", *scaled, F.col(cluster).cast("int").alias(cluster))}
    return [parquet(frame, f"{path.rstrip('/')}/{name}") for name, frame in parts.items()]


def one_csv(frame: DataFrame, path: str) -> str:
    """A small result as one CSV file on the driver, doubles with 17 digits."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(frame.columns)
        for row in frame.toLocalIterator():
            writer.writerow(["" if v is None else f"{v:.17g}" if isinstance(v, float) else v for v in row])
    return path


def csv_parts(frame: DataFrame, path: str) -> str:
    """A large table as CSV parts."""
    full = frame.select(*(F.col(c).cast("string") if t in ("double", "float") else F.col(c) for c, t in frame.dtypes))
    full.write.mode("overwrite").csv(path, header=True)
    return path


#: Columns that the short-named vector format keeps: a fixed part of the format.
SHORT_COLUMNS = ("stand_id", "stand_lbl", "cluster_id", "area_ha", "perim_m", "n_pixels")


def short(frame: DataFrame, ring: str) -> DataFrame:
    """The outline and those columns of the short format that the table has, whole names of at most ten letters."""
    return frame.select(ring, *(c for c in SHORT_COLUMNS if c in frame.columns))


def features(frame: DataFrame, ring: str, properties: Sequence[str], digits: int = 6) -> DataFrame:
    """One JSON text per feature: a polygon with rounded coordinates, and its properties; NaN becomes null."""
    kinds = dict(frame.dtypes)
    clean = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if kinds.get(c) in ("double", "float") else F.col(c) for c in properties]
    closed = F.concat(F.col(ring), F.slice(ring, 1, 1))
    coordinates = F.transform(closed, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(coordinates).alias("coordinates"))
    return frame.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*clean).alias("properties"))).alias("value"))


def geojson_lines(frame: DataFrame, ring: str, properties: Sequence[str], path: str, digits: int = 6) -> str:
    """Features one per line, in parts."""
    features(frame, ring, properties, digits).write.mode("overwrite").text(path)
    return path


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def stage_files(folder: str, stage: str, tables: dict[str, DataFrame], metadata: dict) -> list[dict]:
    """Small tables as CSV and metadata as JSON, with their digests."""
    os.makedirs(folder, exist_ok=True)
    paths = [one_csv(t, os.path.join(folder, f"{stage}_{name}.csv")) for name, t in tables.items()]
    paths.append(os.path.join(folder, f"{stage}.json"))
    with open(paths[-1], "w", encoding="utf-8") as f:
        json.dump(metadata, f, sort_keys=True, indent=1)
    return [{"file": os.path.basename(p), "sha256": digest(p)} for p in paths]
