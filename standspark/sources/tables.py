"""Scans: dated collections, yearly folders, points, vectors, settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection


class EmptyCollection(ValueError):
    """A scan found nothing."""


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    """The table itself; raises if it is empty."""
    if frame.limit(1).count() == 0:
        raise EmptyCollection(f"{what} is empty")
    return frame


def dated(spark: SparkSession, path: str, ts: str, start: str, end: str, bounds: dict | None = None, at_most: dict | None = None, equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """A parquet collection cut to dates, bounds and metadata: all predicates reach the scan."""
    obs = collection.within_dates(spark.read.parquet(path), ts, start, end)
    for column, (low, high) in (bounds or {}).items():
        obs = obs.where(F.col(column).between(low, high))
    return collection.with_metadata(obs, at_most, equal, contains)


def yearly(spark: SparkSession, path: str, first: int, last: int, pattern: str = r"(\d{4})_(\d{4})") -> DataFrame:
    """Annual parquet layers whose year stands in the file's name; other years' files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    years = files.select("path", F.regexp_extract("path", pattern, 1).try_cast("int").alias("year")).where(F.col("year").between(first, last)).collect()
    if not years:
        raise EmptyCollection(f"no layer between {first} and {last}")
    out = None
    for r in sorted(years, key=lambda r: (r["year"], r["path"])):
        one = spark.read.parquet(r["path"]).withColumn("year", F.lit(r["year"]))
        out = one if out is None else out.unionByName(one)
    return out


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def points(spark: SparkSession, path: str, id_: str, lon: str, lat: str) -> DataFrame:
    """Points of a CSV file; ids must be unique and coordinates present."""
    rows = csv(spark, path, f"{id_} string, {lon} double, {lat} double")
    bad = rows.groupBy(id_).agg(F.count("*").alias("n"), F.count(lon).alias("a"), F.count(lat).alias("b")).where("n > 1 OR a < n OR b < n").limit(1).collect()
    if bad:
        raise ValueError(f"{id_} {bad[0][0]!r} is repeated or has no place")
    return rows


#: Geometry as nested arrays fits polygons and multi-polygons only as text; coordinates are parsed by kind.
_FEATURES = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def geojson(spark: SparkSession, path: str, properties: Sequence[str] = ()) -> DataFrame:
    """(feature, piece, ring, kind, properties...): the outer ring of every polygon, points as rings of one."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURES).alias("f"))
    f = text.select(F.posexplode("f.features").alias("feature", "g"))
    kind, raw = F.col("g.geometry.type"), F.col("g.geometry.coordinates")
    pieces = (
        F.when(kind == "Point", F.transform(F.array(F.from_json(raw, "array<double>")), lambda p: F.array(p)))
        .when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>")))
        .when(kind == "Polygon", F.slice(F.from_json(raw, "array<array<array<double>>>"), 1, 1))
        .when(kind == "MultiPolygon", F.transform(F.from_json(raw, "array<array<array<array<double>>>>"), lambda p: p[0]))
    )
    out = f.select("feature", "g", kind.alias("kind"), F.posexplode(pieces).alias("piece", "r"))
    ring = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return out.select("feature", "piece", "kind", ring.alias("ring"), *(F.col("g.properties")[p].alias(p) for p in properties))


def average_mosaics(parts: Sequence[DataFrame], bands: Sequence[str]) -> DataFrame:
    """Mean of several years' pixels."""
    return collection.collapse_years(collection.merge_collections(*parts), ["y", "x"], bands)


def record_of_inputs(images: DataFrame, id_: str, most: int = 100) -> dict:
    """Number of input images, a digest of their ids, and the ids if they are few.

    The digest adds up hashes of ids, so no task gathers them.
    """
    ids = images.select(F.col(id_).cast("string").alias("id")).distinct()
    row = ids.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).first()
    listed = [r["id"] for r in ids.orderBy("id").limit(most).collect()] if row["n"] <= most else None
    return {"n": row["n"], "digest": json.dumps(str(row["h"])), "ids": listed}


def settings(path: str, environment: dict[str, str], prefix: str = "") -> dict[str, str]:
    """Names and values of a settings file (NAME=value, # comments, quotes); the environment's value wins."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and name.strip() and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                out[name.strip()] = value[1:-1] if quoted else value.partition(" #")[0].strip()
    return {k: environment.get(k, v) for k, v in out.items() if k.startswith(prefix)}


#: TIFF sample formats by (format, bits): unsigned, signed, floating.
_TIFF_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tiff_bands(data: bytes):
    """The bands of a baseline TIFF (strips, no compression, interleaved by pixel) as an array (row, column, band)."""
    import struct

    import numpy as np

    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags, width = {}, {1: "B", 3: "H", 4: "I"}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in width:
            size = n * struct.calcsize(width[kind])
            raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
            tags[tag] = struct.unpack(f"{order}{n}{width[kind]}", raw)
    if tags.get(259, (1,)) != (1,) or tags.get(284, (1,)) != (1,) or 273 not in tags:
        raise ValueError("only uncompressed strips, interleaved by pixel, can be read")
    kind = _TIFF_KINDS[tags.get(339, (1,))[0], tags[258][0]]
    raw = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, dtype=order + kind).reshape(tags[257][0], tags[256][0], tags.get(277, (1,))[0])


def raster(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    """(path, y, x, bands as doubles) of raster files; a file is one task, so rasters come as tiles."""
    import numpy as np
    import pandas as pd

    def explode(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                table = tiff_bands(bytes(content))
                if table.shape[2] != len(bands):
                    raise ValueError(f"{name} has {table.shape[2]} bands")
                y, x = np.indices(table.shape[:2])
                yield pd.DataFrame({"path": name, "y": y.ravel(), "x": x.ravel(), **{b: table[:, :, k].ravel().astype(float) for k, b in enumerate(bands)}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(explode, "path string, y long, x long" + "".join(f", {b} double" for b in bands))
