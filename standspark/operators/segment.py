"""Superpixels by simple non-iterative clustering (SNIC, from the published algorithm), tile by tile.

Seeds stand on a grid.  A priority queue takes pixels in order of their distance to a growing
cluster's running mean in colour and place; each pixel is labelled once, so clusters are connected.
Tiles are independent, so memory is bounded by a tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snic(colour: np.ndarray, valid: np.ndarray, size: int, compactness: float, connectivity: int = 8) -> np.ndarray:
    """Labels from 0 of an (h, w, bands) array; -1 where a pixel is not valid.

    A seed stands every ``size`` pixels, at the nearest valid pixel of its cell; a patch that no seed
    reaches gets one of its own at its first pixel.
    """
    h, w, _ = colour.shape
    label = np.full((h, w), -1)
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * (connectivity == 8)
    sums: list[np.ndarray] = []
    count: list[int] = []
    heap: list[tuple[float, int, int, int, int]] = []
    order = 0

    def seed(y: int, x: int) -> None:
        nonlocal order
        sums.append(np.zeros(colour.shape[2] + 2))
        count.append(0)
        heapq.heappush(heap, (0.0, order, y, x, len(sums) - 1))
        order += 1

    def grow() -> None:
        nonlocal order
        while heap:
            _, _, y, x, k = heapq.heappop(heap)
            if label[y, x] >= 0:
                continue
            label[y, x] = k
            sums[k] += np.concatenate([colour[y, x], [y, x]])
            count[k] += 1
            mean = sums[k] / count[k]
            for dy, dx in steps:
                v, u = y + dy, x + dx
                if 0 <= v < h and 0 <= u < w and valid[v, u] and label[v, u] < 0:
                    near = (v - mean[-2]) ** 2 + (u - mean[-1]) ** 2
                    like = float(((colour[v, u] - mean[:-2]) ** 2).sum())
                    heapq.heappush(heap, ((like + near * (compactness / size) ** 2) ** 0.5, order, v, u, k))
                    order += 1

    for y0 in range(0, h, size):
        for x0 in range(0, w, size):
            cell = np.argwhere(valid[y0 : y0 + size, x0 : x0 + size])
            if len(cell):
                mid = np.array([(min(size, h - y0) - 1) / 2, (min(size, w - x0) - 1) / 2])
                y, x = cell[((cell - mid) ** 2).sum(1).argmin()] + (y0, x0)
                seed(int(y), int(x))
    grow()
    while len(left := np.argwhere(valid & (label < 0))):
        seed(int(left[0][0]), int(left[0][1]))
        grow()
    return label


def superpixels(pixels: DataFrame, bands: Sequence[str], size: int = 10, compactness: float = 0.5, connectivity: int = 8, tile: int = 128) -> DataFrame:
    """(y, x, label): one label space over all tiles; pixels with a null band have none and are absent."""
    tiled = pixels.dropna(subset=list(bands)).select("y", "x", *(F.col(b).cast("double").alias(b) for b in bands), F.floor(F.col("y") / tile).cast("long").alias("ty"), F.floor(F.col("x") / tile).cast("long").alias("tx"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(frame["ty"].iloc[0]), int(frame["tx"].iloc[0])
        y, x = frame["y"].to_numpy() - ty * tile, frame["x"].to_numpy() - tx * tile
        colour, valid = np.zeros((tile, tile, len(bands))), np.zeros((tile, tile), dtype=bool)
        colour[y, x], valid[y, x] = frame[list(bands)].to_numpy(), True
        label = snic(colour, valid, size, compactness, connectivity)
        base = ((ty << 24) + tx) * (tile * tile)
        return pd.DataFrame({"y": frame["y"].astype("int64"), "x": frame["x"].astype("int64"), "label": base + label[y, x].astype("int64")})

    return tiled.groupBy("ty", "tx").applyInPandas(work, "y long, x long, label long")
