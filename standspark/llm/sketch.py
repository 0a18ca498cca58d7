"""A Bloom filter, built in the cluster: it says "maybe" or "surely not".

Its size follows the number of keys between two bounds, so that it can be broadcast; beyond the upper one
more keys pass by chance, which costs their readers time and no rightness.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

#: Blocks of the filter; a block is built by one task.
BLOCKS = 64
#: Bits for each key (one key in 40 passes by chance), and the most bits of a filter: 128 megabytes.
BITS_EACH, MOST_BITS = 12, 1 << 30
_U = np.uint64


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, places of the key's bits in its block)."""
    a = textops.mix(keys.view(np.uint64) ^ _U(0x5851F42D4C957F2D))
    b = textops.mix(a + _U(0x14057B7EF767814F))
    return (a >> _U(58)).astype(np.int64), [((a & _U(0xFFFFFFFF)) % _U(bits)).astype(np.int64), (b % _U(bits)).astype(np.int64)]


class Filter:
    def __init__(self, rows: list, bits: int):
        self.bits = bits
        self.table = np.zeros((BLOCKS, bits // 8), dtype=np.uint8)
        for r in rows:
            self.table[r["block"]] |= np.frombuffer(r["bitmap"], dtype=np.uint8)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        block, places = _places(keys, self.bits)
        out = np.ones(len(keys), dtype=bool)
        for p in places:
            out &= (self.table[block, p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(keys: DataFrame, least_bits: int) -> Filter:
    """The filter of the only column (long) of a table that costs little to read twice.

    It has ``least_bits``, or BITS_EACH for each key if that is more, MOST_BITS at most; both bounds hold
    for what comes to the driver, whatever the input.
    """
    total_bits = least_bits
    n = keys.count()
    while total_bits < min(n * BITS_EACH, MOST_BITS):
        total_bits *= 2
    bits = total_bits // BLOCKS

    def build(batches):
        table = np.zeros((BLOCKS, bits), dtype=bool)
        for batch in batches:
            block, places = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            for p in places:
                table[block, p] = True
        full = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([np.packbits(table[b], bitorder="little").tobytes() for b in full], pa.binary())], ["block", "bitmap"])

    def either(key, table):
        total = np.zeros(bits // 8, dtype=np.uint8)
        for x in table.column("bitmap").to_pylist():
            total |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([total.tobytes()], pa.binary())})

    # Keys are dealt by block first, so that a task builds whole blocks and few bitmaps move.
    name = keys.columns[0]
    rows = keys.where(F.col(name).isNotNull()).mapInArrow(build, "block int, bitmap binary").groupBy("block").applyInArrow(either, "block int, bitmap binary").collect()
    return Filter(rows, bits)
