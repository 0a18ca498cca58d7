"""Session helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import keep, shared_folder  # noqa: F401

#: Bytes of text that an operator treats at once; a larger batch is cut, a longer text stands alone.
TEXT_BYTES = 2 << 20


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is written meanwhile: for rows that hold large values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, mod: int):
    """crc32 of an id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; never less than one row."""
    if batch.num_rows == 0:
        return
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)] if batch.nbytes > limit else None
    if sizes is None:
        yield batch
        return
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; a null text is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


#: What operators hold between tasks of one Python worker, and how to let it go.
_HELD: dict[str, Callable[[], None]] = {}


def held_by(owner: str, release: Callable[[], None]) -> None:
    _HELD[owner] = release


def release_others(owner: str) -> None:
    """Let go what other operators hold: a worker serves one operator after another."""
    for name in [n for n in _HELD if n != owner]:
        _HELD.pop(name)()


def map_texts(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", setup: Callable[[], Callable] | None = None, owner: str = "", limit: int = TEXT_BYTES) -> DataFrame:
    """mapInArrow with batches cut to ``limit`` bytes of text.  ``setup`` runs once per task and gives the work."""

    def run(batches):
        release_others(owner)
        act = setup() if setup else work
        for batch in batches:
            for piece in pieces(batch, text, limit):
                out = act(piece)
                if out is not None and out.num_rows:
                    yield out

    return frame.mapInArrow(run, schema)


def by_hash(column: str, share: float, seed: int = 17):
    """True for about ``share`` of the ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
