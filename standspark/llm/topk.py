"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Candidates stay where they are: a shard is a run of SHARD_ROWS rows of a task's input, and a ball tree is
built over each.  Queries go to all tasks in blocks of bounded bytes.  A node is entered with those queries
of a block alone whose bound (inner product with the centre plus norm times radius) reaches their
current k-th score; the child with the larger bounds goes first, so that its scores prune the other.
The k-th score is shared: between the nodes of a tree, from each shard of a task to the next, and from a
pilot sample of the candidates, searched first, to all tasks.

Components become integers, floor(1024 * x), and scores are sums of 64-bit integers, exact where they fit
them; floats serve as bounds alone, with more slack than their rounding.

Defined results: a vector that is null or has a null, NaN or infinite component, or none, takes no part, nor
does a row without an id, nor one with a component whose integer does not fit 64 bits; vectors of different
lengths are not compared; rows that share the query's id are its own; a query that is repeated with the
same vector is asked once, one id with several vectors has the best of all of them; a candidate that is
repeated counts as often.  Ties go to the smaller id.  An empty table gives none.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Candidates of a shard: a ball tree of this many 64-component vectors takes some megabytes.
SHARD_ROWS = 8192
#: Candidates of the pilot sample (in expectation).
PILOT_ROWS = 8192
LEAF = 64
#: Queries that go down a tree together, and bytes of the queries of a block.
TOGETHER, BLOCK_BYTES = 512, 8 << 20
#: Score of a place that nothing has taken yet.
NONE = np.iinfo(np.int64).min + 1


class Best:
    """The k best scores of a block's queries so far, with their ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.query_ids, self.queries, self.floor = query_ids, queries, floor
        self.rough = queries.astype(np.float64)
        self.norm = np.sqrt((self.rough**2).sum(1)) * (1 + 1e-12)
        self.score = np.full((len(queries), k), NONE)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, active: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = self.queries[active] @ vectors.T
        ids = np.broadcast_to(ids, score.shape)
        score = np.where(ids == self.query_ids[active][:, None], NONE, score)
        score, ids = np.concatenate([self.score[active], score], axis=1), np.concatenate([self.id[active], ids], axis=1)
        top = np.lexsort((ids, -score), axis=-1)[:, : self.score.shape[1]]
        self.score[active], self.id[active] = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)

    def needed(self, active: np.ndarray) -> np.ndarray:
        """Scores below this are not among the k best."""
        return np.maximum(self.score[active, -1], self.floor[active]).astype(np.float64)


class BallTree:
    """Centre and radius of every node; leaves hold rows start:stop of the reordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.rough = vectors.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self.root = self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _build(self, start: int, stop: int) -> int:
        rows = self.order[start:stop]
        own = self.rough[rows]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        radius = math.sqrt(away.max())
        at = len(self.nodes)
        self.nodes.append((centre, radius, start, stop, -1, -1))
        if stop - start > LEAF:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            side = np.argsort(own @ (b - a), kind="stable")
            self.order[start:stop] = rows[side]
            middle = (start + stop) // 2
            left, right = self._build(start, middle), self._build(middle, stop)
            self.nodes[at] = (centre, radius, start, stop, left, right)
        return at

    def bound(self, best: Best, node: int, active: np.ndarray) -> np.ndarray:
        """No score below a node is larger; the last terms are more than what is lost to rounding."""
        centre, radius = self.nodes[node][:2]
        size = best.norm[active] * (math.sqrt(float(centre @ centre)) + radius)
        return best.rough[active] @ centre + best.norm[active] * radius + 1e-9 * size + 1

    def search(self, best: Best) -> None:
        def visit(node: int, active: np.ndarray, value: np.ndarray) -> None:
            keep = value >= best.needed(active)
            active, value = active[keep], value[keep]
            if not len(active):
                return
            _, _, start, stop, left, right = self.nodes[node]
            if left < 0:
                best.add(active, self.ids[start:stop], self.vectors[start:stop])
                return
            bounds = [self.bound(best, left, active), self.bound(best, right, active)]
            for turn in (0, 1) if bounds[0].mean() >= bounds[1].mean() else (1, 0):
                visit((left, right)[turn], active, bounds[turn])

        for lo in range(0, len(best.query_ids), TOGETHER):
            active = np.arange(lo, min(lo + TOGETHER, len(best.query_ids)))
            visit(self.root, active, self.bound(best, self.root, active))


def _shards(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of runs of rows with equally long vectors."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vector")
        flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        dim, first = np.diff(offsets), offsets[:-1] - offsets[0]
        for d in np.unique(dim).tolist():
            rows = np.flatnonzero(dim == d)
            held.setdefault(d, []).append((ids[rows], flat[first[rows][:, None] + np.arange(d)]))
            size[d] = size.get(d, 0) + len(rows)
            if size[d] >= SHARD_ROWS:
                own = [np.concatenate(x) for x in zip(*held.pop(d), strict=True)]
                for lo in range(0, size.pop(d), SHARD_ROWS):
                    yield own[0][lo : lo + SHARD_ROWS], own[1][lo : lo + SHARD_ROWS]
    for own in held.values():
        ids, vectors = (np.concatenate(x) for x in zip(*own, strict=True))
        yield ids, vectors


def _search(candidates: DataFrame, block: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Of each task its k best for every query of a block: (ids, vectors of one length, least scores needed)."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        best = {queries.shape[1]: Best(ids, queries, floor, k) for ids, queries, floor in shared.value}
        for ids, vectors in _shards(batches):
            if vectors.shape[1] in best:
                BallTree(ids, vectors).search(best[vectors.shape[1]])
        for b in best.values():
            has = (b.score > NONE) & (b.score >= b.floor[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.query_ids, has.sum(1))), pa.array(b.id[has]), pa.array(b.score[has])], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, vector) with vector = floor(1024 * component) of every vector that takes part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.expr("transform(embedding, x -> CAST(x AS double))").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) >= 9007199254740992D)")
    return rows.select("id", F.expr("transform(v, x -> CAST(floor(1024 * x) AS long))").alias("vector"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all other rows."""
    vectors = common.keep(integer_vectors(embeddings))
    asked = common.keep(vectors.where(is_query).distinct())
    n, (many, wide) = vectors.count(), asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    pilot = vectors.where(common.by_hash("id", min(1.0, PILOT_ROWS / max(n, 1))))
    blocks = max(1, math.ceil(8 * wide / BLOCK_BYTES))
    found = []
    for number in range(blocks if many else 0):
        # A block's queries, and a score for each, come to the driver: BLOCK_BYTES on average.
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        block = [(ids, queries, np.full(len(ids), NONE)) for ids, queries in _together(rows)]
        if not block:
            continue
        # The k-th score of the pilot bounds all other searches from below.
        kth = _ranked(_search(pilot, block, k), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        floor = dict(zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist(), strict=True))
        block = [(ids, queries, np.array([floor.get(i, NONE) for i in ids.tolist()], dtype=np.int64)) for ids, queries, _ in block]
        found.append(common.keep(_search(vectors, block, k)))
    if not found:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return _ranked(whole, k)


def _together(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length."""
    dims = sorted({len(v) for v in rows.column("vector").to_pylist()})
    by = [[(i, v) for i, v in zip(rows.column("id").to_pylist(), rows.column("vector").to_pylist(), strict=True) if len(v) == d] for d in dims]
    return [(np.array([i for i, _ in own], dtype=np.int64), np.array([v for _, v in own], dtype=np.int64)) for own in by]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_exact_topk: the rows of ``embeddings`` whose id is divisible by 100, against all rows."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


#: The same by brute force.
SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
