"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 0.8 or more.

Size-banded tiles with hashed bitmap signatures, exact over all documents:

1. Documents with one and the same set form a class, shown by its smallest id (any others follow it).
2. Two sets that are similar enough share SHARED of their first shingles when each set is put in one
   common order, early enough for what follows to suffice; only those prefixes are joined.  The
   order puts shingles that occur often last, by counts in a table of fixed size, so that common
   passages hardly ever stand in a prefix.  Several shared shingles are asked for, because documents
   that happen to have one phrase in common grow faster in number than similar ones do.
3. Every document has one tile: its home is the prefix shingle that it shares with most others, a band
   of size is a factor of 100 / PERCENT wide, and a band is dealt into tiles of about TILE.
   Near copies have a few tiles between them, however many they are.
4. Two tiles are compared, once, if prefix shingles stand in both, sizes permitting; those of their
   documents go there that share enough of them with the other tile.  What moves between tasks is pairs of tiles, never pairs of
   documents: a group of m near copies makes some (m / documents of a tile) ** 2 of them, each a
   task's work of bounded size, and a set moves once for each pair of its tile.
5. Within two tiles the bit counts of signatures bound the overlap of all pairs from above; pairs that
   pass have their exact sorted sets intersected.  A task hands on each document's number of links and
   a spanning forest of them, at most a row for each document.

Sets hold 64-bit hashes of shingles.

Defined results: a null text is empty; a document without words has an empty set, links with nothing
and is its own component; rows with a null id are left out; a row that is repeated counts once (ids must
tell texts apart: an id with two texts has a row for each set, and their links are those of the id);
ties of class and component go to the smallest id; an empty table gives none; extra columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected
from . import common, sketch, textops

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
PERCENT = 80
#: Buckets of the table of shingle counts; a byte each when sent to the executors.
ORDER_BUCKETS = 1 << 22
#: Bits of a signature for each shingle, and their least and greatest number (powers of two).
BITS_EACH, BITS_LEAST, BITS_MOST = 4, 256, 1 << 17
#: Least bits of the filters of ids and of shingles: 1 and 2 megabytes.
ID_BITS, SHINGLE_BITS = 1 << 23, 1 << 24
#: Prefix shingles that two similar sets share at least (all that must be common, in small sets).
SHARED = 4
#: Shingles of a tile, on average; a task holds two tiles.
TILE = 1 << 18
#: Rows of a batch of sets, and documents whose links a task holds before it hands them on.
SET_ROWS, HELD_DOCS = 64, 1 << 17
_U = np.uint64


def least_overlap(size):
    """Fewest common shingles of two sets with this total size that are similar enough."""
    return -((-PERCENT * size) // (100 + PERCENT))


def prefix_length(n):
    """How many shingles of a set of n, in the common order, must be joined.

    Of n and at least (PERCENT n + 99) // 100 common ones, all but so many may come before the k-th common one.
    """
    common = (PERCENT * n + 99) // 100
    return n - common + np.minimum(SHARED, common)


#: Shared prefix shingles that a set of n has with any that is similar; the other may be smaller by PERCENT.
_ENOUGH = f"least({{shared}}, ceil({PERCENT * PERCENT} * n / 10000))"


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle keys of all texts, first index of each text)."""
    keys, rows = textops.distinct_by_row(*textops.shingles(textops.Words(texts), WORDS))
    return keys, np.searchsorted(rows, np.arange(len(texts) + 1))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Level of each bucket: twice the logarithm to base 2 of how often its shingles occur, over all documents.

    Each task sends a byte per bucket (255 for more), in blocks; the blocks are added up in the cluster.
    """
    block = 1 << 16

    def count(batches):
        total = np.zeros(ORDER_BUCKETS, dtype=np.uint32)
        for batch in batches:
            for piece in common.pieces(batch):
                keys, _ = sets_of(common.texts_of(piece))
                total += np.bincount(bucket(keys), minlength=ORDER_BUCKETS).astype(np.uint32)
        total = np.minimum(total, 255).astype(np.uint8)
        full = [i for i in range(ORDER_BUCKETS // block) if total[i * block : (i + 1) * block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([total[i * block : (i + 1) * block].tobytes() for i in full], pa.binary())], ["block", "counts"])

    def add(key, table):
        total = np.zeros(block, dtype=np.float64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype=np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.rint(2 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    level = np.zeros(ORDER_BUCKETS, dtype=np.uint8)
    for r in rows:
        level[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], dtype=np.uint8)
    return level


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(40)).astype(np.int64) % ORDER_BUCKETS


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key): set_key is a hash of the whole set, null for an empty one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, first = sets_of(common.texts_of(batch))
        n = np.diff(first)
        mixed = textops.mix(keys ^ _U(0xA5A5A5A5A5A5A5A5))
        total, other = np.concatenate([[_U(0)], np.cumsum(mixed)]), np.concatenate([[_U(0)], np.cumsum(textops.mix(keys + _U(12345)))])
        set_key = pa.array(textops.as_signed(total[first[1:]] - total[first[:-1]]), mask=n == 0)
        set_key2 = pa.array(textops.as_signed(other[first[1:]] - other[first[:-1]]), mask=n == 0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), set_key, set_key2], ["doc_id", "n_shingles", "key1", "key2"])

    return common.map_texts(docs, work, "doc_id long, n_shingles long, key1 long, key2 long")


def prefixes(docs: DataFrame, levels, shown, wanted=None) -> DataFrame:
    """(shingle, doc_id, n, at): prefixes of the sets in the common order, of documents that pass the filter
    of ids; with ``wanted``, only shingles that pass it, too."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keep = shown.value.maybe(ids)
        keys, first = sets_of([t if k else b"" for t, k in zip(common.texts_of(batch), keep, strict=True)])
        n = np.diff(first)
        rows = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((keys, levels.value[bucket(keys)], rows))
        place = np.arange(len(keys)) - first[rows]
        inside = place < prefix_length(n)[rows]
        chosen, place = order[inside], place[inside]
        if wanted is not None:
            hit = wanted.value.maybe(textops.as_signed(keys[chosen]))
            chosen, place = chosen[hit], place[hit]
        return pa.RecordBatch.from_arrays([pa.array(textops.as_signed(keys[chosen])), pa.array(ids[rows[chosen]]), pa.array(n[rows[chosen]].astype(np.int32)), pa.array(place.astype(np.int32))], ["shingle", "doc_id", "n", "at"])

    return common.map_texts(docs, work, "shingle long, doc_id long, n int, at int")


def signature_bits(n):
    """Bits of the signature of a set of n: a power of two, some for each shingle."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) * BITS_EACH)).astype(np.int64), BITS_LEAST, BITS_MOST)


def sets_and_marks(docs: DataFrame, chosen) -> DataFrame:
    """(doc_id, n, signature, members) of documents that pass a filter of ids: bitmap of hashes, sorted keys as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(chosen.value.maybe(ids))
        if not len(mine):
            return None
        keys, first = sets_of(common.texts_of(batch.take(pa.array(mine))))
        n, out, marks, signed, place = np.diff(first), [], [], textops.as_signed(keys), textops.mix(keys)
        for lo, hi, bits in zip(first[:-1], first[1:], signature_bits(n), strict=True):
            out.append(np.sort(signed[lo:hi]).tobytes())
            # Lengths are powers of two, so that folding a signature keeps the low bits of a place.
            bitmap = np.zeros(bits, dtype=bool)
            bitmap[(place[lo:hi] % _U(bits)).astype(np.int64)] = True
            marks.append(np.packbits(bitmap, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(n), pa.array(marks, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "n", "signature", "members"])

    return common.map_texts(docs, run, "doc_id long, n long, signature binary, members binary")


def _fold(marks: list[np.ndarray], words: int) -> np.ndarray:
    """Signatures of one length: lengths are powers of two, so the longer are folded onto the shorter."""
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in marks])


def _enough(x: np.ndarray, y: np.ndarray, n_x: int, n_y: np.ndarray) -> np.ndarray:
    """Whether signatures allow enough common shingles: a bit that one has alone costs it a shingle."""
    both = np.bitwise_count(x & y).sum(1, dtype=np.int64)
    bound = both + np.minimum(n_x - np.bitwise_count(x).sum(dtype=np.int64), n_y - np.bitwise_count(y).sum(1, dtype=np.int64))
    return bound >= least_overlap(n_x + n_y)


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """The same for two documents."""
    marks = [np.frombuffer(s, dtype=np.uint64) for s in (a, b)]
    x, y = _fold(marks, min(map(len, marks)))
    return bool(_enough(x, y[None], n_a, np.array([n_b]))[0])


class Tile:
    """Documents of a tile: ids, sizes, signatures and exact sorted sets."""

    def __init__(self, ids: list[int], n: list[int], signatures: list[bytes], members: list[bytes]):
        self.ids, self.n = np.array(ids, dtype=np.int64), np.array(n, dtype=np.int64)
        self.marks = [np.frombuffer(s, dtype=np.uint64) for s in signatures]
        self.words = min(map(len, self.marks))
        self.sets = [np.frombuffer(m, dtype=np.int64) for m in members]
        self.flat = np.concatenate(self.sets)


def links(a: Tile, b: Tile):
    """(index in a, indices in b) of all similar pairs of two tiles; of a tile with itself, each pair once."""
    words = min(a.words, b.words)
    x, y = _fold(a.marks, words), _fold(b.marks, words)
    for i, n in enumerate(a.n):
        ok = (PERCENT * np.maximum(n, b.n) <= 100 * np.minimum(n, b.n)) & (b.ids != a.ids[i])
        if a is b:
            ok[: i + 1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        at = at[_enough(x[i], y[at], n, b.n[at])]
        if not len(at):
            continue
        own, size = a.sets[i], b.n[at]
        flat = b.flat if len(at) == len(b.n) else np.concatenate([b.sets[j] for j in at])
        hit = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
        overlap = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        at = at[100 * overlap >= PERCENT * (n + size - overlap)]
        if len(at):
            yield i, at


class Forest:
    """Links of a task: how many each document has, and the smallest document that they reach."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.count: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def add(self, a: Tile, b: Tile) -> None:
        count_a, count_b = np.zeros(len(a.n), dtype=np.int64), np.zeros(len(b.n), dtype=np.int64)
        for i, at in links(a, b):
            count_a[i] += len(at)
            count_b[at] += 1
            x = self.find(int(a.ids[i]))
            for other in b.ids[at].tolist():
                if (y := self.find(other)) != x:
                    self.root[max(x, y)] = x = min(x, y)
        for tile, count in ((a, count_a), (b, count_b)):
            for j in np.flatnonzero(count).tolist():
                self.count[int(tile.ids[j])] = self.count.get(int(tile.ids[j]), 0) + int(count[j])

    def rows(self) -> pa.RecordBatch:
        ids = list(self.count)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([self.find(i) for i in ids], pa.int64()), pa.array(list(self.count.values()), pa.int64())], ["doc_id", "root", "n"])


def tiles_of(rows: DataFrame) -> DataFrame:
    """(doc_id, tile) from prefix rows with ``docs``, the number of documents of the shingle.

    Documents that share too few shingles with all others together have no tile.
    """
    met = rows.groupBy("doc_id", "n").agg(F.max(F.struct("docs", "shingle"))["shingle"].alias("home"), F.count("*").alias("shared"))
    homes = common.keep(met.where(f"shared >= {_ENOUGH.format(shared=SHARED)}").drop("shared").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int")))
    bands = common.keep(homes.groupBy("home", "band").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles")))
    number = F.pmod(F.xxhash64("doc_id"), "tiles")
    return common.keep(homes.join(bands, ["home", "band"]).select("doc_id", F.xxhash64("home", "band", number).alias("tile")))


def _extent() -> list:
    """Of rows of one shingle: the sizes they span, and the most shingles that any has from this one on."""
    return [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("rest")]


def _may() -> str:
    """Whether a row may be one of the first SHARED of a link with one of others with this extent: sizes are alike,
    and enough follows the shingle, with those before it."""
    return f"{PERCENT} * n <= 100 * hi AND {PERCENT} * lo <= 100 * n AND (least(n - at, rest) + {SHARED - 1}) * {100 + PERCENT} >= {PERCENT} * (n + greatest(lo, {PERCENT} * n DIV 100))"


def routes(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """(doc_id, a, b, side): the pairs (a <= b) of tiles in which a document is compared.

    Tiles are paired where a prefix shingle stands in both, and sizes and places permit a link; only those
    documents of theirs go there that have the shingle and may be similar to one of the other tile.
    """
    placed = common.keep(rows.join(tiles, "doc_id").select("shingle", "tile", "doc_id", "n", "at"))
    met = common.keep(placed.groupBy("shingle", "tile").agg(*_extent(), F.count("*").alias("docs")))
    sides = [met.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in met.columns[1:])) for x in "ab"]
    fits = f"{PERCENT} * lo_a <= 100 * hi_b AND {PERCENT} * lo_b <= 100 * hi_a AND (least(rest_a, rest_b) + {SHARED - 1}) * {100 + PERCENT} >= {PERCENT} * (lo_a + lo_b)"
    both = sides[0].join(sides[1], "shingle").where(f"(tile_a < tile_b OR tile_a = tile_b AND docs_a + docs_b > 2) AND {fits}")
    side = lambda k, own, other: F.struct(F.lit(k).alias("side"), F.col(f"tile_{own}").alias("tile"), *(F.col(f"{c}_{other}").alias(c) for c in ("lo", "hi", "rest")))
    ends = F.when(F.col("tile_a") == F.col("tile_b"), F.array(side(0, "a", "b"))).otherwise(F.array(side(0, "a", "b"), side(1, "b", "a")))
    wanted = both.select("shingle", F.col("tile_a").alias("a"), F.col("tile_b").alias("b"), F.explode(ends).alias("e")).select("shingle", "a", "b", "e.*")
    met = placed.join(wanted, ["shingle", "tile"]).where(_may()).groupBy("doc_id", "n", "a", "b", "side").agg(F.count("*").alias("shared"))
    return common.keep(met.where(f"shared >= {_ENOUGH.format(shared=SHARED)}").select("doc_id", "a", "b", "side"))


def linked(routes: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, root, n): the links that a task has found in its pairs of tiles."""
    # Sets are never broadcast, whatever their size, so that what moves is in proportion to the input.
    filled = sets.join(routes.hint("merge"), "doc_id").select("a", "b", "side", "doc_id", "n", "signature", "members")

    def run(batches):
        forest, now, held = Forest(), None, ({}, {})

        def compare():
            tiles = [Tile(*zip(*side.values(), strict=True)) for side in held if side]
            if len(tiles) == 2 or tiles and now[0] == now[1]:
                forest.add(tiles[0], tiles[-1])

        for batch in batches:
            for a, b, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != now:
                    compare()
                    now, held = (a, b), ({}, {})
                    if len(forest.count) > HELD_DOCS:
                        yield forest.rows()
                        forest = Forest()
                held[side][row[0], row[-1]] = row  # a repeated row counts once
        compare()
        yield forest.rows()

    with common.batch_rows(sets.sparkSession, SET_ROWS):
        return common.keep(filled.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(run, "doc_id long, root long, n long"))


def similar_documents(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id
    (smallest id that links reach), n_links (how many different sets are similar to its own)."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    sized = common.keep(classes(docs))
    # Joins come after tables are written, so that a class with a large share of all rows can be split.
    copies = common.keep(sized.where("key1 IS NOT NULL").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    sized = sized.join(copies, ["key1", "key2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    sized = common.keep(sized.distinct())

    # One document of each class goes on; a filter tells which, and may let copies through, at no harm.
    shown = spark.sparkContext.broadcast(sketch.bloom(sized.where("doc_id = class_id AND n_shingles > 0").select("doc_id"), ID_BITS))
    levels = spark.sparkContext.broadcast(shingle_counts(docs))
    # A document's row gives each of its shingles once, so a shingle counted twice is in two documents.
    met = common.keep(prefixes(docs, levels, shown).select("shingle").groupBy("shingle").count().where("count > 1").select("shingle"))
    wanted = spark.sparkContext.broadcast(sketch.bloom(met, SHINGLE_BITS))
    own = sized.where("doc_id = class_id").select("doc_id")
    rows = common.keep(prefixes(docs, levels, shown, wanted).join(own, "doc_id", "left_semi").distinct())
    shared = common.keep(rows.groupBy("shingle").agg(F.count("*").alias("docs"), *_extent()).where("docs > 1"))
    rows = common.keep(rows.join(shared, "shingle").where(_may()).drop("lo", "hi", "rest"))
    tiles = tiles_of(rows)
    where = routes(rows, tiles)
    involved = spark.sparkContext.broadcast(sketch.bloom(where.select("doc_id"), ID_BITS))
    found = linked(where, sets_and_marks(docs, involved))
    comp = connected(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("doc_id").agg(F.sum("n").alias("n_links"))
    facts = common.keep(comp.join(counts, comp["node"] == counts["doc_id"]).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"), "n_links"))
    return sized.join(facts, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_components(documents: DataFrame) -> DataFrame:
    """similar_documents() without the numbers of links."""
    return similar_documents(documents).drop("n_links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_ngram_jaccard over every whole text of ``documents``."""
    return similar_documents(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
