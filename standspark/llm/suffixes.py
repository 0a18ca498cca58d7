"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a smaller document go.

Every 50-byte window has an anchor, the least 20-byte string in it by a hash; equal windows have equal
anchors.  Consecutive windows with one anchor form a segment.  Only segments whose anchor occurs in
several documents are gathered:

1. Copies of a whole text need no windows: all their bytes go.
2. Anchors that occur in several documents are found by grouped counts, and passed on to a second
   reading as a filter of fixed size (which may let others through, at no harm).
3. Equal segments are found as wholes, by hashes: all but the smallest document's are removed at once.
4. The bytes of the distinct segments are read again, those of an anchor come together and their windows are sorted as suffixes, by
   deep-shallow sorting: multikey quicksort on eight bytes at a time to a shallow depth, then a blind
   trie for each group that still shares a prefix there.  Equal windows stand together, and those of
   all but the smallest document are removed.  Where an anchor has very many distinct segments (the
   edges of a common passage) its windows are dealt by themselves, not by anchor.

Strings are compared byte by byte; segments and texts as wholes by 128-bit hashes.

Defined results: a null text is empty; rows without an id are left out; ids tell documents apart (rows
that repeat an id are one document, and a text of theirs loses what any of them loses at its place); documents under 50 bytes lose nothing.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sketch, textops

#: Length of a repeated string, and of an anchor.
LENGTH, ANCHOR = 50, 20
SPAN = LENGTH - ANCHOR + 1
#: Depth to which windows are sorted by multikey quicksort.
SHALLOW = 24
#: Distinct segments of an anchor from which on its windows are dealt by themselves.
HOT = 500
#: Least bits of the filters of anchors and places, and of ids: 2 and 1 megabytes.
ANCHOR_BITS, ID_BITS = 1 << 24, 1 << 23
#: Windows that a task sorts at once, and bytes of text whose anchors it finds at once (some 50 bytes each).
SORT_WINDOWS, ANCHOR_BYTES = 400_000, 1 << 20
_U = np.uint64
_CHUNK = 1 << 18


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor position, hash of the anchor) of the window that starts at each place of a buffer."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, key = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.uint64)
    for at in range(0, n, _CHUNK):
        size = min(_CHUNK, n - at) + SPAN - 1  # anchors that the chunk's windows choose from
        part = buf[at : at + size + ANCHOR - 1]
        acc = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(textops._BYTE_SEED[part] * textops._cached_powers("up", textops._BASE, 2 * _CHUNK)[: len(part)], out=acc[1:])
        value = textops.mix((acc[ANCHOR:] - acc[:-ANCHOR]) * textops._cached_powers("down", textops._BASE_INV, 2 * _CHUNK)[:size])
        low = (value & ~_U((1 << 20) - 1)) | np.arange(size, dtype=np.uint64)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        own = (low & _U((1 << 20) - 1)).astype(np.int64)
        place[at : at + len(own)], key[at : at + len(own)] = own + at, value[own]
    return place, key


class Segments:
    """Segments of a batch of texts: row, start in the text, number of windows, hash of the anchor."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.base = np.cumsum(size) - size
        place, key = anchors(self.buf)
        rows = np.flatnonzero(size >= LENGTH)
        valid = np.zeros(len(place) + 1, dtype=np.int8)
        np.add.at(valid, self.base[rows], 1)
        np.add.at(valid, self.base[rows] + size[rows] - LENGTH + 1, -1)
        inside = np.flatnonzero(np.cumsum(valid)[:-1])
        if len(inside):
            fresh = np.concatenate([[True], (place[inside[1:]] != place[inside[:-1]]) | (inside[1:] != inside[:-1] + 1)])
            first = np.flatnonzero(fresh)
            self.begin = inside[first]
            self.windows = np.diff(np.concatenate([first, [len(inside)]]))
            self.key = key[self.begin]
        else:
            self.begin = self.windows = np.zeros(0, dtype=np.int64)
            self.key = np.zeros(0, dtype=np.uint64)
        self.row = np.searchsorted(self.base, self.begin, side="right") - 1
        self.start = self.begin - self.base[self.row]


    def bytes(self, which: np.ndarray) -> list[bytes]:
        """Bytes of chosen segments: their windows with the ends of the last."""
        data, end = self.buf.tobytes(), self.begin[which] + self.windows[which] + LENGTH - 1
        return [data[a:b] for a, b in zip(self.begin[which].tolist(), end.tolist(), strict=True)]


class BlindTrie:
    """Orders strings of one length that share a prefix: inner nodes keep the place of a difference only.

    ``add`` walks down blindly by the bytes at those places to a leaf, compares with that leaf's string
    once, and hangs the new string where they differ.
    """

    def __init__(self, text: bytes):
        self.root: bytes | tuple[int, dict] = text
        self.size = 1

    def add(self, text: bytes) -> bool:
        """True if the string is new."""
        node = self.root
        while not isinstance(node, bytes):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node == text:
            return False
        at = next(i for i, (a, b) in enumerate(zip(node, text, strict=True)) if a != b)
        letter, parent, edge, node = node[at], None, None, self.root
        while not isinstance(node, bytes) and node[0] < at:
            parent, edge = node, text[node[0]]
            node = node[1][edge]
        if not isinstance(node, bytes) and node[0] == at:
            node[1][text[at]] = text
        else:
            fresh = (at, {letter: node, text[at]: text})
            if parent is None:
                self.root = fresh
            else:
                parent[1][edge] = fresh
        self.size += 1
        return True

    def ordered(self) -> list[bytes]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, bytes):
                out.append(node)
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(digits: np.ndarray, order: np.ndarray, cut: np.ndarray) -> None:
    """Sort groups of ``order`` by rows of digits, in place; ``cut`` tells where a group begins, and is refined.

    Every group has a pivot digit and is parted into smaller, equal and larger rows; equal ones go on with the
    next digit.  The groups of a round are parted side by side.
    """
    first = np.flatnonzero(cut)
    size = np.diff(np.concatenate([first, [len(order)]]))
    depth = np.zeros(len(first), dtype=np.int64)
    first, size, depth = first[size > 1], size[size > 1], depth[size > 1]
    while len(first):
        ends = np.cumsum(size)
        begin = ends - size
        group = np.repeat(np.arange(len(first)), size)
        own = order[np.repeat(first - begin, size) + np.arange(ends[-1])]
        digit = digits[own, depth[group]]
        x, y, z = digit[begin], digit[begin + size // 2], digit[ends - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[group]
        larger, equal = digit > pivot, digit == pivot
        side = larger * 2 + equal  # 0 smaller, 1 equal, 2 larger
        n = np.bincount(group * 3 + side, minlength=3 * len(first)).reshape(-1, 3)
        start = first[:, None] + np.cumsum(n, axis=1) - n
        for k in range(3):
            mine = np.flatnonzero(side == k)
            # Rows of one side stay in their order: their places follow each other group by group.
            before = np.cumsum(n[:, k]) - n[:, k]
            order[(start[:, k] - before)[group[mine]] + np.arange(len(mine))] = own[mine]
        cut[start[n > 0]] = True
        on = np.column_stack([depth, depth + 1, depth])
        left = (n > 1) & (on < digits.shape[1])
        first, size, depth = start[left], n[left], on[left]


def deep_shallow(windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): windows (rows of LENGTH bytes) sorted within their groups; equal ones share a class.

    Multikey quicksort takes eight bytes as a digit; only groups that tie at the shallow depth, and are not
    all equal, go on to a blind trie.
    """
    n = len(windows)
    order = np.argsort(group, kind="stable")
    cut = np.concatenate([[True], group[order[1:]] != group[order[:-1]]])[:n]
    digits = np.column_stack([np.ascontiguousarray(windows[:, at : at + 8]).view(">u8").ravel().astype(np.uint64) for at in range(0, SHALLOW, 8)])
    multikey_quicksort(digits, order, cut)
    first = np.flatnonzero(cut)
    size = np.diff(np.concatenate([first, [n]]))
    label = np.cumsum(cut) - 1
    rest = windows[order, SHALLOW:]
    same = (rest == rest[first[label]]).all(1)
    uneven = np.unique(label[~same])
    cut_more = np.zeros(n, dtype=bool)
    for g in uneven:
        lo, hi = first[g], first[g] + size[g]
        texts = [rest[i].tobytes() for i in range(lo, hi)]
        trie = BlindTrie(texts[0])
        for t in texts[1:]:
            trie.add(t)
        rank = {t: i for i, t in enumerate(trie.ordered())}
        ranks = np.array([rank[t] for t in texts])
        sort = np.argsort(ranks, kind="stable")
        order[lo:hi] = order[lo:hi][sort]
        cut_more[lo + 1 : hi] = ranks[sort][1:] != ranks[sort][:-1]
    return order, np.cumsum(cut | cut_more) - 1


def repeated(doc: np.ndarray, begin: np.ndarray, count: np.ndarray, group: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """For each window of the segments (in order), whether a smaller document has an equal one in its group."""
    owner = np.repeat(np.arange(len(doc)), count)
    place = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[place]
    order, label = deep_shallow(windows, group[owner])
    own = doc[owner[order]]
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    least = np.minimum.reduceat(own, first)
    out = np.zeros(len(owner), dtype=bool)
    out[order] = own > least[label]
    return out


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, k1, k2): length and hash of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.texts_of(batch)
        keys = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "n_bytes", "k1", "k2"])

    return common.map_texts(docs, work, "doc_id long, n_bytes long, k1 long, k2 long")


def _anchors(docs: DataFrame, shown) -> DataFrame:
    """(anchor) of the segments of documents that pass the filter of ids: once for each document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = shown.value.maybe(batch.column("doc_id").to_numpy(zero_copy_only=False))
        seg = Segments([t if k else b"" for t, k in zip(common.texts_of(batch), keep, strict=True)])
        keys, _ = textops.distinct_by_row(seg.key, seg.row)
        return pa.RecordBatch.from_arrays([pa.array(textops.as_signed(keys))], ["anchor"])

    return common.map_texts(docs, work, "anchor long", limit=ANCHOR_BYTES)


def _place(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Key of a segment by its document and start; keys may coincide."""
    return (doc.astype(np.int64) << 24) ^ start.astype(np.int64)


def _segments(docs: DataFrame, shown, wanted) -> DataFrame:
    """(anchor, doc_id, start, windows, content) of segments whose anchor passes the filter.

    ``content`` is a hash of the segment's bytes; with the anchor's it makes 128 bits.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keep = shown.value.maybe(ids)
        seg = Segments([t if k else b"" for t, k in zip(common.texts_of(batch), keep, strict=True)])
        hit = np.flatnonzero(wanted.value.maybe(textops.as_signed(seg.key)))
        if not len(hit):
            return None
        content = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in seg.bytes(hit)), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(textops.as_signed(seg.key[hit])), pa.array(ids[seg.row[hit]]), pa.array(seg.start[hit].astype(np.int32)), pa.array(seg.windows[hit].astype(np.int32)), pa.array(content)], ["anchor", "doc_id", "start", "windows", "content"])

    return common.map_texts(docs, work, "anchor long, doc_id long, start int, windows int, content long", limit=ANCHOR_BYTES)


def _texts_of_segments(docs: DataFrame, shown, wanted, hot) -> DataFrame:
    """(key, doc_id, start, bytes) of segments whose place passes a filter; the key is the anchor.

    A hot anchor's windows are rows of their own, under a hash of their bytes.  Whether an anchor is
    hot is told by a filter of anchors: the same for all its segments, so equal windows share a key.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keep = shown.value.maybe(ids)
        seg = Segments([t if k else b"" for t, k in zip(common.texts_of(batch), keep, strict=True)])
        hit = np.flatnonzero(wanted.value.maybe(_place(ids[seg.row], seg.start)))
        if not len(hit):
            return None
        key, doc = textops.as_signed(seg.key[hit]), ids[seg.row[hit]]
        start, data = seg.start[hit].astype(np.int64), seg.bytes(hit)
        single = hot.value.maybe(key)
        cold = np.flatnonzero(~single)
        out = [(key[cold], doc[cold], start[cold], [data[i] for i in cold])]
        for i in np.flatnonzero(single):
            n = len(data[i]) - LENGTH + 1
            windows = [data[i][w : w + LENGTH] for w in range(n)]
            keys = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in windows), dtype=np.int64)
            out.append((keys, np.full(n, doc[i]), start[i] + np.arange(n), windows))
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([o[c] for o in out])) for c in range(3)), pa.array([w for o in out for w in o[3]], pa.binary())], ["key", "doc_id", "start", "bytes"])

    return common.map_texts(docs, work, "key long, doc_id long, start long, bytes binary", limit=ANCHOR_BYTES)


def _sorted_windows(rows: DataFrame) -> DataFrame:
    """rows: (key, doc_id, start, bytes), equal windows under one key.  (doc_id, start, windows) of what is removed."""

    def solve(held):
        table = pa.Table.from_batches(held).combine_chunks()
        data = table.column("bytes").to_pylist()
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        buf = np.frombuffer(b"".join(data), dtype=np.uint8)
        count = size - LENGTH + 1
        doc, start, key = (table.column(c).to_numpy() for c in ("doc_id", "start", "key"))
        gone = repeated(doc, np.cumsum(size) - size, count, np.unique(key, return_inverse=True)[1], buf)
        owner = np.repeat(np.arange(len(doc)), count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        hit = np.flatnonzero(gone)
        if not len(hit):
            return None
        first = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
        length = np.diff(np.concatenate([first, [len(hit)]]))
        return pa.RecordBatch.from_arrays([pa.array(doc[owner[hit[first]]]), pa.array(at[hit[first]]), pa.array(length)], ["doc_id", "start", "windows"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            if size > SORT_WINDOWS:  # cut where the key changes
                fresh = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
                if len(fresh):
                    if fresh[0]:
                        held.append(batch.slice(0, int(fresh[0])))
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                    batch = batch.slice(int(fresh[0]))
            if batch.num_rows:
                held.append(batch)
                size += batch.column("bytes").nbytes - batch.num_rows * (LENGTH + 3)
            last = key[-1]
        if held and (out := solve(held)) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id long, start long, windows long")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, windows to remove as (start, number) pairs), (doc_id of copies, which lose all bytes))."""
    spark = docs.sparkSession
    whole = common.keep(_whole(docs).where(f"n_bytes >= {LENGTH}"))
    # Only texts in several rows are joined, and after they are written, so that a large group can be split.
    least = common.keep(whole.groupBy("k1", "k2", "n_bytes").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = common.keep(whole.join(least, ["k1", "k2", "n_bytes"], "left").select("doc_id", F.coalesce(F.col("doc_id") != F.col("least"), F.lit(False)).alias("copy")).distinct())
    copies = marked.where("copy").select("doc_id")
    shown = spark.sparkContext.broadcast(sketch.bloom(marked.where("NOT copy").select("doc_id"), ID_BITS))

    # A document's row gives each of its anchors once, so an anchor counted twice is in two documents
    # (or in a repeated row, which the next reading lets go).
    several = common.keep(_anchors(docs, shown).groupBy("anchor").count().where("count > 1").select("anchor"))
    wanted = spark.sparkContext.broadcast(sketch.bloom(several, ANCHOR_BITS))
    found = common.keep(_segments(docs, shown, wanted))

    same = ["anchor", "content"]
    kinds = common.keep(found.groupBy(*same).agg(F.min("doc_id").alias("least")))
    busy = common.keep(kinds.groupBy("anchor").count().where("count > 1"))
    kinds = kinds.join(busy, "anchor", "left").select(*same, "least", F.col("count").isNotNull().alias("open"))
    told = common.keep(found.join(kinds, same).select("doc_id", "start", "windows", (F.col("doc_id") > F.col("least")).alias("gone"), "open"))
    gone = told.where("gone").select("doc_id", "start", "windows")
    # Of equal segments only the smallest document's go on, and only where the anchor has other segments.
    # Their bytes are read from the texts; a segment that passes the filter by chance does no harm.
    rest = told.where("open AND NOT gone").select(F.shiftleft("doc_id", 24).bitwiseXOR(F.col("start").cast("long")).alias("place"))
    places = spark.sparkContext.broadcast(sketch.bloom(rest, ANCHOR_BITS))
    hot = spark.sparkContext.broadcast(sketch.bloom(busy.where(F.col("count") > HOT).select("anchor"), ID_BITS))
    sorted_ = _sorted_windows(_texts_of_segments(docs, shown, places, hot))
    run = F.struct(F.col("start").cast("int").alias("start"), F.col("windows").cast("int").alias("windows"))
    every = gone.select("doc_id", run.alias("run")).unionByName(sorted_.select("doc_id", run.alias("run")))
    return every.groupBy("doc_id").agg(F.collect_list("run").alias("removed")), copies


def dedup(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    removed, copies = removals(docs)
    what = common.keep(removed.unionByName(copies.select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("windows"))).alias("removed"))).groupBy("doc_id").agg(F.flatten(F.collect_list("removed")).alias("removed")))
    # Documents that lose nothing are told by a filter and stay where they are; the others meet their removals.
    touched = docs.sparkSession.sparkContext.broadcast(sketch.bloom(what.select("doc_id"), ID_BITS))

    def rest(batch: pa.RecordBatch, start: list, windows: list) -> pa.RecordBatch:
        out = []
        for text, start, windows in zip(common.texts_of(batch), start, windows, strict=True):
            cover = np.zeros(len(text) + 1, dtype=np.int64)
            if start:
                start, windows = np.array(start), np.array(windows)
                end = np.where(windows < 0, len(text), np.minimum(start + windows + LENGTH - 1, len(text)))
                np.add.at(cover, start, 1)
                np.add.at(cover, end, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def split(which: bool):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            hit = touched.value.maybe(batch.column("doc_id").to_numpy(zero_copy_only=False)) == which
            mine = batch.take(pa.array(np.flatnonzero(hit)))
            if not which and mine.num_rows:
                return rest(mine, [None] * mine.num_rows, [None] * mine.num_rows)
            return mine

        return work

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    whole = common.map_texts(docs, split(False), schema)
    moved = common.map_texts(docs, split(True), "doc_id long, text string").join(what, "doc_id", "left").select("doc_id", "text", F.col("removed.start").alias("start"), F.col("removed.windows").alias("windows"))
    return whole.unionByName(common.map_texts(moved, lambda b: rest(b, b.column("start").to_pylist(), b.column("windows").to_pylist()), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_suffix_dedup over every whole text of ``documents``."""
    return dedup(common.table(spark, sf_dir, "documents")).drop("kept")
