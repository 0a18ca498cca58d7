"""LM scoring with a hidden Markov language model.

Words fall into classes: the TOP_WORDS most frequent ones have a class each, the others one by their
last bytes, the end of a text has its own.  A hidden Markov model emits classes; a class emits its
words by smoothed counts over the whole training corpus.  Baum-Welch runs over all training
documents, each as one whole sequence: each task adds up expected counts, which are summed across partitions.  Scoring is the
exact forward recursion, scaled at every token, over whole texts.

Counts of all words come from one grouped sum and reach the documents by a join: each block of
documents sends every one of its words once, with the places where it stands, so that a frequent word
is one row per block and no dictionary of the corpus is held anywhere.

Words are told apart by 64-bit hashes.  Defined results: a null or empty text is its end alone;
without training documents all base scores are 0; rows are scored and learnt from one by one, repeated ones
and null ids too; of words equally frequent those with the smaller hash are top words; an empty table gives
none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

STATES = 8
#: Most frequent words with a class of their own.
TOP_WORDS = 512
#: Classes of the other words.
TAILS = 255
CLASSES = TOP_WORDS + TAILS + 1
END = CLASSES - 1
ITERATIONS = 5
#: Tokens that Baum-Welch goes through one by one; what a longer document's pieces hand on is exact.
PIECE = 512
#: Tokens whose forward vectors Baum-Welch holds at once; a longer document stands alone.
HELD_TOKENS = 1 << 20
#: Sums that a task holds before it passes them on.
HELD_SUMS = 1 << 20
#: Documents of a block; their places must fit 16 bits.
BLOCK_DOCS = 8192
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 1 << 17
_U = np.uint64


def tails(words: textops.Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    last = words.buf[words.end - 1].astype(np.uint64)
    for back in (2, 3):
        at = np.maximum(words.end - back, 0)
        last = last << _U(8) | np.where(words.end - back >= words.start, words.buf[at], 0).astype(np.uint64)
    return (textops.mix(last) % _U(TAILS)).astype(np.int64)


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, tail, count = (np.concatenate(x) for x in zip(*held, strict=True))
    kinds, first, back = np.unique(key, return_index=True, return_inverse=True)
    return kinds, tail[first], np.bincount(back, count, len(kinds)).astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(key, tail, c) of every word of the training documents."""

    def run(batches):
        held, size = [], 0

        def flush():
            key, tail, count = held[0]
            return pa.RecordBatch.from_arrays([pa.array(textops.as_signed(key)), pa.array(tail.astype(np.int32)), pa.array(count)], ["key", "tail", "c"])

        for batch in batches:
            for piece in common.pieces(batch):
                words = textops.Words(common.texts_of(piece))
                if not len(words.key):
                    continue
                kinds, first, count = np.unique(words.key, return_index=True, return_counts=True)
                held.append((kinds, tails(words)[first], count))
                size += len(kinds)
                if size > HELD_WORDS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield flush()
                        held, size = [], 0
        if held:
            held = [_merged(held)]
            yield flush()

    rows = train.select("text").mapInArrow(run, "key long, tail int, c long")
    return rows.groupBy("key").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Lexicon:
    """Top words with their counts, and the totals that smoothing needs: all of fixed size."""

    def __init__(self, top: list, by_tail: list, n_docs: int):
        order = sorted(top, key=lambda r: r["key"] % 2**64)
        self.top = np.array([r["key"] % 2**64 for r in order], dtype=np.uint64)
        self.top_count = np.array([r["c"] for r in order], dtype=np.float64)
        self.n_docs = n_docs
        total, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for r in by_tail:
            total[r["tail"]], kinds[r["tail"]] = r["n"], r["v"]
        self.n = int(total.sum()) + n_docs
        self.v = int(kinds.sum()) + (n_docs > 0)
        for r in order:
            total[r["tail"]] -= r["c"]
            kinds[r["tail"]] -= 1
        self.tail_log = np.log10(total + 0.5 * (kinds + 1))
        self.base_log = np.log10(self.n + 0.5 * (self.v + 1))
        self.class_count = np.zeros(CLASSES)
        self.class_count[: len(order)] = self.top_count
        self.class_count[TOP_WORDS : TOP_WORDS + TAILS] = total
        self.class_count[END] = n_docs


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    top = counts.orderBy(F.desc("c"), "key").limit(TOP_WORDS).collect()
    by_tail = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    return Lexicon(top, by_tail, n_docs)


ENCODED = "key long, block long, places binary, doc_id long, place int, train boolean, n_tokens long, classes binary, known long, base double, inner double"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Two kinds of rows, written together so that blocks and places agree.

    A document: its block and place, classes of its tokens, and what its top words and its end add to
    the scores.  A word of a block (key not null): places of documents and how often it stands there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lex, number, task = shared.value, 0, TaskContext.get().partitionId()
        held, place = [], 0

        def words_of_block():
            key, pair = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")  # documents come in order already
            key, pair = key[order], pair[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            offsets = pa.py_buffer(np.concatenate([first, [len(key)]]).astype(np.int32) * 4)
            places = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(pair.tobytes())])
            return _rows(len(first), key=pa.array(textops.as_signed(key[first])), block=pa.array(np.full(len(first), task << 32 | number)), places=places)

        for batch in batches:
            for piece in common.pieces(batch):
                at = 0
                while at < piece.num_rows:
                    part = piece.slice(at, min(piece.num_rows - at, BLOCK_DOCS - place))
                    at += part.num_rows
                    words = textops.Words(common.texts_of(part))
                    n = part.num_rows
                    hit = textops.find(lex.top, words.key)
                    tail = tails(words)
                    rare = hit < 0
                    cls = np.where(rare, TOP_WORDS + tail, hit).astype(np.uint16)
                    base = textops.row_sums(np.where(rare, 0.0, np.log10(lex.top_count[hit] + 0.5) if len(lex.top) else 0.0), words.first)
                    base += np.log10(lex.n_docs + 0.5) - (words.count + 1) * lex.base_log
                    inner = -textops.row_sums(np.where(rare, lex.tail_log[tail], 0.0), words.first)
                    known = words.count - textops.row_sums(rare, words.first).astype(np.int64) + (lex.n_docs > 0)
                    # Each text's classes and then its end.
                    whole = np.full(len(cls) + n, END, dtype=np.uint16)
                    whole[np.arange(len(cls)) + words.doc] = cls
                    offsets = pa.py_buffer((2 * (words.first + np.arange(n + 1))).astype(np.int32))
                    classes = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(whole.tobytes())])
                    yield _rows(n, block=pa.array(np.full(n, task << 32 | number)), doc_id=part.column("doc_id").cast(pa.int64()), place=pa.array(np.arange(place, place + n, dtype=np.int32)), train=part.column("train"), n_tokens=pa.array(words.count + 1), classes=classes, known=pa.array(known), base=pa.array(base), inner=pa.array(inner))
                    key, doc = words.key[rare], words.doc[rare]
                    if len(key):
                        order = np.lexsort((doc, key))
                        key, doc = key[order], doc[order]
                        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
                        tf = np.diff(np.concatenate([first, [len(key)]]))
                        key, doc = key[first], doc[first]
                        # A count over 16 bits stands in several entries.
                        times = -(-tf // 65535)
                        pair = np.empty(int(times.sum()), dtype=[("d", "<u2"), ("n", "<u2")])
                        pair["d"], pair["n"] = np.repeat(doc + place, times), 65535
                        pair["n"][np.cumsum(times) - 1] = tf - 65535 * (times - 1)
                        held.append((np.repeat(key, times), pair))
                    place += n
                    if place == BLOCK_DOCS:
                        if held:
                            yield words_of_block()
                        place, number = 0, number + 1
        if held:
            yield words_of_block()

    return docs.select("doc_id", "text", "train").mapInArrow(run, ENCODED)


_TYPES = {"key": pa.int64(), "block": pa.int64(), "places": pa.binary(), "doc_id": pa.int64(), "place": pa.int32(), "train": pa.bool_(), "n_tokens": pa.int64(), "classes": pa.binary(), "known": pa.int64(), "base": pa.float64(), "inner": pa.float64()}


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, class_count: np.ndarray) -> "Model":
        rng = np.random.default_rng(7)
        share = (class_count + 0.5) / (class_count + 0.5).sum()
        emit = share * np.exp(rng.normal(0, 0.5, (STATES, CLASSES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    def expected(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Expected counts of one E-step over the whole sequences: start, visits, moves, emissions.

        A longer sequence lies in pieces of PIECE tokens that are treated side by side.  The product of a
        piece's matrices carries the forward vector over it and the backward vector back, so that counts
        are those of the whole sequence, moves from piece to piece among them.
        """
        lengths = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences).astype(np.int64)
        parts = -(-lengths // PIECE)
        seq = np.repeat(np.arange(len(sequences)), parts)
        nth = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(lengths) - lengths)[seq] + nth * PIECE
        size = np.minimum(PIECE, lengths[seq] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        start, size, nth, many = start[order], size[order], nth[order], (parts[seq] > 1)[order]
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # pieces longer than t
        emit_t = np.ascontiguousarray(self.emit.T.astype(np.float32))
        move = self.move.astype(np.float32)
        before_piece, beta = self._borders(flat, start, size, many, parts, place, emit_t, move, self.start.astype(np.float32))
        at_start = np.where((nth == 0)[:, None], self.start.astype(np.float32), before_piece @ move)
        alphas = []
        for t, n in enumerate(live):
            seen = emit_t[flat[start[:n] + t]]
            a = (at_start if t == 0 else alphas[-1][:n] @ move) * seen
            alphas.append(a / np.maximum(a.sum(1, keepdims=True), 1e-30))
        moves, emissions = np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        first = np.zeros(STATES)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            gamma = alphas[t] * beta[:n]
            gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-30)
            cls = flat[start[:n] + t]
            for k in range(STATES):
                emissions[:, k] += np.bincount(cls, gamma[:, k], CLASSES)
            ahead = emit_t[cls] * beta[:n]
            if t == 0:
                first = gamma[nth == 0].sum(0, dtype=float)
                ahead, before = ahead[nth > 0], before_piece[nth > 0]
            else:
                before = alphas[t - 1][:n]
            scale = np.maximum(((before @ move) * ahead).sum(1, keepdims=True), 1e-30)
            moves += self.move * (before.T @ (ahead / scale))
            if t:
                back = ahead @ move.T
                beta[:n] = back / np.maximum(back.sum(1, keepdims=True), 1e-30)
        return np.concatenate([first, moves.ravel(), emissions.T.ravel()])

    @staticmethod
    def _borders(flat, start, size, many, parts, place, emit_t, move, start_vector) -> tuple[np.ndarray, np.ndarray]:
        """For each piece: forward vector at the token before it (0 for a first one), backward vector at its last token."""
        before, beta = np.zeros((len(size), STATES), dtype=np.float32), np.ones((len(size), STATES), dtype=np.float32)
        own = np.flatnonzero(many)  # pieces in order of size, longest first
        if not len(own):
            return before, beta
        row = np.full(len(size), -1)
        row[own] = np.arange(len(own))
        product = np.broadcast_to(np.eye(STATES, dtype=np.float32), (len(own), STATES, STATES)).copy()
        for t in range(size[own[0]]):
            n = int(np.searchsorted(-size[own], -t, side="left"))
            x = product[:n] if t == 0 else (product[:n].reshape(-1, STATES) @ move).reshape(n, STATES, STATES)
            x = x * emit_t[flat[start[own[:n]] + t]][:, None, :]
            product[:n] = x / np.maximum(x.sum((1, 2), keepdims=True), 1e-30)
        unit = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-30)
        first, longest = np.cumsum(parts) - parts, int(parts.max())
        for k in range(1, longest):
            here = place[first[parts > k] + k]
            last = place[first[parts > k] + k - 1]
            enter = start_vector if k == 1 else before[last] @ move
            before[here] = unit(np.einsum("ni,nij->nj", np.broadcast_to(enter, (len(here), STATES)), product[row[last]]))
        for k in range(longest - 1, 0, -1):
            here = place[first[parts > k] + k]
            last = place[first[parts > k] + k - 1]
            beta[last] = unit(np.einsum("nij,nj->ni", product[row[here]], beta[here]) @ move.T)
        return before, beta

    @classmethod
    def maximised(cls, counts: np.ndarray, class_count: np.ndarray) -> "Model":
        share = (class_count + 0.5) / (class_count + 0.5).sum()
        start = counts[:STATES] + 1
        move = counts[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1
        emit = counts[STATES + STATES**2 :].reshape(STATES, CLASSES) + 20 * share
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each whole sequence by the scaled forward recursion."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(sequences).astype(np.int64)
        start = (np.cumsum(lengths) - lengths)[order]
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        emit_t = np.ascontiguousarray(self.emit.T)
        total, held = np.zeros(len(sequences)), np.ones(len(sequences))
        a = np.broadcast_to(self.start, (len(sequences), STATES))
        for t, n in enumerate(live):
            a = (a[:n] if t == 0 else a[:n] @ self.move) * emit_t[flat[start[:n] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            # Scales are multiplied and their logarithms taken now and then: products stay far above underflow.
            held[:n] *= scale
            if t % 16 == 15 or n < 64:
                total[:n] += np.log10(held[:n])
                held[:n] = 1.0
        total += np.log10(held)
        out = np.empty(len(sequences))
        out[order] = total
        return out


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint16) for x in batch.column("classes").to_pylist()]


def _held_at_once(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sequences in runs of about HELD_TOKENS tokens."""
    run, size = [], 0
    for s in sequences:
        if run and size + len(s) > HELD_TOKENS:
            yield run
            run, size = [], 0
        run.append(s)
        size += len(s)
    if run:
        yield run


def train(documents: DataFrame, lex: Lexicon) -> Model:
    """Baum-Welch over the encoded training documents."""
    spark = documents.sparkSession
    model = Model.initial(lex.class_count)
    if not lex.n_docs:
        return model
    source = documents.where("train").select("classes")

    def add(key, table):
        total = np.sum([np.frombuffer(x, dtype=np.float64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    for _ in range(ITERATIONS):
        shared = spark.sparkContext.broadcast(model)

        def step(batches, shared=shared):
            total = None
            for batch in batches:
                for part in _held_at_once(_sequences(batch)):
                    own = shared.value.expected(part)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

        rows = source.mapInArrow(step, "part int, counts binary").groupBy("part").applyInArrow(add, "counts binary").collect()
        model = Model.maximised(np.sum([np.frombuffer(r["counts"], dtype=np.float64) for r in rows], axis=0), lex.class_count)
        shared.unpersist()
    return model


def tail_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, place, tail_log, tail_known): sums over each document's words that are not top words."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            blocks, payload = [], []
            for block, parts in held.items():
                doc, value, known = (np.concatenate(x) for x in zip(*parts, strict=True))
                own, back = np.unique(doc, return_inverse=True)
                out = np.empty(len(own), dtype=[("d", "<u2"), ("v", "<f8"), ("k", "<u4")])
                out["d"], out["v"], out["k"] = own, np.bincount(back, value, len(own)), np.bincount(back, known, len(own))
                blocks.append(block)
                payload.append(out.tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(payload, pa.binary())], ["block", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            block = batch.column("block").to_numpy(zero_copy_only=False)
            data = batch.column("places").to_pylist()
            n = np.fromiter((len(x) // 4 for x in data), dtype=np.int64, count=len(data))
            pair = np.frombuffer(b"".join(data), dtype=[("d", "<u2"), ("n", "<u2")])
            value = np.repeat(np.log10(c + 0.5), n) * pair["n"]
            known = np.repeat(c > 0, n) * pair["n"].astype(np.int64)
            owner = np.repeat(block, n)
            order = np.argsort(owner, kind="stable")
            owner, doc, value, known = owner[order], pair["d"][order], value[order], known[order]
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for lo, hi in zip(cut, [*cut[1:], len(owner)], strict=True):
                held.setdefault(int(owner[lo]), []).append((doc[lo:hi], value[lo:hi], known[lo:hi]))
            size += len(owner)
            if size > HELD_SUMS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def add(key, table):
        all_ = np.frombuffer(b"".join(table.column("sums").to_pylist()), dtype=[("d", "<u2"), ("v", "<f8"), ("k", "<u4")])
        own, back = np.unique(all_["d"], return_inverse=True)
        return pa.table({"block": pa.array(np.full(len(own), key[0].as_py())), "place": pa.array(own.astype(np.int32)), "tail_log": pa.array(np.bincount(back, all_["v"], len(own))), "tail_known": pa.array(np.bincount(back, all_["k"], len(own)).astype(np.int64))})

    words = encoded.where("key IS NOT NULL").select("key", "block", "places")
    met = words.join(counts.select("key", "c"), "key", "left").select("block", "places", F.coalesce("c", F.lit(0)).alias("c"))
    partial = met.mapInArrow(run, "block long, sums binary")
    return partial.groupBy("block").applyInArrow(add, "block long, place int, tail_log double, tail_known long")


def score(documents: DataFrame, usable) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents.select("doc_id", "text", usable.alias("train"))
    counts = common.keep(word_counts(docs.where("train")))
    lex = lexicon(counts, docs.where("train").count())
    encoded = common.keep(encode(docs, lex))
    own = encoded.where("key IS NULL").drop("key", "places")
    model = docs.sparkSession.sparkContext.broadcast(train(own, lex))

    def forward(batches):
        for batch in batches:
            if batch.num_rows:
                value = model.value.log10_likelihood(_sequences(batch))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "place", "doc_id", "train", "n_tokens", "known", "base", "inner")), pa.array(value)], ["block", "place", "doc_id", "train", "n_tokens", "known", "base", "inner", "hidden"])

    scored = own.mapInArrow(forward, "block long, place int, doc_id long, train boolean, n_tokens long, known long, base double, inner double, hidden double")
    both = scored.join(tail_sums(encoded, counts), ["block", "place"], "left").fillna(0, ["tail_log", "tail_known"])
    return both.select("doc_id", "train", "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"), (F.col("base") + F.col("tail_log")).alias("base_score"), (F.col("hidden") + F.col("inner") + F.col("tail_log")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_lm_score over every whole text of ``documents``; learns where crc32 of the id mod 5 isn't 1."""
    scored = score(common.table(spark, sf_dir, "documents"), common.crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
