"""BPE encoding and decoding by a streaming transducer of bounded lookahead.

``sufficient_lookahead`` computes from the merge list how far back from the end of a window the
tokenisation can still change when more text follows.  ``Transducer`` reads a text piece by piece,
emits tokens as soon as they lie further back than that, and so needs memory for the window alone,
whatever the text's length.  ``Decoder`` turns tokens into text with an incremental byte-to-text
state machine.

Why the lookahead suffices: run the merges on a window and on a longer text, rank by rank, and let q
be the last boundary up to which both have the same tokens.  A merge (a, b) moves q to the left only
when it crosses q, by len(a), and only if b begins at q in one of the runs.  The next such merge has
a later rank, and its right part has the former left part on its left spine.  The longest chain of
such merges, weighted by the lengths of their left parts, bounds how far q can move.

All tokens come from the transducer.  A pre-token is a stream of its own, since no merge crosses its
border: one that ends within the first window is emitted there, and many such streams are run side by
side.  What the transducer gave for a short run of text between two borders is remembered in a table
of bounded bytes.  Texts pass in pieces, tokens in typed arrays, and digests follow them.

Defined results: a null or empty text has no tokens; the special token's string in a text is one
token, as in the library the vocabulary comes from; every row is encoded, repeated ones and null ids
too; an empty table gives none; extra columns are not read; a text of any length is read whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Bytes that a worker's table of remembered runs may take; it is emptied when full.
MEMO_BYTES = 32 << 20
#: What an entry takes beside its characters and its tokens.
ENTRY_BYTES = 150
#: Characters of text whose tokens are made at once.
PIECE = 1 << 20
#: Bytes of a window up to which windows are merged side by side.
SIDE_BY_SIDE = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """Byte strings by number, laid end to end: many are put together in a few array operations."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the strings of these numbers, end to end; the place behind each)."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return gathered(self.flat, self.first[numbers], size, ends), ends


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """flat[first:first + size] of all, end to end."""
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - ends + size, size) + np.arange(total)]


class Vocabulary:
    """Merge ranks, token bytes and the lookahead of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_letters()
        raw = {t: bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"]}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in spec["model"]["vocab"].items()}
        ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[raw[a]], ids[raw[b]]] = (rank, ids[raw[a] + raw[b]])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(self.merges, self.bytes_of)
        self.text = Strings([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)])
        self.decimal = Strings([b",%d" % i for i in range(max(self.bytes_of) + 1)])


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], bytes_of: dict[int, bytes]) -> int:
    """Bytes before a window's end beyond which the tokenisation no longer depends on what follows."""
    best: dict[int, int] = {}  # by left part: the furthest that a chain ending with it has moved
    spine: dict[int, int] = {}  # a token's left part
    far = 0
    for (a, b), (_, made) in sorted(merges.items(), key=lambda m: m[1][0]):
        moved, t = 0, b
        while True:
            moved = max(moved, best.get(t, 0))
            if t not in spine:
                break
            t = spine[t]
        moved += len(bytes_of[a])
        best[a] = max(best.get(a, 0), moved)
        spine[made] = a
        far = max(far, moved)
    return far


class ManyWindows:
    """Final windows of many short streams at once: one merge of each window in every numpy step."""

    SLOTS = 1 << 19

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], byte_id: list[int]):
        # Open addressing: a pair's slot, or the next free one.
        self.keys = np.full(self.SLOTS, -1, dtype=np.int64)
        self.rank = np.full(self.SLOTS, len(merges), dtype=np.int32)
        self.made = np.zeros(len(merges) + 1, dtype=np.int32)
        left = np.array([a << 20 | b for a, b in merges], dtype=np.int64)
        rank = np.array([r for r, _ in merges.values()], dtype=np.int32)
        self.made[rank] = [m for _, m in merges.values()]
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            won = self.keys[slot] == left
            self.rank[slot[won]] = rank[won]
            left, rank, slot = left[~won], rank[~won], (slot[~won] + 1) % self.SLOTS
        self.byte_id = np.array(byte_id, dtype=np.int32)
        self.none = np.int32(len(merges))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``none`` for pairs that don't merge and where a side is absent (-1)."""
        key = (a.astype(np.int64) << 20 | b).ravel()
        key[b.ravel() < 0] = -2
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.rank[slot], self.none)
        open_ = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.SLOTS
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out.reshape(a.shape)

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each word, tokens of all)."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found = [self._run([words[i] for i in order[lo : lo + 4096]]) for lo in range(0, len(order), 4096)]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        size, flat = (np.concatenate(x) for x in zip(*found, strict=True))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return size[place], gathered(flat, (np.cumsum(size) - size)[place], size[place], np.cumsum(size[place]))

    def _run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        wide = int(lengths.max(initial=0)) + 1
        ids = np.full((len(words), wide), -1, dtype=np.int32)
        ids[np.arange(wide) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        done = ids.copy()
        live, cols = np.arange(len(words)), np.arange(wide)
        rank = np.full(ids.shape, self.none, dtype=np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(live):
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            best = rank[rows, at]
            if (best == self.none).any():
                ended = best == self.none
                done[live[ended]] = ids[ended]
                keep = ~ended
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
                rows = np.arange(len(live))
                if not len(live):
                    break
            shift = np.minimum(cols + (cols > at[:, None]), wide - 1)
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            ids[:, -1], rank[:, -1] = -1, self.none
            ids[rows, at] = self.made[best]
            rank[rows, at] = self.ranks(ids[rows, at], ids[rows, np.minimum(at + 1, wide - 1)])
            has = at > 0
            rank[rows[has], at[has] - 1] = self.ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
        has = done >= 0
        return has.sum(axis=1), done[has]


def merge_window(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for a long list: a heap of pairs over a linked list, n log n."""
    n = len(ids)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = made, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0 and (m := merges.get((ids[x], ids[after[x]]))):
                heapq.heappush(heap, (m[0], x, ids[x], ids[after[x]], m[1]))
    return [t for t, live in zip(ids, alive) if live]


class Transducer:
    """Tokens of one pre-token that comes in pieces of bytes; holds two lookaheads of bytes at most."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = b""

    def feed(self, data: bytes) -> Iterator[int]:
        reach = self.v.lookahead + max(64, self.v.lookahead)
        at = 0
        while at < len(data):
            take = data[at : at + reach - len(self.window)]
            self.window += take
            at += len(take)
            if len(self.window) == reach:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        ids = merge_window([self.v.byte_id[b] for b in self.window], self.v.merges)
        last, done = len(self.window) - self.v.lookahead, 0
        for t in ids:
            n = len(self.v.bytes_of[t])
            if done + n > last:
                break
            done += n
            yield t
        self.window = self.window[done:]

    def finish(self) -> Iterator[int]:
        yield from merge_window([self.v.byte_id[b] for b in self.window], self.v.merges)
        self.window = b""

    @staticmethod
    def side_by_side(vocabulary: Vocabulary, many: ManyWindows, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each stream, tokens of all): short final windows are merged at once, others one by one."""
        size, flat = many.run([x if len(x) <= SIDE_BY_SIDE else b"" for x in streams])
        long = [i for i, x in enumerate(streams) if len(x) > SIDE_BY_SIDE]
        if not long:
            return size, flat
        own = []
        for i in long:
            t = Transducer(vocabulary)
            own.append(np.fromiter(chain(t.feed(streams[i]), t.finish()), dtype=np.int32))
        first = np.cumsum(size) - size
        size[long], first[long] = [len(x) for x in own], len(flat) + np.cumsum([0, *map(len, own[:-1])])
        return size, gathered(np.concatenate([flat, *own]), first, size, np.cumsum(size))


#: Borders of runs.  What counts as white space here contains what the pre-tokeniser takes for it.
_CUT = re.compile(r"(?= \S)")


@functools.cache
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Encodes whole texts; the table of remembered runs lives as long as the worker.

    A space before a character that isn't white space always begins a pre-token, so texts are cut
    there into runs.
    """

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.many = ManyWindows(self.v.merges, self.v.byte_id)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self._empty()

    def _empty(self) -> None:
        self.entry: dict[str, int] = {}
        self.tokens = np.zeros(1 << 16, dtype=np.int32)
        self.first, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.used = self.bytes = 0
        self._remember(["", *self.v.special], np.array([0, *(1 for _ in self.v.special)]), np.array([*self.v.special.values()], dtype=np.int32))

    def _remember(self, runs: list[str], size: np.ndarray, tokens: np.ndarray) -> None:
        at, end = len(self.entry), self.used + int(size.sum())
        while at + len(runs) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while end > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, self.tokens])
        self.size[at : at + len(runs)] = size
        self.first[at : at + len(runs)] = self.used + np.cumsum(size) - size
        self.tokens[self.used : end] = tokens
        self.entry.update(zip(runs, range(at, at + len(runs)), strict=True))
        self.used = end
        self.bytes += sum(map(len, runs)) + ENTRY_BYTES * len(runs) + 4 * int(size.sum())

    def _learn(self, runs: set[str]) -> None:
        """Run the transducer over what is not remembered yet: pre-tokens first, then runs of several."""
        parts = {r: _pattern().findall(r) for r in runs if not r.removeprefix(" ").isalpha()}
        streams = {r for r in runs if r not in parts}.union(*parts.values()).difference(self.entry)
        streams = list(streams)
        self._remember(streams, *Transducer.side_by_side(self.v, self.many, [x.encode() for x in streams]))
        parts = {r: x for r, x in parts.items() if r not in self.entry}
        if parts:
            n = np.fromiter(map(len, parts.values()), dtype=np.int64, count=len(parts))
            entries = np.fromiter(map(self.entry.__getitem__, chain.from_iterable(parts.values())), dtype=np.int64, count=int(n.sum()))
            size = self.size[entries]
            self._remember(list(parts), np.add.reduceat(size, np.cumsum(n) - n), gathered(self.tokens, self.first[entries], size, np.cumsum(size)))

    def _entries(self, runs: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.entry.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            if self.bytes > MEMO_BYTES:
                self._empty()
                lacking = np.arange(len(runs))
            self._learn({runs[i] for i in lacking})
            found[lacking] = np.fromiter((self.entry[runs[i]] for i in lacking), dtype=np.int64, count=len(lacking))
        return found

    def _pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(characters, runs) of a text, about PIECE characters at a time."""
        for part in self.split.split(text) if self.split and any(s in text for s in self.v.special) else [text]:
            at = 0
            while at < len(part):
                end = at + PIECE
                if end < len(part):
                    m = _CUT.search(part, end)
                    end = m.start() if m else len(part)
                yield min(end, len(part)) - at, [part[at:end]] if part in self.v.special else _CUT.split(part[at:end])
                at = end

    def _long(self, run: str) -> Iterator[np.ndarray]:
        """Tokens of a run that is longer than a piece, as they become stable."""
        for m in _pattern().finditer(run):
            own, at = Transducer(self.v), m.start()
            while at < m.end():
                yield np.fromiter(own.feed(run[at : min(at + PIECE // 16, m.end())].encode()), dtype=np.int32)
                at += PIECE // 16
            yield np.fromiter(own.finish(), dtype=np.int32)

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
        """(tokens, [(text, first, last)]): tokens of texts in order; a long text's come in several parts."""
        runs: list[str] = []
        owners: list[tuple[int, int]] = []  # text, runs up to its end
        size = 0

        def emit():
            nonlocal size
            entries = self._entries(runs)
            n = self.size[entries]
            ends = np.cumsum(n)
            ids = gathered(self.tokens, self.first[entries], n, ends)
            ends = np.concatenate([[0], ends])
            cut = [0, *(at for _, at in owners)]
            spans = [(i, int(ends[lo]), int(ends[hi])) for (i, _), lo, hi in zip(owners, cut[:-1], cut[1:], strict=True)]
            runs.clear()
            owners.clear()
            size = 0
            return ids, spans

        for i, text in enumerate(texts):
            for length, own in self._pieces(text):
                for long, some in groupby(own, lambda x: len(x) > PIECE) if length > PIECE else [(False, own)]:
                    if long:
                        yield emit()
                        for ids in chain.from_iterable(map(self._long, some)):
                            yield ids, [(i, 0, len(ids))]
                    else:
                        runs.extend(some)
                        owners.append((i, len(runs)))
                size += length
                if size >= PIECE:
                    yield emit()
        if runs:
            yield emit()

    def encode(self, text: str) -> list[int]:
        return [int(t) for ids, _ in self.encode_many([text]) for t in ids]


class Decoder:
    """Tokens to text, piece by piece: bytes that don't make up a character yet wait for the next token."""

    def __init__(self, vocabulary: Vocabulary):
        self.strings = vocabulary.text
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int] | np.ndarray) -> str:
        return self.feed_bytes(self.strings.join(np.asarray(ids, dtype=np.int64))[0])

    def feed_bytes(self, data: np.ndarray) -> str:
        """The same for the bytes of tokens."""
        return self.state.decode(data.tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class Digests:
    """Number of tokens, digests of the decimal ids and of the decoded text of one document, as its tokens come."""

    def __init__(self, vocabulary: Vocabulary):
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)

    def feed(self, n: int, decimal: np.ndarray, text: np.ndarray) -> None:
        if n:
            self.ids.update(decimal[self.n == 0 :].tobytes())  # a comma stands before each id but the first
            self.text.update(self.decoder.feed_bytes(text).encode())
            self.n += n

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def round_trip(documents: DataFrame, path: str, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: number of tokens, digests of the ids and of the decoded text; the ids if asked for.

    ``path`` is the tokenizer file; executors read it, so it has to be installed on each.
    """

    def setup():
        encoder = _encoder(path)
        common.held_by("bpe", _encoder.cache_clear)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            out, now, own, kept = [], 0, Digests(encoder.v), [[] for _ in texts]
            for ids, spans in encoder.encode_many(texts):
                decimal, decimal_ends = encoder.v.decimal.join(ids)
                text, text_ends = encoder.v.text.join(ids)
                decimal_ends, text_ends = np.concatenate([[0], decimal_ends]), np.concatenate([[0], text_ends])
                for i, lo, hi in spans:
                    while now < i:
                        out.append(own.done())
                        now, own = now + 1, Digests(encoder.v)
                    own.feed(hi - lo, decimal[decimal_ends[lo] : decimal_ends[hi]], text[text_ends[lo] : text_ends[hi]])
                    if keep_ids:
                        kept[i].append(ids[lo:hi])
            while now < len(texts):
                out.append(own.done())
                now, own = now + 1, Digests(encoder.v)
            n, ids_sha, text_sha = zip(*out, strict=True)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, dtype=np.int32), *chain.from_iterable(kept)])
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    source = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return common.map_texts(source, None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, setup=setup, owner="bpe")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_bpe over every whole text of ``documents``."""
    return round_trip(common.table(spark, sf_dir, "documents"), default_path())
