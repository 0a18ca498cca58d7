"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Test items are the indexed documents, passages of the training texts the queries.  A passage is twice
as long as the longest item and passages overlap by half, so each occurrence of an item lies within
one.  Impacts are divided by the item's score for its own text: 1 means that all its terms are there.

A term's postings lie in blocks of items with the largest impact of each block, and its list has a
largest impact.  The passages of a batch are searched side by side: in each round every passage has a
cursor in each of its terms' lists; in the order of their blocks, the first at which the sum of the
lists' largest impacts reaches the threshold is the pivot.  No item before it can reach the threshold, so the
cursors before it skip there; the pivot's block is scored if its own largest impacts reach the
threshold, too, and the cursors move on.  A passage without a pivot is done.  All pairs above the threshold
are found.

A pair is reported when the item's question (5-word shingles) stands in the passage and the answer's
words follow in their order; of an item whose answer has a few words only, nearly all shingles of the
whole item are enough.  Words are compared case-folded in Unicode, without the marks at their edges
(see plain()).

Document frequencies, mean and greatest length are those of all items.  An index holds INDEX_WORDS
words on average, some 80 bytes for each; larger benchmarks are searched one part after another.

Defined results: null and empty texts match nothing; items without words or without an id are not
indexed; an item that stands in the benchmark twice is reported once per row, as is a document that
stands there twice; an item is never cut, however long; of passages with equal shares the first counts;
empty tables give none.  Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
#: Items of a block.
BLOCK = 16
#: Words of the items that are indexed at once, on average.
INDEX_WORDS = 400_000
#: Least share of the question's shingles, and of the answer's words, in the document.
QUESTION, ANSWER = 0.8, 0.8
SHINGLE = 5
#: Least share of a whole item's shingles that is enough where the answer has at most FEW words.
WHOLE, FEW = 0.9, 5
#: Passages that are searched side by side.
TOGETHER = 8192
#: Marks at the edge of a word, and spaces that textops doesn't part words at.
_EDGE = re.compile(r"[^\S\x20\x09-\x0D]|[^\w\s]++(?!\w)|(?<!\S)[^\w\s]+")


def plain(text: bytes) -> bytes:
    """A text with its words case-folded and composed, and a space in place of marks at their edges and of underlines."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.decode(errors="replace")).casefold())
    return _EDGE.sub(" ", folded.replace("_", " ")).encode()


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): at the last line end, else after the last question mark or full stop inside."""
    text = text.rstrip()
    for cut in (text.rfind("\n"), *(m.end() for m in list(re.finditer(r"[?.!]\s", text))[-1:])):
        if cut > 0 and text[:cut].strip() and text[cut:].strip():
            return text[:cut], text[cut:]
    return text, ""


class Statistics:
    """Of all items: how many, their mean and greatest length, and the document frequency of sorted terms."""

    def __init__(self, n: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.longest, self.terms, self.df = n, mean, longest, terms, df

    @classmethod
    def of(cls, words: textops.Words) -> "Statistics":
        terms, df = np.unique(textops.distinct_by_row(words.key, words.doc)[0], return_counts=True)
        return cls(words.n_rows, float(words.count.mean()) if words.n_rows else 1.0, int(words.count.max(initial=1)), terms, df)


class Index:
    """Inverted lists of the items' terms in blocks, and what verification needs of each item."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        words = textops.Words([plain((t or "").encode()) for _, t in items])
        items = [x for x, n in zip(items, words.count, strict=True) if n]
        items.sort(key=lambda x: (len(x[1]), x[0]))  # similar lengths have similar impacts
        words = textops.Words([plain(t.encode()) for _, t in items])
        known = statistics or Statistics.of(words)
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.longest = known.longest
        self.terms, term = np.unique(words.key, return_inverse=True)
        n, size = len(items), words.count
        pair, tf = np.unique(term * max(1, n) + words.doc, return_counts=True)
        term, item = np.divmod(pair, max(1, n))
        df = known.df[textops.find(known.terms, self.terms)] if n else np.zeros(0)
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(known.mean, 1)))
        impact /= np.bincount(item, impact, n)[item]
        # Postings are in order of term and item; runs of one term and block are what a cursor stands on.
        self.blocks = max(1, -(-n // BLOCK))
        run = term * self.blocks + item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if n else np.zeros(0, dtype=int)
        self.run_key = run[first]
        self.run_first = np.concatenate([first, [len(run)]])
        self.run_top = np.maximum.reduceat(impact, first) if n else np.zeros(0)
        self.item, self.impact = item.astype(np.int32), impact
        self.list_first = np.searchsorted(self.run_key, np.arange(len(self.terms) + 1) * self.blocks)
        self.list_top = np.maximum.reduceat(self.run_top, self.list_first[:-1]) if n else np.zeros(0)
        parts = [split_item(t) for _, t in items]
        question, answer = (textops.Words([plain(p[j].encode()) for p in parts]) for j in (0, 1))
        self.question, self.whole = self._shingles(question), self._shingles(words)
        self.answer = [answer.key[lo:hi].tolist() for lo, hi in zip(answer.first[:-1], answer.first[1:], strict=True)]

    @staticmethod
    def _shingles(words: textops.Words) -> list[tuple[int, np.ndarray]]:
        """(words of a shingle, distinct shingles) of each text."""
        key, row = textops.distinct_by_row(*textops.shingles(words, SHINGLE))
        at = np.searchsorted(row, np.arange(words.n_rows + 1))
        return [(min(SHINGLE, int(n)), key[lo:hi]) for n, lo, hi in zip(words.count, at[:-1], at[1:], strict=True)]

    def passages(self, words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row and first word of each passage; passage and term of each pair, in this order)."""
        stride = self.longest
        strides = -(-words.count // stride)
        base = np.concatenate([[0], np.cumsum(strides)])
        row = np.repeat(np.arange(words.n_rows), strides)
        start = words.first[row] + (np.arange(len(row)) - base[row]) * stride
        hit = textops.find(self.terms, words.key)
        known = np.flatnonzero(hit >= 0)
        doc = words.doc[known]
        place = known - words.first[doc]
        # Passage p of a text covers strides p and p + 1; a stride belongs to passages p - 1 and p.
        at, second = base[doc] + place // stride, place >= stride
        key = np.unique(np.concatenate([at, at[second] - 1]) * max(1, len(self.terms)) + np.concatenate([hit[known], hit[known][second]]))
        return row, start, *np.divmod(key, max(1, len(self.terms)))

    def above(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs above the threshold; pairs of passage and term are in order of passage."""
        least = THRESHOLD - 1e-9
        cursor, cand, hits = self.list_first[term], [], []
        while len(passage):
            block = self.run_key[cursor] - term * self.blocks
            order = np.argsort(passage * self.blocks + block, kind="stable")
            own = passage[order]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.concatenate([begins, [len(own)]]))
            total = np.cumsum(self.list_top[term[order]])
            before = np.concatenate([[0.0], total])[begins]
            # The pivot: the first cursor at which the largest impacts of the lists up to it are enough.
            enough = total - np.repeat(before, size) >= least
            reached = np.add.reduceat(enough, begins)
            pivot = np.repeat(block[order][begins + np.minimum(size - reached, size - 1)], size)
            alive = np.repeat(reached > 0, size)
            order, pivot = order[alive], pivot[alive]
            passage, term, cursor, block = passage[order], term[order], cursor[order], block[order]
            # Cursors before the pivot's block skip to it or beyond.
            back = np.flatnonzero(block < pivot)
            cursor[back] = np.searchsorted(self.run_key, term[back] * self.blocks + pivot[back])
            left = cursor < self.list_first[term + 1]
            passage, term, cursor, pivot = passage[left], term[left], cursor[left], pivot[left]
            here = np.flatnonzero(self.run_key[cursor] == term * self.blocks + pivot)
            if len(here):
                own = passage[here]
                begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                bound = np.add.reduceat(self.run_top[cursor[here]], begins)
                scored = np.repeat(bound >= least, np.diff(np.concatenate([begins, [len(own)]])))
                cand.append(own[scored] * self.blocks + pivot[here][scored])
                hits.append(cursor[here][scored])
                cursor[here] += 1
                left = cursor < self.list_first[term + 1]
                passage, term, cursor = passage[left], term[left], cursor[left]
        if not cand or not sum(map(len, cand)):
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        cand, hits = np.concatenate(cand), np.concatenate(hits)
        shown, at = np.unique(cand, return_inverse=True)
        n = self.run_first[hits + 1] - self.run_first[hits]
        entry = np.repeat(self.run_first[hits] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(np.repeat(at, n) * BLOCK + self.item[entry] % BLOCK, self.impact[entry], len(shown) * BLOCK)
        found = np.flatnonzero(score >= least)
        return shown[found // BLOCK] // self.blocks, shown[found // BLOCK] % self.blocks * BLOCK + found % BLOCK, score[found]

    def scored(self, words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score, first word of the passage) of all passages above the threshold."""
        row, start, passage, term = self.passages(words)
        found = []
        for lo in range(0, len(row), TOGETHER):
            span = slice(*np.searchsorted(passage, [lo, lo + TOGETHER]))
            found.append(self.above(passage[span], term[span]))
        if not found:
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int)
        passage, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return row[passage], item, score, start[passage]

    def search(self, words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, best score) of all pairs of a text and an item with a passage above the threshold."""
        row, item, score, _ = self.scored(words)
        order = np.lexsort((-score, item, row))
        row, item, score = row[order], item[order], score[order]
        keep = np.ones(len(row), dtype=bool)
        keep[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[keep], item[keep], score[keep]

    def verify(self, passage: np.ndarray, item: int) -> tuple[bool, float, float]:
        """Whether a passage (keys of its words) holds the item; shares of its question's shingles and of its
        answer's words in order behind the question's first one, 1 for an item without that part."""
        size, question = self.question[item]
        there = runs(passage, size)
        hit = np.flatnonzero(textops.find(question, there) >= 0)
        asked = len(np.unique(there[hit])) / len(question) if len(question) else 1.0
        answer = self.answer[item]
        told = in_order(answer, passage[int(hit[0]) if len(hit) else 0 :].tolist()) / len(answer) if answer else 1.0
        held = asked >= QUESTION and told >= ANSWER
        if not held and (told >= ANSWER or len(set(answer)) <= FEW):
            size, whole = self.whole[item]
            held = np.isin(whole, runs(passage, size)).mean() >= WHOLE
        return held, asked, told


def in_order(wanted: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    place: dict[int, int] = {}
    for k, w in enumerate(wanted):
        place[w] = place.get(w, 0) | 1 << k
    full = (1 << len(wanted)) - 1
    rest = full
    for w in words:
        if hit := rest & place.get(w, 0):
            rest = (rest + hit | rest - hit) & full
    return len(wanted) - rest.bit_count()


def runs(key: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` words, as textops.shingles() has them."""
    n = len(key) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, dtype=np.uint64)
    mult = textops.powers(np.uint64(0xD6E8FEB86659FD93), SHINGLE + 1)[1:]
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += textops.mix(key[j : n + j] * mult[j])
    return textops.mix(total + np.uint64(size))


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _search(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index, words = shared.value, textops.Words([plain(t) for t in common.texts_of(batch)])
        row, item, score, start = index.scored(words)
        best = {}
        for r, i, x, at in zip(row.tolist(), item.tolist(), score.tolist(), start.tolist(), strict=True):
            held, asked, told = index.verify(words.key[at : min(at + 2 * index.longest, int(words.first[r + 1]))], i)
            if held and (old := best.get((r, i), (0, 0, 0)))[1:] < (asked, told) or held and not any(old):
                best[r, i] = max(x, old[0]), asked, told
        out = [(r, int(index.ids[i]), *best[r, i]) for r, i in sorted(best)]
        if not out:
            return None
        ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([x[0] for x in out], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in out], pa.int64()), *(pa.array([x[j] for x in out], pa.float64()) for j in (2, 3, 4))], SCHEMA.replace(" long", "").replace(" double", "").split(", "))

    return common.map_texts(documents, work, SCHEMA)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item."""
    documents = documents.select("doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    known = common.keep(_terms(items))
    n, size, longest = known.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    parts = max(1, -(-size // INDEX_WORDS))
    frequency = known.groupBy("term").agg(F.count("*").alias("df"))
    part_of = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    found = None
    for part in range(parts):
        rows = items.where(part_of == part).collect()
        own = known.where(part_of == part).select("term").distinct().join(frequency, "term").toArrow()
        order = np.argsort(term := own.column("term").to_numpy().view(np.uint64))
        index = Index([(r["item_id"], r["text"]) for r in rows], Statistics(n, size / n, longest, term[order], own.column("df").to_numpy()[order]) if n else None)
        if len(index.ids):
            more = _search(documents, index)
            found = more if found is None else found.unionByName(more)
    return found if found is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def _terms(items: DataFrame) -> DataFrame:
    """(item_id, n, term): each term of each item once; n, the item's words, stands in its first row and is 0 in others."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = textops.Words([plain(t) for t in common.texts_of(batch)])
        key, row = textops.distinct_by_row(words.key, words.doc)
        first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
        return pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), pa.array(words.count[row] * first), pa.array(textops.as_signed(key))], ["item_id", "n", "term"])

    return common.map_texts(items, work, "item_id long, n long, term long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_decontamination: every whole text of ``documents`` against every item of ``benchmark``."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
