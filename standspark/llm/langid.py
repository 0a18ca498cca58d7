"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's words are cut into byte n-grams, each hashed to a row of an embedding table; the mean of the
rows goes through a linear softmax.  Table and softmax are trained together by stochastic gradient
descent in numpy, on at most ROWS_PER_LANG labelled documents of each language (a bounded sample, of texts of
at most LONGEST_SAMPLED bytes).
A temperature fitted on documents kept from training calibrates the scores; a document whose
calibrated score, or whose share of n-grams known from training, lies below what documents of known
language reach is rejected.

Since the model is linear behind the mean, each n-gram's logits are computed once; a text costs one
sum per distinct word, over the whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; so are
all when nothing is labelled.  Rows are predicted one by one, repeated ones and null ids too; of languages with
equal scores the first in their order counts; an empty table gives none.  Words are cut at bytes of white
space; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

#: Labelled documents of each language that training takes at most (in expectation), and their longest text.
ROWS_PER_LANG, LONGEST_SAMPLED = 300, 1 << 17
BUCKETS = 1 << 16
DIM = 16
SIZES = (1, 2, 3, 4)
EPOCHS = 10
RATE = 0.5
#: Share of the sample that is kept for the temperature and the rejection.
CALIBRATE = 0.25
#: Share of correctly identified calibration documents that may lie below the rejection's bounds.
REJECT_TAIL = 0.002
#: Distinct words whose n-grams are looked up at once: some 20 megabytes.
WORDS_AT_ONCE = 8192
_LETTER = regex.compile(r"\p{L}")


def word_buckets(words: textops.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of the chosen words, word by word; first index of each word)."""
    grams = textops.Grams(words, at, 1, 1)
    parts, owner = [], []
    word = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(grams.first))
    for n in SIZES:
        gram, whole = grams.ending_here(n)
        parts.append((textops.mix(gram[whole] * np.uint64(8) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(word[whole])
    bucket, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(at) + 1))


class Model:
    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(5)
        self.langs = langs
        self.table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, len(langs)), dtype=np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)
        self.known = np.zeros(BUCKETS, dtype=bool)
        self.temperature, self.least_score, self.least_known = 1.0, 0.0, 0.0

    def train(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Stochastic gradient descent over runs of words of the texts, long and short."""
        rng = np.random.default_rng(11)
        words = textops.Words(texts)
        at, kind = textops.unique_words(words)
        bucket, first = word_buckets(words, at)
        self.known[bucket] = True
        n_words = words.count
        usable = np.flatnonzero(n_words > 0)
        weight = 1 / np.maximum(np.bincount(labels[usable], minlength=len(self.langs)), 1)
        chance = weight[labels[usable]] / weight[labels[usable]].sum()
        steps = max(1, EPOCHS * len(usable) // 16)
        for step in range(steps):
            rate = RATE * (1 - step / steps)
            docs = rng.choice(usable, 32, p=chance)
            length = np.minimum(n_words[docs], rng.integers(2, 40, len(docs)))
            start = words.first[docs] + (rng.random(len(docs)) * (n_words[docs] - length + 1)).astype(np.int64)
            ids = [kind[s : s + n] for s, n in zip(start, length, strict=True)]
            flat = np.concatenate(ids)
            per_word = first[flat + 1] - first[flat]
            rows = np.repeat(first[flat] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())
            grams = bucket[rows]
            size = np.add.reduceat(per_word, np.concatenate([[0], np.cumsum(length)[:-1]]))
            owner = np.repeat(np.arange(len(docs)), size)
            mean = np.add.reduceat(self.table[grams], np.concatenate([[0], np.cumsum(size)[:-1]])) / size[:, None]
            logits = mean @ self.out + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            slope = (p @ self.out.T) / size[:, None]
            self.out -= rate / len(docs) * 8 * (mean.T @ p)
            self.bias -= rate / len(docs) * p.sum(0)
            np.subtract.at(self.table, grams, (rate * slope)[owner].astype(np.float32))

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mean logits of each whole text, share of its n-grams known from training)."""
        words = textops.Words(texts)
        at, kind = textops.unique_words(words)
        each = np.concatenate([self.table @ self.out, self.known[:, None], np.ones((BUCKETS, 1))], axis=1)
        by_word = np.zeros((len(at), each.shape[1]))
        for lo in range(0, len(at), WORDS_AT_ONCE):
            bucket, first = word_buckets(words, at[lo : lo + WORDS_AT_ONCE])
            by_word[lo : lo + WORDS_AT_ONCE] = textops.row_sums(each[bucket], first)
        total = textops.row_sums(by_word[kind], words.first)
        n = np.maximum(total[:, -1:], 1)
        return total[:, :-2] / n + self.bias, total[:, -2] / n[:, 0]

    def calibrate(self, texts: list[bytes], labels: np.ndarray) -> None:
        logits, known = self.logits(texts)

        def loss(t: float) -> float:
            z = logits / t
            return float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(labels)), labels]))

        self.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        score = softmax(logits / self.temperature)
        right = score.argmax(1) == labels
        if right.any():
            self.least_score = min(float(np.quantile(score.max(1)[right], REJECT_TAIL)), 0.6) * 0.6
            self.least_known = float(np.quantile(known[right], REJECT_TAIL)) * 0.6

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language's index, its calibrated score, whether rejected)."""
        logits, known = self.logits(texts)
        score = softmax(logits / self.temperature)
        best = score.argmax(1)
        top = score[np.arange(len(best)), best]
        return best, top, (top < self.least_score) | (known < self.least_known)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def labelled_sample(documents: DataFrame, usable) -> list:
    """About ROWS_PER_LANG labelled documents of each language: (text, lang); fewer where there are fewer."""
    docs = documents.where(usable & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST_SAMPLED))
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & common.by_hash("doc_id", min(1.0, ROWS_PER_LANG / n)))
    return docs.where(keep).select("doc_id", "text", "lang").collect() if counts else []


def fit(documents: DataFrame, usable) -> Model | None:
    """The model from the labelled documents for which ``usable`` holds; None if there are none."""
    rows = sorted((r for r in labelled_sample(documents, usable) if _LETTER.search(r["text"])), key=lambda r: (str(r["doc_id"]), r["text"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    texts = [r["text"].encode() for r in rows]
    labels = np.array([langs.index(r["lang"]) for r in rows])
    kept = np.random.default_rng(3).random(len(rows)) < CALIBRATE
    kept &= len(rows) >= 20
    model = Model(langs)
    model.train([t for t, k in zip(texts, kept, strict=True) if not k], labels[~kept])
    if kept.any():
        model.calibrate([t for t, k in zip(texts, kept, strict=True) if k], labels[kept])
    return model


def identify(documents: DataFrame, usable=None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected.  ``usable`` limits the rows learnt from."""
    documents = documents.select("doc_id", "text", "lang")
    model = fit(documents, F.lit(True) if usable is None else usable)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        raw = batch.column("text").to_pylist()
        letters = np.array([bool(t and _LETTER.search(t)) for t in raw])
        pred, score, rejected = ["und"] * len(raw), np.zeros(len(raw)), ~letters
        if model is not None and letters.any():
            best, top, weak = model.predict([(t or "").encode() for t in raw])
            pred = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, top, 0.0)
            rejected = rejected | weak
        elif model is None:
            rejected = np.ones(len(raw), dtype=bool)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return common.map_texts(documents.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_language_id over every whole text of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, common.crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
