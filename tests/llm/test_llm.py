"""Training-data operators against plain versions, with edge cases in every input."""

import base64
import hashlib
import json
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from standspark.llm import bpe, common, decontaminate, hmm, html, jaccard, langid, secrets, sketch, suffixes, textops, topk, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, at int, score double, shingle string, label int"
VOCAB = {"en": "the of and to in is that it for with on as are was be by this from".split(), "de": "der die das und ist nicht mit ein für auf im den von zu".split()}


def make(spark, rows):
    """Documents with columns whose names operators use within."""
    return spark.createDataFrame([(i, t, l, "s", len(t or ""), 1, 2, 0.5, "x", 3) for i, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    text = lambda lang, n: " ".join(random.choice(VOCAB[lang]) + random.choice(["", "", "a", "en", "st", ",", "."]) for _ in range(n))
    out = [(i, text(lang := random.choice(["en", "de"]), random.choice([3, 8, 30, 80, 150])), lang) for i in range(120)]
    passage = text("en", 25)
    for i in range(120, 150):  # near copies, some of copies
        w = out[random.choice([0, 1, 2, 3])][1].split()
        if i % 3:
            w[random.randrange(len(w))] = "changed"
        out.append((i, " ".join(w), "en"))
    for i in range(150, 165):  # a passage in otherwise different documents
        out.append((i, text("de", 6) + " " + passage + "\n" + text("en", 5), "en"))
    out += [(170, None, "en"), (171, "", "de"), (172, " \n\t ", None), (173, "123 456 !!", "en"), (174, "one", "en"), (175, "x" * 70000, None), (176, text("en", 6000), "en"), (177, "é" * 60 + " ☃", "de"), (178, "THE Of AND to IN", "en"), (179, "the of and to in", "en")]
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_batches():
    texts = [b"The  cat\x1fsat\n", b"", b" ", "É a".encode(), b"z"]
    w = textops.Words(texts)
    assert [[w.text(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(5)] == [brute.words(t.decode()) for t in texts]
    same = textops.Words([b"x y " * 90000 + b"tail", b"tail"])
    assert same.key[-1] == same.key[-2] and len(set(same.key.tolist())) == 3


def test_secrets(spark, rows):
    der = base64.b64encode(b"\x30\x22" + b"\x02\x01\x00" + b"\x30\x1d" + b"\x06\x03\x2a\x03\x04" + b"\x04\x16" + bytes(22)).decode()
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1234567890'})}.abc"
    extra = [f"PassWord = 'abc' secret:longer1 tokentoken=abcdef api_key=\"aaaaaa", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "0123456789abcdef01234567 0123456789abcdef0123456", f"é {der} x", f"see {token}", "M" * 60, "eyJhbGciOiJub25lIn0.e30.", "secret=" + "a" * 24]
    data = rows + [(200 + k, t, "en") for k, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in secrets.scan(make(spark, data)).collect()}
    assert len(got) == len(data)
    for i, t, _ in data:
        spans = brute.base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i]["n_assign"] == spans.count("assign:") and got[i]["n_hex"] == spans.count("hex:")
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))
    assert "der:" in got[203]["spans"] and "signed:" in got[204]["spans"] and got[205]["spans"] == ""
    assert got[200]["redacted"].count("[assign]") == 3
    assert secrets.scan(empty(spark)).count() == 0


def test_secrets_at_any_alignment_and_over_lines():
    import textwrap

    body = b"\x02\x01\x00" + b"\x02\x82\x01\x01" + b"\x7f" * 257 + b"\x02\x03\x01\x00\x01" + b"\x02\x82\x01\x00" + b"\x55" * 256
    der = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    run, url = base64.b64encode(der).decode(), lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    for before in ("", "k", "ke", "key/", "key: ", "a\n"):
        assert secrets.confirmed_spans(before + run + " end") == [(len(before), len(before) + len(run), "der")]
        assert secrets.confirmed_spans(before + der.hex() + "!") == [(len(before), len(before) + 2 * len(der), "der")]
    for end in ("\n", "\r\n", "\n  "):
        wrapped = end.join(textwrap.wrap(run, 64))
        assert secrets.confirmed_spans("see\n\n" + wrapped + "\nnext words") == [(5, 5 + len(wrapped), "der")]
    token = url('{ "alg":"HS256"}') + "." + url('{"sub":1}') + ".sig"
    assert secrets.confirmed_spans(f"v1.{token}.x") == [(3, 3 + len(token), "signed")]
    blob = base64.b64encode(b"\0\0\0\x07ssh-rsa\0\0\0\x03\1\0\1").decode()
    assert secrets.confirmed_spans(f"{blob} me") == [(0, len(blob), "blob")]
    # One wrong length, a cut run and prose report nothing.
    for text in (base64.b64encode(der[:3] + bytes([der[3] ^ 1]) + der[4:]).decode(), run[:-8], "MAIN MACHINE AAAAB 3045 30820101 e.g. a.b.c www.x.example", "M" * 50_000, "A" * 50_000, "30" * 20_000):
        assert secrets.confirmed_spans(text) == []


def test_key_parsing():
    assert secrets.is_der_key(b"\x30\x06\x02\x01\x00\x30\x01\x00") is False  # nested length doesn't fit
    assert secrets.is_key_blob(b"\0\0\0\x07ssh-rsa\0\0\0\x01\x03") and not secrets.is_key_blob(b"\0\0\0\x07ssh-rsa\0\0\0\x09\x03")


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_path())
    random.seed(2)
    bits = ["a", "ab", " ", "  ", "\n", "'", "s", "'re", "é", "☃", "12", "½", ",.", "<|endoftext|>", "\x85", "\x1c", "the", "---", "=" * 30]
    data = rows + [(300 + k, "".join(random.choice(bits) for _ in range(random.randrange(80))), "en") for k in range(60)]
    got = {r["doc_id"]: r for r in bpe.round_trip(make(spark, data), bpe.default_path(), keep_ids=True).collect()}
    for i, t, _ in data:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), bpe.default_path()).count() == 0


def test_bpe_in_small_pieces_with_a_small_table(monkeypatch):
    """Long texts, long runs and a table that is emptied again and again give the library's tokens, piece by piece."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "PIECE", 500)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 30_000)
    random.seed(21)
    reference, encoder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    bits = ["a", "don't", " ", "  ", "\n", "'re", "é☃", "12", ",.", "<|endoftext|>", "the", " word" * 9, "=" * 700, "xq" * 400]
    texts = ["".join(random.choice(bits) for _ in range(random.choice([0, 3, 40, 400]))) for _ in range(60)] + ["", "z" * 9000, " " * 3000]
    out: list[list[int]] = [[] for _ in texts]
    for ids, spans in encoder.encode_many(texts):
        assert ids.dtype == np.int32 and len(ids) < 4000 and encoder.bytes < 30_000 + 400_000
        for i, lo, hi in spans:
            out[i] += ids[lo:hi].tolist()
    assert out == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_needs_its_lookahead_only():
    from tokenizers import Tokenizer

    v = bpe.Vocabulary(bpe.default_path())
    reference = Tokenizer.from_file(bpe.default_path())
    random.seed(5)
    for _ in range(6):
        text = "".join(random.choice("etaoinshrdluthe") for _ in range(4000))
        t, out = bpe.Transducer(v), []
        for at in range(0, len(text), 97):
            out += t.feed(text[at : at + 97].encode())
            assert len(t.window) <= 2 * v.lookahead + 64
        assert [*out, *t.finish()] == reference.encode(text, add_special_tokens=False).ids


def test_decoder_waits_for_characters():
    v = bpe.Vocabulary(bpe.default_path())
    d = bpe.Decoder(v)
    snow = "☃".encode()
    assert [d.feed([v.byte_id[b]]) for b in snow] == ["", "", "☃"] and d.feed([v.byte_id[snow[0]]]) == "" and d.finish() == "�"


def test_language_id(spark, rows):
    docs = make(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(docs, common.crc_mod("doc_id", 5) != 0).collect()}
    assert len(got) == len(rows)
    for i in (170, 171, 172, 173):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    long = [(i, l) for i, t, l in rows if i < 120 and len(t.split()) >= 30]
    assert np.mean([got[i]["lang_pred"] == l for i, l in long]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.identify(docs, F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_language_scores_equal_plain_sums():
    """Logits of a trained model against means over n-grams, one by one."""
    texts = [b"the of and to in is", b"der die das und", b"von zu im f\xc3\xbcr", b"x"]
    model = langid.Model(["a", "b"])
    model.train(texts, np.array([0, 1, 1, 0]))
    mask = 2**64 - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> 33
            x = x * m & mask
        return x ^ x >> 33

    for text in (*texts, b"The die  and\nder unseen"):
        rows = []
        for word in text.lower().split():
            padded = b"\0" + word + b"\1"
            for n in langid.SIZES:
                for end in range(n, len(padded) + 1):
                    gram = sum(b << 8 * j for j, b in enumerate(reversed(padded[end - n : end])))
                    rows.append(mix((gram * 8 + n) & mask) % langid.BUCKETS)
        mean = model.table[rows].mean(0, dtype=np.float64)
        logits, known = model.logits([text])
        assert logits[0] == pytest.approx(mean @ model.out + model.bias, abs=1e-4)
        assert known[0] == pytest.approx(np.mean(model.known[rows]))


def test_toxicity_ratio_equals_plain_kneser_ney():
    """Log-likelihood ratios against the formula on dictionaries, for seen grams, seen contexts and new ones."""
    rng = random.Random(2)
    counts = {}
    for _ in range(400):
        g = bytes(rng.choice(b"ab") for _ in range(5)) + bytes([rng.choice(b"abc")])
        counts.setdefault(g, [0, 0])[rng.randrange(2)] += 1
    grams = np.array([int.from_bytes(g, "big") for g in counts], dtype=np.uint64)
    tables = [np.array([c[k] for c in counts.values()], dtype=float) for k in (0, 1)]
    model = toxicity.KneserNey(grams, tables[0], tables[1])

    def discount(values):
        one, two = values.count(1), values.count(2)
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    def shared(longer, n):
        """{gram of n: probability of its last byte} from continuation counts of longer grams."""
        if n == 0:
            return None
        kinds = [g[-n:] for g in longer]
        number = {g: kinds.count(g) for g in set(kinds)}
        lower, d, out = shared(sorted(number), n - 1), discount(list(number.values())), {}
        for g in number:
            same = [number[h] for h in number if h[:-1] == g[:-1]]
            out[g] = max(number[g] - d, 0) / sum(same) + d * len(same) / sum(same) * (lower[g[1:]] if lower else 1 / 256)
        return out

    both = {g: sum(c) for g, c in counts.items()}
    lower, d = shared(list(counts), 5), discount(list(both.values()))

    def p(g, k):
        own = {h: c for h, c in counts.items() if h[:-1] == g[:-1]}
        total = sum(both[h] for h in own)
        backoff = max(both[g] - d, 0) / total + d * len(own) / total * lower[g[1:]]
        n = sum(c[k] for c in own.values())
        taken = {h: min(c[k], toxicity.CLASS_DISCOUNT) for h, c in own.items()}
        return (counts[g][k] - taken[g]) / n + sum(taken.values()) / n * backoff if n else backoff

    at = {int(g): i for i, g in enumerate(model.grams)}
    for g in counts:
        assert model.gram_llr[at[int.from_bytes(g, "big")]] == pytest.approx(math.log(p(g, 0)) - math.log(p(g, 1)), abs=1e-4)


def test_toxicity_of_repeated_rows_and_empty_labels(spark):
    random.seed(7)
    data = [(i, " ".join(random.choice(VOCAB["en"]) for _ in range(30)) + (" grawlix" * 4 if i % 3 == 0 else ""), "en") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 90, 2)] * 2, "doc_id long, quality int, toxic int")
    got = toxicity.score(make(spark, data + data[:5] + [(None, "grawlix", "en")]), labels).collect()
    assert len(got) == 96
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    assert np.mean([(min(by[i]) >= toxicity.THRESHOLD) == (i % 3 == 0) for i in range(1, 90, 2)]) > 0.9
    assert {r["score"] for r in toxicity.score(make(spark, data), labels.limit(0)).collect()} == {0.0}


def test_toxicity(spark):
    random.seed(3)
    data, labels = [], []
    for i in range(400):
        w = [random.choice(VOCAB["en"]) + random.choice(["", "an", "er"]) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[random.randrange(60)] = random.choice(["zorgh", "zorghik", "vlaxum"])
        data.append((i, " ".join(w), "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad), "x"))
    data += [(900, None, None), (901, "", "en"), (902, "zorghok " * 40000, "en")]
    labels += [(0, 0, 1, "x"), (999, 1, 1, "x"), (901, 1, None, "x"), (None, 1, 1, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make(spark, data), table).collect()}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], i % 5 == 0) for i in range(400) if i % 2]
    assert min(s for s, bad in held if bad) > max(s for s, bad in held if not bad)
    assert got[900] == got[901] < 0.5 < got[902]
    assert {r["score"] for r in toxicity.score(make(spark, data), table.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(empty(spark), table).count() == 0


def test_kneser_ney_sums_to_one():
    grams = np.array([int.from_bytes(bytes([0, 0, 97, 98, 99, c]), "big") for c in (100, 101, 102)], dtype=np.uint64)
    p = toxicity.KneserNey.shared(grams, 2)
    every = np.array([int.from_bytes(bytes([0, 0, 97, 98, 99, c]), "big") for c in range(256)], dtype=np.uint64)
    assert (p > 1 / 256).all() and toxicity.KneserNey.shared(every, 1).sum() == pytest.approx(1)


def test_decontamination(spark, rows):
    text = dict((i, t) for i, t, _ in rows)
    items = [(1, " ".join(text[5].split()[:40]) if len(text[5].split()) > 40 else text[5] + " with a longer tail of words that nobody else has"), (2, "what is the zanzor of quibble frandle?\nthe answer is morb tilk"), (3, None), (4, ""), (5, "what is the zanzor of quibble frandle?\nthe answer is morb tilk")]
    leak = [(300, text[10] + " What is THE zanzor of quibble frandle?\nThe answer is morb tilk " + text[11], "en"), (301, "what is the zanzor of quibble frandle? " + text[12], "en"), (302, "morb tilk zanzor frandle quibble the is what of answer", "en")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(spark, rows + leak), bench).collect()}
    norm = lambda t: " ".join(brute.words(t))
    expected = {(i, k) for i, t, _ in rows + leak for k, x in items if x and f" {norm(x)} " in f" {norm(t)} "}
    assert {p for p in expected} <= got and (300, 2) in got and (300, 5) in got
    assert not {d for d, _ in got} & {301, 302}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(make(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_ignores_case_and_marks(spark):
    tail = "which river crosses the old bridge of the northern quarter near the mill"
    items = [(1, f"{tail}? Er."), (2, "Qué nación eligió la canción número cien de la colección según el jurado?\nLa acción"), (3, f"{tail[::-1]} and one two three four five? vier rote alte Steine")]
    long = " ".join(f"w{k}" for k in range(50))
    items += [(4, f"{long}? one two three four"), (5, f"{long.replace('w', 'v')}? one two three four five six seven")]
    texts = [f"before {items[0][1]}!! after", f"«{items[1][1].upper()}»", f"({items[2][1].replace(' ', chr(160) + ' ')})...", f"{long} one two three five", long.replace("w", "v")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(spark, [(k + 1, t, "en") for k, t in enumerate(texts)]), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_decontamination_parts_order_and_repeated_rows(spark, rows, monkeypatch):
    """Scores and pairs don't depend on the number of index parts; answers count in their order behind the question."""
    random.seed(31)
    word = lambda: "".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(random.randint(2, 4)))
    ask = [" ".join(word() for _ in range(14)) for _ in range(12)]
    told = [" ".join(word() for _ in range(9)) for _ in range(12)]
    items = [(k, f"{a}? {t}") for k, (a, t) in enumerate(zip(ask, told))] + [(50, " ".join(word() for _ in range(70))), (3, f"{ask[3]}? {told[3]}"), (None, ask[0])]
    mixed = " ".join(random.sample(told[1].split(), 9))
    data = rows[:60] + [(400, f"so {items[0][1]} then", "en"), (401, f"so {ask[1]}? {mixed}", "en"), (402, f"{told[2]} and {ask[2]}? nothing", "en"), (403, f"{ask[3]}? {' '.join(word() for _ in range(300))} {told[3]}", "en"), (404, f"x {items[12][1]} y", "en"), (405, f"{ask[3]}? well, {told[3]}", "en"), (405, f"{ask[3]}? well, {told[3]}", "en"), (None, items[5][1], "en")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for words in (400_000, 40):
        monkeypatch.setattr(decontaminate, "INDEX_WORDS", words)
        found[words] = sorted((r["doc_id"] or -1, r["item_id"], round(r["score"], 6)) for r in decontaminate.contaminated(make(spark, data), bench).collect())
    assert found[40] == found[400_000]
    assert [x[:2] for x in found[40]] == [(-1, 5), (400, 0), (404, 50), (405, 3), (405, 3), (405, 3), (405, 3)]


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.in_order(a, b) == table[-1][-1]


def test_block_scores_equal_brute_force():
    random.seed(9)
    items = [(k, " ".join(random.choice("abcdefghij") * random.randint(1, 2) for _ in range(random.randint(3, 20)))) for k in range(60)]
    index = decontaminate.Index(items)
    texts = [" ".join([t for _, t in random.sample(items, 2)] + ["zz"] * 3) for _ in range(20)]
    row, item, score = index.search(textops.Words([t.encode() for t in texts]))
    n, df = len(items), {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    mean = sum(len(t.split()) for _, t in items) / n
    impact = lambda t: {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.split().count(w) * 2.2 / (t.split().count(w) + 1.2 * (0.25 + 0.75 * len(t.split()) / mean)) for w in set(t.split())}
    expected = {}
    for r, text in enumerate(texts):
        w = text.split()
        for k, t in items:
            own = impact(t)
            best = max(sum(own.get(x, 0) for x in set(w[lo : lo + 2 * index.longest])) / sum(own.values()) for lo in range(0, len(w), index.longest))
            if best >= decontaminate.THRESHOLD:
                expected[r, k] = best
    got = {(int(r), int(index.ids[i])): float(s) for r, i, s in zip(row, item, score, strict=True)}
    assert set(got) == set(expected) and all(got[p] == pytest.approx(expected[p], abs=1e-4) for p in got)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=8).tolist()) for i in range(700)] + [(i, [1.0] * 8) for i in range(700, 1000)]
    data += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8), (1200, [2.0, 3.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("id") % 100 == 0, 10).collect())
    good = [(i, np.floor(1024 * np.float32(v).astype(np.float64)).astype(np.int64)) for i, v in data if i is not None and i < 1000]
    expected = []
    for q, x in good:
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:10]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(expected)
    few = topk.top_k(table.where("vec_id < 4"), F.col("id") == 0, 10).collect()
    assert len(few) == 3
    assert topk.top_k(table.limit(0), F.col("id") == 0, 10).count() == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 600])
def test_top_k_is_exact_for_large_components(spark, monkeypatch, block_bytes):
    """Integers to 2 ** 28, sums far beyond what floats hold; repeated queries and candidates; several blocks and shards."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    rng = np.random.default_rng(6)
    whole = rng.integers(-(2**28), 2**28, (600, 6))
    whole[200:400] = whole[100] + rng.integers(0, 2, (200, 6))  # scores that differ in their last digits
    data = [(i, (v / 1024).tolist()) for i, v in enumerate(whole)]
    data += [data[100], data[100], data[7], data[7]]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("id") % 100 == 0, 10).collect())
    expected = []
    for q in range(0, 600, 100):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(whole[q], whole[i], strict=True)), i) for i, _ in data if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == expected
    assert topk.top_k(table, F.col("id") < 0, 10).count() == 0


PAGE = "<html><head><title>T &amp; t</title><script>if (a < b) '</p>'</script></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><div class='cookie notice'>We use cookies here</div><article><h1>Big\n head</h1><p>First &lt;para&gt; <b>bo</b>ld&nbsp;text goes on for some words.<p>Second one<br>with a break and more words</p><aside>See also this</aside><p>Third has words as well</p></article><div id='comments'><p>I like it a lot</p></div><form>Name <input></form><footer>&copy; us</footer></body></html>"


def test_html(spark):
    data = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "just words & more"), (6, "u", "<div" * 50), (7, "u", PAGE.replace("article", "main")), (1, "u", PAGE)]
    table = spark.createDataFrame([(*d, "x") for d in data], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(table).collect()}
    body = "Big head\n\nFirst <para> bold text goes on for some words.\n\nSecond one with a break and more words\n\nThird has words as well"
    assert got[1]["text"] == body and got[1]["n_chars"] == len(body) and got[7]["text"] == body
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "just words & more"
    assert html.extract(table).count() == len(data) and html.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<body><div style='overflow:hidden'>{}</div></body>", "<body class='has-sidebar'>{}</body>", "<body class='menu'>{}</body>", "<div class='content no-sidebar'>{}</div>", "<div id='post-with-comments'>{}</div>",
    "<div data-hidden='hidden' title='class=ad'>{}</div>", "<html class='modal'><body>{}</body></html>", "<form class='menu'><main id='share' hidden>{}</main></form>", "<div class='social'><div id='nav'><article class='related'>{}</article></div></div>",
])
def test_html_keeps_pages_of_any_style(page):
    body = "<p>First words of the text go on.</p><p>Second ones as well.</p>"
    assert html.main_text(page.format(body), {"tag:p": -0.1}) == "First words of the text go on.\n\nSecond ones as well."


@pytest.mark.parametrize("page", ["<body class='has-sidebar'><article>{}</article></body>", "<article class='post comment-status-open'>{}</article>", "<form><article>{}</article></form>", "<main><article>{}</article><section id='comments'><article class='comment'><p>Reader says this</p></article></section></main>"])
def test_html_keeps_the_marked_article(page):
    body = "<p>First words of the text go on.</p><p>Second <span class='ad'>gone</span> ones<br>as well.</p>"
    for weight in ({}, {"tag:p": -0.1}, {"attr:post": -5.0, "element:form": -9.0}):
        assert html.main_text(page.format(body), weight) == "First words of the text go on.\n\nSecond ones as well."


def test_html_evidence_overrules_priors():
    """Words of a class that stand in articles on labelled pages are kept, whatever the class is called."""
    page = "<article><div class='notice'>" + "in the text " * 20 + "</div><div class='box'>" + "and so on " * 40 + "</div></article><div class='strip'>" + "bought words " * 60 + "</div>"
    inside, outside = html.kinds(html.Page(page))
    learnt = html.weights(inside, outside)
    assert learnt["attr:notice"] > html.AGAINST >= learnt["attr:strip"] and html.feature_weight(0, 0, "attr:notice") <= html.AGAINST
    other = "<div class='strip'>bought words here</div><p>Words of another page.</p>"
    assert html.main_text(other, learnt) == "Words of another page."


def test_html_best_run_is_the_best():
    rng = random.Random(8)
    for _ in range(300):
        x = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(1, 14))]
        spans = [(sum(x[i : j + 1]), -i, -j) for i in range(len(x)) for j in range(i, len(x))]
        best = max(s[0] for s in spans)
        found = html.best_run(x)
        assert (found is None) == (best <= 0)
        assert found is None or abs(sum(x[found[0] : found[1] + 1]) - best) < 1e-9


def test_html_hostile_pages_take_linear_time():
    import time

    for page in ("<a " + "\"'" * 500_000, "<a " * 300_000, "<div>" * 100_000 + "</x>" * 100_000 + "word", "<a ='" * 200_000, "<a b=\"c>d' <e f='>\" " * 50_000, "<!--" * 200_000, "<" * 500_000, "<article>" * 30_000 + "word"):
        began = time.process_time()
        html.main_text(page, {})
        assert time.process_time() - began < 3


def test_html_holds_every_given_article():
    """All given pages against a parser of their one layout."""
    import html as entities
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    inside, outside = html.Counter(), html.Counter()
    for p in pages[:100]:
        i, o = html.kinds(html.Page(p))
        inside.update(i)
        outside.update(o)
    weight = html.weights(inside, outside)
    for p in pages:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p, re.S)[1])
        plain = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts)
        assert html.main_text(p, weight) == "\n\n".join(x for x in plain if x)


def test_html_excludes_by_attributes_of_their_name():
    for mark in ("hidden", "hidden=''", "CLASS='x Ads'", "id=comments", "role='navigation'", "aria-hidden = \"true\""):
        assert html.main_text(f"<p>Text that stays here.</p><div {mark}>gone</div><p>And more of it.</p>", {"tag:div": -0.1, "tag:p": -0.1}) == "Text that stays here.\n\nAnd more of it."


def test_lm_scores(spark, rows):
    train = common.crc_mod("doc_id", 5) != 1
    got = {r["doc_id"]: r for r in hmm.score(make(spark, rows), train).collect()}
    expected = brute.unigram_scores([(i, t) for i, t, _ in rows], lambda i: brute.crc(i) % 5 != 1)
    assert set(got) == set(expected)
    for i, (n, known, total, base) in expected.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["score"] < 0
    twice = hmm.score(make(spark, rows + rows[:3]).unionByName(make(spark, [(None, "the of", "en")])), train).collect()
    assert len(twice) == len(rows) + 4 and len({(r["doc_id"], r["score"]) for r in twice}) == len(rows) + 1
    none = hmm.score(make(spark, rows), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["base_score"] == pytest.approx(0) for r in none)
    assert hmm.score(empty(spark), train).count() == 0


def test_forward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    draw = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    m = hmm.Model(draw(hmm.STATES), draw(hmm.STATES, hmm.STATES), draw(hmm.STATES, hmm.CLASSES))
    seqs = [np.array(s, dtype=np.uint16) for s in ([1], [2, 3, 2], [5, 700, 1, hmm.END])]
    for s, value in zip(seqs, m.log10_likelihood(seqs), strict=True):
        total = sum(m.start[path[0]] * m.emit[path[0], s[0]] * math.prod(m.move[a, b] * m.emit[b, c] for a, b, c in zip(path, path[1:], s[1:])) for path in itertools.product(range(hmm.STATES), repeat=len(s)))
        assert value == pytest.approx(math.log10(total))
    counts = m.expected(seqs)
    assert counts[: hmm.STATES].sum() == pytest.approx(3, rel=1e-4) and counts[hmm.STATES + hmm.STATES**2 :].sum() == pytest.approx(8, rel=1e-4)
    better = hmm.Model.maximised(counts, np.zeros(hmm.CLASSES))
    assert better.log10_likelihood(seqs).sum() > m.log10_likelihood(seqs).sum()


@pytest.mark.parametrize("piece", [4, 512])
def test_expected_counts_are_those_of_whole_sequences(monkeypatch, piece):
    monkeypatch.setattr(hmm, "PIECE", piece, raising=False)
    rng = np.random.default_rng(3)
    draw = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) ** 3)
    m = hmm.Model(draw(hmm.STATES), draw(hmm.STATES, hmm.STATES) * 0.2 + 0.8 * np.eye(hmm.STATES), draw(hmm.STATES, hmm.CLASSES))
    seqs = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 3, 4, 5, 8, 33, 100, 700, 1500)]
    first, moves, emissions = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
    for s in seqs:
        e, b = m.emit[:, s].T, [np.ones(hmm.STATES)]
        a = [m.start * e[0]]
        for t in range(1, len(s)):
            a.append((a[-1] / a[-1].sum() @ m.move) * e[t])
            b.append((m.move @ (e[-t] * b[-1])) / (m.move @ (e[-t] * b[-1])).sum())
        b.reverse()
        for t in range(len(s)):
            gamma = a[t] * b[t] / (a[t] @ b[t])
            emissions[:, s[t]] += gamma
            first += gamma * (t == 0)
            if t:
                xi = a[t - 1][:, None] * m.move * (e[t] * b[t])
                moves += xi / xi.sum()
    assert m.expected(seqs) == pytest.approx(np.concatenate([first, moves.ravel(), emissions.ravel()]), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("hot", [1, 500])
def test_suffix_dedup(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    random.seed(6)
    phrases = ["".join(random.choice("ab c") for _ in range(random.randint(30, 150))) for _ in range(8)]
    data = rows + [(1000 + i * 7 % 101, "".join(random.choice(phrases)[random.randint(0, 9) : random.randint(20, 150)] for _ in range(random.randint(0, 5))), "en") for i in range(100)]
    docs = make(spark, data + [(5, rows[5][1], rows[5][2])]).unionByName(make(spark, [(None, "no id", "en")]))
    got = [(r[0], tuple(r)[1:5]) for r in suffixes.dedup(docs).collect()]
    expected = brute.repeated_bytes([(i, t) for i, t, _ in data])
    assert len(got) == len(data) + 1 and all(value == expected[i] for i, value in got)
    assert suffixes.dedup(empty(spark)).count() == 0


def test_deep_shallow_orders_like_sorted():
    random.seed(8)
    texts = ["".join(random.choice("ab") * 30 if random.random() < 0.5 else random.choice("ab") for _ in range(60))[:50].ljust(50, "a") for _ in range(300)] * 2
    windows = np.frombuffer("".join(texts).encode(), dtype=np.uint8).reshape(-1, 50)
    order, label = suffixes.deep_shallow(windows, np.zeros(len(texts), dtype=np.int64))
    assert [texts[i] for i in order] == sorted(texts)
    assert label[-1] + 1 == len(set(texts))


def test_jaccard(spark, rows):
    docs = make(spark, rows + [rows[0]]).unionByName(make(spark, [(None, "no id", "en")]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs).collect()}
    expected = brute.jaccard_components([(i, t) for i, t, _ in rows])
    assert got == expected and any(c != i for i, (_, c) in expected.items())
    assert jaccard.similar_components(empty(spark)).count() == 0


def test_jaccard_tiles_lose_nothing(spark, monkeypatch):
    """Documents of a common middle, in chains, with tiles so small that many are paired."""
    monkeypatch.setattr(jaccard, "TILE", 3)
    random.seed(12)
    middle = [f"m{k}" for k in range(40)]
    data = []
    for i in range(90):
        w = list(middle)
        for k in random.sample(range(40), random.choice([0, 1, 1, 2])):
            w[k] = f"v{random.randrange(6)}"
        data.append((i, " ".join(w[: random.choice([40, 39, 36, 33])]), "en"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(make(spark, data)).collect()}
    assert got == brute.jaccard_components([(i, t) for i, t, _ in data])


@pytest.mark.parametrize("tile", [3, 256])
def test_jaccard_counts_every_link(spark, rows, monkeypatch, tile):
    """Links within components, too: near copies of one text, exact copies among them."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    random.seed(13)
    data = list(rows)
    for i in range(1000, 1060):
        w = [f"m{k}" for k in range(60)]
        for k in random.sample(range(60), random.choice([0, 1, 1, 2])):
            w[k] = f"v{random.randrange(3)}"
        data.append((i, " ".join(w), "en"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"], r["n_links"]) for r in jaccard.similar_documents(make(spark, data)).collect()}
    sets = {i: frozenset(brute.shingle_set(t)) for i, t, _ in data}
    components, kinds = brute.jaccard_components([(i, t) for i, t, _ in data]), set(sets.values())
    links = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in kinds if o != s and o and s) for s in kinds}
    least = {s: min(i for i in sets if sets[i] == s) for s in kinds}
    assert got == {i: (*components[i], least[s] if s else i, links[s]) for i, s in sets.items()}
    assert jaccard.similar_documents(empty(spark)).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    """3,000 near copies, each with one word of its own: links follow from the places of those words."""
    n, words = 3000, [f"m{k}" for k in range(60)]
    data = [(i, " ".join([*words[: i % 60], f"own{i}", *words[i % 60 + 1 :]]), "en") for i in range(n)]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.similar_documents(make(spark, data)).collect()}
    cover = [{s for s in range(56) if s <= p < s + 5} for p in range(60)]
    linked = [[q for q in range(60) if 100 * (c := 56 - len(cover[p] | cover[q])) >= 80 * (112 - c)] for p in range(60)]
    # All links lead to document 0, by way of those that differ at an end.
    assert got == {i: (0, n // 60 * len(linked[i % 60]) - 1) for i in range(n)}


def test_signature_bound_is_above(spark):
    rng = np.random.default_rng(2)
    for n, m, c in ((50, 60, 45), (700, 650, 600), (3, 3, 3), (5000, 4500, 4400)):
        keys = rng.integers(1, 2**63, n + m - c, dtype=np.uint64)
        marks = []
        for own in (keys[:n], keys[n - c :]):
            bits = int(jaccard.signature_bits(np.array([len(own)]))[0])
            b = np.zeros(bits, dtype=bool)
            b[(textops.mix(own) % np.uint64(bits)).astype(np.int64)] = True
            marks.append(np.packbits(b, bitorder="little").tobytes())
        if 100 * c >= 80 * (n + m - c):
            assert jaccard.may_be_similar(*marks, n, m)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 3).select(F.col("id").alias("k"))
    f = sketch.bloom(keys, 1 << 18)
    assert f.maybe(np.arange(0, 5000, 3)).all() and f.maybe(np.arange(10**6, 10**6 + 5000)).mean() < 0.2


def test_pipeline_stages(spark, rows, tmp_path):
    item = "what is the zanzor of quibble frandle?\nthe answer is morb tilk"
    data = rows + [(300, rows[20][1] + " " + item, "en"), (301, "secret = abcdefghij and " + " ".join(VOCAB["en"] * 2), "en")]
    make(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.keep(stage(spark, docs, str(tmp_path)))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "bpe" or docs.columns == columns
        if name == "secrets":
            assert "[assign]" in docs.where("doc_id = 301").first()["text"]
    ids = {i for i, _, _ in data}
    assert {170, 171, 172, 173} <= ids - kept["language"]
    groups = brute.jaccard_components([(i, t) for i, t, _ in data if i in kept["language"]])
    assert kept["near_copy"] == {i for i, (_, c) in groups.items() if i == c}
    assert kept["near_copy"] - kept["benchmark"] == {300} and kept["secrets"] == kept["bpe"] == kept["benchmark"]
    assert docs.count() == len(kept["bpe"])


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; null and repeated ids, one with two texts; extra columns whose names operators use."""
    def stages(frame, folder):
        frame.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        return corpus_pipeline.run(spark, str(folder)).collect()

    columns = "doc_id long, text string, lang string, source string, n_chars long, at int, tile long, rejected boolean"
    (tmp_path / "none").mkdir()
    assert stages(spark.createDataFrame([], columns), tmp_path / "none") == []
    random.seed(19)
    text = lambda: " ".join(random.choice(VOCAB["en"]) for _ in range(40))
    data = [(i, text(), "en", "s", 9, 1, 2, True) for i in range(30)]
    data += [data[3], data[3], (None, text(), "en", "s", 9, 1, 2, True), (7, "zz " + text(), "en", "s", 9, 1, 2, True), (40, None, None, None, None, None, None, None)]
    (tmp_path / "odd").mkdir()
    got = stages(spark.createDataFrame(data, columns), tmp_path / "odd")
    ids = [r["doc_id"] for r in got]
    assert sorted(ids) == sorted(set(ids)) and set(ids) <= set(range(30)) and len(ids) > 25
