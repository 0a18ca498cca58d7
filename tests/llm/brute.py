"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """{doc_id: (size, smallest reachable)} over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated_bytes(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    first, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def unigram_scores(rows, train):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {i: words(t) for i, t in rows}
    c, n_docs = Counter(), 0
    for i, w in tokens.items():
        if train(i):
            c.update(w)
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + (n_docs > 0)
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (len(w) + 1, sum(c[x] > 0 for x in w) + (n_docs > 0), n, sum(log(c[x]) for x in w) + log(n_docs)) for i, w in tokens.items()}


def base_spans(text):
    """The base patterns of the secret scan by a scan of their own."""
    out = []
    i = 0
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    while m := pattern.search(text, i):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
        i = m.end()
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    order = ["assign", "access", "hex"]
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], order.index(x[1]))))
