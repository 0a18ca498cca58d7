"""Secret scan by structural confirmation.

Three base patterns (assigned values, access key ids, long hex runs) are reported as they stand.
Further candidates are reported only after their structure has been confirmed: base64 and hex runs
are decoded and parsed as DER key encodings (nested lengths must fill each other exactly), as
length-prefixed key blobs, or as signed tokens whose header is a JSON object naming an algorithm.

A key may begin at any character of a run, so at any alignment, and go on over line ends.  It is tried
wherever the characters decode to the first bytes that its structure demands (a sequence's tag and
length; the zero bytes before a short field; the magic of a key file); its own lengths say where it
ends.  Every three parts joined by dots are tried as a signed token.

Defined results: a null or empty text has no spans; several rows with one doc_id and repeated rows are
scanned one by one, as is a null id; an empty table gives none; extra columns, whatever their names, are
not read; spans that begin together stand in the order of KINDS.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Base patterns: (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Where a run decodes to 0x30 and a length below 0x80 or of one to four bytes; in hex, too.
_DER = {"base64": re.compile(r"M(?=[A-I][A-Za-z0-9+/]{2})"), "hex": re.compile(r"3(?=0(?:[0-7][0-9A-Fa-f]|8[1-4]))")}
#: Where it decodes to a field length below 256, or to the magic openssh-key-v1 and a zero byte.
_BLOB = {"base64": re.compile(r"AAAA(?=[A-Za-z0-9+/])|b3BlbnNzaC1rZXktdjEA"), "hex": re.compile(r"(?i)000000(?=[0-9a-f]{2})|6f70656e7373682d6b65792d763100")}
_RUN = {"base64": re.compile(r"[A-Za-z0-9+/]+"), "hex": re.compile(r"[0-9A-Fa-f]+")}
_PADDING = re.compile(r"={1,2}")
_WRAP = re.compile(r"[ \t]*\r?\n[ \t]*")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
#: Order of the kinds where spans begin together.
KINDS = ("assign", "access", "hex", "der", "blob", "signed", "armour")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Deepest nesting that a key encoding is followed to.
MAX_DEPTH = 12


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER item at ``at``; None if it does not fit."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + more], "big")
        at += more
        if n < 0x80:
            return None  # not the shortest form
    return (tag, at, at + n) if at + n <= end else None


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the items that fill data[at:end] exactly, nested sequences checked; None otherwise."""
    tags = []
    while at < end:
        item = der_item(data, at, end)
        if item is None or depth > MAX_DEPTH:
            return None
        tag, start, stop = item
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            if der_items(data, start, stop, depth + 1) is None:
                return None
        elif tag not in (0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x80, 0x81):
            return None
        tags.append(tag)
        at = stop
    return tags


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the data (but for base64 padding) and begins as key encodings do."""
    item = der_item(data, 0, len(data)) if data[:1] == b"\x30" else None
    if item is None or item[2] != len(data):
        return False
    tags = der_items(data, item[1], item[2])
    if not tags:
        return False
    return tags[:2] == [0x02, 0x30] or tags[:2] == [0x30, 0x03] or tags[:2] == [0x02, 0x04] or (len(tags) >= 3 and set(tags) == {0x02})


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields that fill the data exactly, the first of which names a key kind."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        n = int.from_bytes(data[:4], "big")
        return len(data) >= 4 and 0 < n <= 64 and data[4 : 4 + n].isascii()
    at, fields = 0, 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if n > len(data) - at - 4:
            return False
        if fields == 0 and not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{2,60}", data[4 : 4 + n]):
            return False
        at, fields = at + 4 + n, fields + 1
    return fields >= 2 and at == len(data)


#: A field of 5 to 64 bytes that names a key kind.
_FIRST_FIELD = re.compile(rb"\0\0\0[\x05-\x40](ssh|ecdsa|sk)-")


def _decoded(run: str, urlsafe: bool = False) -> bytes:
    run = run.rstrip("=")
    run = run[: len(run) - (len(run) % 4 == 1)]
    run += "=" * (-len(run) % 4)
    return (base64.urlsafe_b64decode if urlsafe else base64.b64decode)(run)


def is_signed_token(token: str) -> bool:
    """Header and claims are JSON objects and the header names its algorithm."""
    head, body, _ = token.split(".", 2)
    try:
        if not (raw := _decoded(head, True)).lstrip().startswith(b"{"):
            return False
        header, claims = json.loads(raw), json.loads(_decoded(body, True))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def taken(text: str, at: int, most: int | None, code: str) -> tuple[str, int]:
    """(``most`` characters of the run that begins at ``at``, line ends within it left out; the place behind them)."""
    parts, size = [], 0
    while m := _RUN[code].match(text, at, len(text) if most is None else at + most - size):
        parts.append(m[0])
        size, at = size + len(m[0]), m.end()
        wrap = None if size == most else _WRAP.match(text, at)
        if wrap is None or not _RUN[code].match(text, wrap.end(), wrap.end() + 1):
            break
        at = wrap.end()
    return "".join(parts), at


def _bytes(run: str, code: str) -> bytes:
    return _decoded(run) if code == "base64" else bytes.fromhex(run[: len(run) // 2 * 2])


def der_at(text: str, at: int, code: str) -> int | None:
    """The place behind the DER key that begins at a character; None if there is none."""
    head = _bytes(taken(text, at, 12, code)[0], code)
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    chars = 2 * size if code == "hex" else -(-4 * size // 3)
    if at + chars > len(text):
        return None
    run, end = taken(text, at, chars, code)
    if len(run) < chars or not is_der_key(_bytes(run, code)[:size]):
        return None
    return m.end() if code == "base64" and chars % 4 and (m := _PADDING.match(text, end)) else end


def blob_at(text: str, at: int, code: str) -> int | None:
    """The place behind the key blob that begins at a character and fills its run; None if there is none."""
    head = _bytes(taken(text, at, 120 if code == "base64" else 180, code)[0], code)
    if not head.startswith(b"openssh-key-v1\0") and not _FIRST_FIELD.match(head):
        return None
    run, end = taken(text, at, None, code)
    if not is_key_blob(_bytes(run, code)):
        return None
    return m.end() if code == "base64" and (m := _PADDING.match(text, end)) else end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping for each kind."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose structure has been confirmed."""
    found = []
    for kind, starts, ends_at in (("der", _DER, der_at), ("blob", _BLOB, blob_at)):
        for code, pattern in starts.items():
            done = 0
            for m in pattern.finditer(text):
                if m.start() >= done and (end := ends_at(text, m.start(), code)):
                    found.append((m.start(), end, kind))
                    done = end
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(len(parts) - 2):
            token = ".".join(parts[k : k + 3])
            if parts[k] and parts[k + 1] and is_signed_token(token):
                found.append((at, at + len(token), "signed"))
            at += len(parts[k]) + 1
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            body = "".join(m[2].split())
            try:
                data = _decoded(body)
            except ValueError:
                continue
            if is_der_key(data) or is_key_blob(data):
                found = [f for f in found if f[0] < m.start() or f[1] > m.end()]
                found.append((m.start(), m.end(), "armour"))
    return found


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are joined."""
    out, at = [], 0
    for start, end, kind in in_order(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, number of spans by base kind, all spans and the redacted text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base = in_order(base_spans(text or ""))
            spans = in_order(base + confirmed_spans(text or ""))
            kinds = [s[2] for s in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), text if not spans else redact(text, spans)))
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, *(pa.array([r[i] for r in rows], pa.string()) for i in (3, 4, 5))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    source = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return common.map_texts(source, work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def redacted(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The table with the secrets of each text replaced by their kind; null texts stay null."""

    def run(batches):
        for batch in (piece for whole in batches for piece in common.pieces(whole, text_column)):
            at = batch.schema.get_field_index(text_column)
            texts = [t and redact(t, base_spans(t) + confirmed_spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_secret_scan over every whole text of ``documents``."""
    return scan(common.table(spark, sf_dir, "documents")).drop("redacted")
