"""Secret scans: patterns first, then structural confirmation of encoded candidates.

Base kinds are plain patterns: ``assign``, ``access`` and ``hex``. Structural
kinds are reported only when the decoded bytes parse:

* ``pem``  a PEM private-key block whose body decodes to a private key,
* ``key``  a base64 run that decodes to one,
* ``hexkey``  a hex run that does,
* ``jwt``  a signed token: header and claims are JSON objects, the header
  names an algorithm, and the signature has that algorithm's length.

A private key is DER with exactly nested lengths (PKCS #1, DSA, SEC 1, or PKCS #8
whose inner key parses by its algorithm) or the length-prefixed OpenSSH format.
Encrypted ones count too: a PKCS #8 envelope with its parameters, and a PEM block
with ``Proc-Type`` and ``DEK-Info`` headers whose body is whole cipher blocks.
Public keys and certificates parse but are not secrets. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import split_words, text_slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "hexkey", "jwt")
SPAN = "array<struct<kind:string,start:long,end:long>>"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_ANY = re.compile(rb"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_BASE64 = re.compile(rb"[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_-]{40,}={0,2}")
_PEM_EDGE = re.compile(rb"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_PEM_BODY = re.compile(rb"\s*((?:[A-Za-z-]+:[^\r\n]*\r?\n)*)([A-Za-z0-9+/=\s]*)")
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
#: Every pattern but assignments and PEM blocks lies within a word of this many bytes.
LONG_WORD = 20
#: Signature bytes of the signed-token algorithms; RSA ones depend on the key.
_SIGNATURES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}


def _from_base64(raw: bytes) -> bytes | None:
    raw = raw.translate(bytes.maketrans(b"-_", b"+/"), b" \t\r\n\x0b\x0c").rstrip(b"=")
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, lo: int = 0, hi: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the values that fill ``data[lo:hi]`` exactly; None if lengths don't nest."""
    hi, out = len(data) if hi is None else hi, []
    while lo < hi:
        if hi - lo < 2:
            return None
        tag, n = data[lo], data[lo + 1]
        lo += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or lo + width > hi:
                return None
            n = int.from_bytes(data[lo : lo + width], "big")
            lo += width
            if n < 0x80 or n >> 8 * (width - 1) == 0:
                return None  # DER takes the shortest form
        if lo + n > hi:
            return None
        out.append((tag, lo, lo + n))
        lo += n
    return out


def is_private_key(data: bytes | None) -> bool:
    """Whether the bytes are one private key in a known encoding, to the last byte."""
    if not data or len(data) < 24:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return _is_openssh(data)
    outer = der_items(data) if data[0] == 0x30 else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(data, outer[0][1], outer[0][2])
    if not items or items[0][0] != 0x02:
        return False
    tags, version = [t for t, _, _ in items], data[items[0][1] : items[0][2]]
    size = lambda i: items[i][2] - items[i][1]
    if tags[:9] == [0x02] * 9 and tags[9:] in ([], [0x30]) and version in (b"\0", b"\1"):
        return size(1) >= 32  # PKCS #1: modulus, exponents, primes
    if tags == [0x02] * 6 and version == b"\0":
        return size(1) >= 64 and size(2) >= 20 and size(5) >= 16  # DSA: p, q, g, public and private number
    if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1") and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return _is_inner_key(data, items[1], data[items[2][1] : items[2][2]])
    if tags[:2] == [0x02, 0x04] and version == b"\1":
        return items[1][2] - items[1][1] in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1
    return False


#: Algorithm identifiers of PKCS #8 keys, and of password-based encryption.
_RSA, _DSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
_RAW_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _is_inner_key(data: bytes, identifier: tuple[int, int, int], key: bytes) -> bool:
    """PKCS #8: the key inside must parse as its algorithm's."""
    algorithm = der_items(data, identifier[1], identifier[2])
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    name, inner = data[algorithm[0][1] : algorithm[0][2]], der_items(key)
    if not inner or len(inner) != 1:
        return False
    tag, lo, hi = inner[0]
    if name in _RAW_KEYS:
        return tag == 0x04 and hi - lo == _RAW_KEYS[name]
    if name == _DSA:
        return tag == 0x02 and hi - lo >= 16
    return name in (_RSA, _EC) and tag == 0x30 and is_private_key(key)


def is_encrypted_key(data: bytes | None) -> bool:
    """Whether the bytes are an encrypted PKCS #8 envelope: password-based algorithm with parameters, then ciphertext."""
    outer = der_items(data) if data and data[0] == 0x30 else None
    items = der_items(data, outer[0][1], outer[0][2]) if outer and len(outer) == 1 else None
    if not items or [t for t, _, _ in items] != [0x30, 0x04]:
        return False
    algorithm = der_items(data, items[0][1], items[0][2])
    if not algorithm or [t for t, _, _ in algorithm] != [0x06, 0x30]:
        return False
    parameters = der_items(data, algorithm[1][1], algorithm[1][2])
    return data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_BASED) and bool(parameters) and items[1][2] - items[1][1] >= 16


def pem_blocks(raw: bytes, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Private-key blocks of ``raw[lo:hi]`` whose body is a key; each line is looked at once."""
    began, kind, body = 0, b"", -1
    for m in _PEM_EDGE.finditer(raw, lo, hi):
        if m[1] == b"BEGIN":
            began, kind, body = m.start(), m[2], m.end()
        elif body >= 0:
            if m[2] == kind and _is_pem_key(raw[body : m.start()]):
                yield began, m.end()
            body = -1


def _is_pem_key(body: bytes) -> bool:
    m = _PEM_BODY.fullmatch(body)
    data = _from_base64(m[2]) if m else None
    if not data:
        return False
    if b"Proc-Type:" in m[1] and b"ENCRYPTED" in m[1]:
        return b"DEK-Info:" in m[1] and len(data) >= 32 and len(data) % 8 == 0
    return is_private_key(data) or is_encrypted_key(data)


def _is_openssh(data: bytes) -> bool:
    at = 15

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):  # cipher, derivation, its options
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys)) and field() is not None and at == len(data)


def is_signed_token(header: bytes, claims: bytes, signature: bytes) -> bool:
    """Whether three base64url parts make a signed token."""
    try:
        head, body = (json.loads(_from_base64(x) or b"") for x in (header, claims))
    except ValueError:
        return False
    made = _from_base64(signature)
    if not isinstance(head, dict) or not isinstance(body, dict) or made is None:
        return False
    name = head.get("alg")
    if not isinstance(name, str):
        return False
    return len(made) in _SIGNATURES[name] if name in _SIGNATURES else name[:2] in ("RS", "PS") and len(made) >= 128


def _is_key(data: bytes | None) -> bool:
    return is_private_key(data) or is_encrypted_key(data)


def _in_word(word: bytes) -> Iterator[tuple[str, int, int]]:
    for m in _ACCESS.finditer(word):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(word):
        if m.end() - m.start() >= 24:
            yield "hex", m.start(), m.end()
    for m in _HEX_ANY.finditer(word):
        if (m.end() - m.start()) % 2 == 0 and _is_key(bytes.fromhex(m[0].decode())):
            yield "hexkey", m.start(), m.end()
    if len(word) >= 40:
        for m in _BASE64.finditer(word):
            if _is_key(_from_base64(m[0])):
                yield "key", m.start(), m.end()
        for m in _JWT.finditer(word):
            if is_signed_token(*m.groups()):
                yield "jwt", m.start(), m.end()


def spans_of_texts(column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start and then kind."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    for first, last, data, offsets in text_slices(column):
        words = split_words(data, offsets)
        long = np.flatnonzero(words.end - words.start >= LONG_WORD)
        owner = np.searchsorted(offsets, words.start[long], "right") - 1
        raw, lead = data.tobytes(), None
        low = raw.lower()
        hits = {}
        for w, doc in zip(long.tolist(), owner.tolist(), strict=True):
            lo = int(words.start[w])
            found = [(k, lo + s, lo + e) for k, s, e in _in_word(raw[lo : int(words.end[w])])]
            if found:
                hits.setdefault(doc, []).extend(found)
        for doc in range(last - first):
            lo, hi = int(offsets[doc]), int(offsets[doc + 1])
            if any(low.find(k, lo, hi) >= 0 for k in _KEYWORDS):
                hits.setdefault(doc, []).extend(("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw, lo, hi) if m.end(2) - m.start(2) >= 6)
            if raw.find(b"-----BEGIN ", lo, hi) >= 0:
                hits.setdefault(doc, []).extend(("pem", s, e) for s, e in pem_blocks(raw, lo, hi))
        for doc, found in hits.items():
            if lead is None:
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = lead[int(offsets[doc])]
            out[first + doc] = sorted(((k, int(lead[s] - base), int(lead[e] - base)) for k, s, e in found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array of ``(kind, start, end)`` spans, by start and then kind.

    A null or empty text has none. Rows are handled one by one, so repeated
    rows, null ids and extra columns need no rule; a column named like ``into``
    is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of_texts(batch.column(kept.index(text_col)))
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*kept, into])

    return docs.select(*kept).mapInArrow(run, f"{fields}, `{into}` {SPAN}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and list of each document's spans; a null or empty text has none.

    Every row is handled by itself, null ids and repeated rows included; other
    columns are not read, so their names don't matter.
    """
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), text_col), text_col).drop(text_col)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``.

    A null text stays null; all other columns stay as they are. Every text is
    cut and joined once, however many spans it has.
    """
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = columns.index(text_col)
        for batch in batches:
            spans = spans_of_texts(batch.column(place))
            if any(spans):
                texts = [clean(t, found) if found else t for t, found in zip(batch.column(place).to_pylist(), spans, strict=True)]
                batch = batch.set_column(place, text_col, pa.array(texts, batch.column(place).type))
            yield batch

    return docs.mapInArrow(run, fields)
