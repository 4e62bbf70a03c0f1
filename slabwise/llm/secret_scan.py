"""Secret scan with structural confirmation.

Pattern candidates come first; base64 and hex candidates are then decoded, and only those that parse as a key
encoding (DER with consistent nested lengths, an OpenSSH key file) or as a signed token with a JSON header are
reported beside the pattern kinds. Wrapped, escaped and URL-safe forms are joined before they are decoded, and key
numbers have to fit one another. The operator is local to each document: no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import bounded_batches

#: Kinds in report order; the first three are the pattern kinds.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")
BASE = KINDS[:3]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: A line, or lines that a line break, written out or not, ends; the alphabet of either kind.
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}(?:\\r)?(?:\\n|\r?\n)[\t ]*)*[A-Za-z0-9+/_-]{40,}(?:(?:\\r)?(?:\\n|\r?\n)[\t ]*[A-Za-z0-9+/_-]+)?={0,2}")
_BREAK = re.compile(r"\\[rn]|\s+")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
_FENCE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
_HEADER = re.compile(r"[A-Za-z-]+: [^\n]*(?:\n[ \t][^\n]*)*")
#: Object identifiers of password-based encryption, PKCS#5 and PKCS#12.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUN = bytes(ord("h") if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_B64_RUN = bytes(ord("b") if c < 128 and (chr(c).isalnum() or chr(c) in "+/-_") else 32 for c in range(256))


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER items that fill ``data`` exactly; None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n == 0x80 or n > 0x84:
            return None
        if n > 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_key_der(data: bytes) -> bool:
    """Whether bytes are a private or public key: PKCS#1, PKCS#8 (encrypted too), SEC1, DSA or SubjectPublicKeyInfo.
    Numbers have to fit: an RSA modulus is the product of its factors, a DSA value the power that it stands for, and a
    lone pair of numbers an odd modulus of 512 bits or more with a small odd exponent."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (items := der_items(top[0][1])):
        return False
    tags = [t for t, _ in items]
    if tags[:9] == [2] * 9 or tags in ([2] * 6, [2, 2]):
        x = [int.from_bytes(c, "big", signed=True) for t, c in items if t == 2]
        if len(x) == 2:
            return x[0] >= 1 << 511 and x[0] % 2 == 1 and 3 <= x[1] < 1 << 64 and x[1] % 2 == 1
        if len(x) == 6:
            return x[0] == 0 and x[1] >= 1 << 511 and max(x[1:]).bit_length() <= 16_384 and 1 < x[3] < x[1] and x[5] > 0 and pow(x[3], x[5], x[1]) == x[4]
        return x[0] in (0, 1) and x[1] > 1 and min(x[2:6]) > 0 and (x[4] * x[5] == x[1] or x[0] == 1)
    alg = lambda c: bool((x := der_items(c)) and x[0][0] == 6)
    if tags[:3] == [2, 0x30, 4]:
        return alg(items[1][1])
    if tags[:2] == [2, 4] and items[0][1] == b"\x01":
        return 16 <= len(items[1][1]) <= 72
    if tags == [0x30, 4]:
        return alg(items[0][1]) and der_items(items[0][1])[0][1].startswith(_PBE) and len(items[1][1]) >= 16
    return tags == [0x30, 3] and alg(items[0][1])


def is_openssh_key(data: bytes) -> bool:
    """Whether bytes start as an OpenSSH key file whose length-prefixed fields fit."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        at += 4 + n
    return 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def is_signed_token(text: str) -> bool:
    """Whether the first part of a dotted token decodes to a JSON object that names an algorithm."""
    head, body, _ = text.split(".", 2)
    try:
        h = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str)


def _decoded(text: str) -> bytes:
    """Bytes of base64 in either alphabet, line breaks left out."""
    body = _BREAK.sub("", text).rstrip("=").translate({45: 43, 95: 47})
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _fenced(text: str) -> Iterator[tuple[int, int]]:
    """Spans of fenced key texts: what is between the fences decodes to a key, or its headers say that it is
    encrypted."""
    begun = None
    for m in _FENCE.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2]:
            body = text[begun.end() : m.start()].replace("\\r", "").replace("\\n", "\n").replace("\r", "")
            headers = "".join(_HEADER.findall(body))
            data = _decoded(_HEADER.sub("", body))
            encrypted = "Proc-Type: 4,ENCRYPTED" in headers and "DEK-Info: " in headers and len(data) >= 16 and len(data) % 8 == 0
            if encrypted or is_key_der(data) or is_openssh_key(data):
                yield begun.start(), m.end()
            begun = None


def find_secrets(raw: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind order. Cheap byte tests decide which patterns run."""
    if not raw:
        return []
    low, runs = raw.lower(), raw.translate(_B64_RUN)
    named, access = any(n in low for n in _NAMES), b"AKIA" in raw
    hexes, b64 = b"h" * 32 in raw.translate(_HEX_RUN), b"b" * 40 in runs
    token, pem = b"eyJ" in raw, b"-----BEGIN " in raw
    if not (named or access or hexes or b64 or token or pem):
        return []
    text, out = raw.decode("utf-8", "replace"), []
    if named:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if hexes:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if token:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if b64:
        for m in _B64.finditer(text):
            data = _decoded(m[0])
            if is_openssh_key(data):
                out.append(("openssh", *m.span()))
            elif is_key_der(data):
                out.append(("der", *m.span()))
        for m in _HEXKEY.finditer(text):
            if is_key_der(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
                out.append(("der", *m.span()))
    if pem:
        out += [("pem", a, z) for a, z in _fenced(text)]
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings): one row per input row, findings an array of (kind, start, end) in code points.

    Null and empty texts have no findings. Other columns of ``docs`` are not read, whatever their names. Repeated
    rows and ids give repeated results; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    listed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, type=listed)], names=["id", "findings"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, findings {FINDINGS}").withColumnRenamed("id", id_col)


def digest(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per pattern kind, the hash of the pattern spans, and all spans as text."""
    count = lambda k: F.size(F.filter("findings", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("findings", lambda x: x.kind.isin(*BASE))
    return findings.select(id_col, *(count(k) for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))
