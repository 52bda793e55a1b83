"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and long hexadecimal runs. Beyond them, armoured blocks, base64 or hexadecimal runs and
dotted tokens are candidates only: each is decoded, and reported if its bytes are the encoding of a private key, all of whose
nested lengths fit exactly, or a signed token, whose header names an algorithm that its signature's length suits.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship

#: Plain kinds, then confirmed ones; spans that start together come in this order.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
BASE_KINDS = KINDS[:3]
SPANS = "array<struct<kind:string,start:long,end:long>>"
# Texts are searched as bytes: every pattern is ASCII, which UTF-8 never uses inside another character.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # of lower-cased bytes
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(.*?)-----END \1PRIVATE KEY-----", re.S)
_WRAPPED = re.compile(rb"(?:\\[nr]|\s)+")
#: A sequence's base64 begins with M and a letter up to I; the other beginning is that of an openssh container.
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:M[A-I]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{30,}")
_LINES = re.compile(rb"(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_HEX_KEY = re.compile(rb"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee])[0-9A-Fa-f]{38,}")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_MAGIC = b"openssh-key-v1\0"
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
# fixed values: bytes of a signature by algorithm
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64, "none": 0}


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that data is made of, or None unless every length is written shortest and all fit exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size - 0x80
            size = int.from_bytes(data[at : at + width], "big")
            if not 1 <= width <= 4 or size < max(0x80, 1 << 8 * (width - 1)):
                return None
            at += width
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _number(element: tuple[int, bytes]) -> int:
    return int.from_bytes(element[1], "big")


def is_key(data: bytes) -> bool:
    """Whether data is a private key: an RSA, DSA or curve key, one of them in its container, an encrypted one, or openssh's."""
    if data.startswith(_MAGIC):
        return _is_openssh(data[len(_MAGIC) :])
    outer = elements(data)
    parts = elements(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == _SEQUENCE else None
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _ in parts]
    if tags[:2] == [_SEQUENCE, _OCTETS] and len(parts) == 2:  # encrypted: an algorithm and its output
        return _names_algorithm(parts[0][1]) and len(parts[1][1]) >= 16
    if tags[0] != _INTEGER or len(parts[0][1]) != 1:
        return False
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:  # a container: version, algorithm, the key's own encoding
        inner = elements(parts[2][1])
        return _number(parts[0]) in (0, 1) and _names_algorithm(parts[1][1]) and bool(inner) and len(inner) == 1 and inner[0][0] in (_SEQUENCE, _OCTETS, _INTEGER)
    if tags[1] == _OCTETS:  # a curve key: version 1, the secret, then curve and point in context tags
        return _number(parts[0]) == 1 and 20 <= len(parts[1][1]) <= 66 and all(tag in (0xA0, 0xA1) and elements(value) for tag, value in parts[2:])
    if any(tag != _INTEGER for tag in tags) or any(not value or value[0] >= 0x80 for _, value in parts):
        return False
    if len(parts) == 9:  # RSA: modulus is the product of the primes
        return _number(parts[0]) == 0 and _number(parts[1]) == _number(parts[4]) * _number(parts[5]) > 1 << 255
    # DSA: version, p, q, g, public, secret
    return len(parts) == 6 and _number(parts[0]) == 0 and _number(parts[1]) > 1 << 511 and _number(parts[2]) > max(1, _number(parts[5])) and (_number(parts[1]) - 1) % _number(parts[2]) == 0


def _names_algorithm(content: bytes) -> bool:
    parts = elements(content)
    return bool(parts) and parts[0][0] == _OID and len(parts[0][1]) >= 3


def _strings(data: bytes, count: int) -> tuple[list[bytes], bytes] | None:
    """`count` strings with lengths of four bytes, and what is left."""
    out = []
    for _ in range(count):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 + size:
            return None
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def _is_openssh(data: bytes) -> bool:
    head = _strings(data, 3)  # cipher, derivation and its options
    if not head or len(head[1]) < 4 or not 1 <= (keys := int.from_bytes(head[1][:4], "big")) <= 64:
        return False
    rest = _strings(head[1][4:], keys + 1)
    if not rest or rest[1] or not rest[0][-1]:
        return False
    kinds = [_strings(blob, 1) for blob in rest[0][:-1]]
    return all(k and re.match(rb"(?:ssh-|ecdsa-sha2-|sk-)", k[0][0]) for k in kinds)


def _decoded(text: bytes) -> bytes | None:
    """The bytes of base64 in either alphabet, with or without padding; None unless the text is whole."""
    plain = _WRAPPED.sub(b"", text).translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + b"=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _object(part: bytes) -> dict | None:
    try:
        found = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(text: bytes) -> bool:
    """Whether text is header.claims.signature: two JSON objects, and a signature as long as the header's algorithm makes it."""
    header, claims, signature = text.split(b".")
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str) or _object(claims) is None:
        return False
    found = _decoded(signature)
    if found is None:
        return False
    if re.fullmatch("[RP]S(?:256|384|512)", head["alg"]):
        return len(found) >= 128 and len(found) % 64 == 0
    return _SIGNATURE.get(head["alg"]) == len(found)


def _key_size(data: bytes) -> int:
    """How many bytes the key that data begins with says it has; data may end before it or go on after it."""
    if not data.startswith(_MAGIC):
        width = max(0, data[1] - 0x80)
        return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
    at = len(_MAGIC)
    strings = lambda at, count: at if not count or at > len(data) else strings(at + 4 + int.from_bytes(data[at : at + 4], "big"), count - 1)
    at = strings(at, 3)
    return strings(at + 4, min(65, int.from_bytes(data[at : at + 4], "big") + 1))


def _first_characters(text: bytes, count: int) -> bytes:
    """The first `count` characters of base64 and their padding, with the line ends between them; text itself if it is shorter."""
    m = re.match(rb"(?:(?:\r?\n)?[A-Za-z0-9+/_-]){%d}={0,2}(?![A-Za-z0-9+/_-])" % count, text) if count <= len(text) else None
    return m[0] if m else text


def byte_spans(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of every secret, in bytes."""
    for m in _ASSIGN.finditer(raw.lower()):  # short ones are dropped after matching: they use up the text that they match
        if m.end(1) - m.start(1) >= 6:
            yield m.start(), m.end(), 0
    if b"AKIA" in raw:
        yield from ((*m.span(), 1) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20)
    yield from ((*m.span(), 2) for m in _HEX.finditer(raw))
    armoured = []
    if b"-----BEGIN " in raw:
        for m in _PEM.finditer(raw):
            locked = b"Proc-Type: 4,ENCRYPTED" in m[2]
            data = _decoded(m[2].rsplit(b"\n\n", 1)[-1] if locked else m[2])
            if data and (is_key(data) or (locked and len(data) >= 48 and len(data) % 8 == 0)):  # an old encrypted key is whole blocks
                armoured.append(m.span())
                yield *m.span(), 3
    for m in _BASE64.finditer(raw):
        if any(a <= m.start() < b for a, b in armoured):
            continue
        whole = raw[m.start() : _LINES.match(raw, m.end()).end()]
        plain = _WRAPPED.sub(b"", whole).rstrip(b"=")  # lengths inside tell how long it is; what follows on other lines may be text
        whole = _first_characters(whole, -(-8 * _key_size(_decoded(plain[: len(plain) // 4 * 4])) // 6))
        data = _decoded(whole)
        if data and is_key(data):
            yield m.start(), m.start() + len(whole), 4
    for m in _HEX_KEY.finditer(raw):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0].decode())):
            yield *m.span(), 4
    if b"eyJ" in raw:
        yield from ((*m.span(), 5) for m in _TOKEN.finditer(raw) if is_token(m[0]))


def spans_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, in code points, in order."""
    found = list(byte_spans(raw))
    if not found:
        return []
    begins = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80  # bytes at which a code point begins
    at, last, count = {}, 0, 0
    for place in sorted({x for span in found for x in span[:2]}):
        count += int(np.count_nonzero(begins[last:place]))
        last, at[place] = place, count
    return sorted((at[a], kind, at[b]) for a, b, kind in found)


def secret_spans(text: pa.Array) -> pa.Array:
    starts, kinds, ends, offsets = [], [], [], [0]
    for value in text:
        for start, kind, end in spans_of(value.as_buffer().to_pybytes()) if value.is_valid else ():
            starts.append(start)
            kinds.append(KINDS[kind])
            ends.append(end)
        offsets.append(len(starts))
    struct = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def find_secrets(docs: DataFrame, output: str = "secrets") -> DataFrame:
    """docs (text, more columns) with an array of (kind, start, end): every secret of the whole text, by start and then kind, in code
    points with the end exclusive.

    Kinds: assign (a named secret of six characters or more), access (AKIA and 16 characters or more), hex (24 digits or more), and the
    confirmed ones: pem (an armoured private key), key (one in bare base64 or hexadecimal), token (a signed token). Spans of different kinds
    may overlap. A null or empty text has none; repeated rows have equal spans; a column of the output's name is replaced, all
    others are kept. Every row stays, nothing is shuffled, and a task holds one text at a time in Python.
    """
    ship(docs.sparkSession)
    return docs.withColumn(output, F.arrow_udf(secret_spans, SPANS)("text"))


def op12_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
