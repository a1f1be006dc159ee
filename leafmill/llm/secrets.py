"""Secret scans with structural confirmation.

Candidates come from patterns; a base64 or hex candidate is reported only after it has
been decoded and what it holds has been parsed: nested lengths that add up (DER and
OpenSSH keys), a known algorithm name, or the JSON header of a signed token. Time is
linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import quoted, small_batches, text_of

#: Kinds in the order in which spans that begin together are listed.
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("private_key", "public_key", "certificate", "ssh_key", "signed_token")
KINDS = BASE_KINDS + METHOD_KINDS

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
_HEADER_LINE = re.compile(r"([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)")
#: Line ends written out, as in JSON and environment strings.
_ESCAPED = re.compile(r"\\+[nr]")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Parts joined by dots, as long as they go on.
_CHAIN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")

_HEX_BYTES = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_BYTES = bytes(98 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for c in range(256))

#: Object identifiers of key algorithms, in DER.
_OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a8648ce3d0201"): "ec", bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b656e"): "x25519", bytes.fromhex("2a8648ce380401"): "dsa",
}
#: How those of password based encryption begin (PKCS #5, PKCS #12).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_SIGNING = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none"}
#: Bytes of an initial vector, by the cipher of a PEM body that is encrypted as a whole.
_PEM_CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
#: Levels of nesting that are followed.
_DEPTH = 12


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int, list | None]] | None:
    """The elements (tag, begin, end, children) that fill data[at:end], or None."""
    out = []
    while at < end:
        if end - at < 2 or depth > _DEPTH:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or n > 1 and not data[at]:
                return None
            at += n
        if at + size > end:
            return None
        kids = _der(data, at, at + size, depth + 1) if tag & 0x20 else None
        if tag & 0x20 and kids is None:
            return None
        out.append((tag, at, at + size, kids))
        at += size
    return out


def _first_oid(data: bytes, nodes: list | None) -> str | None:
    for tag, a, b, kids in nodes or ():
        if tag == 0x06 and data[a:b] in _OIDS:
            return _OIDS[data[a:b]]
        if kids and (found := _first_oid(data, kids)):
            return found
    return None


def _der_kind(data: bytes) -> str | None:
    """private_key, public_key or certificate, if data is just one such structure."""
    if len(data) < 35 or data[0] != 0x30:  # the shortest: SEC 1 of 28 bytes, without parameters
        return None
    top = _der(data, 0, len(data))
    if not top or len(top) != 1:
        return None
    kids = top[0][3] or []
    tags = [k[0] for k in kids]
    if len(kids) >= 9 and all(t == 0x02 for t in tags[:9]):
        return "private_key"  # PKCS #1: version, modulus, exponents, primes
    if len(tags) >= 3 and tags[:3] == [0x02, 0x30, 0x04] and _first_oid(data, kids[1][3]):
        return "private_key"  # PKCS #8
    if tags == [0x30, 0x04] and kids[0][3] and kids[0][3][0][0] == 0x06 and data[kids[0][3][0][1] : kids[0][3][0][2]].startswith(_PBE):
        return "private_key"  # PKCS #8, encrypted
    if len(tags) >= 2 and tags[:2] == [0x02, 0x04] and kids[1][2] - kids[1][1] in (28, 32, 48, 66):
        return "private_key"  # SEC 1
    if len(tags) == 6 and all(t == 0x02 for t in tags):
        return "private_key"  # DSA
    if tags == [0x30, 0x03] and _first_oid(data, kids[0][3]):
        return "public_key"
    if tags == [0x02, 0x02] and kids[0][2] - kids[0][1] >= 64:
        return "public_key"
    if tags == [0x30, 0x30, 0x03] and len(kids[0][3] or ()) >= 6:
        return "certificate"
    return None


def _ssh_parts(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Strings with their lengths before them, up to the end or so many, and where they end."""
    parts: list[bytes] = []
    while at < len(data) if most is None else len(parts) < most:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return parts, at


def _ssh_name(x: bytes) -> bool:
    return x.startswith((b"ssh-", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-"))


def _is_openssh(data: bytes) -> bool:
    """Whether the sections of an OpenSSH private key add up: the parameters, each public key, and
    the private ones, which are whole blocks and, where they aren't encrypted, are read as well."""
    if not (found := _ssh_parts(data, 15, 3)):
        return False
    (cipher, derivation, options), at = found
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= n <= 16 or not (found := _ssh_parts(data, at + 4, n + 1)) or found[1] != len(data):
        return False
    *public, private = found[0]
    names = []
    for key in public:
        parts = _ssh_parts(key)
        if not parts or len(parts[0]) < 2 or not _ssh_name(parts[0][0]):
            return False
        names.append(parts[0][0])
    if cipher != b"none":
        salt = _ssh_parts(options, 0, 1)
        return derivation == b"bcrypt" and salt is not None and salt[1] + 4 == len(options) and len(private) > 0 and len(private) % 8 == 0
    if options or derivation != b"none" or len(private) % 8 or private[:4] != private[4:8]:
        return False
    parts = _ssh_parts(private, 8, 2)
    return parts is not None and parts[0][0] == names[0]


def _structure(data: bytes) -> str | None:
    if kind := _der_kind(data):
        return kind
    if data.startswith(b"openssh-key-v1\0"):
        return "ssh_key" if _is_openssh(data) else None
    if data[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13") and (found := _ssh_parts(data)) and len(found[0]) >= 2:
        return "public_key" if _ssh_name(found[0][0]) else None
    return None


def _pem_kind(label: str, body: str) -> str | None:
    """What the text between two marks proves to be. Header lines end with a blank one."""
    lines = _ESCAPED.sub("\n", body).strip().splitlines()
    head: dict[str, str] = {}
    n = 0
    while n < len(lines) and (m := _HEADER_LINE.fullmatch(lines[n].strip())):
        head[m[1].lower()] = m[2]
        n += 1
    rest = "".join(lines[n:])
    if not _PEM_BODY.fullmatch(rest):
        return None
    for data in _decoded("".join(rest.split())):
        if kind := _structure(data):
            return kind
        if "ENCRYPTED" in head.get("proc-type", "") and label.endswith("PRIVATE KEY"):
            cipher, _, iv = head.get("dek-info", "").partition(",")
            size = _PEM_CIPHERS.get(cipher.strip().upper(), 0)
            if size and re.fullmatch(rf"[0-9A-Fa-f]{{{2 * size}}}", iv.strip()) and data and len(data) % size == 0:
                return "private_key"
    return None


def _decoded(text: str) -> Iterator[bytes]:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return
    padded = body + "=" * (-len(body) % 4)
    try:
        yield base64.urlsafe_b64decode(padded) if "-" in body or "_" in body else base64.b64decode(padded, validate=True)
    except (binascii.Error, ValueError):
        return


def _json(part: str) -> object:
    """What a part of a token holds; ValueError if it isn't JSON."""
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens: three parts of a chain, the first of which holds the JSON header of a
    signature (from an eyJ on, where it begins with anything else), the second JSON."""
    out = []
    for m in _CHAIN.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            skip, used = parts[i].find("eyJ"), 1
            if skip >= 0 and parts[i + 1]:
                try:
                    header = _json(parts[i][skip:])
                    if isinstance(header, dict) and header.get("alg") in _SIGNING:
                        _json(parts[i + 1])
                        out.append((at + skip, at + sum(map(len, parts[i : i + 3])) + 2, "signed_token"))
                        used = 3
                except ValueError:
                    pass
            at += sum(len(p) + 1 for p in parts[i : i + used])
            i += used
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the pattern kinds, by begin, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES) or not low.isascii():
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of what decodes to a structure that proves it a secret or key."""
    out = []
    if "-----BEGIN " in text:
        begun = None  # a mark counts with the very next one, so that every text between is read once
        for m in _PEM_MARK.finditer(text):
            if m[1] == "BEGIN":
                begun = m
            elif begun:
                if begun[2] == m[2] and (kind := _pem_kind(m[2], text[begun.end() : m.start()])):
                    out.append((begun.start(), m.end(), kind))
                begun = None
    begins, ends = [a for a, _, _ in out], [b for _, b, _ in out]
    if "eyJ" in text:
        out += _tokens(text)
    flat = text.encode("utf-8", "replace").translate(_B64_BYTES)
    if b"b" * 40 in flat:
        for m in _BASE64.finditer(text):
            i = bisect_right(begins, m.start()) - 1
            if i >= 0 and m.start() < ends[i]:
                continue
            for data in _decoded(m[0]):
                if kind := _structure(data):
                    out.append((m.start(), m.end(), kind))
        for m in _LONG_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _structure(bytes.fromhex(m[0]))):
                out.append((m.start(), m.end(), kind))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text, by begin, then kind as in KINDS, then end; each once."""
    found = {*base_spans(text), *confirmed_spans(text)}
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, begin, end in code points): one row per row of docs.

    Null and empty texts have no spans. Ids may be null or repeat; no other column is read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    one = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "begin": s, "end": e} for s, e, k in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(one))], ["doc_id", "spans"])

    return rows.mapInArrow(spans, "doc_id long, spans array<struct<kind: string, begin: int, end: int>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["begin"], s["end"], s["kind"]) for s in r] for r in b.column(1).to_pylist()]
            count = {k: pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in BASE_KINDS}
            sha = [hashlib.sha256(listed([s for s in r if s[2] in BASE_KINDS]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), count["assign"], count["access"], count["hex"], pa.array(sha, pa.string()), pa.array([listed(r) for r in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(columns, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
