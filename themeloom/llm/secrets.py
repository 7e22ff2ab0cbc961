"""Secret scans with structural confirmation.

Expressions only propose. A candidate is reported when what it encodes has the
structure of a secret: base64 or hex is decoded, DER lengths must nest exactly,
OpenSSH keys must parse field by field, a token's header must be JSON that names
an algorithm, and checksums that a token carries must hold. A plain random key
has no inner structure; it counts when it is assigned to a name that says so,
decodes to a key's number of bytes and those bytes are as spread as random ones.

Null and empty texts have no findings; very long ones are searched whole. Where
findings overlap, the longest is reported, and of equally long ones the first
kind in ``KINDS``. Repeated rows are reported as often as they occur. Other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import disjoint, whole

KINDS = ("private_key", "signed_token", "checksummed_token", "access_key_id", "encoded_key", "assigned_key")

#: What any candidate must contain, for the scan that most texts end with; RE2 syntax. Each expression below has a part here that
#: finds at least as much: no edges are asked for, what lies between name and value may be anything that no value has, and İ and ı
#: count as an i, as in Python.
HINT = (
    r"-----BEGIN|[A-Za-z0-9+/_-]{32}|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16}|gh[pousr]_|(?:AKIA|ASIA)[A-Z2-7]{16}"
    r"|(?i:password|passwd|pwd|secret|token|ap[iİı][_-]?key|access[_-]?key|auth|credent[iİı]al|pr[iİı]vate[_-]?key)(?i:[_-][a-z0-9İı]+)*[^A-Za-z0-9+/_-]{0,5}[:=][^A-Za-z0-9+/_-]{0,6}[A-Za-z0-9+/_-]{16}"
)

#: A header line may not hold the next beginning, so that no part of a text is searched more than once or twice.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*+((?:[A-Za-z-]+: (?:(?!-----BEGIN)[^\n])*+\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
CHECKED = re.compile(r"(?<![A-Za-z0-9_])(gh[pousr])_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
#: What is assigned, with the sign before it; the name is looked for backwards from the sign, as a name of many parts would else be searched once for each part.
VALUE = re.compile(r"(?:=>|:=|[:=])(?=\s{0,4}[\"']?([A-Za-z0-9+/_-]{16,}+={0,2}+)(?![A-Za-z0-9+/=_-]))")
NAME = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)(?=[_-]|$)")
_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789İıſK_-")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
KEY_BYTES = frozenset((8, 9, 10, 12, 16, 20, 24, 30, 32, 40, 48, 64))


def decode64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, white space ignored; None if it isn't base64."""
    text = re.sub(r"\s", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item; None unless the lengths fill the data exactly."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data) or data[i] == 0:
                return None
            n = int.from_bytes(data[i : i + k])
            if n < 0x80:
                return None
            i += k
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def der_key(data: bytes) -> str | None:
    """The encoding, if the data is one private key in DER."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    items = der_items(top[0][1])
    if not items:
        return None
    tags = [tag for tag, _ in items]
    if tags[:3] == [0x02, 0x30, 0x04] and items[0][1] in (b"\0", b"\1"):
        inner = der_items(items[1][1])
        return "pkcs8" if inner and inner[0][0] == 0x06 else None
    if tags == [0x02] * 9 and items[0][1] in (b"\0", b"\1"):
        return "pkcs1"
    if tags == [0x02] * 6 and items[0][1] == b"\0":
        return "dsa"
    if tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1"
    if tags == [0x30, 0x04]:
        inner = der_items(items[0][1])
        return "encrypted_pkcs8" if inner and inner[0][0] == 0x06 else None
    return None


def ssh_key(data: bytes) -> str | None:
    """openssh, if the data is a private key in OpenSSH's format, to the last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    i, fields = len(magic), []

    def field() -> bytes | None:
        nonlocal i
        n = int.from_bytes(data[i : i + 4])
        if i + 4 + n > len(data):
            return None
        i += 4 + n
        return data[i - n : i]

    for _ in range(3):
        if (x := field()) is None:
            return None
        fields.append(x)
    keys = int.from_bytes(data[i : i + 4])
    i += 4
    if not 1 <= keys <= 16 or any(field() is None for _ in range(keys + 1)) or i != len(data):
        return None
    return "openssh"


def signed_header(head: str, body: str) -> str | None:
    """The algorithm that a signed token's header names, if header and payload decode to what they must be."""
    data, payload = decode64(head), decode64(body)
    if data is None or payload is None:
        return None
    try:
        header = json.loads(data)
        json.loads(payload)
    except ValueError:
        return None
    return header["alg"] if isinstance(header, dict) and isinstance(header.get("alg"), str) else None


def random_bytes(data: bytes) -> bool:
    """Whether bytes are as varied as those of a random key: few repeats, and no run of text or counting."""
    if len(set(data)) < 0.75 * len(data) * (1 - len(data) / 512):
        return False
    steps = [(b - a) % 256 for a, b in zip(data, data[1:], strict=False)]
    return max(map(steps.count, set(steps)), default=0) <= max(2, len(steps) // 4)


def _assigned(value: str) -> str | None:
    """The encoding of a value that may be a key."""
    if HEX.fullmatch(value):
        if len(value) % 2 == 0 and len(value) // 2 in KEY_BYTES and random_bytes(bytes.fromhex(value)):
            return f"hex{len(value) * 4}"
        return None
    mixed = sum(any(c in part for c in value) for part in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
    data = decode64(value) if mixed == 3 else None
    return f"base64_{len(data) * 8}" if data and len(data) >= 12 and random_bytes(data) else None


def _named(text: str, sign: int) -> bool:
    """Whether the name before a sign has a part that says it is secret, with single separators and whole parts after it."""
    end = sign
    while sign - end < 4 and end and text[end - 1].isspace():
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    begin = end
    while begin and text[begin - 1] in _PART:
        # what follows the part must be single separators and whole parts
        if text[begin - 1] in "_-" and (begin == end or text[begin] in "_-"):
            break
        begin -= 1
    return NAME.search(text, begin, end) is not None


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, detail`` of every confirmed secret, in order and apart."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    for m in PEM.finditer(text):
        data = decode64(m[3])
        detail = data and (ssh_key(data) if m[1] == "OPENSSH PRIVATE KEY" else der_key(data))
        if not detail and data and "ENCRYPTED" in m[2] and len(data) % 8 == 0:
            detail = "encrypted_pem"
        if detail:
            found.append((m.start(), m.end(), "private_key", detail))
    for m in TOKEN.finditer(text):
        if detail := signed_header(m[1], m[2]):
            found.append((m.start(), m.end(), "signed_token", detail))
    for m in CHECKED.finditer(text):
        # the last six characters are the CRC-32 of the thirty before, in base 62
        want = 0
        for c in m[3]:
            want = want * 62 + _BASE62[c]
        if zlib.crc32(m[2].encode()) == want:
            found.append((m.start(), m.end(), "checksummed_token", m[1]))
    for m in ACCESS.finditer(text):
        # sixteen base-32 characters hold ten bytes, the account among them
        if int.from_bytes(base64.b32decode(m[1])[:6]) >> 7 & ((1 << 40) - 1) < 10**12:
            found.append((m.start(), m.end(), "access_key_id", m[0][:4]))
    for m in RUN.finditer(text):
        data = bytes.fromhex(m[0]) if HEX.fullmatch(m[0]) and len(m[0]) % 2 == 0 else decode64(m[0])
        if data and (detail := der_key(data) or ssh_key(data)):
            found.append((m.start(), m.end(), "encoded_key", detail))
    for m in VALUE.finditer(text):
        if _named(text, m.start()) and (detail := _assigned(m[1])):
            found.append((m.start(1), m.end(1), "assigned_key", detail))
    found.sort(key=lambda x: (x[0] - x[1], KINDS.index(x[2]), x[0]))
    return disjoint(found)


def hinted(texts: pa.Array) -> pa.Array:
    """Which texts may hold a candidate."""
    return pc.fill_null(pc.match_substring_regex(texts, HINT), False)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("detail", pa.string()), ("sha256", pa.string())])
    for batch in batches:
        rows = batch.filter(hinted(batch.column(1)))
        found = [(doc, start, end, kind, detail, hashlib.sha256(text[start:end].encode()).hexdigest()) for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for start, end, kind, detail in find(text)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, kind, detail, sha256`` of every confirmed secret; positions are in characters, and the secret itself is given as a digest only."""
    return docs.select(whole("doc_id"), "text").mapInArrow(_scan_batches, "doc_id long, start int, end int, kind string, detail string, sha256 string")


def redact(text: str) -> str:
    """The text with ``[kind]`` in place of every confirmed secret."""
    out, at = [], 0
    for start, end, kind, _ in find(text):
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced, same columns; where there is an ``n_chars``, it is that of the new text."""
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            hit = hinted(texts).to_numpy(zero_copy_only=False).nonzero()[0]
            new = {i: y for i, x in zip(hit.tolist(), texts.take(pa.array(hit)).to_pylist(), strict=True) if (y := redact(x)) != x}
            if new:
                mask = pa.array([i in new for i in range(len(texts))])
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(texts, mask, pa.array(list(new.values()), texts.type))
                if count is not None:
                    columns[count] = pc.replace_with_mask(columns[count], mask, pa.array([len(x) for x in new.values()]).cast(columns[count].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
