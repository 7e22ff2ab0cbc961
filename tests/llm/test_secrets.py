import base64
import json
import random
import re
import string
import zlib

import pytest

from themeloom.llm import secrets as S

rng = random.Random(3)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k)
    return bytes([tag]) + size + body


def number(bits):
    return der(0x02, b"\0" + rng.getrandbits(bits).to_bytes(bits // 8))


PKCS1 = der(0x30, der(0x02, b"\0"), *[number(b) for b in (1024, 24, 1024, 512, 512, 512, 512, 512)])
PKCS8 = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48"), der(0x05)), der(0x04, PKCS1))
SEC1 = der(0x30, der(0x02, b"\1"), der(0x04, rng.randbytes(32)), der(0xA0, der(0x06, b"\x2a\x86\x48")))
field = lambda x: len(x).to_bytes(4) + x
SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(b"k" * 51) + field(rng.randbytes(136))
url64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
JWT = ".".join([url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(b'{"sub":"1"}'), url64(rng.randbytes(32))])


def pem(name, data):
    return f"-----BEGIN {name}-----\n" + "\n".join(base64.b64encode(data).decode()[i : i + 64] for i in range(0, 4 * len(data), 64)) + f"\n-----END {name}-----"


def checked():
    body = "".join(rng.choices(string.ascii_letters + string.digits, k=30))
    crc, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        tail = (string.digits + string.ascii_uppercase + string.ascii_lowercase)[r] + tail
    return "ghp_" + body + tail


@pytest.mark.parametrize(
    ("secret", "kind", "detail"),
    [
        (pem("RSA PRIVATE KEY", PKCS1), "private_key", "pkcs1"),
        (pem("PRIVATE KEY", PKCS8), "private_key", "pkcs8"),
        (pem("EC PRIVATE KEY", SEC1), "private_key", "sec1"),
        (pem("OPENSSH PRIVATE KEY", SSH), "private_key", "openssh"),
        (JWT, "signed_token", "HS256"),
        (checked(), "checksummed_token", "ghp"),
        (base64.b64encode(SEC1).decode(), "encoded_key", "sec1"),
        (SEC1.hex(), "encoded_key", "sec1"),
    ],
)
def test_confirmed(secret, kind, detail):
    text = f"Ä before\n{secret} after"
    assert S.find(text) == [(9, 9 + len(secret), kind, detail)]
    assert S.redact(text) == f"Ä before\n[{kind}] after"


def test_broken_structure_is_not_reported():
    cut = PKCS1[:-1]
    wrong = checked()
    wrong = wrong[:-1] + ("0" if wrong[-1] != "0" else "1")
    for text in (pem("RSA PRIVATE KEY", cut), pem("PRIVATE KEY", PKCS1 + b"\0"), pem("OPENSSH PRIVATE KEY", SSH[:-3]), "x." + JWT[2:], wrong, "a" * 64, rng.randbytes(40).hex()):
        assert S.find(text) == [], text


def test_assigned_keys():
    key = rng.randbytes(20).hex()
    assert S.find(f'token = "{key}" x') == [(9, 49, "assigned_key", "hex160")]
    assert S.find(f"AWS_SECRET_KEY: {base64.b64encode(rng.randbytes(30)).decode()}")[0][2] == "assigned_key"
    for text in (f'checksum = "{key}"', "token = " + "0123456789abcdef" * 2, "secret: themanwhowalkedalone", "token = " + "ab" * 20, f"token = {key}a"):
        assert S.find(text) == [], text


def test_every_token_of_the_table_is_found_and_nothing_else(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = {(r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'(?i)(?:token = "|password=)([0-9a-f]{40}|[0-9a-f]{20})(?![0-9a-f])', r.text)}
    got = {(r.doc_id, r.start, r.end) for r in S.scan(docs).collect()}
    assert len(want) > 100 and got == want


def brute(text):
    """Every confirmed secret of a text, by trying what lies between characters that a candidate can't have."""
    out = []
    runs = lambda chars: [(m.start(), m.end()) for m in re.finditer(f"[{chars}]+", text)]
    at = text.find("-----BEGIN ")
    while at >= 0:
        close = text.find("-----", at + 11)
        name = text[at + 11 : close]
        last = text.find(f"-----END {name}-----", close)
        if close > 0 and last > 0 and name.endswith("PRIVATE KEY"):
            data = S.decode64(text[close + 5 : last])
            if data and (kind := S.ssh_key(data) if "OPENSSH" in name else S.der_key(data)):
                out.append((at, last + len(f"-----END {name}-----"), "private_key", kind))
        at = text.find("-----BEGIN ", at + 1)
    for i, j in runs("A-Za-z0-9_.-"):
        parts, edge = text[i:j].split("."), i
        for k, part in enumerate(parts):
            if len(parts) >= k + 3 and len(part) >= 8 and len(parts[k + 1]) >= 2 and len(parts[k + 2]) >= 16 and (alg := S.signed_header(part, parts[k + 1])):
                out.append((edge, edge + sum(map(len, parts[k : k + 3])) + 2, "signed_token", alg))
            edge += len(part) + 1
    for i, j in runs("A-Za-z0-9+/_-"):
        data = bytes.fromhex(text[i:j]) if S.HEX.fullmatch(text[i:j]) and (j - i) % 2 == 0 else S.decode64(text[i:j])
        pad = next(k for k in range(3) if k == 2 or text[j + k : j + k + 1] != "=")
        if j - i >= 32 and text[j + pad : j + pad + 1] != "=" and data and (kind := S.der_key(data) or S.ssh_key(data)):
            out.append((i, j + pad, "encoded_key", kind))
        before = text[max(0, i - 200) : i]
        name = re.search(r"""(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)(?:[_-][a-z0-9]+)*["']?\s{0,4}(?:=>|:=|[:=])\s{0,4}["']?$""", before)
        if j - i >= 16 and name and (kind := S._assigned(text[i : j + pad])):
            out.append((i, j + pad, "assigned_key", kind))
    for i, j in runs("A-Za-z0-9_"):
        word = text[i:j]
        if len(word) == 40 and word[:4] in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
            value = 0
            for c in word[34:]:
                value = value * 62 + (string.digits + string.ascii_uppercase + string.ascii_lowercase).index(c)
            if value == zlib.crc32(word[4:34].encode()):
                out.append((i, j, "checksummed_token", word[:3]))
    out.sort(key=lambda x: (x[0] - x[1], S.KINDS.index(x[2]), x[0]))
    kept = []
    for x in out:
        if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


def test_scan_equals_brute_force(spark):
    """The whole table and texts with a secret of each kind put into them, without the hint."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    planted = [pem("RSA PRIVATE KEY", PKCS1), pem("OPENSSH PRIVATE KEY", SSH), JWT, checked(), base64.b64encode(SEC1).decode(), SEC1.hex(), "my_token_x := '9f86d081884c7d659a2f'", "api-key=" + base64.b64encode(rng.randbytes(24)).decode(), pem("PRIVATE KEY", PKCS8[:-1])]
    for n, text in enumerate([r.text for r in docs][:400]):
        at = rng.randrange(len(text) + 1)
        texts[10**6 + n] = f"{text[:at]} {planted[n % len(planted)]}\n{text[at:]}"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in S.scan(rows).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.kind, r.detail))
    want = {i: found for i, t in texts.items() if (found := brute(t))}
    assert len(want) > 300 and {i: sorted(x) for i, x in got.items()} == want


@pytest.mark.parametrize("shape", ["a-", "token-", "token=", "password_a=", "-----BEGIN PRIVATE KEY-----\nA: ", "-----BEGIN PRIVATE KEY----- ", "a.", "aaaaaaaa.bb.", "_", "x=> ", "token = 9f86d081884c7d659a2f\n", JWT + " "])
def test_long_texts_take_time_in_proportion(shape):
    import time

    began = time.process_time()
    S.find((shape * 400_000)[:400_000])
    assert time.process_time() - began < 8, "a search in the square of this length takes minutes"


def test_odd_rows(spark):
    rows = [(1, None, 5, "a"), (2, "", 5, "b"), (3, f"x {JWT} " * 2, None, None), (3, f"x {JWT} " * 2, None, None), (None, "y " * 400_000 + JWT, 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kind string")
    got = S.scan(docs).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 800_000), (3, 2), (3, 2), (3, 5 + len(JWT)), (3, 5 + len(JWT))]
    clean = S.redacted(docs)
    assert clean.schema == docs.schema
    by = {(r.doc_id, r.text, r.n_chars, r.kind) for r in clean.collect()}
    assert by == {(1, None, 5, "a"), (2, "", 5, "b"), (3, "x [signed_token] " * 2, 34, None), (None, "y " * 400_000 + "[signed_token]", 800_014, "d")}
    assert S.scan(docs.limit(0)).count() == 0 == S.redacted(docs.limit(0)).count()


def test_every_text_with_findings_is_hinted():
    import pyarrow as pa

    key, small = "9f86d081884c7d659a2f", ".".join([url64(b'{"alg":"none"}'), url64(b"{}"), "a" * 16])
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "auth", "credential", "private_key", "private-key", "PrivateKey"]
    texts = [f"{before}{name}{after}{sign}{key}" for before in ("", "my_", "X-") for name in names for after in ("", "_prod", "-a-2", '"') for sign in ("=", ": ", " => '", "\u2003:=\u00a0\t\v \"")]
    texts += ["SECRET_KEY=" + key, "token_prod = " + key, "auth-header:" + key, "cRedent\u0131al=" + key, "pa\u017f\u017fword=" + key, small, f"x {small}.", "a_AKIA" + "A" * 16, checked()]
    assert all(S.find(t) for t in texts)
    assert S.hinted(pa.array([*texts, None])).to_pylist() == [True] * len(texts) + [False]


def test_scan_and_redaction_reach_short_values(spark):
    docs = spark.createDataFrame([(1, "pwd=9f86d081884c7d659a2f"), (2, "SECRET_KEY=9f86d081884c7d659a2f"), (3, "api-key: none")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start) for r in S.scan(docs).collect()) == [(1, 4), (2, 11)]
    assert sorted(r.text for r in S.redacted(docs).collect()) == ["SECRET_KEY=[assigned_key]", "api-key: none", "pwd=[assigned_key]"]
