import gzip
import io
import random

import pytest

from themeloom.llm import warc as W


def head(n, i, **more):
    return {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{i}>", **more}


BLOCKS = [b"", b"one", b"line\r\n\r\nWARC/1.1\r\nnot a record" * 40, bytes(range(256)) * 3000, "ünï".encode()]
FILE = [W.member(head(0, i), b) for i, b in enumerate(BLOCKS)]


def read(data):
    return [(r.offset, r.block, r.status) for r in W.records(io.BytesIO(data))]


def starts(parts):
    return [sum(map(len, parts[:i])) for i in range(len(parts))]


@pytest.mark.parametrize("chunk", [1, 7, 1000, 1 << 18])
def test_every_chunk_size(monkeypatch, chunk):
    parts = FILE[:3] + FILE[4:] if chunk < 1000 else FILE
    blocks = BLOCKS[:3] + BLOCKS[4:] if chunk < 1000 else BLOCKS
    monkeypatch.setattr(W, "CHUNK", chunk)
    want = [(o, b, "ok") for o, b in zip(starts(parts), blocks, strict=True)]
    assert read(b"".join(parts)) == want
    plain = [gzip.decompress(p) for p in parts]
    assert read(b"".join(plain)) == [(o, b, "ok") for o, b in zip(starts(plain), blocks, strict=True)]
    # all records in one member
    assert [x[1:] for x in read(gzip.compress(b"".join(plain)))] == [(b, "ok") for b in blocks]


def test_truncated_file():
    data = b"".join(FILE)
    for cut in (len(data) - 3, len(data) - len(FILE[4]) - 100):
        got = read(data[:cut])
        whole = sum(e <= cut for e in starts([*FILE, b""])[1:])
        assert [x[1:] for x in got[:whole]] == [(b, "ok") for b in BLOCKS[:whole]]
        assert [x[2] for x in got[whole:]] and all(x[2] in ("truncated", "bad_gzip") for x in got[whole:])


def test_damage_costs_one_record():
    rng = random.Random(0)
    for _ in range(30):
        broken = rng.randrange(1, 4)
        bad = bytearray(FILE[broken])
        at = rng.randrange(12, len(bad) - 1)
        bad[at] ^= 0xFF
        got = read(b"".join([*FILE[:broken], bytes(bad), *FILE[broken + 1 :]]))
        good = [x[1] for x in got if x[2] == "ok"]
        assert good == [b for i, b in enumerate(BLOCKS) if i != broken], (broken, at)
        assert any(x[2] != "ok" for x in got)


def test_framing_and_digests():
    plain = gzip.decompress(FILE[1])
    cases = {
        plain.replace(b"one", b"onE"): "digest_mismatch",
        plain.replace(b"Content-Length: 3", b"Content-Length: 2"): "bad_framing",
        plain.replace(b"Content-Length: 3", b"Content-Length: 400"): "truncated",
        plain.replace(b"Content-Length", b"Content-Size"): "bad_header",
        plain.replace(b"WARC/1.1", b"HTTP/1.1"): "bad_header",
        plain.replace(b"WARC-Block-Digest", b"X-Digest"): "no_digest",
        plain.replace(b"sha1:", b"sha1:A"): "digest_mismatch",
    }
    for data, want in cases.items():
        got = read(gzip.compress(data) + FILE[4])
        assert [x[2] for x in got] == [want, "ok"], want
        assert read(data + b"" if want == "truncated" else data + gzip.decompress(FILE[4]))[0][2] == want
    md5 = plain.replace(b"sha1:", b"md5:").replace(plain.split(b"sha1:")[1].split(b"\r\n")[0], b"f97c5d29941bfb1b2fdab0874906ab82")
    assert read(md5)[0][2] == "ok"


def test_round_trip_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(3)
    got = W.round_trip(pages)
    assert {tuple(r) for r in got.collect()} == {(r.page_id, r.url, r.html, "ok") for r in pages.collect()} and got.count() == pages.count()


@pytest.mark.parametrize("chunk", [1000, 1 << 18])
def test_heads_of_any_length(spark, monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rng = random.Random(1)
    urls = ["http://x/" + "".join(rng.choices("abcdefgh", k=n)) for n in (70_000, 300_000, 2_000_000)]
    data = b"".join(W.member(head(0, i, **{"WARC-Target-URI": u}), b"body") for i, u in enumerate(urls))
    for file in (data, gzip.decompress(data)):
        assert [(r.headers["warc-target-uri"], r.block, r.status) for r in W.records(io.BytesIO(file))] == [(u, b"body", "ok") for u in urls]
    # what is no record isn't taken for a long head
    assert [r.status for r in W.records(io.BytesIO(b"junk" * 100_000))] == ["bad_header"]
    pages = spark.createDataFrame([(i, u, "page") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(map(tuple, W.round_trip(pages).collect())) == [(i, u, "page", "ok") for i, u in enumerate(urls)]


def test_odd_rows(spark, monkeypatch, tmp_path):
    rows = [(1, None, "a", 1), (2, "", None, 1), (None, "http://x/ä", "", 1), (3, "u", "z" * 3_000_000, 1), (3, "u", "same", 1), (3, "u", "same", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int").coalesce(1)
    got = sorted((r.page_id or 0, r.url is None, r.url or "", r.html is None, len(r.html or ""), r.status) for r in W.round_trip(pages).collect())
    assert got == sorted((p or 0, u is None, u or "", h is None, len(h or ""), "ok") for p, u, h, _ in rows)
    assert W.round_trip(pages.limit(0)).count() == 0
    assert W.write_pages(pages, str(tmp_path / "w")) == 6
    assert [f.name for f in (tmp_path / "w").iterdir()] == ["part-000000-0000.warc.gz"]
