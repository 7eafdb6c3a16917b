"""Top-k search and WARC derivatives."""

import math
import random

import pytest

from mnemolake.llm import topk, warc

SCHEMA = "vec_id long, embedding array<float>, label int, g int, side int, v string"


def _brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("group_rows", [4096, 7])
def test_top_k(spark, monkeypatch, group_rows):
    monkeypatch.setattr(topk, "GROUP_ROWS", group_rows)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    as32 = lambda v: [float(__import__("numpy").float32(x)) for x in v]
    rows = [(i, as32([c + rng.gauss(0, 0.1) for c in centres[i % 5]])) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, rows[1][1]), (550, [0.0] * 8)]
    frame = spark.createDataFrame([(*r, 0, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == _brute(rows)


def test_top_k_small_tables(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, 0, ""), (1, [1.0], 0, 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 65536)]
    large = spark.createDataFrame([(0, [1e30, 1.0], 0, 0, 0, ""), (1, [1e30, 1.0], 0, 0, 0, ""), (2, [-1e30, 1.0], 0, 0, 0, "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(large).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]  # held at a long's ends


PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><nav><a href="/x?a=1&amp;b=2">go</a></nav><!-- no --><p>One&nbsp;two<br>three &lt;4</p></body></html>'


def test_warc_round_trip(spark):
    pages = [(1, "https://a.example/x", PAGE), (2, None, None), (3, "http://b.example", ""), (None, "u", "x" * 200_000), (1, "https://a.example/x", PAGE)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record string")
    got = warc.page_derivatives(frame, with_record=True).collect()
    assert len(got) == 10 and warc.page_derivatives(frame.limit(0)).count() == 0
    source = warc.response(1, "https://a.example/x", PAGE, "1970-01-01T00:00:00Z")
    metadata, conversion = (next(r for r in got if r.page_id == 1 and r.record_type == t) for t in ("metadata", "conversion"))
    for r in (metadata, conversion):
        parsed = list(warc.parse(bytes(r.record)))
        assert len(parsed) == 1 and parsed[0].block.decode() == r.block and parsed[0].to_bytes() == bytes(r.record)
        assert r.refers_to == source.get("WARC-Record-ID") == parsed[0].get("WARC-Refers-To") and r.target_uri == "https://a.example/x"
        assert parsed[0].get("WARC-Block-Digest") == warc.digest(parsed[0].block) == r.block_digest and int(parsed[0].get("Content-Length")) == len(parsed[0].block)
        assert r.source_payload_digest == warc.digest(PAGE.encode())
    assert conversion.block == "go\nOne two\nthree <4"
    assert {"title: A & B", "language: fr", "outlink: /x?a=1&b=2", "sourceHeader-Content-Type: text/html; charset=utf-8", "sourceStatus: HTTP/1.1 200 OK"} <= set(metadata.block.split("\r\n"))
    assert len({r.record_id for r in got}) == 8  # a repeated row gives equal records
    other = warc.page_derivatives(spark.createDataFrame([(None, "u", "<p>one"), (None, "u", "<p>two")], "page_id long, url string, html string")).collect()
    assert len({r.record_id for r in other}) == 4


def test_top_k_exact_scores(spark):
    """Long vectors, components beyond four bytes, and rows that repeat an id."""
    rows = [(0, [1e6] * 600), (1, [1e6] * 600), (2, [1.0] * 600), (3, [3e9] * 2), (50, [-1e6] * 600), (0, [2.0] * 600), (4, [1e300])]
    frame = spark.createDataFrame([(*r, 0, 1, 2, "x") for r in rows], SCHEMA.replace("array<float>", "array<double>"))
    got = sorted(map(tuple, topk.top_k(frame).collect()))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            score = lambda w: max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63) + 1)  # noqa: E731, B023
            scored = sorted((-score(w), i) for m, (i, w) in enumerate(whole) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_leaves_work_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 64)
    monkeypatch.setattr(topk, "RING_ROWS", 16)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 20]], 0, 1, 2, "x") for i in range(1500)]
    assert topk.visited_share(spark.createDataFrame(rows, SCHEMA)) < 0.5


def test_warc_of_bad_records_and_long_tag_soup():
    import gzip
    import time

    good = warc.response(1, "http://x", "<p>text", "2020-01-01T00:00:00Z").to_bytes()
    assert len(list(warc.parse(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1) + good))) >= 1
    assert len(list(warc.parse(gzip.compress(good) + gzip.compress(good)))) == 2
    for charset in ("idna", "undefined", "no-such", "utf-16", "hex"):
        source = warc.Record([("WARC-Type", "response")], f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>x".encode())
        assert warc.derive(source) is not None
    packed = gzip.compress(b"<p>packed")
    chunked = b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    source = warc.Record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked)
    assert warc.derive(source)[1].block == b"packed"
    assert warc.plain_text("<head><title>t</title><p>one<p>two") == "one\ntwo"
    for soup in ("<a " * 100_000, "<script>" * 50_000, "<!--" * 50_000, "<" * 200_000, "<a href=" * 50_000 + ">"):
        began = time.time()
        warc.scan(soup)
        assert time.time() - began < 5, soup[:10]


def test_warc_files(spark):
    sources = [warc.response(i, f"http://x/{i}", f"<p>text {i}</p>", "2020-01-01T00:00:00Z") for i in range(3)]
    other = warc.record("warcinfo", "<urn:uuid:0>", b"software: x\r\n", "application/warc-fields", [])
    content = other.to_bytes() + b"".join(s.to_bytes() for s in sources)
    frame = spark.createDataFrame([(7, bytearray(content)), (8, None), (9, bytearray(b"")), (10, bytearray(content[:-60]))], "key long, content binary")
    got = warc.derivatives(frame).collect()
    assert sorted(r.key for r in got) == [7] * 6 + [10] * 4
    assert {r.refers_to for r in got if r.key == 7} == {s.get("WARC-Record-ID") for s in sources}
    assert [r.block for r in got if r.key == 7 and r.record_type == "conversion"] == ["text 0", "text 1", "text 2"]
