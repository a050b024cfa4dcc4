"""Texts of a megabyte whose time or memory once grew with the square of their length; nulls and records that were mixed up."""

import time
import tracemalloc

import numpy as np
import pytest

from verdigris.llm import html, mixing, pii, quality, warc


def timed(f, most):
    start = time.time()
    out = f()
    assert time.time() - start < most
    return out


def test_a_megabyte_of_digits_before_an_at():
    text = "see " + "7" * 1_000_000 + "@example.com and 77777777 again"
    spans = pii.base_spans(text)
    tracemalloc.start()
    nodes, _, skip = timed(lambda: pii.nodes(text, spans), 8)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert len(nodes) == 2 and skip == [(0, 1)]


def test_tails_of_numbers_link_as_stored_suffixes_did():
    text = "call +1 (319) 555-5132 or 5555132, 3195555132, 13195555132 or 9995132 or é5555132 now; card 4111 1111 1111 1111 and 1111111111111111"
    nodes, _, skip = pii.nodes(text, pii.base_spans(text))
    said = [text[a:b] for a, b, *_ in nodes]
    ends, want = [b for _, b, *_ in nodes], {}
    digits = lambda t: t.translate(pii.DIGITS)
    for a, b in sorted((a, b) for _, a, b in pii.base_spans(text)):
        for size in range(7, len(digits(text[a:b])) + 1):
            want.setdefault(digits(text[a:b])[-size:], sum(e <= a for e in ends))
    linked = {(said[h], said[n]) for h, n in skip}
    for n, (_, _, _, label) in enumerate(nodes):
        hub = want.get(digits(said[n]), n)
        assert label or hub == n or (said[hub], said[n]) in linked
    assert {n for _, n in linked} >= {"5555132", "3195555132", "13195555132"} and not {"9995132", "é5555132"} & {n for _, n in linked}


def test_a_megabyte_of_capitals(spark):
    texts = ["A" * 1_000_000 + "a", "A" * 1_000_000, "AB Ab ABc AB1 A (AB) AB\nXY!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    got = timed(lambda: {r["row"]: r["n_caps"] for r in quality.figures(df).select("row", "n_caps").collect()}, 20)
    assert got == {0: 0, 1: 1, 2: 4}


def test_deep_trees():
    n = 200_000
    rng = np.random.default_rng(1)
    parent = np.arange(-1, n - 1)
    unary, edge = rng.normal(size=n), np.log([[0.8, 0.2], [0.3, 0.7]])
    p = timed(lambda: html.marginals(parent, unary, edge), 2)
    assert len(p) == n and np.isfinite(p).all()
    # Node by node gives what levels give.
    for size in (1, 2, 30, 400):
        tree = np.array([-1, *[rng.integers(-1, i) for i in range(1, size)]])
        some = rng.normal(size=size) * 3
        assert np.allclose(html.marginals(tree, some, edge), html._marginals_of_chains(tree.tolist(), some.tolist(), edge), atol=1e-12)
    assert len(html.marginals(np.zeros(0, int), np.zeros(0), edge)) == 0


def test_a_page_of_nested_blocks():
    page = "<html><body>" + "<div>" * 200_000 + "text in the middle of it all" + "</div>" * 200_000 + "</body></html>"
    timed(lambda: html.Page(page), 10)


def test_copies_tell_nulls_apart(spark):
    rows = [(1, "en", None, "one two three four"), (1, "en", "one two three four", None)] + [(i, "en", "s", "word " * 40) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = [(r["source"], r["text"]) for r in mixing.mixed_documents(docs).filter("doc_id = 1").collect()]
    assert got and set(got) == {(None, "one two three four")}


def record(kind, body, more=b""):
    return b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_payloads_of_all_records(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"warcinfo", b"software: x\r\n") + record(b"metadata", b"fetchTimeMs: 7\r\n") + record(b"request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", b"Content-Type: application/http; msgtype=request\r\n") + record(b"resource", b"abc"))
    got = {r["warc_type"]: bytes(r["payload"]) for r in warc.load(spark, str(tmp_path)).collect()}
    assert got == {"warcinfo": b"software: x\r\n", "metadata": b"fetchTimeMs: 7\r\n", "request": b"", "resource": b"abc"}


def test_a_record_without_a_length_names_its_file(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match=r"bad\.warc.*without a Content-Length"):
        warc.load(spark, str(tmp_path)).collect()
