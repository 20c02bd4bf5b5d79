"""Very long texts and many matches in one text, and columns of a caller that are called like an operator's own."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import common, decontamination, pii


def test_word_hashes_in_parts(monkeypatch):
    rng = random.Random(3)
    blobs = [b" ".join(bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 9))) for _ in range(n)) for n in (0, 40, 1, 0, 300)] + [b"", b"x" * 500, b" \t"]
    data, offsets = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    whole = common.word_hashes(data, offsets)
    for size in (16, 50, 333):
        monkeypatch.setattr(common, "HASHED", size)
        cut = common.word_hashes(data, offsets)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()


def _search(rng, n_items):
    vocabulary = [f"w{k}" for k in range(900)]
    texts = [" ".join(rng.choices(vocabulary, k=60)).encode() for _ in range(n_items)]
    items = decontamination.Items(list(enumerate(texts)))
    idf = np.ones(len(items.vocabulary))
    latent = idf[:, None] * items.matrix(idf).T
    term, query = np.nonzero(latent)
    return texts, decontamination.Search(items, idf, np.searchsorted(term, np.arange(len(idf) + 1)), query, latent[term, query])


def _found(search, text):
    data = np.frombuffer(text.translate(decontamination.PLAIN), np.uint8)
    h, own = common.word_hashes(data, np.array([0, len(data)]))
    return sorted({(item, round(lcs, 9)) for _, item, _, lcs in search.leaks(h, own, 1)})


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts, search = _search(rng, 40)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)).encode()
    text = b" ".join([prose(500), texts[3], prose(37), texts[7], prose(2000), texts[11], prose(5)])
    whole = _found(search, text)
    assert {i for i, _ in whole} == {3, 7, 11}
    for halves in (1, 2, 7, 10_000):
        monkeypatch.setattr(decontamination, "HALVES", halves)
        assert _found(search, text) == whole


def test_memory_grows_little_with_a_text():
    """10 MB of the benchmark's own words in one text: about ten times the text is held."""
    rng = np.random.default_rng(1)
    _, search = _search(random.Random(5), 200)

    def peak(n):
        text = b" ".join(b"w%d" % k for k in rng.integers(0, 900, n))
        tracemalloc.start()
        _found(search, text)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top / len(text), top

    small, large = peak(200_000), peak(2_000_000)
    assert large[1] < 16 * 9.8e6 and large[0] < small[0]


def test_fifty_thousand_addresses(spark):
    """Twice the addresses take about twice the time, no more."""
    def run(n):
        d = spark.createDataFrame([(1, " ".join(f"mail me{k}@mail.example.com." for k in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.redacted(pii.with_spans(d, out="found").select("doc_id", "text", F.size("found").alias("n"))).first()
        assert (r.n, r.text.count("[EMAIL]"), r.text[:21]) == (n, n, "mail [EMAIL]. mail [E")
        return time.perf_counter() - began

    run(10)
    few, many = run(5_000), run(50_000)
    assert many < 10 * few + 20


def test_overlapping_spans_at_piece_ends(spark):
    rng = random.Random(2)
    parts = ["4539 1488 0343 6467", "+44 20 7946 0958", "10.0.0.1", "a.b@c.de", "x" * 500, "é" * 11, "word ", " ", "+4539148803436467", "1.2.3.4@5.6.7.8"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(60))) for k in range(30)] + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.found for r in pii.with_spans(d, out="found").collect()}
    for r in pii.redacted(d).collect():
        text, out, at = dict(rows)[r.doc_id], "", 0
        for x in sorted(spans[r.doc_id], key=lambda x: (x.s, -x.e)):
            if x.s >= at:
                out += text[at : x.s] + f"[{x.kind.upper()}]"
            at = max(at, x.e)
        assert r.text == (None if text is None else out + text[at:])


def test_columns_of_the_caller_stay(spark):
    d = spark.createDataFrame([(1, "mail a@b.de", "m", "c", "s", "f", "t", "l", "x")], "doc_id long, text string, pii_spans__m_email string, pii_spans__cut string, pii__spans string, pii__far string, leaks__text string, decontamination__leaks string, decontamination__leaks__text string")
    bench = spark.createDataFrame([(1, "some other words that are a benchmark item here and there")], "item_id long, text string")
    more = d.columns[2:]
    for out in (pii.with_spans(d), pii.redacted(d), decontamination.with_leaks(d, bench), decontamination.decontaminate(d, bench)):
        r = out.select(*more).first()
        assert tuple(r) == ("m", "c", "s", "f", "t", "l", "x")
