"""Every operator against a brute-force version, on small tables with nulls, repeats, ties, long and empty texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import common, components, decontamination, language_id, mixing, near_copies, pii, quality_classifier, quality_rules, repeats, simhash, suffix_index, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, kept string, fp int, size int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids, langs, sources = ids or list(range(n)), langs or [None] * n, sources or ["a"] * n
    rows = [(i, t, g, s, len(t or ""), 1, "x", 2, 3) for i, t, g, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng, n, words="the of and river stone light under seven green paper house window later simple copper engine garden".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    shared = prose(rng, 120)
    out = [prose(rng, 90) for _ in range(6)]
    out += [out[0], out[1] + " tail", "x " + shared + " y", shared + " " + prose(rng, 30), prose(rng, 20) + " " + shared, None, "", " \t\n", "one", "two words", "Ünïcode ßtraße — 漢字 text", "no\x85break\xa0here and\x1cthere", "spam " * 300, "a\nb\n" * 40, prose(rng, 3000)]
    return out


def by_id(d):
    return {r.doc_id: r for r in d.collect()}


def split(t):
    return WORD.findall((t or "").encode())


def test_words_are_the_contract_s(texts):
    for t in texts:
        b = (t or "").encode()
        h, own = common.word_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert common.words(b) == split(t) and len(h) == len(split(t)) and not own.any()


def test_substring_dedup(spark, texts):
    got = by_id(repeats.dedup_substrings(table(spark, texts), texts=True))
    least = {}
    for i, t in enumerate(texts):
        w = split(t)
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    for i, t in enumerate(texts):
        w = split(t)
        lost = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                lost[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, gone in zip(w, lost, strict=True) if not gone)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(w), sum(lost), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert sum(r.n_removed for r in got.values()) > 300


def test_substring_dedup_odd_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    d = table(spark, [long, long, long, "z " + long, long], ids=[None, 5, 5, 5, 9])
    assert sorted((r.doc_id or -1, r.n_removed) for r in repeats.dedup_substrings(d).collect()) == [(-1, 0), (5, 0), (5, 0), (5, 0), (9, 40)]


def test_gap_coding():
    rng = np.random.default_rng(2)
    for span in (10, 300, 100_000):
        c = np.unique(rng.integers(0, span, 200))
        assert (repeats.unpack_gaps(repeats.pack_gaps(c)) == c).all()


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, texts, hot):
    length, blobs = 400, [(t or "").encode() for t in texts]
    seen = {}
    for b in blobs:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    got = by_id(suffix_index.dedup_bytes(table(spark, texts), hot=hot, texts=True))
    for i, b in enumerate(blobs):
        lost = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                lost[k : k + length] = b"\1" * length
        kept = bytes(x for x, gone in zip(b, lost, strict=True) if not gone)
        spans = sum(1 for k in range(len(b)) if lost[k] and (k == 0 or not lost[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(lost), spans, kept), i


def test_suffix_dedup_in_parts_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "PART", 700)
    rng = random.Random(8)
    t = prose(rng, 600)
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_index.dedup_bytes(table(spark, [t, t, "q" + t[5:800] + "é"], ids=[1, 1, None])).collect())
    assert got == [(-1, 795), (1, len(t)), (1, len(t))]


def test_string_hashes():
    data = np.frombuffer(b"abcabcabcabdabcabc", np.uint8)
    for n in (1, 2, 3, 5, 7, 8, 18):
        h = suffix_index.string_hashes(data, n)
        raw = data.tobytes()
        parts = [raw[k : k + n] for k in range(len(raw) - n + 1)]
        assert len(h) == len(parts) and len(set(zip(h.tolist(), parts, strict=True))) == len(set(parts)) == len(set(h.tolist()))


def test_simhash(spark, texts):
    import xxhash

    texts = [*texts, texts[2].upper(), texts[2].replace("stone", "Stone"), texts[3] + " one"]

    def fingerprint(t):
        w = [x.decode() for x in WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode())]
        if not w:
            return 0
        h = [xxhash.xxh64(" ".join(w[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = by_id(simhash.near_duplicates(table(spark, texts)))
    assert {i: (r.fp & (1 << 64) - 1, r.component_id) for i, r in got.items()} == {i: (f, c) for i, (f, c) in enumerate(zip(fps, root, strict=True))}
    kept = simhash.drop_near_duplicates(table(spark, texts))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and {r.doc_id for r in kept.collect()} == set(root)


def test_simhash_links_in_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base, base[:20] ^ np.uint64(1 << 40), base[:20] ^ np.uint64((1 << 3) | (1 << 63)), base[:10] ^ np.uint64(7)])
    nodes = spark.createDataFrame([(int(x),) for x in np.unique(near).view(np.int64)], "fp long")
    want = {frozenset((int(a), int(b))) for a in near.view(np.int64) for b in near.view(np.int64) if a != b and (int(a) ^ int(b) & -1) is not None and bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") <= 2}
    for rows in (20_000, 1):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
        found = components.components(simhash.links(nodes)).collect()
        root = {r.node: r.root for r in found}
        assert all(root[a] == root[b] for a, b in map(tuple, want)) and len({frozenset(p) for p in want}) > 30
        assert set(root) == {x for p in want for x in p}


def test_components_chain(spark):
    n = 60
    d = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    assert {r.node: r.root for r in components.components(d).collect()} == {k: 0 for k in range(n + 1)} | {200: 200, 201: 200}


def test_token_counts_and_prefixes(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [*texts, "a<|endoftext|>b <|endoftext|> it's  done \n\n x", "   lead", "trail   ", "1234 5,678.90!!", "é combining \U0001f600 ok"]
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = by_id(token_counts.token_counts(table(spark, more), limit=50, prefixes=True))
    for i, t in enumerate(more):
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), count(t), count(t) > 50)
        assert len(r.tokens_at) == len(t or "") + 1 and r.tokens_at[0] == 0 and r.tokens_at[-1] == r.n_tokens
        assert count((t or "")[: r.fit_chars]) <= 50
    c = token_counts.counter("byte_bpe_50k.json")
    for t in [*more[-5:], texts[16], texts[17], "it'll be x's", "a<|endoftext|>", "  <|endoftext|>'s", "x  \n <|endoftext"]:
        truth = [count(t[:k]) for k in range(len(t) + 1)]
        found = c.table(t)
        assert found.tolist() == truth
        for budget in range(0, 12):
            # The longest of all prefixes within the budget, none longer.
            assert c.within(found, budget) == max(k for k, n in enumerate(truth) if n <= budget)


def test_token_questions_ask_no_library(spark, texts, monkeypatch):
    import tokenizers

    def refuse(*_, **__):
        raise AssertionError("the table answers")

    monkeypatch.setattr(tokenizers, "Tokenizer", refuse)
    c = token_counts.PrefixCounter("byte_bpe_50k.json")
    t = c.table(texts[16])
    assert t[c.within(t, 5)] <= 5 and int(t[-1]) > 5


def test_token_counts_rows(spark):
    d = spark.createDataFrame([(None, "two words", 1), (3, "two words", 2), (3, "two words", 2), (4, "", 3)], "doc_id long, text string, tokens_at int")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(d).collect())
    assert got == [(-1, 2), (3, 2), (3, 2), (4, 0)]


def test_pii_base_spans(spark):
    rng = random.Random(5)
    parts = ["a.b+c@x-y.org", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (377) 555-0271", "+44 20 7946 0958 x", "+1", "é", "日本", ".", " ", ",", "token = \"6cfd1f1f244d4c4c327ecfd8fd9898497c475388\"", "my ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "IBAN DE88370400440532013000", "7992739871300"]
    docs = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + [None, "", "1" * 5000, "a" * 20_000, "a@b." + "c." * 4000 + "d", "1-" * 3000]
    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def holds(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        return {"email": True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    got = by_id(pii.with_spans(table(spark, docs), out="spans"))
    for i, t in enumerate(docs):
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(base) for m in re.finditer(p, t or "") if holds(kind, m[0]))
        assert [(s.s, s.rank, s.e) for s in got[i].spans if s.rank < 4] == want, t
    kinds = {s.kind for r in got.values() for s in r.spans}
    assert {"email", "ip", "card", "phone", "iban", "ssn", "secret"} <= kinds


def test_pii_redaction_keeps_columns(spark):
    d = table(spark, ["write a@b.org or +1 (377) 555-0271 now", None, "clean"])
    out = pii.redacted(d)
    assert out.columns == d.columns and [r.text for r in out.orderBy("doc_id").collect()] == ["write [EMAIL] or [PHONE] now", None, "clean"]


def rules(t):
    w = [x.decode() for x in split(t)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    small = [t for t in texts if t is None or len(t) < 8000] + ["| a | b |\n| a | b |\n# x"]
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 1), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality_rules(table(spark, small), labels))
    for i, t in enumerate(small):
        r, want = got[i], rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_isolation_forest_finds_the_odd():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (2000, 4)), rng.normal(9, 1, (20, 4))])
    trees = quality_rules.grow(rows, 3)
    a = quality_rules.anomaly(rows, trees, len(rows))
    assert a[-20:].min() > np.quantile(a[:-20], 0.97) and ((0 < a) & (a < 1)).all()


def test_quality_classifier_on_planted(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(60, 200)) for _ in range(160)]
    bad = [prose(rng, 80).upper().replace(" ", "!! ") for _ in range(30)] + [prose(rng, 60).replace(" ", "$$$ ") for _ in range(30)]
    toxic = [prose(rng, 40) + rng.choice([" idiot ", " moron "]) + prose(rng, 40) for _ in range(30)]
    docs = good + bad + toxic + [None, "", "é"]
    n = len(docs)
    labels = spark.createDataFrame([(i, int(not len(good) <= i < len(good) + len(bad)), int(len(good) + len(bad) <= i < len(good) + len(bad) + len(toxic))) for i in range(0, n - 3, 2)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    d = table(spark, docs)
    got = by_id(quality_classifier.classify(d, labels))
    kept = [got[i].quality__kept for i in range(n)]
    assert sum(kept[: len(good)]) >= 0.97 * len(good) and sum(kept[len(good) : n - 3]) <= 4 and not kept[n - 3] and not kept[n - 2]
    assert quality_classifier.quality_filter(d, labels).columns == d.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    alone = by_id(quality_classifier.classify(d, none))
    assert sum(alone[i].quality__kept for i in range(len(good))) >= 0.95 * len(good)


def test_language_id(spark):
    rng = random.Random(2)
    vocab = {"en": "the and that have with this from they would there".split(), "de": "der und nicht sich auch über für eine wäre schön".split(), "el": "και το να που με για από στο ότι είναι".split()}
    langs = [rng.choice(list(vocab)) for _ in range(240)]
    docs = [" ".join(rng.choice(vocab[g]) for _ in range(rng.randrange(8, 60))) for g in langs]
    docs[:4] = [None, "12 34 --", "", "the"]
    seen = [g if k % 5 else None for k, g in enumerate(langs)]
    got = by_id(language_id.identify(table(spark, docs, langs=seen)))
    assert len(got) == 240 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in range(3))
    right = [got[k].lang_pred == langs[k] for k in range(4, 240)]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert {r.lang_pred for r in language_id.identify(table(spark, docs)).collect()} == {"und"}


def test_language_blocks_count_every_ngram(monkeypatch):
    is_letter = language_id.letters()
    t = "Größe und  Maß, 12 ça va? " * 40
    whole = language_id.counts(t, is_letter)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert (language_id.counts(t, is_letter) == whole).all()


def water(sizes, weights, cap):
    free, target, rest = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while free:
        x = rest / sum(weights[k] for k in free)
        full = {k for k in free if x * weights[k] > cap * sizes[k]}
        if not full:
            for k in free:
                target[k] = x * weights[k]
            break
        for k in full:
            target[k] = cap * sizes[k]
            rest -= target[k]
        free -= full
    return target


def test_mixing(spark):
    rng = random.Random(9)
    docs = [prose(rng, rng.randrange(0, 50)) for _ in range(300)] + [None, "", prose(rng, 4000)]
    sources = [rng.choice(["Z", "a", "b", "é", None, "c", "tiny"] if k < 300 else ["a"]) for k in range(303)]
    sources = [s if s != "tiny" or k % 9 == 0 else "b" for k, s in enumerate(sources)]
    d = table(spark, docs, sources=sources)
    rows = mixing.mix_sources(d).collect()
    order = sorted({s for s in sources if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(split(t)) for t, s in zip(docs, sources, strict=True) if s == o) for o in order]
    want = water(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    assert len(rows) == 303
    for o, n, t in zip(order, sizes, want, strict=True):
        mine = [r for r in rows if r.source == o]
        assert {r.source_size for r in mine} == {n} and all(abs(r.target - t) < 1e-6 for r in mine) and abs(sum(r.taken for r in mine) - t) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert max((r.taken - r.size * int(t // n) for r in mine if n), default=0) >= 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(d.repartition(7)).collect()))
    out = mixing.mixed(d)
    assert out.columns == [c for c in d.columns if c != "size"] + ["size", "source_size", "target", "taken"] and out.agg(F.sum("taken")).first()[0] == sum(r.taken for r in rows)


def test_decontamination(spark):
    rng = random.Random(13)
    words = [f"{a}{b}{c}" for a in "brk tol mun sil".split() for b in "ade ori unt ext".split() for c in "al en is or um ta".split()] + ["the", "of", "and"] * 10
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))
    items = [text(rng.randrange(14, 60)) for _ in range(30)] + [text(200), None, ""]
    docs = [text(rng.randrange(20, 400)) for _ in range(60)]
    para = items[3].split()
    para = " ".join(w for k, w in enumerate(para) if k % 9) + " indeed"
    planted = {len(docs): 0, len(docs) + 1: 3, len(docs) + 2: 30, len(docs) + 3: 5}
    docs += [text(70) + "\n" + items[0].upper() + ", " + text(33), text(10) + " " + para, text(500) + " " + items[30] + " " + text(5), items[5], None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = by_id(decontamination.with_leaks(table(spark, docs), bench, "found"))
    assert {i: [x.item_id for x in r.found] for i, r in got.items() if r.found} == {i: [k] for i, k in planted.items()}
    d = table(spark, docs)
    clean = decontamination.decontaminate(d, bench)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == set(range(len(docs))) - set(planted)
    assert decontamination.decontaminate(d, bench.limit(0)).count() == len(docs)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_TERMS", 25)
    items = [" ".join(f"q{k}w{j}" for j in range(20)) for k in range(4)]
    got = by_id(decontamination.with_leaks(table(spark, [f"aa {items[1]} bb {items[3]}", "nothing at all"]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    assert [x.item_id for x in got[0].leaks] == [1, 3] and got[1].leaks == []


def test_decontamination_blocks_by_passages_too(spark, monkeypatch):
    items = [" ".join(f"q{k}w{j}" for j in range(20)) for k in range(4)]
    bench = spark.createDataFrame([*enumerate(items), (1, items[1])], "item_id long, text string")
    found = []
    for most in (1000, 1):
        monkeypatch.setattr(decontamination, "BLOCK_QUERIES", most)
        found.append({i: sorted({x.item_id for x in r.leaks}) for i, r in by_id(decontamination.with_leaks(table(spark, [f"aa {items[1]} bb {items[3]}", "nothing", None]), bench)).items()})
    assert found[0] == found[1] == {0: [1, 3], 1: [], 2: []}


def test_decontamination_cosine_is_one(spark):
    items = [" ".join(f"q{k}w{j}" for j in range(10)) for k in range(5)]
    texts = [items[0] + " q0w3" * 30, items[1], items[2] + " other words of no item " * 3, *(f"plain text number {k} and no more" for k in range(200))]
    n, df = len(texts), {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    known = {w for i in items for w in i.split()}

    def vector(t):
        return {w: t.split().count(w) * (np.log((n + 1) / (df.get(w, 0) + 1)) + 0.1) for w in set(t.split()) & known}

    def cosine(a, b):
        a, b = vector(a), vector(b)
        return sum(a[w] * b.get(w, 0) for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    got = by_id(decontamination.with_leaks(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    for k, t in enumerate(texts[:3]):
        truth = cosine(t, items[k])
        if truth >= decontamination.MIN_COSINE + 0.05:
            assert [x.item_id for x in got[k].leaks] == [k] and abs(got[k].leaks[0].cosine - truth) < 0.05, truth
    assert got[1].leaks[0].cosine > 0.95 and max(x.cosine for r in got.values() for x in r.leaks) < 1.0001
    assert not any(r.leaks for i, r in got.items() if i > 2)


def test_lcs():
    rng = random.Random(1)
    for _ in range(100):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(9))], np.int64) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.common_length(a, b) == t[-1, -1]


def test_empty_tables(spark):
    d = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some text of an item")], "item_id long, text string")
    made = [repeats.dedup_substrings(d), suffix_index.dedup_bytes(d), simhash.near_duplicates(d), simhash.drop_near_duplicates(d), token_counts.token_counts(d), pii.with_spans(d), quality_rules.quality_rules(d, labels), quality_classifier.classify(d, labels), language_id.identify(d), mixing.mix_sources(d), decontamination.with_leaks(d, bench)]
    assert [m.count() for m in made] == [0] * len(made)


def test_unicode_letters_match_python():
    is_letter = language_id.letters()
    assert is_letter[ord("ß")] and not is_letter[ord("5")] and unicodedata.category("ª") == "Lo" and is_letter[ord("ª")]


def jaccard_components(texts, n=5):
    """The least index of each text's component, by brute force over all pairs."""
    def shingles(t):
        w = [x.lower() for x in split(t)]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("small, block", [(16, 4000), (2, 7)])
def test_near_copies_by_brute_force(spark, texts, monkeypatch, small, block):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    rng = random.Random(8)
    made, line = list(texts), prose(rng, 40)
    for _ in range(12):
        base = prose(rng, rng.choice([9, 60, 150])).split()
        for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06):
            made.append(" ".join(w if rng.random() >= share else "other" + str(rng.random()) for w in base))
    made += [made[40].upper(), line + " " + prose(rng, 12), *(line + f" and {i} so on" for i in range(40))]
    want = jaccard_components(made)
    got = by_id(near_copies.near_copies(table(spark, made)))
    assert [got[i].component_id for i in range(len(made))] == want
    kept = near_copies.drop_near_copies(table(spark, made))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_pipeline_stage_drops_copies_of_0_8(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    near = [*base[:50], "x", *base[51:100], "y", *base[101:150], "z", *base[151:]]  # 185 of 200 shingles stay: 185 / 215
    far = [w if k % 20 else "v" for k, w in enumerate(base)]
    kept = corpus_pipeline.near_duplicates(spark, table(spark, [" ".join(t) for t in (base, near, far)]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_near_copies_go_by_fingerprints_first(spark, monkeypatch):
    """Fingerprints and pivots find what differs in few bits, whole sets decide, and the prefix pass compares only what is apart by then."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    near = [*base[:700], "x", *base[701:]]
    other = [f"v{rng.randrange(10**6)}" for _ in range(204)]
    similar = [*other[:50], "x", *other[51:100], "y", *other[101:]]
    asked = []
    inner = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda docs, marks, pairs, shingle: (asked.append(pairs.count()), inner(docs, marks, pairs, shingle))[1])
    got = by_id(near_copies.near_copies(table(spark, [" ".join(t) for t in (base, near, other, similar)])))
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 2]
    assert asked == [1, 1]  # the first two by fingerprints, and not again; the others by prefixes
    hashes = next(near_copies.shingle_sets(pa.RecordBatch.from_arrays([pa.array([" ".join(base).encode()])], names=["text"])))[1]
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert simhash.over_half(hashes) == sum(1 << k for k in range(64) if 2 * int(bits[:, k].sum()) > len(hashes))


def test_near_copies_carry_packed_texts(spark, monkeypatch):
    """What crosses for verification is smaller than the texts themselves, and much smaller than sets of 8 bytes a shingle."""
    rng = random.Random(22)
    base = prose(rng, 2000).split()
    texts = [" ".join(base), " ".join([*base[:1000], "x", *base[1001:]])]
    sizes = []
    inner = near_copies.written

    def written(df, what, *partition_by):
        made = inner(df, what, *partition_by)
        if what == "candidate-texts":
            sizes.extend(r.n for r in made.selectExpr("length(packed) n").collect())
        return made

    monkeypatch.setattr(near_copies, "written", written)
    near_copies.near_copies(table(spark, texts)).count()
    assert len(sizes) >= 2 and max(sizes) < len(texts[0]) / 2


def test_near_copies_of_nothing(spark):
    assert near_copies.drop_near_copies(table(spark, ["a"]).limit(0)).count() == 0


def test_telling_words_are_counted_over_all_labelled(spark, monkeypatch):
    """A word of 60 labelled toxic documents tells, however few of them are in the sample for the weights."""
    seen = {}
    inner = quality_classifier._fitted
    monkeypatch.setattr(quality_classifier, "_fitted", lambda chosen, target, label, vocabulary: (seen.update({target: vocabulary}), inner(chosen, target, label, vocabulary))[1])
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 12)
    rng = random.Random(6)
    texts = [prose(rng, 60) + (" zwackelig" if i % 10 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    quality_classifier.fit(table(spark, texts), labels)
    word = b"zwackelig"
    keys = quality_classifier.hash_of(quality_classifier.feature_keys(np.frombuffer(word, np.uint8), np.array([0, len(word)])))
    assert np.isin(keys[0], seen["toxic"])
    # Exactly what brute force counts: words are in as many texts as they say.
    d = table(spark, ["a b a", "b", "c b"]).selectExpr("cast(text as binary) plain", "1 n_quality", "500000 bad_quality", "cast(doc_id > 0 as int) n_toxic", "0 bad_toxic")
    got = sorted((r.n_quality, r.bad_quality, r.n_toxic) for r in quality_classifier.word_counts(d).collect())
    assert got == [(1, 500000, 0), (1, 500000, 1), (3, 1500000, 2)]


def test_telling_words_cross_as_packed_distinct_words(spark, monkeypatch):
    """Counting gets each distinct word of a text once, compressed, and counts as it does from the texts."""
    texts = ["b a " * 500, None, "", "a " + " ".join(f"long{k}" for k in range(3000)), "c"]
    d = table(spark, texts).selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) plain")
    packed = quality_classifier.packed_words(d)
    rows = {r.doc_id: r for r in packed.collect()}
    assert rows[0].size == 3 and len(rows[0].packed) < 20 and rows[1].size == rows[2].size == 0
    assert len(rows[3].packed) < rows[3].size / 2
    weigh = [F.lit(1).alias("n_quality"), F.lit(2).alias("bad_quality"), F.col("doc_id").alias("n_toxic"), F.lit(0).alias("bad_toxic")]
    want, got = (sorted(map(tuple, quality_classifier.word_counts(x.select(*x.columns, *weigh)).collect())) for x in (d, packed))
    assert got == want and len(got) > 3000
    monkeypatch.setattr(quality_classifier, "BATCH_BYTES", 2 * rows[3].size)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([rows[3].size] * 3), pa.array([rows[3].packed] * 3)], names=["doc_id", "size", "packed"])
    parts = list(quality_classifier.unpacked(batch))
    assert [p.num_rows for p in parts] == [2, 1] and parts[0].schema.names == ["doc_id", "plain"]


def test_word_hashes_by_brute_force(monkeypatch):
    """A word's hash is the sum of its bytes' numbers times powers, whatever stands before it and wherever parts end."""
    rng = random.Random(31)
    texts = ["".join(rng.choice("ab \n\té$A") for _ in range(rng.randrange(80))).encode() for _ in range(60)] + [b"", b" ", b"x" * 900, b"y"]
    want = [(sum(int(common._BYTE[c]) * pow(int(common._BASE), k, 1 << 64) for k, c in enumerate(w)) % (1 << 64), i) for i, t in enumerate(texts) for w in t.split()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for size in (64, 1 << 18):
        monkeypatch.setattr(common, "HASHED", size)
        h, own = common.word_hashes(data, offsets)
        assert own.tolist() == [i for _, i in want]
        assert h.tolist() == common.mix(np.array([x for x, _ in want], np.uint64)).tolist()


def test_texts_are_read_once_before_scoring(spark):
    """Words and rules are taken from a text in one pass; counting, sampling and sums read what that pass wrote."""
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    quality_classifier.fit(d.mapInArrow(counted, d.schema), labels)
    assert read.value == len(texts)


def test_sums_of_words_cross_by_block(spark, monkeypatch):
    """What tasks have summed up meets in the same sums, wherever tasks and blocks end, in far fewer bytes than rows of words take."""
    rng = np.random.default_rng(5)
    w = np.unique(rng.integers(0, 1 << 31, 4000))
    s = np.column_stack([np.ones(len(w), np.int64), rng.choice([0, 12345], len(w)), np.zeros(len(w), np.int64), np.full(len(w), -(1 << 40))])
    z = quality_classifier.coded(w, s)
    got = quality_classifier.decoded(z, 4)
    assert got[0].tolist() == w.tolist() and got[1].tolist() == s.tolist() and len(z) < 6 * len(w)
    texts = ["a b a", "b", "c b", *(" ".join(f"w{(k * 37) % 90}" for k in range(i, i + 20)) for i in range(60))]
    d = table(spark, texts).selectExpr("cast(text as binary) plain", "1 n_quality", "doc_id bad_quality", "cast(doc_id > 0 as int) n_toxic", "0 bad_toxic")
    want = sorted(map(tuple, quality_classifier.word_counts(d.coalesce(1)).collect()))
    monkeypatch.setattr(quality_classifier, "HELD", 8)
    monkeypatch.setattr(quality_classifier, "BLOCK_BITS", 27)
    assert sorted(map(tuple, quality_classifier.word_counts(d.repartition(3)).collect())) == want and len({r[0] for r in want}) == len(want)
    assert quality_classifier.word_counts(d.limit(0)).count() == 0


def test_rules_of_batches_are_those_of_texts():
    rng = random.Random(9)
    texts = [None, "", " \n ", "a", "a b", "A b\nA b\n\n#", "a b c a b c", "é#É $$ ü ü ü ü", *("".join(rng.choice("ab \n#Aé") for _ in range(rng.randrange(200))) for _ in range(200))]
    rows = [None if t is None else t.encode() for t in texts]
    got = quality_rules.batch_counts(pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["text"]))
    assert list(map(tuple, got.tolist())) == [quality_rules.counts(t) for t in rows]


def test_workers_give_back_what_they_freed():
    """Blocks freed below one that is still held stay with the process, which later tasks of other stages share an executor with."""
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    pins = []

    def run(batches):
        held = [b"x" * 100_000 for _ in range(3000)]
        pins.append(b"y" * 100_000)
        del held
        yield from batches

    before = resident()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 100


def test_weights_are_learnt_from_all_documents(spark, monkeypatch):
    """However few documents the sample has, the others teach the weights, in the same parts wherever Spark deals the rows."""
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 12)
    monkeypatch.setattr(quality_classifier, "PART_ROWS", 150)
    rng = random.Random(16)
    texts = [prose(rng, 60) + (" zwackelig" if i % 5 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    models = [quality_classifier.fit(table(spark, texts).repartition(n), labels)["toxic"] for n in (1, 7)]
    assert all(np.array_equal(models[0].state(), m.state()) for m in models)
    got = by_id(quality_classifier.classify(table(spark, texts), labels))
    toxic, clean = ([got[i].quality__toxic for i in range(600) if (i % 5 == 0) == yes] for yes in (True, False))
    assert min(toxic) > 2 * max(clean) and np.mean(np.array(toxic) > 0.5) > 0.9


def test_near_copies_ask_only_likely_pairs(spark):
    """Signs of sets lose no link, and rule out pairs that share a common passage alone, in blocks of any size, before any text is looked at."""
    rng = np.random.default_rng(13)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(300):
        a = np.unique(some(int(rng.integers(1, 700))))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.8, 1))], some(int(len(a) * rng.uniform(0, 0.1)))]))
        near = near_copies.near_signs(near_copies.signs(a)[:, None], near_copies.signs(b)[:, None], np.array([len(a) + len(b)]))
        assert near[0] or not near_copies.similar(a, b)
    passage = some(60)
    sets = [np.unique(np.concatenate([passage, some(140)])) for _ in range(40)]
    sets.append(np.unique(np.concatenate([sets[0][:-1], some(1)])))
    n, m = len(sets), np.stack([near_copies.signs(x) for x in sets])
    same = lambda v: pa.array(np.full(n, v))
    node = pa.array(np.arange(n))
    columns = [same(7), same(0), same(0), node, pa.array([len(x) for x in sets]), same(0), node, same(0), *(pa.array(m[:, k].copy()) for k in range(near_copies.SIGNS))]
    block = pa.RecordBatch.from_arrays(columns, names=[*"token low high node size at root part".split(), *near_copies._SIGN_COLUMNS])
    got = [tuple(r.values()) for b in near_copies._second_pass(iter([block])) for r in b.to_pylist()]
    assert got == [(0, n - 1)]
