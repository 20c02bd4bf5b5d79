import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import search as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_clean_inline_deletes_controls_and_collapses(spark):
    assert one(spark, T.clean_inline(F.lit("  a\x0b\r b \tc\x00d "))) == "a b cd"
    assert one(spark, T.clean_inline(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("raw", "want"), [("Ann & 5 others", "Ann"), ("Олена та ще 3 учасники", "Олена"), ("  ", T.UNKNOWN), ("Bob\n Lee", "Bob Lee"), ("A" * 300, "A" * 200)])
def test_clean_speaker(spark, raw, want):
    assert one(spark, T.clean_speaker(F.lit(raw))) == want


def test_tokens_and_norms(spark):
    assert one(spark, T.word_tokens(F.lit("Don't_stop, Їжак 42!"))) == ["don", "t", "stop", "їжак", "42"]
    assert one(spark, T.evidence_norm(F.lit("  A_b — c! "))) == "a_b c"
    assert one(spark, T.long_text(F.lit("w " * 12))) and not one(spark, T.long_text(F.lit("w " * 11)))
    assert one(spark, T.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]


def corpus(spark):
    rows = [("a:0", "a", 0, "decision", "Ann", "use the event router", None, "active"), ("a:1", "a", 1, "tldr", "Bob", "events and routers", "Ann Lee", "open"), ("b:0", "b", 0, "fact", "Cid", "nothing here", None, "active"), ("b:1", "b", 1, "fact", "Cid", "an event", None, "active")]
    chunks = spark.createDataFrame(rows, "chunk_id string, session string, ordinal int, kind string, speaker string, text string, owners string, status string")
    meetings = spark.createDataFrame([("a", "2024-02-01", ["Ann Lee", "Bob"]), ("b", "2024-01-01", ["Cid"])], "session string, meeting_date string, participants array<string>")
    return chunks, meetings


def ids(d):
    return [r.chunk_id for r in d.collect()]


def test_all_terms_first_then_any(spark):
    c, m = corpus(spark)
    assert ids(S.search(c, m, "event router")) == ["a:0", "a:1"]
    assert set(ids(S.search(c, m, "event nonsense"))) == {"a:0", "a:1", "b:1"}


def test_filters_and_browse(spark):
    c, m = corpus(spark)
    assert ids(S.search(c, m, "event", participants=["lee", "bob"], kinds=["tldr"], owner="ann", status="open", date_from="2024-01-15")) == ["a:1"]
    assert ids(S.search(c, m, "")) == ["a:0", "a:1", "b:0", "b:1"]
    assert ids(S.search(c, m, "the", stop_words=["the"])) == ["a:0"]
    with pytest.raises(ValueError):
        S.search(c, m, "x", limit=0)


def test_any_term_where_the_filters_leave_none_with_all(spark):
    c = spark.createDataFrame([("a:0", "a", 0, "fact", "Ann", "one two", None, None), ("b:0", "b", 0, "fact", "Bob", "one only", None, None)], "chunk_id string, session string, ordinal int, kind string, speaker string, text string, owners string, status string")
    m = spark.createDataFrame([("a", "2024-01-01", ["Ann"]), ("b", "2024-01-01", ["Bob"])], "session string, meeting_date string, participants array<string>")
    assert ids(S.search(c, m, "one two")) == ["a:0"]
    assert ids(S.search(c, m, "one two", participants=["bob"])) == ["b:0"]
    assert S.query_terms("What about the зустріч router") == ["router"] and S.query_terms("the what") == ["the", "what"]


def test_bm25_formula(spark):
    import math

    c, m = corpus(spark)
    got = {r.chunk_id: r.score for r in S.search(c, m, "nothing").collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    lengths, n = [5, 6, 3, 3], 3
    want = -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / (sum(lengths) / 4)))
    assert got == {"b:0": pytest.approx(want, abs=1e-6)}


def test_index_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "session int, content_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "session int, content_hash string")
    assert {r.session: r.change for r in S.index_diff(old, new).collect()} == {1: "unchanged", 2: "indexed", 3: "removed", 4: "indexed"}
