"""The pipeline as a whole on a small corpus with nulls, empty texts, repeats, leaks, personal data and clashing columns."""

from __future__ import annotations

import random

import corpus_pipeline
from colloquy.llm.queries import ORACLE_SQL

WORDS = "the of and river stone light under seven green paper house window later simple copper engine garden market letter winter bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n)) + "."


def corpus(rng):
    """Rows of documents, of labels, of the benchmark, and which rows are copies, leaks and hold an address."""
    items = [(k, prose(rng, 60).replace("river", f"item{k}")) for k in range(6)]
    docs = [(i, prose(rng, rng.randint(80, 160)), "en", rng.choice("abc"), None) for i in range(150)]
    copies = [(1000 + k, docs[k][1] + (" tail" if k % 2 else ""), "en", "a", None) for k in range(12)]
    leaks = [(2000 + k, prose(rng, 40) + " " + items[k][1] + " " + prose(rng, 40), "en", "b", None) for k in range(6)]
    mails = [(3000 + k, prose(rng, 60) + f" write to someone{k}@mail.example.com " + prose(rng, 40), "en", "c", None) for k in range(6)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "a", 0), (4002, " \n ", "en", None, 3), (None, prose(rng, 90), "en", "a", 5), (4003, prose(rng, 3000), "en", "c", 1)]
    bad = [(5000 + k, "$$ ## buy now click here ### " * 30, "en", "a", None) for k in range(10)]
    labels = [(d[0], 1, 0) for d in docs[:80]] + [(d[0], 0, 0) for d in bad[:8]]
    return docs, copies, leaks, mails, odd, bad, labels, items


def test_run(spark, tmp_path):
    docs, copies, leaks, mails, odd, bad, labels, items = corpus(random.Random(7))
    rows = [(*r, 7, "x", 0.5) for r in [*docs, *copies, *leaks, *mails, *odd, *bad, docs[3]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, pii__spans string, decontamination__leaks double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = stage(spark, before, str(tmp_path))
        assert d.columns == before.columns, name
        d.write.parquet(f"{tmp_path}/stage-{name}")
        d = spark.read.parquet(f"{tmp_path}/stage-{name}")
        kept[name] = {r.doc_id: r for r in d.collect()}
    clean = {r[0] for r in docs}
    assert len(clean & kept["quality"].keys()) >= 0.9 * len(clean)
    for k, copy in enumerate(copies):  # one document of each group stays
        group = {docs[k][0], copy[0]} & kept["quality"].keys()
        assert len(group & kept["near_duplicates"].keys()) == (1 if group else 0)
    leaked = {r[0] for r in leaks}
    assert not leaked & kept["decontamination"].keys() and (clean & kept["near_duplicates"].keys()) <= kept["decontamination"].keys()
    for r in mails:
        if r[0] in kept["pii"]:
            assert "[EMAIL]" in kept["pii"][r[0]].text and "@" not in kept["pii"][r[0]].text
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= kept["pii"].keys() and len(got) > 50


def test_the_sql_of_the_queries_names_queries():
    assert {"op2_substring_dedup", "op13_lexical_search"} <= set(ORACLE_SQL) and corpus_pipeline.ORACLE_SQL is None
