import difflib
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import similarity as M
from colloquy.operators import align, clean, fold, ledger

ENTRY = "session string, ord long, speaker string, kind string, text string, start_ms long, end_ms long"


def entries(spark, rows, session="s"):
    return spark.createDataFrame([(session, i, *r) for i, r in enumerate(rows)], ENTRY)


def got(d):
    return [(r.speaker, r.text) for r in d.orderBy("start_ms", "ord").collect()]


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert M.lcs_length(a, b) == t[-1][-1]


@pytest.mark.parametrize(("a", "b", "fuzzy", "want"), [("we go", "we go now", False, "we go now"), ("go now", "We go now.", False, "We go now."), ("cat", "dog", True, None), ("we will meet on friday at noon", "we will meet on monday at noon", True, "we will meet on monday at noon"), ("we will meet on friday at noon", "we will meet on monday at noon", False, None)])
def test_related(a, b, fuzzy, want):
    assert M.related(a, b, fuzzy) == want


def test_stitch():
    assert M.stitch("we talked to the", "to the engineers") == "we talked to the engineers"
    assert M.stitch("це зробить інже", "інженеру скажу") == "це зробить інженеру скажу"
    assert M.stitch("hello there", "good day") == "hello there good day"


def test_growing_captions_merge(spark):
    d = entries(spark, [("A", "caption", "we", 0, 500), ("A", "caption", "we will", 600, 900), ("A", "caption", "we will start", 1000, 1500), ("B", "caption", "fine", 1600, 1900)])
    assert got(fold.merge_related(d)) == [("A", "we will start"), ("B", "fine")]


def test_short_replies_stay_and_chat_dedups(spark):
    d = entries(spark, [("A", "caption", "Так", 0, 1), ("A", "caption", "Так", 61_000, 61_001), ("A", "chat", "link", 1, 1), ("A", "chat", "link", 30_000, 30_000)])
    assert sorted(got(fold.merge_related(d))) == [("A", "link"), ("A", "Так"), ("A", "Так")]


def test_fuzzy_only_close(spark):
    a, b = LONG, LONG.replace("seven", "7th")
    close = entries(spark, [("A", "caption", a, 0, 1000), ("A", "caption", b, 1100, 2000)])
    far = entries(spark, [("A", "caption", a, 0, 1000), ("A", "caption", b, 5000, 6000)])
    assert len(got(fold.merge_related(close))) == 1 and len(got(fold.merge_related(far))) == 2


def test_replay_burst(spark):
    five, more = "a b c d e", "f g h i j"
    rows = [("A", "caption", five, 0, 1), ("A", "caption", more, 10, 11), ("A", "caption", five, 50_000, 50_001), ("A", "caption", more, 50_050, 50_051), ("A", "caption", "Так", 50_060, 50_061)]
    d = fold.drop_bursts(clean.recent_replays(entries(spark, rows)))
    assert got(d) == [("A", five), ("A", more), ("A", "Так")]


def test_exact_replay_batch(spark):
    rows = [("A", "caption", LONG, 0, 1), ("A", "caption", "ok", 5, 6), ("A", "caption", LONG, 240_000, 1), ("A", "caption", "ok", 240_000, 1), ("A", "caption", "new", 240_000, 1)]
    assert got(clean.exact_replay_batches(entries(spark, rows))) == [("A", LONG), ("A", "ok"), ("A", "new")]


def test_turns(spark):
    rows = [("A", "caption", "first part", 0, 1000), ("A", "caption", "second part", 2000, 3000), ("A", "caption", "later", 20_000, 21_000), ("B", "caption", "no", 21_500, 22_000), ("B", "caption", "no", 22_500, 23_000)]
    assert got(fold.assemble_turns(entries(spark, rows))) == [("A", "first part second part"), ("A", "later"), ("B", "no"), ("B", "no")]


@pytest.mark.parametrize(("phrase", "times", "left"), [("дякую", [120, 150, 180, 210, 240], 0), ("sub by", [172, 194, 224, 254, 284], 1), ("sub by", [0, 5, 70, 140], 4), ("", [0, 30, 60, 90], 4)])
def test_periodic(spark, phrase, times, left):
    d = spark.createDataFrame([("s", i, phrase, t * 1000) for i, t in enumerate(times)], "session string, ord long, phrase string, start_ms long")
    assert fold.drop_periodic(d).count() == left


def test_fold_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(str(k), i, "AB"[rng.randrange(2)], "caption", " ".join(rng.choice(["go", "we", "now", "then"]) for _ in range(rng.randrange(1, 6))), i * 700, i * 700 + 600) for k in range(4) for i in range(60)]
    d = spark.createDataFrame(rows, ENTRY)
    once = sorted(map(tuple, fold.merge_related(d).collect()))
    assert once == sorted(map(tuple, fold.merge_related(d.orderBy(F.rand(5)).repartition(7)).collect()))


def test_entry_projection(spark):
    raw = spark.createDataFrame([("s", 0, " A & 2 others", " hi\t you ", None, "-5", "12.9"), ("s", 1, None, "", None, "1", "2"), ("t", 0, "B", "x", "chat", "soon", None)], "session string, ord long, speaker string, text string, kind string, startMs string, endMs string")
    assert [tuple(r) for r in clean.refuse_bad_times(clean.project_entries(raw)).collect()] == [("s", 0, "A", "hi you", "caption", 0, 12)]


def test_overlap_and_words(spark):
    words = spark.createDataFrame([("s", 0, 0.0, 0.4, "Hello"), ("s", 1, 0.6, 1.0, "there"), ("s", 2, 9.0, 9.5, "late")], "session string, seg_id int, start double, end double, text string")
    turns = spark.createDataFrame([("s", 0, 0.0, 0.5, "A"), ("s", 1, 0.5, 2.0, "B")], "session string, turn_ord int, start double, end double, speaker string")
    d = align.overlap_speakers(words, turns, 1.0)
    assert [r.speaker for r in d.orderBy("seg_id").collect()] == ["A", "B", "UNKNOWN"]
    assert align.merge_words(d.withColumnRenamed("seg_id", "ord")).count() == 3


@pytest.mark.parametrize(("times", "speakers"), [([1000.0, 8.0, 9.0], {"SPEAKER_00"}), ([1000.0, 4.0], {"A", "B"})])
def test_collapse(spark, times, speakers):
    rows = [("s", "ABC"[i], 0.0, t) for i, t in enumerate(times)]
    assert {r.speaker for r in align.collapse_speakers(spark.createDataFrame(rows, "session string, speaker string, start double, end double")).collect()} == speakers


def folded(spark, rows_in_batch):
    rng = random.Random(5)
    words = "we will start on friday with the budget and then look at hiring plans for next year".split()
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 40, 900, 2000, 30_000])
        n = rng.choice([1, 2, 4, 6, 14])
        k = rng.randrange(len(words) - 2)
        rows.append((rng.choice("AB"), rng.choice(["caption", "caption", "chat"]), " ".join((words[k:] + words)[:n]), at, at + 800))
    d = entries(spark, rows, "hot").union(entries(spark, rows[:7], "cold"))
    items = d.select(F.col("ord").alias("item_id"), F.length("session").cast("long").alias("session"), F.lit("fact").alias("type"), F.lit("open").alias("status"), F.lit("high").alias("confidence"), F.col("text").alias("claim"), F.lit("").alias("deadline"), (F.col("ord") % 50).alias("source_order"), F.array(F.lit("A")).alias("owners"), F.array(F.concat(F.lit("quote "), "ord")).alias("quotes"))
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, str(rows_in_batch))
    try:
        made = [
            fold.drop_bursts(d.withColumn("candidate", F.col("ord") % 3 > 0)), fold.merge_related(d), fold.assemble_turns(d), fold.pack_lines(d.select("session", "ord", "text"), 100),
            fold.drop_periodic(d.select("session", "ord", F.col("speaker").alias("phrase"), "start_ms")), fold.greedy_dedup(items), fold.diverse_selection(items),
        ]
        return [sorted(map(str, x.collect())) for x in made]
    finally:
        spark.conf.set(name, before)


def test_folds_do_not_depend_on_batches(spark):
    whole = folded(spark, 10_000)
    assert all(whole)
    assert folded(spark, 3) == whole


def test_periodic_against_whole_groups(spark):
    rng = random.Random(8)
    rows = []
    for phrase in ("дякую", "hello", "", "bye", None):
        at = 0
        for _ in range(60):
            at += rng.choice([5_000, 20_000, 25_000, 40_000, 41_000, 90_000])
            rows.append(("s", len(rows), phrase, at))
    rows += [("t", 1000 + i, "дякую", 30_000 * i) for i in range(12)]
    want = []
    for key in {(r[0], r[2]) for r in rows}:
        g = sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (r[3], r[1]))
        loop = fold.looping([r[3] for r in g]) if key[1] else set()
        gone = (set(range(len(g))) if len(loop) >= 8 and len(loop) >= 0.75 * len(g) else loop) if key[1] == "дякую" else loop - {min(loop, default=None)}
        want += [r[1] for k, r in enumerate(g) if k not in gone]
    d = fold.drop_periodic(spark.createDataFrame(rows, "session string, ord long, phrase string, start_ms long"))
    assert d.columns == ["session", "ord", "phrase", "start_ms"]
    assert sorted(r.ord for r in d.collect()) == sorted(want)


def test_leaks_by_sequence_against_all_pairs(spark):
    rng = random.Random(4)
    said = ["we should look at the budget again", "the budget should be looked at again", "so we ship the new build on monday", "yes", "a b c d", ""]
    rows = [(rng.choice("st"), i, t := rng.randrange(0, 3_000_000), t + rng.choice([500, 400_000]), "".join(c for c in rng.choice(said) if rng.random() > 0.05).strip()) for i in range(120)]
    d = spark.createDataFrame(rows, "session string, id long, start_ms long, end_ms long, norm string").withColumn("tokens", F.filter(F.split("norm", " +"), lambda x: x != ""))
    a, b = F.col("m.norm"), F.col("o.norm")
    made = align.leaks(d.where("id % 2 = 0"), d.where("id % 2 = 1"), 30_000, align.may_agree(a, b, 0.85), align.sequences_agree(a, b, 0.85))
    gone = {
        m[1] for m in rows for o in rows
        if m[0] == o[0] and m[1] % 2 == 0 and o[1] % 2 == 1 and len(m[4]) >= 16 and len(m[4].split()) >= 4 and len(o[4].split()) >= 4
        and o[3] >= m[2] - 30_000 and o[2] <= m[3] + 30_000 and difflib.SequenceMatcher(None, m[4], o[4]).ratio() >= 0.85
    }
    assert gone
    assert sorted(r.id for r in made.collect()) == [r[1] for r in rows if r[1] % 2 == 0 and r[1] not in gone]


def test_equal_claims_are_one_class(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta"] * 40 + ["Eta zeta, epsilon delta gamma beta alpha!"] * 10 + ["alpha beta gamma delta epsilon zeta eta theta", "iota", None, ""]
    d = spark.createDataFrame([(None if i % 2 else "x", i, t) for i, t in enumerate(texts)], "session string, item_id long, claim string")
    classes = {r.item_id: r.representative for r in ledger.claim_classes(d).collect()}
    assert classes == {i: i % 2 if i < 50 else i for i in range(52)}
    pairs = [(r.session, r.a, r.b, round(r.similarity, 6)) for r in ledger.duplicate_pairs(d).collect()]
    assert pairs == [("x", 0, 50, 0.875)]
