"""The evidence ledger: grounding in the transcript, status and ownership rules, lifecycle, QA, selection, rendering.

items: session, item_id, type, claim, owners, deadline, status, commitment_strength, confidence, source_order, lifecycle_reason.
proofs: session, item_id, proof_ord, quote, timestamp. lines: session, line, timestamp, speaker, text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import clean_text, evidence_norm, jaccard

#: Item types, statuses and their order.
TYPES = ("fact", "participant_claim", "recommendation", "hypothesis", "proposal", "decision", "commitment", "completed_action", "open_question")
STATUSES = ("active", "open", "completed", "superseded")
CONFIDENCES = ("high", "medium", "low")
OPEN_TYPES = ("commitment", "open_question", "proposal")
TYPE_RANK = {"decision": 90, "completed_action": 85, "commitment": 80, "open_question": 70, "proposal": 60, "fact": 50, "participant_claim": 40, "recommendation": 30, "hypothesis": 20}
STATUS_RANK = {"active": 4, "open": 3, "completed": 2, "superseded": 1}
THEME_TYPE_SCORE = {"fact": 5, "participant_claim": 4, "recommendation": 3, "proposal": 2, "hypothesis": 1}
THEME_CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
LAST = 10**9
#: Tokens whose numbers of claims order them, the most frequent ones (the order bears on the cost alone), and the longs of a claim's mark.
MOST_COMMON, MARK = 200_000, 8
#: Characters of a transcript in which its date stands.
HEAD_CHARS = 3000

#: Cue words of the lifecycle rules (Ukrainian), over normalised text.
CUES = {
    "first_person": r"(?:(?:я|так|да)\s+(?:вам\s+|тобі\s+|це\s+)?)?(?:зроблю|підготую|надішлю|скину|передам|перевірю|додам|заповню|створю|розішлю|проконтролюю|візьму|поговорю|напишу|оформлю|продублюю|відправлю|закину|поставлю|підключу|домовлюся|зробимо|підготуємо|надішлемо|скинемо|передамо|перевіримо|додамо|заповнимо|створимо|розішлемо|проконтролюємо|візьмемо|поговоримо|напишемо|оформимо|продублюємо|відправимо|закинемо|поставимо|підключимо|домовимося|синхронізуємося|проведемо|організуємо|спробую|спробуємо|постараюся|постараюсь|постараємося)",
    "owner_accepts": r"(?:прийнято|погоджуюся|погоджуюсь|беру|окей|добре)",
    "completed": r"(?:вже\s+)?(?:зробив|зробила|зробили|надіслав|надіслала|надіслали|відправив|відправила|відправили|скинув|скинула|скинули|закинув|закинула|закинули|передав|передала|передали|заповнив|заповнила|заповнили|створив|створила|створили|додав|додала|додали)",
    "strong": r"(?:підсумок|підсумували|залишаємо|залишимо|робимо|рухаємось|рухатись\s+таким\s+чином|остаточн(?:е|ий|а)\s+рішення|фінальн(?:е|ий|а)\s+рішення)",
    "accepted": r"(?:погоджуюся|погоджуюсь|погодили|погоджено|прийнято|згоден|згодна|згодні|підтверджую|так\s+і\s+робимо|окей\s+так|домовились|домовилися|домовлено|вирішили|вирішено)",
    "conditional": r"(?:якщо|у\s+разі|за\s+умови|залежно\s+від|після\s+перевірки)",
    "help_claim": r"(?:(?:залишатися|бути)\s+на\s+зв\s*язку|(?:надавати\s+)?допомог\w*\s+(?:за\s+потреби|якщо\s+потрібно)|підключатися\s+(?:за\s+потреби|якщо\s+потрібно))",
    "help_quote": r"(?:якщо|коли).{0,40}(?:потріб\w*|допомог\w*).{0,60}(?:підключай|кажи|звертай|не\s+соромся)",
    "obligation": r"(?:мають|повинн\w*|потрібно|слід|зарезерв\w*|заповн\w*|поставити\s+ціль)",
    "managers": r"(?:(?:hiring|хайринг|наймаюч\w*)\s+)?менеджер\w*",
    "recruiters": r"рекрутер\w*",
    "two_days": r"сьогодні\s+(?:або\s+)?завтра",
}
WEEKDAYS = {"monday": r"понеділ\w*|monday", "tuesday": r"вівтор\w*|tuesday", "wednesday": r"серед\w*|wednesday", "thursday": r"четвер\w*|thursday", "friday": r"п\s+ятниц\w*|пятниц\w*|friday", "saturday": r"субот\w*|saturday", "sunday": r"неділ\w*|sunday"}



def cue(text: Column, name: str, cues: dict[str, str] = CUES) -> Column:
    """Whether a cue stands in normalised text, at word boundaries."""
    return text.rlike(rf"(?U)\b{cues[name]}\b")


def anchors(proofs: DataFrame, lines: DataFrame) -> DataFrame:
    """proofs that are verbatim in a line, with line, speaker, source_timestamp where they are certain, and supported.

    The line of the proof's own timestamp wins if it is the only one; else the only matching line. The speaker needs all
    matching lines (of that timestamp, if it matches) to agree. The join is an equi-join on session: a proof meets its session's lines.
    """
    p = proofs.withColumn("q", evidence_norm(F.col("quote"))).where("q != ''").alias("p")
    line = lines.withColumn("n", evidence_norm(F.col("text"))).alias("l")
    hit = p.join(line, (F.col("p.session") == F.col("l.session")) & F.contains("l.n", F.col("p.q"))).select("p.session", "p.item_id", "p.proof_ord", "p.quote", F.col("p.timestamp").alias("asked"), "l.line", F.col("l.timestamp").alias("ts"), "l.speaker", "l.text")
    at = F.col("ts") == F.col("asked")
    g = hit.groupBy("session", "item_id", "proof_ord", "quote", "asked").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(at).alias("n_at"), F.count_distinct(F.lower("speaker")).alias("speakers"), F.count_distinct(F.when(at, F.lower("speaker"))).alias("speakers_at"),
        F.min(F.when(at, F.struct("line", "ts", "speaker", "text"))).alias("first_at"), F.min(F.struct("line", "ts", "speaker", "text")).alias("first"),
    )
    sure = F.when(F.col("n_at") == 1, F.col("first_at")).when(F.col("n") == 1, F.col("first"))
    who = F.when(F.col("speakers_at") == 1, F.col("first_at.speaker")).when(F.col("speakers") == 1, F.col("first.speaker"))
    return g.select("session", "item_id", "proof_ord", "quote", F.when(F.col("n_at") > 0, F.col("asked")).otherwise("").alias("timestamp"), sure["line"].alias("line"), sure["ts"].alias("source_timestamp"), F.coalesce(who, sure["speaker"]).alias("speaker"), F.coalesce(sure["text"], F.col("quote")).alias("source_text"))


def _lengths(c: Column, of: DataFrame) -> Column:
    """The lengths that a column has, as an array: at most as many as its longest value has characters."""
    found = sorted(r[0] for r in of.select(F.length(c)).distinct().collect())
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")


def _ends_of(vocabulary: DataFrame, lengths: Column, end: Column) -> DataFrame:
    """w, df and piece: of each word the pieces of the given lengths that `end` cuts from it; n is the length there."""
    fits = F.filter(lengths, lambda n: n <= F.length("w"))
    return vocabulary.select("w", "df", F.explode(fits).alias("n")).select("w", "df", end.alias("piece"))


def quoted_in(quotes: DataFrame, docs: DataFrame, normal: bool = False) -> DataFrame:
    """(quote, doc_id) for every distinct quote that stands verbatim in a document; normal: quotes are normalised already.

    Every quote gets words whose texts are its candidates, by equi-joins with the distinct words of all documents. Words inside a quote are whole words of each text that
    has it, and the rarest of them does. A quote of two words is the end of one word and the beginning of the next: of the words that
    end so, or begin so, the rarer ones do. A quote of one word stands in a word: all words that hold it do. Empty quotes stand nowhere. Null texts hold nothing.
    """
    q = quotes.select("quote", (F.col("quote") if normal else evidence_norm(F.col("quote"))).alias("q")).where("q != ''").distinct()
    d = docs.select("doc_id", evidence_norm(F.col("text")).alias("n"))
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("n", " "))).alias("w")).where("w != ''")
    vocabulary = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    parts = q.select("q", F.split("q", " ").alias("words")).distinct()
    inner = parts.where(F.size("words") > 2).select("q", F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words") - 2))).alias("w"))
    keys = inner.join(vocabulary, "w").groupBy("q").agg(F.min(F.struct("df", "w"))["w"].alias("w")).select("q", "w")
    single = parts.where(F.size("words") == 1).select("q")
    inside = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda at: F.substr(F.col("w"), at, F.col("n")))))
    keys = keys.unionByName(_ends_of(vocabulary, _lengths(F.col("q"), single), inside).join(single.withColumnRenamed("q", "piece"), "piece").select(F.col("piece").alias("q"), "w"))
    pair = parts.where(F.size("words") == 2).select("q", F.col("words")[0].alias("end"), F.col("words")[1].alias("begin"))
    sides = [
        _ends_of(vocabulary, _lengths(F.col(c), pair), cut).join(pair.select("q", F.col(c).alias("piece")), "piece").select("q", F.lit(c).alias("side"), "w", "df")
        for c, cut in (("end", F.right(F.col("w"), F.col("n"))), ("begin", F.left(F.col("w"), F.col("n"))))
    ]
    both = sides[0].unionByName(sides[1])
    rarer = both.groupBy("q", "side").agg(F.sum("df").alias("df")).groupBy("q").agg(F.min(F.struct("df", "side"))["side"].alias("side"))
    keys = keys.unionByName(both.join(rarer, ["q", "side"], "left_semi").select("q", "w"))
    near = words.join(keys, "w").select("doc_id", "q").distinct()
    found = near.join(d, "doc_id").where(F.contains("n", F.col("q"))).select("q", "doc_id")
    return q.join(found, "q").select("quote", "doc_id")


def tracked_tokens(text: Column) -> Column:
    """number:<n> and weekday:<name> of a text: what a claim may not invent."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(?=\d)(?<!\w)(\d{1,4}(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.concat(F.lit("number:"), F.replace(n, F.lit(","), F.lit("."))))
    norm = evidence_norm(text)
    days = F.filter(F.array(*(F.when(norm.rlike(rf"(?U)\b(?:{p})\b"), F.lit(f"weekday:{d}")) for d, p in WEEKDAYS.items())), lambda x: x.isNotNull())
    # Most texts name no day: one plain search spares them the seven with word boundaries.
    days = F.when(F.lower(text).rlike("|".join(p.replace(r"п\s+ят", "ят").replace(r"\w*", "") for p in WEEKDAYS.values())), days).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(numbers, days))


def ground_claims(df: DataFrame, claim: str, support: Column, out: str) -> DataFrame:
    """df with `out`: the claim without bracketed asides that hold unsupported numbers or weekdays; empty if some are left.

    Every step is a column of its own, so that no text is searched twice.
    """
    aside = r"\s*\([^()]*(?:\)|$)"
    c = F.col(claim)
    steps = ("known", "own", "asides", "pieces", "in_asides", "tidy", "left")
    k, own, asides, parts, inside, tidy, left = (f"{out}__{s}" for s in steps)
    d = df.withColumns({k: tracked_tokens(support), own: tracked_tokens(c), asides: F.regexp_extract_all(c, F.lit(f"({aside})"), F.lit(1)), parts: F.split(c, aside, -1)})
    d = d.withColumn(inside, F.transform(asides, tracked_tokens))
    kept = F.transform(F.arrays_zip(F.col(asides).alias("a"), F.col(inside).alias("t")), lambda x: F.when(F.size(F.array_except(x["t"], F.col(k))) > 0, "").otherwise(x["a"]))
    joined = F.array_join(F.transform(F.arrays_zip(F.col(parts).alias("p"), F.concat(kept, F.array(F.lit(""))).alias("a")), lambda x: F.concat(x["p"], x["a"])), "")
    d = d.withColumn(tidy, F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s+([,.;:])", "$1"), r"\s+", " ")))
    d = d.withColumn(left, F.size(F.array_except(tracked_tokens(F.col(tidy)), F.col(k))))
    sound = F.size(F.array_except(F.col(own), F.col(k))) == 0
    return d.withColumn(out, F.when(sound, c).when(F.col(left) == 0, F.col(tidy)).otherwise("")).drop(*(f"{out}__{s}" for s in steps))


def consistent_weekdays(claim: Column, transcript: Column) -> Column:
    """The claim, unless it names weekdays that the two days of the month it names aren't: without the asides that name them, or empty if others are left.

    Year and month are those of the first date in the transcript's first HEAD_CHARS characters; a day that the month hasn't leaves nothing.
    """
    month = F.regexp_extract(F.substring(transcript, 1, HEAD_CHARS), r"(?U)\b(20\d{2}-\d{2})-\d{2}\b", 1)
    pair = r"(?U)\b([0-3]?\d)\s*(?:та|і|й|,|[-–])\s*([0-3]?\d)\s*числ\w*"

    def real(first: Column, norm: Column) -> Column:
        """The weekdays (from 0) of the two days, null for one that the month hasn't; first is the month's first day."""
        days = F.transform(F.array(*(F.regexp_extract(norm, pair, k) for k in (1, 2))), lambda d: d.try_cast("int"))
        return F.transform(days, lambda d: F.when(d.between(1, F.dayofmonth(F.last_day(first))), (F.weekday(first) + d - 1) % 7))

    def judged(text: Column, said: Column, days: Column) -> Column:
        same = said == F.array_sort(F.array_distinct(days))
        return F.when(F.exists(days, lambda d: d.isNull()), "").when(same, text).otherwise(bound(_without_days(text), lambda rest: F.when(_names_day(rest), "").otherwise(rest)))

    def known(text: Column, norm: Column, at: Column) -> Column:
        first = F.concat(at, F.lit("-01")).try_cast("date")
        told = bound(_days_said(norm), lambda said: F.when(F.size(said) == 0, text).otherwise(bound(real(first, norm), lambda days: judged(text, said, days))))
        return F.when(~((at != "") & norm.rlike(pair)), text).otherwise(told)

    # Each step is worked out once and handed on; most claims stop at the first ones.
    return bound(claim, lambda text: bound(evidence_norm(text), lambda norm: bound(month, lambda at: known(text, norm, at))))


#: All weekdays as one search: no word begins two of them, so what it finds is what seven searches find.
_ANY_DAY = rf"(?U)\b(?:{'|'.join(WEEKDAYS.values())})\b"
#: The first two characters of a weekday's word, and its number from 0.
_DAY_OF = {"по": 0, "mo": 0, "ві": 1, "tu": 1, "се": 2, "we": 2, "че": 3, "th": 3, "п ": 4, "пя": 4, "fr": 4, "су": 5, "sa": 5, "не": 6, "su": 6}


def _days_said(norm: Column) -> Column:
    """The weekdays (from 0) that normalised text names, sorted."""
    number = F.create_map(*(F.lit(x) for kv in _DAY_OF.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(norm, F.lit(f"({_ANY_DAY})"), F.lit(1)), lambda w: F.element_at(number, F.left(w, F.lit(2))))))


def _names_day(text: Column) -> Column:
    return evidence_norm(text).rlike(_ANY_DAY)


def _without_days(text: Column) -> Column:
    """Text without the asides that name a weekday, in single spaces."""
    asides = F.filter(F.regexp_extract_all(text, F.lit(r"(\s*\([^()]*(?:\)|$))"), F.lit(1)), _names_day)
    return F.trim(F.regexp_replace(F.aggregate(asides, text, lambda c, a: F.replace(c, a, F.lit(""))), r"(?U)\s+", " "))


def coerced_status(kind: Column, status: Column) -> Column:
    """Unknown statuses become their type's; completed actions are completed, decisions active unless superseded, open types never active."""
    known = F.when(status.isin(*STATUSES), status).when(kind == "completed_action", "completed").when(kind.isin(*OPEN_TYPES), "open").otherwise("active")
    return F.when(kind == "completed_action", "completed").when((kind == "decision") & (known != "superseded"), "active").when(kind.isin(*OPEN_TYPES) & (known == "active"), "open").otherwise(known)


def validated(items: DataFrame, proofs: DataFrame, lines: DataFrame) -> DataFrame:
    """Items of a known type with a claim and a verbatim proof: coerced, anchored, grounded; evidence as an array."""
    found = anchors(proofs, lines)
    by = found.groupBy("session", "item_id").agg(F.array_sort(F.collect_list(F.struct("proof_ord", "timestamp", "source_timestamp", "line", "speaker", "quote", "source_text"))).alias("evidence"))
    text = lines.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("transcript"))
    d = items.withColumn("claim", clean_text(F.col("claim"))).where(F.col("type").isin(*TYPES) & (F.col("claim") != "")).join(by, ["session", "item_id"]).join(text, "session")
    support = F.array_join(F.transform("evidence", lambda e: e["source_text"]), " ")
    said = lambda e: evidence_norm(e["source_text"])
    owns = lambda o: F.exists("evidence", lambda e: (evidence_norm(e["speaker"]) == evidence_norm(o)) & (cue(said(e), "first_person") | cue(said(e), "owner_accepts")))
    owners = F.filter(F.transform(F.coalesce("owners", F.array().cast("array<string>")), clean_text), lambda o: (o != "") & owns(o))
    inferred = F.array_distinct(F.transform(F.filter("evidence", lambda e: (F.coalesce(e["speaker"], F.lit("")) != "") & cue(said(e), "first_person")), lambda e: e["speaker"]))
    both = evidence_norm(F.concat_ws(" ", "claim", support))
    group = F.when(cue(both, "obligation") & cue(both, "managers"), F.array(F.lit("Hiring managers"))).when(cue(both, "obligation") & cue(both, "recruiters"), F.array(F.lit("Recruiters"))).otherwise(F.array().cast("array<string>"))
    owners = F.when((F.col("type") != "commitment") | (F.size(owners) > 0), owners).when(F.size(inferred) > 0, inferred).otherwise(group)
    due = clean_text(F.col("deadline"))
    due = F.when(F.contains(evidence_norm(F.col("transcript")), evidence_norm(due)), due).otherwise("")
    unclear = cue(evidence_norm(due), "two_days")
    d = ground_claims(d, "claim", support, "sound_claim")
    out = d.select(
        "session", "item_id", "type", F.col("sound_claim").alias("claim"), coerced_status(F.col("type"), F.trim("status")).alias("status"),
        F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("medium").alias("confidence"),
        F.when((F.col("type") == "commitment") & F.col("commitment_strength").isin("explicit", "soft"), F.col("commitment_strength")).otherwise("not_applicable").alias("commitment_strength"),
        owners.alias("owners"), F.when(unclear, "сьогодні або завтра").otherwise(due).alias("deadline"), unclear.alias("deadline_ambiguous"),
        F.coalesce(F.array_min(F.transform("evidence", lambda e: e["line"])), F.lit(0)).cast("long").alias("source_order"),
        F.coalesce(F.nullif(F.array_join(F.array_distinct(F.filter(F.transform("evidence", lambda e: e["speaker"]), lambda s: s.isNotNull() & (s != ""))), " / "), F.lit("")), F.lit("—")).alias("speaker"), "evidence",
    )
    return out.where("claim != ''")


def accepted(quotes: Column, cues: dict[str, str] = CUES) -> Column:
    """Explicit acceptance decides for, then a condition against, then a strong wording for a decision."""
    any_ = lambda n: F.exists(quotes, lambda q: cue(evidence_norm(q), n, cues))
    return F.when(any_("accepted"), True).when(any_("conditional"), False).otherwise(any_("strong"))


def lifecycle(items: DataFrame, cues: dict[str, str] = CUES) -> DataFrame:
    """Generic offers of help go; commitments already done are completed actions; decisions nobody accepted are proposals. Needs quotes."""
    q = F.col("quotes")
    any_ = lambda n: F.exists(q, lambda x: cue(evidence_norm(x), n, cues))
    offer = (F.col("type") == "commitment") & (F.coalesce("deadline", F.lit("")) == "") & cue(evidence_norm(F.col("claim")), "help_claim", cues) & cue(F.array_join(F.transform(q, evidence_norm), " "), "help_quote", cues)
    done = (F.col("type") == "commitment") & F.exists(q, lambda x: cue(evidence_norm(x), "completed", cues) & ~cue(evidence_norm(x), "first_person", cues))
    loose = (F.col("type") == "decision") & (F.col("status") == "active") & ~accepted(q, cues)
    return items.where(~offer).withColumns({
        "type": F.when(done, "completed_action").when(loose, "proposal").otherwise(F.col("type")),
        "status": F.when(done, "completed").when(loose, "open").otherwise(F.col("status")),
        "lifecycle_reason": F.when(loose & any_("conditional"), "conditional_decision"),
    })


def grounded_language(claim: Column, quotes: Column, letters: str = "А-Яа-яІіЇїЄєҐґ", least: float = 0.2) -> Column:
    """The longest quote in place of a claim of which less than a fifth of the letters are of the transcript's script."""
    own, every = F.length(F.regexp_replace(claim, f"[^{letters}]", "")), F.length(F.regexp_replace(claim, f"[^A-Za-z{letters}]", ""))
    longest = F.aggregate(F.transform(quotes, clean_text), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    use = (every > 0) & (own < least * every) & longest.rlike(f"[{letters}]")
    return F.when(use, F.concat(F.upper(F.substring(longest, 1, 1)), F.substring(longest, 2, 2**31 - 1))).otherwise(claim)


def claim_tokens(items: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """by, item_id, the distinct words of the claim in their order by code point, and a name of that set; claims without a word are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(evidence_norm(F.col("claim")), " "), lambda x: x != "")))
    return items.select(*by, "item_id", words.alias("tokens")).where(F.size("tokens") > 0).withColumn("set", F.sha2(F.array_join("tokens", " "), 256))


def claim_classes(items: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, item_id, representative): the least item_id among claims of the same words stands for them all."""
    t = claim_tokens(items, by).select(*by, "item_id", "set").alias("t")
    least = t.groupBy(*by, "set").agg(F.min("item_id").alias("representative")).alias("r")
    return t.join(least, [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "set")]).select(*(F.col(f"t.{c}") for c in by), "item_id", "representative")


def duplicate_pairs(items: DataFrame, least: float = 0.84, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, a, b, similarity) with a < b whose claims' token sets have that Jaccard similarity at least.

    a and b are representatives: n claims of the same words are one here, see claim_classes() for the members. item_id is unique within by.
    Prefix filtering: in one global order of tokens, rarest first, two such sets share a token among their first
    size - ceil(least * size) + 1 ones. So only those are joined on; lengths must fit, and places leave room for enough shared tokens. Tokens cross as 64-bit
    hashes, and only prefixes do; texts of the few pairs that are left decide. Of two sets at least as many tokens are in one alone as the bits in which
    their marks differ, a mark having a bit set where an odd number of tokens fall on it: that rules out most pairs inside the join.
    """
    every = claim_tokens(items, by)
    hashed = every.select(*by, "item_id", "set", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"))
    df = hashed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    common = df.where("df > 1").orderBy(F.desc("df"), "token").limit(MOST_COMMON).toArrow()
    token = common.column("token").to_numpy()
    known = items.sparkSession.sparkContext.broadcast((np.sort(token), (len(token) - np.argsort(token)).astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, level = known.value
        for b in batches:
            column = b.column(b.schema.get_field_index("tokens"))
            flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
            at = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
            place = np.where(tokens[at] == flat, level[at], 0) if len(tokens) else np.zeros(len(flat), np.int64)
            first, marks = [], np.zeros((b.num_rows, MARK), np.int64)
            for i, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                own, n = flat[low:high], high - low
                order = np.lexsort((own, place[low:high]))[: n - math.ceil(n * least - 1e-9) + 1]
                first.append(own[order])
                odd = np.bincount((own.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * MARK), minlength=64 * MARK) % 2
                marks[i] = np.packbits(odd.astype(bool)).view(np.int64)
            keep = [b.column(b.schema.get_field_index(c)) for c in (*by, "item_id", "set")]
            size = pc.list_value_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, size, pa.array(first, pa.list_(pa.int64())), *(pa.array(marks[:, k].copy()) for k in range(MARK))], names=[*by, "item_id", "set", "n", "prefix", *bits])

    bits = [f"mark{k}" for k in range(MARK)]
    kinds = dict(hashed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "item_id", "set")) + ", n long, prefix array<bigint>, " + ", ".join(f"{c} long" for c in bits)
    short = hashed.mapInArrow(prefixes, schema)
    same = F.row_number().over(Window.partitionBy(*by, "set").orderBy("item_id"))
    pre = short.withColumn("same", same).where("same = 1").select(*by, "item_id", "n", *bits, F.posexplode("prefix").alias("nth", "token"))
    a, b = pre.alias("a"), pre.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "token")] + [F.col("a.item_id") < F.col("b.item_id"), F.col("a.n") >= F.col("b.n") * least, F.col("b.n") >= F.col("a.n") * least]
    # From their first shared token on, two such sets have enough tokens left to be that similar.
    on.append(F.least(F.col("a.n") - F.col("a.nth"), F.col("b.n") - F.col("b.nth")) >= (F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in bits), F.lit(0))
    on.append(apart <= (F.col("a.n") + F.col("b.n")) * ((1 - least) / (1 + least)) + 1e-9)
    cand = a.join(b, on).select(*(F.col(f"a.{c}") for c in by), F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).distinct()
    j = cand.alias("c")
    for side in ("a", "b"):
        own = [F.col(f"c.{c}").eqNullSafe(F.col(f"{side}.{c}")) for c in by]
        j = j.join(every.alias(side), [F.col(f"c.{side}") == F.col(f"{side}.item_id"), *own])
    j = j.select(*(F.col(f"c.{c}") for c in by), F.col("c.a"), F.col("c.b"), F.col("a.tokens").alias("ta"), F.col("b.tokens").alias("tb"))
    return j.withColumn("similarity", jaccard(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= least).select(*by, "a", "b", "similarity")


def rank_of(column: str, ranks: dict[str, int], default: int = 0) -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in ranks.items()), F.lit(default))


def survivors(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """The preferred item of each group of duplicates: by type, status, number of proofs, order, then smallest id."""
    score = F.struct(rank_of("type", TYPE_RANK), rank_of("status", STATUS_RANK), F.col("n_evidence"), F.col("source_order"), -F.col("item_id"))
    return items.groupBy(*group).agg(F.max_by("item_id", score).alias("survivor"), F.count(F.lit(1)).alias("merged"), F.sum("n_evidence").alias("n_evidence"), F.min(F.when(F.col("source_order") > 0, F.col("source_order"))).alias("source_order"))


def qa_findings() -> list[tuple[str, str, Column]]:
    """Over items with is_accepted; duplicates are a matter of duplicate_pairs()."""
    c = F.col
    return [
        ("unaccepted_decision", "error", (c("type") == "decision") & (c("status") == "active") & ~c("is_accepted")),
        ("missing_owner", "warning", (c("type") == "commitment") & (c("status") == "open") & (F.size("owners") == 0)),
        ("missing_source_anchor", "warning", (c("n_evidence") > 0) & (F.coalesce("source_order", F.lit(0)) == 0)),
        ("ambiguous_deadline", "warning", F.coalesce("deadline_ambiguous", F.lit(False))),
    ]


def ledger_order() -> Column:
    return F.coalesce(F.nullif(F.col("source_order"), F.lit(0)), F.lit(LAST))


def even_picks(items: DataFrame, picks: int = 5) -> DataFrame:
    """Items at round(i * (n - 1) / (picks - 1)) of each session's order, halves to even; all of them if they are no more than picks."""
    w = Window.partitionBy("session")
    d = items.withColumn("at", F.row_number().over(w.orderBy(ledger_order(), "item_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (picks - 1), 0).cast("int"))
    return d.where((F.col("n") <= picks) | F.array_contains(places, F.col("at").cast("int"))).drop("n")


def top_items(items: DataFrame, types: Sequence[str], limit: int = 10) -> DataFrame:
    """The first `limit` live items of the given types in each session's order."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy(ledger_order(), "item_id"))
    return items.where(F.col("type").isin(*types) & (F.col("status") != "superseded")).withColumn("nth", nth).where(F.col("nth") <= limit)


def render_sections(items: DataFrame, headings: dict[str, str]) -> DataFrame:
    """session and body: a heading per type in the given order and its claims, first spelling of each only; actions show owners and deadline."""
    nth = F.row_number().over(Window.partitionBy("session", "type", evidence_norm(F.col("claim"))).orderBy(ledger_order(), "item_id"))
    owners = F.when(F.size("owners") > 0, F.concat(F.lit("["), F.array_join("owners", ", "), F.lit("] "))).otherwise("")
    due = F.when(F.coalesce("deadline", F.lit("")) != "", F.concat(F.lit(" — дедлайн: "), "deadline")).otherwise("")
    action = F.col("type") == "commitment"
    line = F.concat(F.lit("- "), F.when(action, owners).otherwise(""), "claim", F.when(action, due).otherwise(""))
    place = rank_of("type", {t: i for i, t in enumerate(headings)}, len(headings))
    d = items.where(F.col("type").isin(*headings)).withColumn("nth", nth).where("nth = 1").select("session", "type", place.alias("place"), ledger_order().alias("o"), "item_id", line.alias("line"))
    sec = d.groupBy("session", "type", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "item_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    title = F.coalesce(*(F.when(F.col("type") == t, F.lit(h)) for t, h in headings.items()))
    return sec.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(title, F.lit("\n"), "body").alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
