"""Personal data: regular expressions propose spans, checks confirm them, nearby words adjust a score. SQL functions only.

The four base kinds are fixed: a match that fails its check (Luhn, address parts, number of digits) is dropped and
not tried again at another place. Further kinds (IBAN, social security number, secret) stand if their score, which a
checksum and the words shortly before the span raise or lower, reaches ACCEPT. Base spans stay whatever their score.

Null text counts as empty: no spans, and the hash of the empty string. Rows are independent, so repeated rows and ties
don't matter; other columns stay as they are, whatever their names (only a column called like the one asked for gives way to it). The time of a text grows with its length and its
matches, not with their squares: places are running totals by blocks, and words near a span are cut from pieces of the text. All patterns are possessive and anchored at run starts, so that texts of one endless
run of digits or letters take linear time and no stack. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from .common import documents, spare

#: kind -> (pattern, characters that any match holds). (?:\G|(?<!x)) starts at a run's start or where the match before
#: ended, which are the only places where leftmost matches can start; ++ never gives back, and needn't here.
KINDS: dict[str, tuple[str, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "secret": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9_-])", ""),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a match before its surroundings, what a passed checksum adds, what a word of the kind nearby adds.
START = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3, "secret": 0.2}
CHECKED = {"card": 0.4, "iban": 0.5}
NEARBY, AGAINST = 0.4, -0.3
ACCEPT = 0.6
#: Characters before a span in which its words are looked for.
REACH = 40
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|ip",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "secret": "token|secret|password|passwd|api.?key|access.?key|bearer",
}
#: Words that speak against the kind.
COUNTER = {"card": "order|serial|invoice", "ip": "version|release", "phone": "isbn|serial", "ssn": "isbn|part|model", "secret": "sha1|commit|digest|checksum"}
SPAN = "array<struct<s:int,e:int,kind:string,rank:int,score:double>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Every second digit from the right doubled, its digits added: the sum ends in 0."""
    d = F.split(F.reverse(_digits(v)), "")
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.try_to_number(c, F.lit("9")).cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(v: Column) -> Column:
    """The first four characters at the end, letters as 10 to 35: the number leaves 1."""
    s = F.regexp_replace(v, r"\x20", "")
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97) == 1


def _confirmed(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & luhn(v)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(v)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    pattern, hint = KINDS[kind]
    may = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _placed(text: Column, kind: str, found: Column) -> Column:
    """The matches with their places: between them stands what split() leaves, so lengths add up to ends."""
    gaps = F.split(text, KINDS[kind][0], -1)
    lengths = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")), lambda x: F.length(x["g"]) + F.length(x["m"]))
    ends = arrays.running(lengths, lambda a, b: a + b, F.lit(0))
    placed = F.transform(F.arrays_zip(found.alias("m"), ends.alias("e")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("v")))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def _scored(pieces: Column, kind: str, placed: Column) -> Column:
    ok = F.filter(placed, lambda x: _confirmed(kind, x["v"]))

    def score(x: Column) -> Column:
        before = F.lower(arrays.part(pieces, F.greatest(x["s"] - REACH, F.lit(0)), x["s"]))

        def of(before: Column) -> Column:
            out = F.lit(START[kind] + CHECKED.get(kind, 0.0)) + F.when(before.rlike(CONTEXT[kind]), NEARBY).otherwise(0.0)
            return out + (F.when(before.rlike(COUNTER[kind]), AGAINST).otherwise(0.0) if kind in COUNTER else 0.0)

        return arrays.bound(before, of)

    rank = list(KINDS).index(kind)
    spans = F.transform(ok, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), score(x).alias("score")))
    return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= ACCEPT)


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with a column `out`, an array of (s, e, kind, rank, score), ordered by start and kind; code points, end exclusive."""
    made = {k: (spare(docs, f"{out}__m_{k}"), spare(docs, f"{out}__p_{k}")) for k in KINDS}
    cut = spare(docs, f"{out}__cut")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Each step in a projection of its own, so that no regular expression runs twice.
    d = docs.withColumns({m: _matches(t, k) for k, (m, _) in made.items()})
    none = reduce(Column.__and__, (F.size(m) == 0 for m, _ in made.values()))
    d = d.withColumns({p: _placed(t, k, F.col(m)) for k, (m, p) in made.items()} | {cut: F.when(~none, arrays.pieces(t))})
    d = d.withColumn(out, F.concat(*(_scored(F.col(cut), k, F.col(p)) for k, (_, p) in made.items())).cast(SPAN))
    in_order = lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    return d.withColumn(out, F.array_sort(out, in_order)).drop(cut, *(c for pair in made.values() for c in pair))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; spans that overlap become one, named after the first, and the longest of those."""
    found = spare(docs, "pii__spans")
    far, cut = spare(docs, "pii__far"), spare(docs, "pii__cut")
    first = F.array_sort(found, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    d = with_spans(docs, out=found).withColumn(found, first)
    d = d.withColumn(far, arrays.running(F.transform(found, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0)))
    d = d.withColumn(cut, F.when(F.size(found) > 0, arrays.pieces(F.col("text").cast("string"))))
    # A span that begins before the farthest end so far belongs to the group before it.
    heads = F.filter(F.transform(found, lambda x, i: F.when((i == 0) | (x["s"] >= F.get(F.col(far), i - 1)), F.struct(x["s"].alias("s"), x["kind"].alias("kind"), i.alias("i")))), lambda x: x.isNotNull())

    def joined(heads: Column) -> Column:
        begin = lambda x: F.when(x["i"] == 0, 0).otherwise(F.get(F.col(far), x["i"] - 1))
        body = F.transform(heads, lambda x: F.concat(arrays.part(F.col(cut), begin(x), x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(body, ""), arrays.part(F.col(cut), F.element_at(F.col(far), -1), F.length(F.col("text").cast("string"))))

    clean = arrays.bound(heads, joined)
    return d.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text"))).drop(found, far, cut)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_spans(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), out="found")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return d.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
