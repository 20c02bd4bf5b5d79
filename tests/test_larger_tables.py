"""What larger tables bring that the smallest don't: keys of any size, sessions and texts of many more rows."""

from __future__ import annotations

import duckdb
import pytest

from colloquy.plans import registry


def rows_and_sql(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL, over the tables given as DataFrames."""
    con = duckdb.connect()
    for t, d in tables.items():
        d.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=str), sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("customer", [7777, 8888, 77771, 88880, 888812])
def test_numbers_of_no_customer(spark, tmp_path, customer):
    """A customer's key supports no number but its own, whatever it is or begins with."""
    orders = spark.createDataFrame([(k, customer) for k in range(1, 7)], "o_orderkey long, o_custkey long")
    got, want = rows_and_sql(spark, tmp_path, "claim_token_grounding", orders=orders)
    assert got == want


def test_weekdays_are_worked_out_once(spark):
    """The rule's plan names the claim's normal form once, however many of its steps use it; it was in there 82 times."""
    from pyspark.sql import functions as F

    from colloquy.operators import ledger

    d = spark.createDataFrame([("Зустріч 5 та 7 числа (понеділок)", "2024-02-05"), ("29 та 30 числа, monday", "2023-02-01"), ("5 та 6 числа monday", "2024-13-01"), ("0 та 6 числа (monday)", "2024-02-05")], "c string, t string")
    d = d.select(ledger.consistent_weekdays(F.col("c"), F.col("t")).alias("c"))
    assert [r.c for r in d.collect()] == ["Зустріч 5 та 7 числа", "", "", ""]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower(") < 10


def test_similar_claims_meet_by_short_rows(spark):
    """Pairs are those of brute force, and what is joined to find them are prefixes of hashes: texts of unlike claims are never in a shuffle of pairs."""
    import random

    from colloquy.operators import ledger

    rng = random.Random(12)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    claims = [" ".join(w if rng.random() > 0.05 else f"v{rng.randrange(9)}" for w in rng.choice(base)) for _ in range(300)] + ["", " . ", "x", "X!"]
    lang = [rng.choice(["en", None]) for _ in claims]
    d = spark.createDataFrame([(k, g, c) for k, (g, c) in enumerate(zip(lang, claims, strict=True))], "item_id long, lang string, claim string")
    sets, least = {}, {}
    for k, (g, c) in enumerate(zip(lang, claims, strict=True)):
        words = frozenset(c.lower().replace("!", " ").replace(".", " ").split())
        if words and (g, words) not in least:
            least[g, words] = k
            sets[k] = g, words
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.84 * len(sets[a][1] | sets[b][1])}
    found = ledger.duplicate_pairs(d, 0.84, ["lang"])
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "mapinarrow" in plan.lower() and "bit_count" in plan
