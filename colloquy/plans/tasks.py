"""Task queries: orders play commitments, customers play notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tasks as T
from ..sources.tables import table
from .registry import query


@query("""with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders)
select 'note-' || o_custkey as note, k as ord, 'Order ' || o_orderkey || ' today' as name, 'Clerk ' || o_custkey as involved from n""")
def tasks_from_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note a customer: a bullet for each order, nested ones inherit the owner, a second line continues each."""
    o = table(spark, sf_dir, "orders").withColumn("first", F.min("o_orderkey").over(_by_customer()))
    top = F.col("o_orderkey") == F.col("first")
    bullet = F.concat(F.when(top, F.concat(F.lit("- **[Clerk "), "o_custkey", F.lit("]** "))).otherwise("  - "), F.lit("`Order` [" ), "o_orderkey", F.lit("](http://x/y)\ntoday — без дедлайну."))
    notes = o.groupBy(F.concat(F.lit("note-"), "o_custkey").alias("note")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", bullet.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return T.from_bullets(notes.select("note", F.concat(F.lit("# T\n## Summary\n- no\n## Action items\n"), "body", F.lit("\n## End\n- no")).alias("markdown")))


def _by_customer():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey")


_LEDGER = """t as (select o_orderkey as item_id, 'note-' || o_custkey as note, 'Deliver ' || o_orderpriority as claim, case when o_totalprice > 200000 then 'soft' else 'explicit' end as st, strftime(o_orderdate, '%Y-%m') as due, case when o_custkey % 2 = 0 then 'Ann Lee, Clerk ' || o_custkey % 10 else 'Clerk ' || o_custkey % 10 end as involved from orders where o_orderstatus = 'O'),
 d as (select *, row_number() over (partition by note, trim(regexp_replace(lower(claim), '[^\\p{L}\\p{N}_]+', ' ', 'g')) order by item_id) as k from t),
 f as (select note, case when st = 'soft' then 'Спробувати: ' else '' end || claim || ' — дедлайн: ' || due as name, involved from d where k = 1), g as (select *, sha256(note || chr(10) || lower(name) || chr(10) || lower(involved)) as fingerprint from f)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    clerk = F.concat(F.lit("Clerk "), F.col("o_custkey") % 10)
    return T.from_ledger(o.select(
        F.col("o_orderkey").alias("item_id"), F.concat(F.lit("note-"), "o_custkey").alias("note"), F.lit("commitment").alias("type"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("completed").alias("status"), F.concat(F.lit("Deliver "), "o_orderpriority").alias("claim"),
        F.when(F.col("o_totalprice") > 200_000, "soft").otherwise("explicit").alias("commitment_strength"), F.date_format("o_orderdate", "yyyy-MM").alias("deadline"), F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("Ann Lee"), clerk)).otherwise(F.array(clerk)).alias("owners"), F.col("o_orderkey").alias("source_order"),
    ))


@query(f"with {_LEDGER} select * from g")
def tasks_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir)


@query(f"with {_LEDGER} select * from g where involved like 'Ann Lee%' and fingerprint not in (select fingerprint from g where fingerprint < '8')")
def tasks_pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of one person that are not on the board; half of all fingerprints are."""
    t = _tasks(spark, sf_dir)
    return T.pending(t, t.where("fingerprint < '8'").select("fingerprint"), ["ann lee"]).select("note", "name", "involved", "fingerprint")


@query("""select c_custkey, case c_custkey % 4 when 0 then 'Ann, Bob' when 1 then 'Bob_1' when 2 then '' else 'Team 7' end as involved, 'key hf_*** end' as log from customer""")
def owner_labels_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "**S1**, [S10](http://a)").when(k % 4 == 1, "S10_1").when(k % 4 == 2, "— немає.").otherwise("Team 7")
    names = {"S1": "Ann", "S10": "Bob", "S10_1": "Bob_1"}
    return table(spark, sf_dir, "customer").select("c_custkey", T.resolve_owners(raw, names).alias("involved"), T.redact(F.concat(F.lit("key hf_Ab"), k, F.lit(" end"))).alias("log"))
