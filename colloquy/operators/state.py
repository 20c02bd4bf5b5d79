"""Session state: retries, refreshes, retention, silence; all as projections and windows over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, BASE_S, MOST_S = 5, 60, 3600


def backoff(attempts: Column, most_power: int | None = None) -> Column:
    """Seconds to wait after so many attempts: doubling from a minute up to an hour."""
    power = attempts - 1 if most_power is None else F.least(attempts - 1, F.lit(most_power))
    return F.least(F.lit(MOST_S), BASE_S * F.pow(F.lit(2), F.least(power, F.lit(20)))).cast("long")


def retry_schedule(failures: DataFrame) -> DataFrame:
    """session, at, kind (of failures) with attempts, same_kind, terminal and wait_s.

    same_kind counts failures of one kind on end; two empty responses on end, or MAX_ATTEMPTS attempts, are terminal.
    """
    by = Window.partitionBy("session").orderBy("at", "id")
    d = failures.withColumn("attempts", F.row_number().over(by)).withColumn("turn", F.sum((~F.col("kind").eqNullSafe(F.lag("kind").over(by))).cast("int")).over(by))
    d = d.withColumn("same_kind", F.row_number().over(Window.partitionBy("session", "turn").orderBy("at", "id")))
    terminal = (F.col("attempts") >= MAX_ATTEMPTS) | ((F.col("kind") == "empty_response") & (F.col("same_kind") >= 2))
    return d.withColumn("terminal", terminal).withColumn("wait_s", F.when(~F.col("terminal"), backoff(F.col("attempts")))).drop("turn")


def fuller_exports(exports: DataFrame) -> DataFrame:
    """One export a session: the first with the most entries and, among those, the latest end. Equal ones are duplicates of the first."""
    score = F.struct("n_entries", "max_end_ms", (-F.col("arrival")).alias("o"))
    return exports.groupBy("session").agg(F.max_by(F.struct("arrival", "n_entries", "max_end_ms"), score).alias("b"), F.count(F.lit(1)).alias("exports")).select("session", "b.*", "exports")


def upsert_exports(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """session, n_entries, max_end_ms, action after a batch: imported, refreshed (strictly fuller) or duplicate."""
    best = incoming.groupBy("session").agg(F.max(F.struct("n_entries", "max_end_ms")).alias("new"))
    j = current.select("session", F.struct("n_entries", "max_end_ms").alias("old")).join(best, "session", "full")
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "imported").when(F.col("new") > F.col("old"), "refreshed").otherwise("duplicate")
    pick = F.when(action.isin("imported", "refreshed"), F.col("new")).otherwise(F.col("old"))
    return j.select("session", pick.alias("s"), action.alias("action")).select("session", "s.*", "action")


def retention(states: DataFrame, now: Column, days: int) -> DataFrame:
    """Complete sessions whose output exists and that are older than so many days."""
    return states.where((F.col("status") == "complete") & F.col("has_output") & (F.col("finished_at") < now - F.expr(f"interval {days} days")))


def silences(signals: DataFrame, quiet_ms: int, grace_ms: int) -> DataFrame:
    """Stretches in which both tracks of a session were silent for quiet_ms: session, silent_from, silent_to.

    signals: session, ms, id, track, active. Counting begins when both tracks have been seen and grace_ms after the start. A silence ends
    with the next active signal of either track, or the session's last signal.
    """
    by = Window.partitionBy("session").orderBy("ms", "id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    d = signals.withColumns({
        "start": F.min("ms").over(Window.partitionBy("session")), "end": F.max("ms").over(Window.partitionBy("session")),
        "both": (F.count_if(F.col("track") == "mic").over(so_far) > 0) & (F.count_if(F.col("track") == "system").over(so_far) > 0),
    })
    d = d.withColumn("ready", F.min(F.when(F.col("both"), F.col("ms"))).over(Window.partitionBy("session")))
    act = d.where("active").withColumn("to", F.coalesce(F.lead("ms").over(by), F.col("end")))
    out = act.where((F.col("to") - F.col("ms") >= quiet_ms) & (F.col("to") >= F.col("start") + grace_ms) & (F.col("ready") <= F.col("to")))
    return out.select("session", F.col("ms").alias("silent_from"), F.col("to").alias("silent_to"))
