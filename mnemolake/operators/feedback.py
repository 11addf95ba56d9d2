"""Feedback: attribution of signals to recalls, and the usefulness of recalled memories. All sessions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import at

# Signal types, and constants of the scores.
SIGNALS = ("session_success", "session_failure", "build_passed", "test_passed", "correction", "error_resolved", "error_free_run", "tool_error", "explicit_boost")
ALIASES = {"test_pass": "test_passed"}
WINDOW_MINUTES, LEAST_SIGNALS, POSITION_DISCOUNT = 60, 2, 0.3


def signal_type(c: Column) -> Column:
    """The known name, or null."""
    for old, new in ALIASES.items():
        c = F.when(c == old, new).otherwise(c)
    return F.when(c.isin(*SIGNALS), c)


def _minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def attribute(signals: DataFrame, recalls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each signal with the session's latest recall up to an hour before it; none after the session's end.

    An as-of join as one window over the union of both logs: the last recall
    carried forward, so the rows of a session are sorted once and never paired.
    """
    ends = sessions.select(F.col("id").alias("session_id"), "ended_at")
    r = recalls.select("session_id", F.col("recalled_at").alias("at"), F.lit(0).alias("kind"), F.col("id").alias("recall"), F.lit(None).cast("string").alias("signal"))
    s = signals.select("session_id", F.col("occurred_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("recall"), F.col("id").alias("signal"))
    upto = Window.partitionBy("session_id").orderBy("at", "kind", F.desc("recall")).rowsBetween(Window.unboundedPreceding, 0)
    x = r.unionByName(s).withColumn("last", F.last(F.when(F.col("kind") == 0, F.struct("at", "recall")), ignorenulls=True).over(upto)).where(F.col("kind") == 1)
    x = x.join(ends, "session_id", "left")
    ok = (F.col("last.at") >= F.col("at") - _minutes(WINDOW_MINUTES)) & (F.col("ended_at").isNull() | (F.col("at") <= F.col("ended_at")))
    return x.select(F.col("signal").alias("id"), "session_id", F.when(ok, F.col("last.recall")).alias("recall_event_id"))


def score(recalls: DataFrame, signals: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """(memory_id, recall_event_id, effectiveness, signal_count, computed_at) of all completed sessions."""
    ends = sessions.where(F.col("ended_at").isNotNull()).select(F.col("id").alias("session_id"), "ended_at")
    r = recalls.where(F.size("memory_ids") > 0).join(ends, "session_id").withColumn("until", F.least(F.col("ended_at"), F.col("recalled_at") + _minutes(WINDOW_MINUTES))).where(F.col("until") > F.col("recalled_at"))
    s = signals.where((F.col("signal_value") != 0) & signal_type(F.col("signal_type")).isNotNull()).select("session_id", F.col("recall_event_id").alias("of"), "signal_type", "signal_value", "occurred_at")
    r = r.select(F.col("id").alias("recall"), "session_id", "recalled_at", "until", "memory_ids")
    # Signals that name their recall meet it by its id, the others by session and hour: a recall's window lies in two hours at most.
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (WINDOW_MINUTES * 60_000_000)).cast("long")
    spans = r.select("recall", "session_id", "recalled_at", "until")
    bound = spans.join(s.where(F.col("of").isNotNull()), (F.col("recall") == F.col("of")) & (spans["session_id"] == s["session_id"])).select("recall", "signal_value")
    free = s.where(F.col("of").isNull() | F.col("signal_type").isin("session_success", "session_failure")).withColumn("slot", slot("occurred_at"))
    spans = spans.withColumn("slot", F.explode(F.array_distinct(F.array(slot("recalled_at"), slot("until")))))
    near = spans.join(free, ["session_id", "slot"]).where(F.col("occurred_at").between(F.col("recalled_at"), F.col("until")) & ~F.coalesce(F.col("of") == F.col("recall"), F.lit(False)))
    hit = bound.unionByName(near.select("recall", "signal_value"))
    sums = hit.groupBy("recall").agg(F.count("*").alias("n"), F.sum("signal_value").alias("total"), F.sum(F.abs("signal_value")).alias("size"))
    x = r.join(sums, "recall", "left")
    raw = F.when(F.coalesce("n", F.lit(0)) < LEAST_SIGNALS, 0.0).otherwise(F.col("total") / F.greatest("size", F.lit(1)))
    x = x.select("recall", raw.alias("raw"), F.coalesce("n", F.lit(0)).alias("n"), F.posexplode("memory_ids").alias("i", "memory_id"))
    return x.select("memory_id", F.col("recall").alias("recall_event_id"), (F.col("raw") / (1 + POSITION_DISCOUNT * F.col("i"))).alias("effectiveness"), F.col("n").alias("signal_count"), at(as_of).alias("computed_at"))


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores, with the time of the first computation kept."""
    key = ["memory_id", "recall_event_id"]
    n = new.groupBy(*key).agg(F.max_by("effectiveness", "effectiveness").alias("effectiveness"), F.max("signal_count").alias("signal_count"), F.max("computed_at").alias("computed_at"))
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("effectiveness", "signal_count", "computed_at")])
    x = n.join(o, key, "full_outer")
    return x.select(*key, F.coalesce("effectiveness", "o_effectiveness").alias("effectiveness"), F.coalesce("signal_count", "o_signal_count").alias("signal_count"), F.coalesce("o_computed_at", "computed_at").alias("computed_at"))


def log(table: DataFrame, new: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with new recalls or signals, and those that are refused.

    The project comes from the session. A row that names an unknown session, or
    another project than its session's, is refused, as is a signal of unknown type.
    """
    of = sessions.select(F.col("id").alias("session_id"), F.col("project").alias("_project"), F.col("ended_at").alias("_ended"), F.lit(True).alias("_known"))
    x = new.join(of, "session_id", "left")
    bad = F.col("session_id").isNotNull() & (F.col("_known").isNull() | (F.col("project").isNotNull() & ~F.col("project").eqNullSafe(F.col("_project"))))
    if "signal_type" in new.columns:
        x = x.withColumn("_type", signal_type(F.col("signal_type")))
        bad |= F.col("_type").isNull()
        ends = F.col("_type").isin("session_success", "session_failure") & F.col("_ended").isNotNull()
        x = x.withColumns({"signal_type": F.coalesce("_type", "signal_type"), "occurred_at": F.when(ends, F.col("_ended")).otherwise(F.col("occurred_at"))})
    x = x.withColumn("_bad", bad).withColumn("project", F.coalesce("project", "_project"))
    kept = x.where(~F.col("_bad")).select(*new.columns)
    return table.unionByName(kept, allowMissingColumns=True), x.where(F.col("_bad")).select(*new.columns)


def between(table: DataFrame, moment: str, start: str, end: str, project: str | None = None) -> DataFrame:
    """Recalls or signals of a window, newest first, both ends included."""
    keep = F.col(moment).between(at(start), at(end))
    return table.where(keep if project is None else keep & (F.col("project") == project)).orderBy(F.desc(moment), "id")


def counts(signals: DataFrame, start: str | None = None, end: str | None = None, kind: str | None = None, project: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if start is not None:
        keep &= F.col("occurred_at") >= at(start)
    if end is not None:
        keep &= F.col("occurred_at") <= at(end)
    if kind is not None:
        keep &= F.col("signal_type") == kind
    if project is not None:
        keep &= F.col("project") == project
    return signals.where(keep).agg(F.count("*").alias("n"))
