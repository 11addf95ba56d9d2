"""Training examples from memories and sessions, in three formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import SESSION_TOLERANCE, session_record, unmatched
from .memory import active, in_project


def examples(memories: DataFrame, sessions: DataFrame, project: str | None = None, effects: DataFrame | None = None) -> DataFrame:
    """(topic, summary, weight, access_count, effectiveness, source_id): telling topics, sessions, and session memories that no session stands for."""
    m = memories.where(active() & in_project(project))
    told = (F.col("topic").isin("errors/resolved", "corrections")) | F.col("topic").startswith("decisions/") | F.col("topic").startswith("context/")
    cols = ["topic", "summary", "weight", "access_count", F.col("id").alias("source_id")]
    out = m.where(told).select(*cols)
    s = sessions.where(F.col("summary").isNotNull() & in_project(project))
    s = s.select(F.concat(F.lit("session/"), "project").alias("topic"), session_record(F.col("task"), F.col("summary")).alias("summary"), F.coalesce("ended_at", "started_at").alias("at"))
    legacy = m.where(F.col("topic").startswith("session/"))
    left = unmatched(legacy.select("topic", "summary", F.col("created_at").alias("at"), "id"), s, ["topic", "summary"], SESSION_TOLERANCE)
    out = out.unionByName(s.select("topic", "summary", F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("access_count"), F.lit(None).cast("string").alias("source_id")))
    out = out.unionByName(legacy.join(left, "id", "left_semi").select(*cols))
    if effects is None:
        return out.withColumn("effectiveness", F.lit(None).cast("double"))
    e = effects.groupBy(F.col("memory_id").alias("source_id")).agg(F.avg("effectiveness").alias("effectiveness"))
    return out.join(e, "source_id", "left")


def quality(rows: DataFrame, weight: float | None = None, recalls: int | None = None, effectiveness: float | None = None) -> DataFrame:
    """Bounds that hold where the value is known; effectiveness binds only rows with an id."""
    keep = F.lit(True)
    if weight is not None:
        keep &= F.col("weight") >= weight
    if recalls is not None:
        keep &= F.coalesce(F.col("access_count") >= recalls, F.lit(True))
    if effectiveness is not None:
        keep &= F.col("source_id").isNull() | F.coalesce(F.col("effectiveness") >= effectiveness, F.lit(False))
    return rows.where(keep)


def sft(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("What is our convention for: "), "topic").alias("instruction"), F.col("summary").alias("response"))


def alpaca(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("Topic: "), "topic").alias("instruction"), F.lit("").alias("input"), F.col("summary").alias("output"))


def dpo(rows: DataFrame) -> DataFrame:
    """Corrections with an original and a corrected line, the last of each, both with content; the most useful first."""
    def line(name: str):
        found = F.regexp_extract_all("summary", F.lit(rf"(?m)^{name}:(.*)$"), F.lit(1))
        return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))

    x = rows.where((F.col("topic") == "corrections") | F.contains(F.col("summary"), F.lit("Original:")))
    x = x.withColumn("rejected", line("Original")).withColumn("chosen", line("Correction")).where((F.col("rejected") != "") & (F.col("chosen") != ""))
    x = x.orderBy(F.desc_nulls_last("effectiveness"), F.desc("weight"), "topic", "summary")
    return x.select(F.concat(F.lit("Fix the code: "), "topic").alias("prompt"), "chosen", "rejected")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
