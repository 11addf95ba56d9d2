"""Reads, counts and aggregates over memories: filters pushed to the scan, one grouping each."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(as_of: str | datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def in_project(project: str | None) -> Column:
    """Null means all projects; a name leaves out rows without a project."""
    return F.lit(True) if project is None else F.coalesce(F.col("project") == project, F.lit(False))


def active() -> Column:
    return F.col("invalidated_at").isNull()


def days_before(as_of: str, days: float) -> Column:
    return at(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))


def get(memories: DataFrame, id: str, project: str | None = None) -> DataFrame:
    return memories.where((F.col("id") == id) & in_project(project))


def list_invalidated(memories: DataFrame, project: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    return memories.where(~active() & in_project(project)).orderBy(F.desc("invalidated_at"), F.desc("updated_at"), "id").offset(offset).limit(limit)


def by_topic(memories: DataFrame, topic: str, project: str | None = None, include_invalidated: bool = False, newest_first: bool = False, worktree: str | None = None) -> DataFrame:
    keep = (F.col("topic") == topic) & in_project(project)
    if not include_invalidated:
        keep &= active()
    if worktree is not None:
        keep &= F.col("worktree") == worktree
    order = [F.desc("created_at"), F.desc("weight")] if newest_first else [F.desc("weight"), F.desc("created_at")]
    return memories.where(keep).orderBy(*order, "id")


def topic_page(memories: DataFrame, topic: str, project: str | None, limit: int) -> DataFrame:
    """The newest ``limit`` memories of a topic, each with the topic's total."""
    rows = memories.where((F.col("topic") == topic) & active() & in_project(project))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("created_at"), "id").limit(limit).crossJoin(F.broadcast(total))


def keyword_search(memories: DataFrame, words: list[str], project: str | None = None, limit: int = 20, offset: int = 0, worktree: str | None = None) -> DataFrame:
    """Any word within keywords, summary or topic, ASCII case aside; no words give no rows."""
    hit = F.lit(False)
    for w in words:
        low = w.lower()
        hit |= F.lower(F.array_join("keywords", '","')).contains(low) | F.lower("summary").contains(low) | F.lower("topic").contains(low)
    if worktree is not None:
        hit &= F.col("worktree") == worktree
    return memories.where(hit & active() & in_project(project)).orderBy(F.desc("weight"), "id").offset(offset).limit(limit)


def hash_exists(memories: DataFrame, key: str) -> DataFrame:
    return memories.where(active() & F.array_contains("keywords", f"hash:{key}")).agg((F.count("*") > 0).alias("found"))


def count_expired(memories: DataFrame, as_of: str) -> DataFrame:
    return memories.where(active() & (F.col("expires_at") < at(as_of))).agg(F.count("*").alias("n"))


def count_low_weight(memories: DataFrame, threshold: float) -> DataFrame:
    return memories.where(active() & (F.col("weight") < threshold) & ~F.col("importance").isin("critical", "high")).agg(F.count("*").alias("n"))


def stats(memories: DataFrame, project: str | None = None) -> DataFrame:
    return memories.where(active() & in_project(project)).agg(F.count("*").alias("total"), F.countDistinct("topic").alias("topics"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_weight"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def topics(memories: DataFrame, project: str | None = None) -> DataFrame:
    return memories.where(active() & in_project(project)).groupBy("topic").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def topic_health(memories: DataFrame, as_of: str, project: str | None = None) -> DataFrame:
    """Every topic's health in one grouping."""
    old = days_before(as_of, 14)
    return memories.where(active() & in_project(project)).groupBy("topic").agg(
        F.count("*").alias("n"),
        F.avg("weight").alias("avg_weight"),
        F.avg("access_count").alias("avg_access"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.max("last_accessed").alias("last_accessed"),
        F.count_if((F.col("weight") < 0.5) & (F.col("created_at") < old)).alias("stale"),
        (F.count("*") >= 15).alias("needs_consolidation"),
    )


def health_report(memories: DataFrame, project: str | None = None) -> DataFrame:
    kinds = [F.count_if(F.col("importance") == i).alias(i) for i in ("critical", "high", "medium", "low", "ephemeral")]
    return memories.where(active() & in_project(project)).groupBy("topic").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.count_if(F.col("weight") < 0.3).alias("low_weight"), *kinds)


def projects(memories: DataFrame) -> DataFrame:
    return memories.where(active()).groupBy(F.coalesce("project", F.lit("(none)")).alias("project")).agg(F.count("*").alias("n"))


def consolidation_targets(memories: DataFrame, thresholds: dict[str, int], default: int, exempt: tuple[str, ...] = (), project: str | None = None) -> DataFrame:
    """Topics with at least as many memories as their own threshold, or the default one."""
    limit = F.lit(default)
    for topic, n in thresholds.items():
        limit = F.when(F.col("topic") == topic, n).otherwise(limit)
    counts = topics(memories, project).select("topic", "n")
    return counts.where((F.col("n") >= limit) & ~F.col("topic").isin(*exempt))


def consolidation_hints(memories: DataFrame, threshold: int = 15, project: str | None = None) -> DataFrame:
    counts = topics(memories, project)
    span = F.timestamp_diff("DAY", F.col("oldest"), F.col("newest"))
    return counts.where((F.col("n") >= threshold) | ((F.col("n") > 20) & (span > 7))).select("topic", "n")


def stale_hints(memories: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return memories.where(active()).select("id", (F.col("last_accessed") <= days_before(as_of, days)).alias("stale"))


def purge_counts(memories: DataFrame, sessions: DataFrame, documents: DataFrame, project: str, chunks: DataFrame | None = None) -> DataFrame:
    """How many rows of each table a purge of the project would take; chunks go with their documents."""
    counts = [t.where(in_project(project)).agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k, t in (("memories", memories), ("sessions", sessions), ("documents", documents))]
    if chunks is not None:
        gone = chunks.join(documents.where(in_project(project)).select(F.col("id").alias("document_id")), "document_id", "left_semi")
        counts.append(gone.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("entity"), "n"))
    return reduce(DataFrame.unionByName, counts)


def purge_counts_before(tables: dict[str, tuple[DataFrame, str]], cutoff: str) -> DataFrame:
    """How many rows of each table, given with its time column, a purge of what is older than the cutoff would take."""
    counts = [t.where(F.col(c) < at(cutoff)).agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k, (t, c) in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def stale_memoirs(memoirs: DataFrame, concepts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(id, stale): whether neither a memoir nor one of its concepts has changed for so many days."""
    last = concepts.groupBy(F.col("memoir_id").alias("id")).agg(F.max("updated_at").alias("_last"))
    x = memoirs.join(last, "id", "left")
    return x.select("id", (F.greatest("updated_at", "_last") <= days_before(as_of, days)).alias("stale"))


def embed_backlog(memories: DataFrame) -> DataFrame:
    """Memories without a vector and the text that would be embedded."""
    return memories.where(F.col("embedding").isNull()).select("id", F.concat_ws(" ", "topic", "summary").alias("text"))


def newest_per_topic(memories: DataFrame, n: int, project: str | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("created_at"), "id"))
    return memories.where(active() & in_project(project)).withColumn("rank", rank).where(F.col("rank") <= n)
