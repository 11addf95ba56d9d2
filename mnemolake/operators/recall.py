"""Recall from end to end: what is asked is cleaned, read for hints, searched, filtered, counted and logged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions.text import CODE_RELATED, SESSION_QUERY, code_terms, fragments, sanitize_query

from . import search, sessions
from .memory import active, at

SHARED = "_shared"


def cleaned(spark: SparkSession, query: str) -> str:
    """The query without prompt debris; itself where nothing would be left."""
    return spark.range(1).select(sanitize_query(F.lit(query))["text"]).first()[0] or query


def expansion(concepts: DataFrame, query: str, index: search.TextIndex | None = None) -> list[str]:
    """Names of concepts, five at most, that a question about code means; none for other questions."""
    names = code_terms(query)
    if not names or not re.search(CODE_RELATED, query):
        return []
    parts = [p for n in names for p in fragments(n)]
    return [r["name"] for r in search.expand_code(concepts, names, parts, query=query, index=index).collect()]


def recall(
    memories: DataFrame, query: str, limit: int, offset: int = 0, values: list[float] | None = None, concepts: DataFrame | None = None, project: str | None = None, worktree: str | None = None,
    topic: str | None = None, keyword: str | None = None, effects: DataFrame | None = None, as_of: str | None = None, index: search.TextIndex | None = None, concept_index: search.TextIndex | None = None,
) -> DataFrame:
    """(id, score, place) of what a query brings back, best first.

    Questions about sessions, and, where ``concepts`` are given, about code, are
    answered by ordered branches and have no score. Others are by hybrid search with
    the shared project's hits at 0.7 of their score, or, without a vector, by full
    text. Topic and keyword are looked at last, so they may leave fewer than ``limit``.
    """
    asked = cleaned(memories.sparkSession, query)
    session_like = re.search(SESSION_QUERY, asked) is not None
    names = expansion(concepts, asked, concept_index) if concepts is not None else []
    none = F.lit(None).cast("double").alias("score")
    if (session_like or names) and project is not None:
        found = search.context_recall(memories, asked, limit, project, names, session_like, index, offset).select("id", none, F.struct("branch", "place").alias("o"))
    elif values is not None:
        hits = search.hybrid(memories, asked, values, limit, offset, project, effects, as_of, worktree, index)
        if project not in (None, SHARED):
            hits = search.shared_merge(hits, search.hybrid(memories, asked, values, limit, offset, SHARED, effects, as_of, index=index), limit)
        found = hits.select("id", "score", F.struct((-F.col("score")).alias("s"), "id").alias("o"))
    else:
        hits = search.fts_or_keywords(memories, asked, project, limit + offset, index)
        hits = hits if worktree is None else hits.where(F.col("worktree") == worktree)
        found = hits.orderBy(F.desc("weight"), F.desc("created_at"), "id").offset(offset).limit(limit).select("id", none, F.struct((-F.col("weight")).alias("w"), "created_at", "id").alias("o"))
    if topic is not None or keyword is not None:
        keep = F.lit(True)
        if topic is not None:
            keep &= F.col("topic") == topic
        if keyword is not None:
            keep &= F.exists("keywords", lambda k: k.contains(keyword))
        found = found.join(memories.where(keep).select("id"), "id", "left_semi")
    return found.withColumn("place", F.row_number().over(Window.orderBy("o"))).drop("o")  # ``limit`` rows


PREAMBLE = "Here is context from previous analysis of this project. Use it to answer efficiently without re-reading files.\n\n"


def preamble_rows(memories: DataFrame, query: str, limit: int, index=None) -> DataFrame:
    """(id, line, place): what full text finds, the heaviest first, or else the heaviest of all active memories."""
    found = search.fts(memories, query, limit=limit, ranked=False, index=index).drop("rank")
    heaviest = memories.where(active()).orderBy(F.desc("weight"), "id").limit(limit)
    rows = search.otherwise(found, heaviest)
    order = Window.orderBy(F.desc("weight"), F.desc("created_at"), "id")
    line = F.concat(F.lit("- "), F.when(F.col("branch").isNotNull(), F.concat(F.lit("["), "branch", F.lit("] "))).otherwise(""), "summary")
    return rows.select("id", line.alias("line"), F.row_number().over(order).alias("place"))  # ``limit`` rows


def preamble(memories: DataFrame, query: str, limit: int, index=None) -> DataFrame:
    """One row (text): the lines as a preamble for a prompt, empty if there is no memory."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return preamble_rows(memories, query, limit, index).agg(F.when(F.count("*") > 0, F.concat(F.lit(PREAMBLE), lines, F.lit("\n---\n\n"))).otherwise("").alias("text"))


def recall_event(hits: DataFrame, all_sessions: DataFrame, query: str, as_of: str, project: str | None, session_id: str | None) -> DataFrame:
    """One row for the log: the ids in their order, and the session that asked, or the project's active one."""
    ids = hits.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("memory_ids"))
    if session_id is not None:
        owner = all_sessions.sparkSession.range(1).select(F.lit(session_id).alias("session_id"))
    elif project is not None:
        owner = sessions.active_session(all_sessions, project).agg(F.max("id").alias("session_id"))
    else:
        owner = all_sessions.sparkSession.range(1).select(F.lit(None).cast("string").alias("session_id"))
    key = F.sha2(F.concat_ws("|", F.lit(query), F.lit(as_of), F.col("session_id")), 256)
    return ids.crossJoin(F.broadcast(owner)).select(key.alias("id"), "session_id", F.lit(query).alias("query"), at(as_of).alias("recalled_at"), "memory_ids", F.size("memory_ids").cast("long").alias("memory_count"), F.lit(project).cast("string").alias("project"))  # one row each
