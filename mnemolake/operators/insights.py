"""Analytics, activity, lessons, change log and passive views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.text import extract_keywords

from .memory import active, at, by_topic, days_before, in_project

# Topics of lessons with what their groups are called; the sentences of lessons below are fixed too.
LESSON_TOPICS = {"corrections": ("corrections", "correction"), "errors/resolved": ("errors", "error"), "tests/resolved": ("tests", "test")}


def analytics(memories: DataFrame, memoirs: DataFrame, concepts: DataFrame, links: DataFrame, as_of: str, project: str | None = None) -> DataFrame:
    """One row of totals; invalidated memories count too."""
    m = memories.where(in_project(project)).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("access_count") > 0).alias("recalled"),
        F.coalesce(F.try_divide(F.count_if(F.col("access_count") > 0), F.count("*")), F.lit(0.0)).alias("utilisation"),
        F.count_if(F.col("created_at") >= days_before(as_of, 7)).alias("created_7d"),
        F.count_if(F.col("created_at") >= days_before(as_of, 30)).alias("created_30d"),
        F.count_if(F.col("weight") < 0.3).alias("decayed"),
        F.avg("weight").alias("avg_weight"),
        F.min("weight").alias("min_weight"),
    )
    others = (memoirs.agg(F.count("*").alias("memoirs"), F.count_if(F.col("name").startswith("code:")).alias("code_memoirs")), concepts.agg(F.count("*").alias("concepts")), links.agg(F.count("*").alias("links")))
    for o in others:  # one row each
        m = m.crossJoin(F.broadcast(o))
    return m


def top_topics(memories: DataFrame, limit: int = 10, project: str | None = None) -> DataFrame:
    return memories.where(in_project(project)).groupBy("topic").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"), F.max("created_at").alias("newest")).orderBy(F.desc("n"), "topic").limit(limit)


def importance_distribution(memories: DataFrame, project: str | None = None) -> DataFrame:
    return memories.where(in_project(project)).agg(*[F.count_if(F.col("importance") == i).alias(i) for i in ("critical", "high", "medium", "low", "ephemeral")])


def activity(memories: DataFrame, sessions: DataFrame, as_of: str, project: str | None = None) -> DataFrame:
    m = memories.where(in_project(project)).agg(F.count("*").alias("memories"), F.max(F.when(F.col("topic").startswith("session/"), F.col("created_at"))).alias("last_session_memory"), F.max_by("id", F.struct("created_at", "id")).alias("newest_memory"))
    s = sessions.where(F.coalesce(F.col("ended_at"), F.col("started_at")) >= days_before(as_of, 7)).agg(F.count("*").alias("recent_sessions"))
    return m.crossJoin(F.broadcast(s))


def lessons(memories: DataFrame, project: str | None = None, per_topic: int = 50) -> DataFrame:
    """Grouped lessons: newest memories of three topics, grouped by their first keywords or the start of the summary."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("created_at"), F.desc("weight"), "id"))
    rows = memories.where(F.col("topic").isin(*LESSON_TOPICS) & active() & in_project(project)).withColumn("nth", rank).where(F.col("nth") <= min(per_topic, 50))
    none = F.size("keywords") == 0
    first = F.when(none, F.substring("summary", 1, 20)).otherwise(F.array_join(F.slice("keywords", 1, 2), "|"))
    second = F.when(none, F.substring("summary", 1, 30)).otherwise(F.get("keywords", F.lit(0)))
    rows = rows.withColumn("key", F.when(F.col("topic") == "corrections", first).otherwise(second))
    groups = rows.groupBy("topic", "key").agg(F.count("*").alias("frequency"), F.min_by("summary", "nth").alias("description"), F.min_by("keywords", "nth").alias("keywords"))
    category = F.col("topic")
    for topic, (name, _) in LESSON_TOPICS.items():
        category = F.when(F.col("topic") == topic, name).otherwise(category)
    return groups.select(category.alias("category"), "key", "frequency", "description", F.array_join("keywords", "|").alias("keywords")).orderBy(F.desc("frequency"), "description", "category", "key")


def keyword_lessons(memories: DataFrame, project: str | None = None, limit: int = 10) -> DataFrame:
    """Keyword lessons: at most 50 memories, grouped by each keyword and significant word; groups of two or more."""
    place = F.when(F.col("topic") == "corrections", 0).when(F.col("topic") == "errors/resolved", 1).otherwise(2)
    rows = memories.where(F.col("topic").isin(*LESSON_TOPICS) & active() & in_project(project)).withColumn("place", place)
    rows = rows.orderBy("place", F.desc("weight"), "id").limit(50).withColumn("nth", F.row_number().over(Window.orderBy("place", F.desc("weight"), "id")))  # 50 rows
    words = F.concat(F.transform("keywords", lambda k: F.lower(k)), extract_keywords(F.col("summary")))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(F.array_join(F.slice(F.split(F.trim("summary"), r"\s+"), 1, 3), " "))))
    each = rows.select("place", "nth", "summary", F.explode(words).alias("keyword"))
    groups = each.groupBy("keyword").agg(F.count("*").alias("n"), *[F.count_if(F.col("place") == i).alias(f"n{i}") for i in range(3)], F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda s: s["summary"]).alias("texts"))
    groups = groups.where((F.col("n") >= 2) & ((F.col("n0") == 0) | (F.col("n0") >= 2)))
    rest = F.slice("texts", 2, F.size("texts"))
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.get("texts", F.lit(0))), r"\s+"), lambda t: t != "")))
    common = F.filter(tokens, lambda t: F.forall(rest, lambda s: F.contains(F.lower(s), t)))
    pattern = F.when(F.size(common) > 0, F.concat(F.lit("avoid "), F.array_join(common, " "))).otherwise(F.concat(F.lit("pattern like '"), F.substring(F.get("texts", F.lit(0)), 1, 50), F.lit("'")))
    said = F.when(F.col("n0") > 0, F.concat(F.lit("[corrections] When working with '"), "keyword", F.lit("': "), pattern, F.lit(" — avoided "), F.col("n0").cast("string"), F.lit(" times")))
    said = said.when(F.col("n1") > 0, F.concat(F.lit("[errors] Common issue in '"), "keyword", F.lit("': "), pattern, F.lit(" — resolved "), F.col("n1").cast("string"), F.lit(" times")))
    said = said.otherwise(F.concat(F.lit("[tests] Test failures in '"), "keyword", F.lit("': "), pattern, F.lit(" — fixed "), F.col("n2").cast("string"), F.lit(" times")))
    return groups.select(said.alias("lesson")).orderBy("lesson").limit(limit)


def top_keywords(memories: DataFrame, topic: str, limit: int = 10, project: str | None = None) -> DataFrame:
    rows = by_topic(memories, topic, project).select(F.explode("keywords").alias("keyword"))
    return rows.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(limit)


#: Memories that a topic needs before it is promoted, and concepts that are made of its keywords.
PROMOTION_THRESHOLD, PROMOTED = 15, 10


def promotions(memories: DataFrame, memoirs: DataFrame, project: str | None = None) -> DataFrame:
    """(topic, memoir, n, keyword, uses, place): the commonest keywords of every topic with enough memories whose memoir's name, the topic with dashes, is free."""
    m = memories.where(active() & in_project(project))
    ready = m.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= PROMOTION_THRESHOLD).withColumn("memoir", F.replace("topic", F.lit("/"), F.lit("-")))
    ready = ready.join(memoirs.select(F.col("name").alias("memoir")), "memoir", "left_anti")
    used = m.select("topic", F.explode("keywords").alias("keyword")).groupBy("topic", "keyword").agg(F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("uses"), "keyword"))
    top = used.withColumn("place", place).where(F.col("place") <= PROMOTED)
    return ready.join(top, "topic", "left").select("topic", "memoir", "n", "keyword", "uses", "place")


def promote(memories: DataFrame, memoirs: DataFrame, concepts: DataFrame, links: DataFrame, as_of: str, project: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memoirs, concepts, links) once every ready topic is a memoir: a concept for each of its commonest keywords, and a related_to link, weighed by the share of memories that have both, between two that stand in one memory. Done again, it changes nothing."""
    p = promotions(memories, memoirs, project)
    memoir_id = F.concat(F.lit("mem:"), "memoir")
    concept_id = lambda k: F.concat(memoir_id, F.lit(":"), k)
    new = p.select("topic", "memoir", "n").distinct()
    made = new.select(memoir_id.alias("id"), F.col("memoir").alias("name"), F.concat(F.lit("promoted from "), "topic").alias("description"), at(as_of).alias("created_at"))
    words = p.where(F.col("keyword").isNotNull())
    nodes = words.select(concept_id(F.col("keyword")).alias("id"), memoir_id.alias("memoir_id"), F.col("keyword").alias("name"), F.concat(F.lit("in "), F.col("uses").cast("string"), F.lit(" memories of "), "topic").alias("definition"), (F.col("uses") / F.col("n")).alias("confidence"), F.lit(1).alias("revision"))
    held = memories.where(active() & in_project(project)).select("topic", F.array_distinct("keywords").alias("k"))
    mine = held.join(words.groupBy("topic", "memoir", "n").agg(F.collect_set("keyword").alias("top")), "topic").withColumn("k", F.array_sort(F.array_intersect("k", "top")))  # ten keywords a topic
    pairs = mine.select("memoir", "n", F.explode("k").alias("a"), "k").select("memoir", "n", "a", F.explode("k").alias("b")).where(F.col("a") < F.col("b"))
    edges = pairs.groupBy("memoir", "n", "a", "b").agg(F.count("*").alias("both")).select(concept_id(F.col("a")).alias("source_id"), concept_id(F.col("b")).alias("target_id"), F.lit("related_to").alias("relation"), (F.col("both") / F.col("n")).alias("weight"))
    return tuple(old.unionByName(add, allowMissingColumns=True) for old, add in ((memoirs, made), (concepts, nodes), (links, edges)))


def changelog(memories: DataFrame, sessions: DataFrame, since: str, project: str | None = None) -> DataFrame:
    """Counts since a cutoff: sessions, memories by topic, resolved errors, corrections."""
    m = memories.where(active() & in_project(project) & (F.col("created_at") >= at(since)))
    by = m.groupBy("topic").agg(F.count("*").alias("n")).select(F.concat(F.lit("topic "), "topic").alias("entry"), "n")
    s = sessions.where(in_project(project) & (F.coalesce(F.col("ended_at"), F.col("started_at")) >= at(since))).agg(F.count("*").alias("n")).select(F.lit("sessions").alias("entry"), "n")
    return by.unionByName(s)


def since_word(word: str, now):
    """The start that a date word or an ISO date means."""
    from datetime import datetime, timedelta

    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    words = {"today": day, "yesterday": day - timedelta(days=1), "last week": now - timedelta(days=7), "last month": now - timedelta(days=30)}
    return words.get(word.strip().lower()) or datetime.fromisoformat(word)


def compact_summaries(sessions: DataFrame, project: str, limit: int) -> DataFrame:
    """The project's newest sessions; of those, the ones with a summary. The limit comes first."""
    return sessions.where(F.col("project") == project).orderBy(F.desc("started_at"), "id").limit(limit).where(F.col("summary").isNotNull())


def passive_bundle(memories: DataFrame, sessions: DataFrame, project: str, memory_project: str) -> DataFrame:
    """The start-of-session context: newest sessions, decisions, errors and context, cut to 200 characters."""
    parts = []
    for section, topic, n in (("decisions", "decisions/p", 3), ("errors", "errors/active", 3), ("context", "context/p", 5)):
        parts.append(by_topic(memories, topic, memory_project, newest_first=True).limit(n).select(F.lit(section).alias("section"), "id", F.substring("summary", 1, 200).alias("text")))
    s = sessions.where(F.col("project") == project).orderBy(F.desc("started_at"), "id").limit(3)
    out = s.select(F.lit("sessions").alias("section"), "id", F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("text"))
    for p in parts:
        out = out.unionByName(p)
    return out


def council(sessions: DataFrame) -> DataFrame:
    """Structured artifacts kept as JSON in session summaries."""
    s = sessions.where(F.col("summary").startswith("{"))
    return s.select("id", F.coalesce(F.get_json_object("summary", "$.task"), F.col("task")).alias("task"), F.get_json_object("summary", "$.verdict").alias("verdict"))
