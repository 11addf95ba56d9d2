"""Queries over memories: reads, counts, aggregates, insights, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.operators import insights as I
from mnemolake.operators import memory as M
from mnemolake.sources.adapters import AS_OF

from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
ROW = ["id", "topic", "project", "importance", "weight", "created_at"]
COLS = ", ".join(ROW)


@query("mem_get", f"SELECT {COLS} FROM memories WHERE id = '00000042'")
def _(t):
    return M.get(t.memories, "00000042").select(*ROW)


@query("mem_get_guarded", f"SELECT {COLS} FROM memories WHERE id = '00000042' AND project = 'none'")
def _(t):
    return M.get(t.memories, "00000042", "none").select(*ROW)


@query("mem_list_invalidated", "SELECT id, invalidated_at, invalidation_reason FROM memories WHERE invalidated_at IS NOT NULL AND project = 'en' ORDER BY invalidated_at DESC, updated_at DESC, id LIMIT 10 OFFSET 2")
def _(t):
    return M.list_invalidated(t.memories, "en", 10, 2).select("id", "invalidated_at", "invalidation_reason")


@query("mem_by_topic", f"SELECT {COLS} FROM memories WHERE topic = 'preferences' AND invalidated_at IS NULL AND project = 'en'")
def _(t):
    return M.by_topic(t.memories, "preferences", "en").select(*ROW)


@query("mem_by_topic_all", f"SELECT {COLS} FROM memories WHERE topic = 'notes'")
def _(t):
    return M.by_topic(t.memories, "notes", None, include_invalidated=True, newest_first=True).select(*ROW)


@query("mem_by_topic_scoped", f"SELECT {COLS} FROM memories WHERE topic = 'notes' AND invalidated_at IS NULL AND worktree = 'alpha'")
def _(t):
    return M.by_topic(t.memories, "notes", None, worktree="alpha").select(*ROW)


@query("mem_topic_page", "WITH r AS (SELECT *, count(*) OVER () AS total FROM memories WHERE topic = 'notes' AND invalidated_at IS NULL) SELECT id, created_at, total FROM r ORDER BY created_at DESC, id LIMIT 5")
def _(t):
    return M.topic_page(t.memories, "notes", None, 5).select("id", "created_at", "total")


_KW = "(contains(lower(array_to_string(keywords, '\",\"')), 'src3') OR contains(lower(summary), 'src3') OR contains(lower(topic), 'src3') OR contains(lower(array_to_string(keywords, '\",\"')), 'thing') OR contains(lower(summary), 'thing') OR contains(lower(topic), 'thing'))"


@query("mem_keyword_search", f"SELECT {COLS} FROM memories WHERE {_KW} AND invalidated_at IS NULL AND project = 'en' ORDER BY weight DESC, id LIMIT 20 OFFSET 3")
def _(t):
    return M.keyword_search(t.memories, ["src3", "Thing"], "en", 20, 3).select(*ROW)


@query("mem_keyword_search_scoped", f"SELECT {COLS} FROM memories WHERE {_KW} AND invalidated_at IS NULL AND worktree = 'beta' ORDER BY weight DESC, id LIMIT 20")
def _(t):
    return M.keyword_search(t.memories, ["src3", "Thing"], None, 20, 0, "beta").select(*ROW)


@query("mem_hash_exists", "SELECT count(*) > 0 AS found FROM memories WHERE invalidated_at IS NULL AND list_contains(keywords, 'hash:abc')")
def _(t):
    return M.hash_exists(t.memories, "abc")


@query("mem_count_expired", f"SELECT count(*) AS n FROM memories WHERE invalidated_at IS NULL AND expires_at < {NOW}")
def _(t):
    return M.count_expired(t.memories, AS_OF)


@query("mem_count_low_weight", "SELECT count(*) AS n FROM memories WHERE invalidated_at IS NULL AND weight < 0.3 AND importance NOT IN ('critical', 'high')")
def _(t):
    return M.count_low_weight(t.memories, 0.3)


@query("mem_stats", "SELECT count(*) AS total, count(DISTINCT topic) AS topics, coalesce(avg(weight), 0) AS avg_weight, min(created_at) AS oldest, max(created_at) AS newest FROM memories WHERE invalidated_at IS NULL AND project = 'de'")
def _(t):
    return M.stats(t.memories, "de")


@query("mem_topics", "SELECT topic, count(*) AS n, avg(weight) AS avg_weight, min(created_at) AS oldest, max(created_at) AS newest FROM memories WHERE invalidated_at IS NULL GROUP BY topic")
def _(t):
    return M.topics(t.memories)


@query("topic_health", f"SELECT topic, count(*) AS n, avg(weight) AS avg_weight, avg(access_count) AS avg_access, min(created_at) AS oldest, max(created_at) AS newest, max(last_accessed) AS last_accessed, count(*) FILTER (weight < 0.5 AND created_at < {NOW} - INTERVAL 14 DAY) AS stale, count(*) >= 15 AS needs_consolidation FROM memories WHERE invalidated_at IS NULL GROUP BY topic")
def _(t):
    return M.topic_health(t.memories, AS_OF)


@query("health_report", "SELECT topic, count(*) AS n, avg(weight) AS avg_weight, count(*) FILTER (weight < 0.3) AS low_weight, " + ", ".join(f"count(*) FILTER (importance = '{i}') AS {i}" for i in ("critical", "high", "medium", "low", "ephemeral")) + " FROM memories WHERE invalidated_at IS NULL GROUP BY topic")
def _(t):
    return M.health_report(t.memories)


@query("projects", "SELECT coalesce(project, '(none)') AS project, count(*) AS n FROM memories WHERE invalidated_at IS NULL GROUP BY 1")
def _(t):
    return M.projects(t.memories)


@query("purge_counts", "SELECT 'memories' AS entity, count(*) AS n FROM memories WHERE project = 'en' UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE project = 'en' UNION ALL SELECT 'documents', count(*) FROM rag_documents WHERE project = 'en'")
def _(t):
    return M.purge_counts(t.memories, t.sessions, t.rag_documents, "en")


@query("consolidation_targets", "SELECT topic, count(*) AS n FROM memories WHERE invalidated_at IS NULL AND topic <> 'notes' GROUP BY topic HAVING count(*) >= CASE topic WHEN 'corrections' THEN 500000 ELSE 15 END")
def _(t):
    return M.consolidation_targets(t.memories, {"corrections": 500_000}, 15, ("notes",))


@query("consolidation_hints", "SELECT topic, count(*) AS n FROM memories WHERE invalidated_at IS NULL AND project = 'es' GROUP BY topic HAVING count(*) >= 15 OR (count(*) > 20 AND date_sub('hour', min(created_at), max(created_at)) / 24 > 7)")
def _(t):
    return M.consolidation_hints(t.memories, 15, "es")


@query("stale_hints", f"SELECT id, last_accessed <= {NOW} - INTERVAL 30 DAY AS stale FROM memories WHERE invalidated_at IS NULL")
def _(t):
    return M.stale_hints(t.memories, AS_OF)


@query("embed_backlog", "SELECT id, topic || ' ' || summary AS text FROM memories WHERE embedding IS NULL")
def _(t):
    return M.embed_backlog(t.memories)


@query("newest_per_topic", "SELECT id, topic, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, id) AS rank FROM memories WHERE invalidated_at IS NULL) WHERE rank <= 3")
def _(t):
    return M.newest_per_topic(t.memories, 3).select("id", "topic", "rank")


@query("analytics_snapshot", f"""SELECT m.*, (SELECT count(*) FROM memoirs) AS memoirs, (SELECT count(*) FROM memoirs WHERE name LIKE 'code:%') AS code_memoirs, (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM concept_links) AS links
FROM (SELECT count(*) AS total, count(*) FILTER (access_count > 0) AS recalled, count(*) FILTER (access_count > 0) / count(*)::DOUBLE AS utilisation, count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY) AS created_7d, count(*) FILTER (created_at >= {NOW} - INTERVAL 30 DAY) AS created_30d, count(*) FILTER (weight < 0.3) AS decayed, avg(weight) AS avg_weight, min(weight) AS min_weight FROM memories) m""")
def _(t):
    return I.analytics(t.memories, t.memoirs, t.concepts, t.concept_links, AS_OF)


@query("top_topics", "SELECT topic, count(*) AS n, avg(weight) AS avg_weight, max(created_at) AS newest FROM memories WHERE project = 'fr' GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def _(t):
    return I.top_topics(t.memories, 5, "fr")


@query("importance_dist", "SELECT " + ", ".join(f"count(*) FILTER (importance = '{i}') AS {i}" for i in ("critical", "high", "medium", "low", "ephemeral")) + " FROM memories")
def _(t):
    return I.importance_distribution(t.memories)


@query("activity_snapshot", f"SELECT count(*) AS memories, max(created_at) FILTER (topic LIKE 'session/%') AS last_session_memory, arg_max(id, (created_at, id)) AS newest_memory, (SELECT count(*) FROM sessions WHERE coalesce(ended_at, started_at) >= {NOW} - INTERVAL 7 DAY) AS recent_sessions FROM memories")
def _(t):
    return I.activity(t.memories, t.sessions, AS_OF)


_CASE = "CASE topic WHEN 'corrections' THEN 'corrections' WHEN 'errors/resolved' THEN 'errors' ELSE 'tests' END"


@query("lessons_grouped", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, weight DESC, id) AS nth FROM memories WHERE topic IN ('corrections', 'errors/resolved', 'tests/resolved') AND invalidated_at IS NULL),
k AS (SELECT *, CASE WHEN len(keywords) = 0 THEN substr(summary, 1, CASE topic WHEN 'corrections' THEN 20 ELSE 30 END) WHEN topic = 'corrections' THEN array_to_string(keywords[1:2], '|') ELSE keywords[1] END AS key FROM r WHERE nth <= 50)
SELECT {_CASE} AS category, key, count(*) AS frequency, arg_min(summary, nth) AS description, array_to_string(arg_min(keywords, nth), '|') AS keywords FROM k GROUP BY topic, key""")
def _(t):
    return I.lessons(t.memories)


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("lessons_keyword", f"""WITH r AS (SELECT *, CASE topic WHEN 'corrections' THEN 0 WHEN 'errors/resolved' THEN 1 ELSE 2 END AS place FROM memories WHERE topic IN ('corrections', 'errors/resolved', 'tests/resolved') AND invalidated_at IS NULL AND project = 'en'),
o AS (SELECT *, row_number() OVER (ORDER BY place, weight DESC, id) AS nth FROM r),
w AS (SELECT place, nth, summary, list_concat(list_transform(keywords, lambda k: lower(k)), list_distinct(list_filter(list_transform(regexp_split_to_array(summary, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda w: strlen(w) > 3 AND w NOT IN ({_STOP})))) AS words FROM o WHERE nth <= 50),
e AS (SELECT place, nth, summary, unnest(words) AS keyword FROM w),
g AS (SELECT keyword, count(*) AS n, count(*) FILTER (place = 0) AS n0, count(*) FILTER (place = 1) AS n1, count(*) FILTER (place = 2) AS n2, list(summary ORDER BY nth) AS texts FROM e GROUP BY keyword HAVING count(*) >= 2 AND (n0 = 0 OR n0 >= 2)),
p AS (SELECT *, list_filter(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(texts[1]), '\\s+'), lambda t: t <> ''))), lambda t: len(list_filter(texts[2:], lambda s: NOT contains(lower(s), t))) = 0) AS common FROM g),
q AS (SELECT *, CASE WHEN len(common) > 0 THEN 'avoid ' || array_to_string(common, ' ') ELSE 'pattern like ''' || substr(texts[1], 1, 50) || '''' END AS pattern FROM p)
SELECT CASE WHEN n0 > 0 THEN '[corrections] When working with ''' || keyword || ''': ' || pattern || ' — avoided ' || n0 || ' times' WHEN n1 > 0 THEN '[errors] Common issue in ''' || keyword || ''': ' || pattern || ' — resolved ' || n1 || ' times' ELSE '[tests] Test failures in ''' || keyword || ''': ' || pattern || ' — fixed ' || n2 || ' times' END AS lesson FROM q ORDER BY lesson LIMIT 10""")
def _(t):
    return I.keyword_lessons(t.memories, "en")


@query("top_keywords", "WITH k AS (SELECT unnest(keywords) AS keyword FROM memories WHERE topic = 'notes' AND invalidated_at IS NULL) SELECT keyword, count(*) AS n FROM k GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10")
def _(t):
    return I.top_keywords(t.memories, "notes")


@query("changelog", "SELECT 'topic ' || topic AS entry, count(*) AS n FROM memories WHERE invalidated_at IS NULL AND created_at >= TIMESTAMP '2024-01-20' GROUP BY topic UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE coalesce(ended_at, started_at) >= TIMESTAMP '2024-01-20'")
def _(t):
    return I.changelog(t.memories, t.sessions, "2024-01-20 00:00:00")


@query("changelog_project", "SELECT 'topic ' || topic AS entry, count(*) AS n FROM memories WHERE invalidated_at IS NULL AND project = 'en' AND created_at >= TIMESTAMP '2024-01-20' GROUP BY topic UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE project = 'en' AND coalesce(ended_at, started_at) >= TIMESTAMP '2024-01-20'")
def _(t):
    return I.changelog(t.memories, t.sessions, "2024-01-20 00:00:00", "en")


@query("compact_summaries", "SELECT id, summary FROM (SELECT * FROM sessions WHERE project = 'p1' ORDER BY started_at DESC, id LIMIT 20) WHERE summary IS NOT NULL")
def _(t):
    return I.compact_summaries(t.sessions, "p1", 20).select("id", "summary")


_SECTION = "(SELECT '{s}' AS section, id, substr(summary, 1, 200) AS text FROM memories WHERE topic = '{t}' AND invalidated_at IS NULL AND project = 'en' ORDER BY created_at DESC, weight DESC, id LIMIT {n})"


@query("passive_bundle", "(SELECT 'sessions' AS section, id, substr(coalesce(summary, ''), 1, 200) AS text FROM sessions WHERE project = 'p1' ORDER BY started_at DESC, id LIMIT 3) UNION ALL " + " UNION ALL ".join(_SECTION.format(s=s, t=t, n=n) for s, t, n in (("decisions", "decisions/p", 3), ("errors", "errors/active", 3), ("context", "context/p", 5))))
def _(t):
    return I.passive_bundle(t.memories, t.sessions, "p1", "en")


_FLAGS = ", ".join(f"CASE WHEN regexp_matches(summary, '{p}') THEN '{k}' END" for k, p in X.SECRETS.items())


@query("secret_flags", f"SELECT id, array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), '|') AS labels FROM memories")
def _(t):
    return t.memories.select("id", F.array_join(X.secret_labels(F.col("summary")), "|").alias("labels"))


@query("redact", "SELECT id, CASE WHEN " + " OR ".join(f"regexp_matches(summary, '{p}')" for p in X.SECRETS.values()) + " THEN '[REDACTED]' ELSE summary END AS summary FROM memories")
def _(t):
    return t.memories.select("id", X.redact(F.col("summary")).alias("summary"))


_CODE = X.CODE_RELATED


@query("code_related", f"SELECT id, regexp_matches(summary, '{_CODE}') AS code, regexp_matches(summary, '{X.SESSION_QUERY}') AS session FROM memories")
def _(t):
    return t.memories.select("id", X.code_related(F.col("summary")).alias("code"), X.session_query(F.col("summary")).alias("session"))


_RAW = "concat('<sys a=\"1\">', chr(10), 'User: ```py', chr(10), summary, '   ', topic, '</sys>')"
_SANE = f"""WITH q AS (SELECT id, {_RAW} AS c FROM memories),
a AS (SELECT *, regexp_replace(c, '{X.XML_TAG}', ' ', 'g') AS a FROM q),
b AS (SELECT *, regexp_replace(a, '{X.FRAMING}', '', 'g') AS b FROM a),
d AS (SELECT *, regexp_replace(b, '{X.CODE_TICKS}', ' ', 'g') AS d FROM b),
e AS (SELECT *, regexp_replace(d, '^\\s+|\\s+$', '', 'g') AS t FROM d),
f AS (SELECT *, regexp_replace(t, '\\s+', ' ', 'g') AS e FROM e),
g AS (SELECT *, substr(e, 1, {X.MAX_QUERY}) AS cut FROM f)
SELECT id, CASE WHEN length(e) <= {X.MAX_QUERY} THEN e WHEN contains(cut, ' ') THEN substr(cut, 1, length(cut) - strpos(reverse(cut), ' ')) ELSE cut END AS text,
 array_to_string(list_filter([CASE WHEN a <> c THEN 'xml_tags' END, CASE WHEN b <> a THEN 'conversation_framing' END, CASE WHEN d <> b THEN 'markdown_noise' END, CASE WHEN e <> t THEN 'whitespace_normalized' END, CASE WHEN length(e) > {X.MAX_QUERY} THEN 'truncated' END], lambda x: x IS NOT NULL), '|') AS removed FROM g"""


@query("query_sanitize", _SANE)
def _(t):
    raw = F.concat(F.lit('<sys a="1">\nUser: ```py\n'), F.col("summary"), F.lit("   "), F.col("topic"), F.lit("</sys>"))
    return t.memories.select("id", X.sanitize_query(raw).alias("s")).select("id", "s.text", F.array_join("s.removed", "|").alias("removed"))


@query("extract_keywords", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(summary, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda w: strlen(w) > 3 AND w NOT IN ({_STOP})))), ' ') AS words FROM memories")
def _(t):
    return t.memories.select("id", F.array_join(X.extract_keywords(F.col("summary")), " ").alias("words"))


@query("source_types", "SELECT source_path, CASE lower(regexp_extract(source_path, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'code' ELSE 'text' END AS kind, regexp_matches(source_path, '(^|/)(\\.[^/]+|target|node_modules)(/|$)') AS skipped FROM rag_documents")
def _(t):
    return t.rag_documents.select("source_path", X.source_type(F.col("source_path")).alias("kind"), X.skipped_path(F.col("source_path")).alias("skipped"))


@query("dedupe_hash", "SELECT id, substr(sha256(id || chr(10) || topic), 1, 12) AS hash, CASE WHEN length(summary) > 160 THEN substr(summary, 1, 160) || '...' ELSE summary END AS snippet FROM memories")
def _(t):
    return t.memories.select("id", X.dedupe_hash(F.col("id"), F.col("topic")).alias("hash"), X.snippet(F.col("summary"), 160).alias("snippet"))


@query("answer_score", "SELECT id, contains(lower(summary), 'and')::INT + contains(lower(summary), 'the')::INT + contains(lower(summary), 'zzz')::INT AS hits FROM memories")
def _(t):
    return t.memories.select("id", X.answer_score(F.col("summary"), ["AND", "the", "zzz"]).alias("hits"))
