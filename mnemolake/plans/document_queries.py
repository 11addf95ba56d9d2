"""Queries of documents, chunks, artifacts and project links."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions.embedding import embed
from mnemolake.functions.text import redact_fields
from mnemolake.operators import chunking as C
from mnemolake.operators import documents as D
from mnemolake.operators import insights as I
from mnemolake.operators import memory as M
from mnemolake.operators import transcripts as TR
from mnemolake.operators import transitions as T
from mnemolake.sources import snapshot as SN
from mnemolake.sources.adapters import AS_OF

from .registry import query
from .search_queries import CHUNKS_SQL, chunks


@query("doc_by_path", "SELECT id, project FROM rag_documents WHERE source_path = '/src5/45.py' AND project IS NOT NULL")
def _(t):
    return D.by_path(t.rag_documents, "/src5/45.py").select("id", "project")


@query("doc_list", "SELECT id, source_type FROM rag_documents WHERE project = 'de'")
def _(t):
    return D.listed(t.rag_documents, "de").select("id", "source_type")


@query("doc_chunks", f"WITH {CHUNKS_SQL} SELECT id, chunk_index::INT AS chunk_index FROM chunks WHERE document_id = 'doc_3'")
def _(t):
    return D.chunks_of(chunks(t), "doc_3").select("id", "chunk_index")


@query("doc_chunk_page", f"WITH {CHUNKS_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY chunk_index) - 1 AS n, count(*) OVER () AS total FROM chunks WHERE document_id = 'doc_3') SELECT id, total, total > 3 AS has_more FROM n WHERE n >= 1 AND n < 3")
def _(t):
    return D.chunk_page(chunks(t), "doc_3", 1, 2).select("id", "total", "has_more")


@query("doc_counts", f"WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM rag_documents WHERE project = 'fr') AS documents, (SELECT count(*) FROM chunks WHERE project = 'fr') AS chunks")
def _(t):
    return D.counts(t.rag_documents, chunks(t).drop("project"), "fr")


def _artifacts(t):
    return t.audit_log.select(F.col("id").alias("artifact_id"), F.col("operation").alias("artifact_type"), F.lit("p").alias("project"), F.col("timestamp").alias("created_at"))


@query("artifacts_by_type", "SELECT id AS artifact_id, timestamp AS created_at FROM audit_log WHERE operation = 'store'")
def _(t):
    return D.artifacts(_artifacts(t), "store", "p").select("artifact_id", "created_at")


@query("latest_artifact", "SELECT id AS artifact_id FROM audit_log WHERE operation = 'update' ORDER BY timestamp DESC, id LIMIT 1")
def _(t):
    return D.latest_artifact(_artifacts(t), "update").select("artifact_id")


LINKS_SQL = "links AS (SELECT DISTINCT a.lang AS source_project, b.lang AS target_project FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 16 = 3 AND a.lang <> b.lang)"


@query("linked_projects", f"WITH {LINKS_SQL} SELECT target_project FROM links WHERE source_project = 'en'")
def _(t):
    return D.linked(_links(t), "en")


def _links(t):
    """Projects whose documents follow each other, at some places, are linked."""
    d = t.raw("documents").select("doc_id", "lang")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("target_project"))
    return d.where("doc_id % 16 = 3").join(after, "doc_id").where("lang <> target_project").select(F.col("lang").alias("source_project"), "target_project").distinct()


@query("related_memories", f"WITH {LINKS_SQL} SELECT id, project FROM memories WHERE invalidated_at IS NULL AND (project = 'fr' OR project IN (SELECT target_project FROM links WHERE source_project = 'fr'))")
def _(t):
    return D.shared_with(t.memories, _links(t), "fr").select("id", "project")


@query("onboard", "SELECT count(*) AS memories, count(DISTINCT topic) AS topics, (SELECT count(*) FROM rag_documents WHERE project = 'en') AS documents FROM memories WHERE invalidated_at IS NULL AND project = 'en'")
def _(t):
    return D.onboard(t.memories, t.rag_documents, "en")


@query("recall_global", "WITH h AS (SELECT coalesce(project, '(none)') AS project, id, weight FROM memories WHERE invalidated_at IS NULL AND topic = 'notes' ORDER BY weight DESC, id LIMIT 40) SELECT project, string_agg(id, ',' ORDER BY weight DESC, id) AS ids FROM h GROUP BY project")
def _(t):
    hits = M.by_topic(t.memories, "notes").orderBy(F.desc("weight"), "id").limit(40).withColumn("score", F.col("weight"))
    return D.global_recall(hits).select("project", F.array_join("ids", ",").alias("ids"))


@query("council", "SELECT id, coalesce(json_extract_string(s, '$.task'), task) AS task, json_extract_string(s, '$.verdict') AS verdict FROM (SELECT id, task, CASE WHEN id LIKE '%1' THEN '{\"task\": \"t1\", \"verdict\": \"ok\"}' ELSE '{\"verdict\": \"no\"}' END AS s FROM sessions WHERE task IS NOT NULL)")
def _(t):
    s = t.sessions.where("task IS NOT NULL").withColumn("summary", F.when(F.col("id").endswith("1"), '{"task": "t1", "verdict": "ok"}').otherwise('{"verdict": "no"}'))
    return I.council(s)


@query("embed_all", "SELECT id, length(topic || ' ' || summary)::DOUBLE AS first FROM memories WHERE embedding IS NULL")
def _(t):
    v = embed(M.embed_backlog(t.memories), lambda texts: [[float(len(x)), 1.0] for x in texts])
    return v.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("purge_counts_chunks", f"WITH {CHUNKS_SQL} SELECT 'memories' AS entity, count(*) AS n FROM memories WHERE project = 'en' UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE project = 'en' UNION ALL SELECT 'documents', count(*) FROM rag_documents WHERE project = 'en' UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE project = 'en'")
def _(t):
    return M.purge_counts(t.memories, t.sessions, t.rag_documents, "en", chunks(t))


@query("document_delete_state", f"WITH {CHUNKS_SQL} SELECT 'document' AS kind, id FROM rag_documents WHERE source_path <> '/src5/45.py' UNION ALL SELECT 'chunk', c.id FROM chunks c JOIN rag_documents d ON d.id = c.document_id WHERE d.source_path <> '/src5/45.py'")
def _(t):
    d, c = T.delete_document(t.rag_documents, chunks(t), "/src5/45.py")
    return d.select(F.lit("document").alias("kind"), "id").unionByName(c.select(F.lit("chunk").alias("kind"), "id"))


@query("reingest_chunks_state", f"WITH {CHUNKS_SQL} SELECT document_id, count(*) AS n FROM (SELECT document_id FROM chunks WHERE document_id NOT LIKE '%3' UNION ALL SELECT id || 'b' FROM rag_documents WHERE id LIKE '%3') GROUP BY 1")
def _(t):
    new = t.rag_documents.where(F.col("id").endswith("3")).withColumn("id", F.concat("id", F.lit("b")))
    c = T.reingest(t.rag_documents, chunks(t).select("document_id"), new, new.select(F.col("id").alias("document_id")))[1]
    return c.groupBy("document_id").agg(F.count("*").alias("n"))


@query("reingest_keep_state", "SELECT id FROM rag_documents UNION ALL SELECT 'new_' || id FROM rag_documents WHERE id LIKE '%4'")
def _(t):
    again = t.rag_documents.where(F.col("id").endswith("3")).withColumn("id", F.concat("id", F.lit("b")))
    fresh = t.rag_documents.where(F.col("id").endswith("4")).withColumns({"id": F.concat(F.lit("new_"), "id"), "source_path": F.concat("source_path", F.lit(".new"))})
    new = again.unionByName(fresh)
    return T.reingest(t.rag_documents, t.rag_documents.select(F.col("id").alias("document_id")), new, new.select(F.col("id").alias("document_id")), force=False)[0].select("id")


@query("artifact_store_state", "SELECT id AS artifact_id, operation AS artifact_type, CAST(NULL AS VARCHAR) AS payload FROM audit_log UNION ALL SELECT 'art', 'council', '{\"a\":[1,2]}'")
def _(t):
    a = D.add_artifact(_artifacts(t), "art", "council", '{ "a": [1, 2] }', AS_OF)
    return a.select("artifact_id", "artifact_type", "payload")


@query("store_state", "SELECT id, topic, weight FROM memories UNION ALL SELECT 'again_' || id, topic, weight FROM memories WHERE topic = 'notes'")
def _(t):
    new = t.memories.where("topic = 'notes'").withColumn("id", F.concat(F.lit("again_"), "id"))
    return T.store(t.memories, new).select("id", "topic", "weight")


@query("archive_round_trip", "SELECT id, topic, weight, created_at, array_to_string(keywords, '|') AS keywords FROM memories")
def _(t):
    m = t.memories.select("id", "topic", "weight", "created_at", "keywords")
    rows, _ = SN.import_archive(SN.export_archive({"memory": m, "session": t.sessions}), "memory", m.schema)
    return rows.select("id", "topic", "weight", "created_at", F.array_join("keywords", "|").alias("keywords"))


@query("redact_fields", "SELECT id, '[REDACTED]' AS token, CASE WHEN topic = 'notes' THEN '[REDACTED]' ELSE topic END AS note FROM memories")
def _(t):
    said = F.when(F.col("topic") == "notes", "password: abcdefghij").otherwise(F.col("topic"))
    m = t.memories.select("id", redact_fields(F.create_map(F.lit("Auth_Token"), F.col("id"), F.lit("note"), said)).alias("m"))
    return m.select("id", F.col("m")["Auth_Token"].alias("token"), F.col("m")["note"].alias("note"))


def _lines(t):
    """The conversations as a session's JSON lines, with a tool call and a failed result in each."""
    v = t.turns.withColumn("path", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string,command:string>").alias("input"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("content"))
    tool = lambda name, path, command: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(name).alias("name"), F.struct(path.cast("string").alias("file_path"), command.cast("string").alias("command")).alias("input"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("content"))
    failed = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<file_path:string,command:string>").alias("input"), F.lit(True).alias("is_error"), F.concat(F.lit("failed at "), F.col("turn").cast("string")).alias("content"))
    none = F.lit(None)
    content = F.array(said, tool("Edit", F.concat(F.lit("/a/"), (F.col("turn") % 3).cast("string"), F.lit(".py")), none), tool("Bash", none, F.concat(F.lit("run "), F.col("turn").cast("string"))), failed)
    body = F.struct(F.lit("u").alias("uuid"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("/home/me/proj").alias("cwd"), F.struct("role", content.alias("content")).alias("message"))
    return v.select("path", F.col("turn").cast("int").alias("n"), F.to_json(body).alias("line"))


@query("transcript_normalise", """WITH v AS (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text FROM turns GROUP BY conv_id, turn), f AS (SELECT conv_id, '/a/' || (turn % 3) || '.py' AS f, min(turn) AS fst FROM v GROUP BY 1, 2)
SELECT 'c' || v.conv_id || '.jsonl' AS path, 'uuid' AS runtime, 's' || v.conv_id AS session, 'proj' AS project, (count(*) FILTER (role IN ('user', 'assistant') AND turn IS NOT NULL)) AS messages,
 (SELECT string_agg(f, ',' ORDER BY fst) FROM f WHERE f.conv_id = v.conv_id) AS files, string_agg('run ' || turn, ',' ORDER BY turn) AS commands, string_agg('failed at ' || turn, ',' ORDER BY turn) FILTER (turn IN (SELECT turn FROM (SELECT turn, row_number() OVER (ORDER BY turn) AS k FROM v x WHERE x.conv_id = v.conv_id) WHERE k <= 20)) AS errors
FROM v GROUP BY v.conv_id""")
def _(t):
    n = TR.normalise(_lines(t))
    return n.select("path", "runtime", "session", "project", "messages", *[F.array_join(c, ",").alias(c) for c in ("files", "commands", "errors")])


@query("notifications", "SELECT DISTINCT conv_id::VARCHAR AS thread, turn::VARCHAR AS turn, 0.75::DOUBLE AS weight, text AS summary FROM turns UNION ALL SELECT 'x', 'y', 0.35, NULL")
def _(t):
    x = t.turns.select(F.to_json(F.struct(F.lit("agent-turn-complete").alias("type"), F.col("conv_id").cast("string").alias("thread-id"), F.col("turn").cast("string").alias("turn-id"), F.col("text").alias("last-assistant-message"))).alias("line"))
    start = t.spark.sql("""SELECT '{"type": "session-start", "thread-id": "x", "turn-id": "y"}' AS line UNION ALL SELECT 'no json'""")
    return TR.notifications(x.unionByName(x).unionByName(start)).select("thread", "turn", F.col("weight").cast("double").alias("weight"), "summary")


@query("memory_files", "SELECT id || '.md' AS path, CASE id LIKE '%1' WHEN true THEN 'memory/feedback' ELSE 'memory/note' END AS topic, CASE id LIKE '%1' WHEN true THEN 'high' ELSE 'medium' END AS importance, topic AS name, id AS summary FROM memories")
def _(t):
    head = F.concat(F.lit("---\nname: "), F.col("topic"), F.when(F.col("id").endswith("1"), "\ntype: feedback").otherwise(""), F.lit("\n---\n\n"), F.col("id"), F.lit("\n"))
    return TR.memory_files(t.memories.select(F.concat("id", F.lit(".md")).alias("path"), head.alias("content"))).select("path", "topic", "importance", "name", "summary")


@query("symbol_listing", "SELECT 'part_' || p_partkey AS name, 'function' AS kind, p_partkey::INT AS line_start, (p_partkey + 2)::INT AS line_end FROM part")
def _(t):
    x = t.raw("part").select(F.explode(F.array(F.concat(F.lit("function part_"), "p_partkey", F.lit(" ["), "p_partkey", F.lit(":0-"), F.col("p_partkey") + 2, F.lit(":9]")), F.lit("  field inner [1:0-1:5]"))).alias("line"))
    return C.parse_symbols(x).select("name", "kind", "line_start", "line_end")
