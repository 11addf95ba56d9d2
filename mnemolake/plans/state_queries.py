"""Queries of state transitions, the graph, sessions, feedback, evaluation and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mnemolake.operators import chunking as C
from mnemolake.operators import evaluation as E
from mnemolake.operators import export as X
from mnemolake.operators import extract as FX
from mnemolake.operators import feedback as FB
from mnemolake.operators import graph as G
from mnemolake.operators import sessions as SE
from mnemolake.operators import transcripts as TR
from mnemolake.operators import transitions as T
from mnemolake.sources import snapshot as SN
from mnemolake.sources.adapters import AS_OF

from .document_queries import LINKS_SQL
from .document_queries import _links as project_links
from .registry import query
from .search_queries import EFFECTS_SQL, effects

NOW = f"TIMESTAMP '{AS_OF}'"
LABELS = "list_transform(labels, lambda x: x.namespace || ':' || x.value)"
KEEP = "id, topic, round(weight, 9) AS weight"


def _slim(df):
    return df.select("id", "topic", F.round("weight", 9).alias("weight"))


_DECAY = "CASE WHEN invalidated_at IS NULL AND importance <> 'critical' THEN greatest(0, weight * (1 - (1 - {f}) * CASE importance WHEN 'high' THEN 0.5 WHEN 'low' THEN 2.0 ELSE 1.0 END / (1 + 0.1 * access_count))) ELSE weight END"


@query("decay_state", f"SELECT id, round({_DECAY.format(f=0.9)}, 9) AS weight FROM memories")
def _(t):
    return T.decay(t.memories, 0.9).select("id", F.round("weight", 9).alias("weight"))


@query("auto_decay_state", f"SELECT id, round({_DECAY.format(f=0.95)}, 9) AS weight FROM memories")
def _(t):
    return T.auto_decay(t.memories, 30).select("id", F.round("weight", 9).alias("weight"))


@query("prune_state", f"SELECT {KEEP} FROM memories WHERE NOT (invalidated_at IS NULL AND weight < 0.3 AND importance NOT IN ('critical', 'high'))")
def _(t):
    return _slim(T.prune(t.memories, 0.3))


@query("expire_state", f"SELECT {KEEP} FROM memories WHERE NOT (invalidated_at IS NULL AND coalesce(expires_at < {NOW}, false))")
def _(t):
    return _slim(T.expire(t.memories, AS_OF))


@query("invalidate_state", f"SELECT id, CASE WHEN id = '00000008' THEN {NOW} ELSE invalidated_at END AS invalidated_at, CASE WHEN id = '00000008' THEN 'wrong' ELSE invalidation_reason END AS invalidation_reason FROM memories")
def _(t):
    return T.invalidate(t.memories, "00000008", AS_OF, "wrong").select("id", "invalidated_at", "invalidation_reason")


@query("update_state", f"SELECT id, CASE WHEN id = '00000009' THEN 'new' ELSE summary END AS summary, CASE WHEN id = '00000009' THEN 1.0 ELSE weight END AS weight, CASE WHEN id = '00000009' THEN 'low' ELSE importance END AS importance, CASE WHEN id = '00000009' THEN {NOW} ELSE updated_at END AS updated_at FROM memories")
def _(t):
    return T.update(t.memories, "00000009", AS_OF, "new", "low").select("id", "summary", "weight", "importance", "updated_at")


@query("forget_state", "SELECT id, topic FROM memories WHERE id NOT IN ('00000001', '00000002')")
def _(t):
    return T.forget(t.memories, ["00000001", "00000002"]).select("id", "topic")


@query("touch_state", f"SELECT id, CASE WHEN hit THEN {NOW} ELSE last_accessed END AS last_accessed, access_count + hit::INT AS access_count FROM (SELECT *, id IN (SELECT unnest(memory_ids) FROM recall_events WHERE id LIKE '%7') AS hit FROM memories)")
def _(t):
    ids = t.recall_events.where(F.col("id").endswith("7")).select(F.explode("memory_ids").alias("id"))
    return T.touch(t.memories, ids, AS_OF).select("id", "last_accessed", "access_count")


@query("replace_state", "SELECT id, CASE WHEN id LIKE '%5' THEN 0.5::DOUBLE ELSE weight END AS weight FROM memories UNION ALL SELECT 'new1', 0.5")
def _(t):
    new = t.memories.where(F.col("id").endswith("5")).select("id", "topic").unionByName(t.spark.sql("SELECT 'new1' AS id, 'notes' AS topic")).withColumn("weight", F.lit(0.5))
    return T.replace(t.memories.select("id", "topic", "weight"), new).select("id", "weight")


_MERGED = """WITH n AS (SELECT * FROM memories WHERE topic = 'notes' AND invalidated_at IS NULL AND project = 'en'), o AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS nth FROM n),
k AS (SELECT k, min((nth, i)) AS f FROM (SELECT nth, unnest(keywords) AS k, unnest(range(len(keywords))) AS i FROM o) GROUP BY k)
SELECT 'consolidated:notes' AS id, 'Consolidated ' || count(*) || ' memories for topic ''notes'': ' || string_agg(CASE WHEN length(summary) <= 120 THEN summary ELSE substr(summary, 1, 120) || '…' END, ' | ' ORDER BY nth) FILTER (nth <= 8) AS summary,
 arg_max(importance, CASE importance WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS importance, (SELECT string_agg(k, '|' ORDER BY f) FROM k) AS keywords, string_agg(id, '|' ORDER BY nth) AS related, arg_max(branch, nth) FILTER (nth = (SELECT max(nth) FROM o)) AS branch FROM o"""


@query("consolidated_memory", _MERGED)
def _(t):
    return T.consolidated(t.memories, "notes", "en").select("id", "summary", "importance", F.array_join("keywords", "|").alias("keywords"), F.array_join("related_ids", "|").alias("related"), "branch")


@query("consolidate_state", "SELECT id FROM memories WHERE NOT (topic = 'notes' AND invalidated_at IS NULL AND project = 'en') UNION ALL SELECT 'consolidated:notes'")
def _(t):
    return T.consolidate(t.memories, "notes", "en").select("id")


@query("consolidate_given_state", f"SELECT id, topic, importance, round(weight, 9) AS weight FROM memories WHERE NOT (topic = 'notes' AND invalidated_at IS NULL) UNION ALL SELECT 'summed', 'notes', 'high', 1.0")
def _(t):
    return T.consolidate_as(t.memories, "notes", "summed", "all notes in short", AS_OF).select("id", "topic", "importance", F.round("weight", 9).alias("weight"))


@query("promote_shared", f"SELECT id, project, {KEEP.partition(', ')[2]} FROM memories UNION ALL SELECT 'copy', '_shared', topic, 1.0 FROM memories WHERE id = '00000010'")
def _(t):
    return T.promote(t.memories, "00000010", "copy").select("id", "project", "topic", F.round("weight", 9).alias("weight"))


@query("link_projects", f"WITH {LINKS_SQL} SELECT source_project, target_project FROM links UNION SELECT 'de', '_shared' UNION SELECT '_shared', 'de'")
def _(t):
    return T.link_projects(project_links(t), "de", "_shared")


@query("purge_state", "SELECT 'memories' AS kind, id FROM memories WHERE project <> 'en' UNION ALL SELECT 'documents', id FROM rag_documents WHERE project <> 'en'")
def _(t):
    kept = T.purge_project({"memories": t.memories, "documents": t.rag_documents}, "en")
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("kind"), "id") for k, df in kept.items()])


@query("purge_before_state", "SELECT 'memories' AS kind, id FROM memories WHERE created_at >= TIMESTAMP '2024-01-10' UNION ALL SELECT 'sessions', id FROM sessions WHERE started_at >= TIMESTAMP '2024-01-10'")
def _(t):
    kept = T.purge_before({"memories": (t.memories, "created_at"), "sessions": (t.sessions, "started_at")}, "2024-01-10 00:00:00")
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("kind"), "id") for k, df in kept.items()])


@query("archive_merge", """WITH o AS (SELECT id, weight, created_at, keywords FROM memories WHERE topic <> 'notes'), n AS (SELECT id, least(weight + 0.2, 1.0) AS weight, created_at - INTERVAL 1 DAY AS created_at, ['extra'] AS keywords FROM memories WHERE topic LIKE '%e%')
SELECT coalesce(o.id, n.id) AS id, round(CASE WHEN o.id IS NULL THEN n.weight WHEN n.id IS NULL THEN o.weight ELSE greatest(o.weight, n.weight) END, 9) AS weight, CASE WHEN o.id IS NULL THEN n.created_at WHEN n.id IS NULL THEN o.created_at ELSE least(o.created_at, n.created_at) END AS created_at,
 array_to_string(CASE WHEN o.id IS NULL THEN n.keywords WHEN n.id IS NULL THEN o.keywords ELSE list_sort(list_distinct(list_concat(o.keywords, n.keywords))) END, '|') AS keywords FROM o FULL OUTER JOIN n ON o.id = n.id""")
def _(t):
    m = t.memories.select("id", "topic", "weight", "created_at", "keywords")
    new = m.where("topic LIKE '%e%'").select("id", F.least(F.col("weight") + 0.2, F.lit(1.0)).alias("weight"), (F.col("created_at") - F.make_dt_interval(F.lit(1))).alias("created_at"), F.array(F.lit("extra")).alias("keywords"))
    out = T.archive_merge(m.where("topic <> 'notes'").drop("topic"), new)
    return out.select("id", F.round("weight", 9).alias("weight"), "created_at", F.array_join("keywords", "|").alias("keywords"))


@query("archive_skip", "SELECT id, weight FROM memories")
def _(t):
    m = t.memories.select("id", "weight")
    return T.archive_merge(m.where("id LIKE '%1'"), m.withColumn("weight", F.when(F.col("id").endswith("1"), 9.0).otherwise(F.col("weight"))), "skip")


@query("archive_overwrite", "SELECT id, CASE WHEN id LIKE '%1' THEN 9.0 ELSE weight END AS weight FROM memories")
def _(t):
    m = t.memories.select("id", "weight")
    return T.archive_merge(m.where("id LIKE '%1'"), m.withColumn("weight", F.when(F.col("id").endswith("1"), 9.0).otherwise(F.col("weight"))), "overwrite")


@query("reingest_state", "SELECT id, source_type FROM (SELECT id, source_type FROM rag_documents WHERE id NOT LIKE '%3' UNION ALL SELECT id || 'b', 'text' FROM rag_documents WHERE id LIKE '%3')")
def _(t):
    docs = t.rag_documents.select("id", "source_path", "source_type")
    new = docs.where(F.col("id").endswith("3")).select(F.concat("id", F.lit("b")).alias("id"), "source_path", F.lit("text").alias("source_type"))
    chunks = docs.select(F.col("id").alias("document_id"))
    return T.reingest(docs, chunks, new, new.select(F.col("id").alias("document_id")))[0].select("id", "source_type")


@query("audit_list", "SELECT id, timestamp, operation FROM audit_log WHERE timestamp >= TIMESTAMP '2024-01-05' AND operation = 'store' ORDER BY timestamp DESC, id LIMIT 15")
def _(t):
    return T.audit_list(t.audit_log, "2024-01-05 00:00:00", "store", 15).select("id", "timestamp", "operation")


@query("audit_rollback_state", "SELECT id, CASE WHEN id = (SELECT memory_id FROM audit_log WHERE id = 'aud_34') THEN NULL ELSE invalidated_at END AS invalidated_at FROM memories")
def _(t):
    return T.rollback(t.memories, t.audit_log, "aud_34").select("id", "invalidated_at")


_FNV = "lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode(summary)), '..'), lambda x: ('0x' || x)::UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0'))"


@query("audit_append", f"SELECT id, timestamp, operation, memory_id, topic, CAST(NULL AS VARCHAR) AS content_hash FROM audit_log UNION ALL SELECT 'aud_new_' || id, updated_at, 'update', id, topic, {_FNV} FROM memories")
def _(t):
    e = t.memories.select(F.concat(F.lit("aud_new_"), "id").alias("id"), F.col("updated_at").alias("timestamp"), F.lit("update").alias("operation"), F.col("id").alias("memory_id"), "topic", "summary")
    return T.audit(t.audit_log, e).select("id", "timestamp", "operation", "memory_id", "topic", "content_hash")


@query("audit_get", "SELECT id, operation, memory_id FROM audit_log WHERE id = 'aud_34'")
def _(t):
    return T.audit_get(t.audit_log, "aud_34").select("id", "operation", "memory_id")


@query("graph_neighbors", "SELECT DISTINCT id FROM (SELECT target_id AS id FROM concept_links WHERE source_id = 'n:3' UNION ALL SELECT source_id FROM concept_links WHERE target_id = 'n:3')")
def _(t):
    return G.neighbours(t.concept_links, "n:3")


_BFS = """WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM concept_links UNION SELECT target_id, source_id FROM concept_links),
w AS (SELECT 'r:1' AS id, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.id WHERE w.depth < 2), v AS (SELECT id, min(depth)::INT AS depth FROM w GROUP BY id)"""


@query("graph_bfs2", _BFS + " SELECT id, depth FROM v")
def _(t):
    return G.bfs(t.concept_links, "r:1", 2)


@query("graph_bfs_links", _BFS + " SELECT DISTINCT l.source_id, l.target_id, l.relation, coalesce(s.name, '?') AS source, coalesce(t.name, '?') AS target FROM concept_links l LEFT JOIN concepts s ON s.id = l.source_id LEFT JOIN concepts t ON t.id = l.target_id WHERE l.source_id IN (SELECT id FROM v WHERE depth < 2) OR l.target_id IN (SELECT id FROM v WHERE depth < 2)")
def _(t):
    links = t.concept_links
    return G.with_names(G.bfs_links(links, G.bfs(links, "r:1", 2), 2), t.concepts).select("source_id", "target_id", "relation", "source", "target")


@query("graph_label", f"SELECT id, confidence FROM concepts WHERE memoir_id = 'mem_geo' AND list_contains({LABELS}, 'kind:nation') ORDER BY confidence DESC, id LIMIT 10")
def _(t):
    return G.with_label(t.concepts, "mem_geo", "kind:nation", 10).select("id", "confidence")


@query("graph_labels_intersect", f"SELECT id FROM concepts WHERE memoir_id = 'mem_geo' AND list_contains({LABELS}, 'kind:supplier') AND list_contains({LABELS}, 'region:2')")
def _(t):
    return G.with_labels(t.concepts, "mem_geo", ["kind:supplier", "region:2"]).select("id")


@query("callers", "SELECT source_id AS id, relation, weight FROM concept_links WHERE target_id = 'p:8' AND relation IN ('related_to', 'depends_on')")
def _(t):
    return G.callers(t.concept_links, "p:8")


@query("callees", "SELECT target_id AS id, relation, weight FROM concept_links WHERE source_id = 'p:9' AND relation IN ('related_to', 'depends_on')")
def _(t):
    return G.callees(t.concept_links, "p:9")


@query("implementors", "SELECT source_id AS id, relation, weight FROM concept_links WHERE target_id = 'p:15' AND relation IN ('related_to', 'instance_of', 'refines')")
def _(t):
    return G.implementors(t.concept_links, "p:15")


@query("memoir_stats", "SELECT count(*) AS concepts, avg(confidence) AS avg_confidence, (SELECT count(*) FROM concept_links WHERE source_id IN (SELECT id FROM concepts WHERE memoir_id = 'mem_geo')) AS links FROM concepts WHERE memoir_id = 'mem_geo'")
def _(t):
    return G.memoir_stats(t.concepts, t.concept_links, "mem_geo")


@query("label_counts", f"WITH l AS (SELECT unnest({LABELS}) AS label FROM concepts WHERE memoir_id = 'mem_geo') SELECT label, count(*) AS n FROM l GROUP BY label")
def _(t):
    return G.label_counts(t.concepts, "mem_geo")


@query("concept_refine_state", "SELECT id, CASE WHEN id = 'n:5' THEN 'new' ELSE definition END AS definition, CASE WHEN id = 'n:5' THEN least(1.0, confidence + 0.1) ELSE confidence END AS confidence, revision + (id = 'n:5')::INT AS revision FROM concepts")
def _(t):
    return G.refine(t.concepts, "n:5", "new").select("id", "definition", "confidence", "revision")


_NEW = "SELECT id, memoir_id, name, CASE WHEN revision = 2 AND confidence > 0.35 THEN definition || '!' ELSE definition END AS definition, labels FROM concepts WHERE memoir_id = 'mem_geo' AND NOT starts_with(id, 'r:') UNION ALL SELECT 'x:1', 'mem_geo', 'NEW', 'new one', [struct_pack(namespace := 'kind', value := 'new')]"


@query("graph_upsert_report", f"""WITH n AS ({_NEW}) SELECT CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'created' WHEN o.definition = n.definition THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n, sum(CASE WHEN n.id IS NOT NULL AND o.id IS NOT NULL AND o.definition <> n.definition THEN o.revision + 1 ELSE coalesce(o.revision, 1) END)::BIGINT AS revisions
FROM concepts o FULL OUTER JOIN n ON o.memoir_id = n.memoir_id AND o.name = n.name GROUP BY 1""")
def _(t):
    c = t.concepts
    new = c.where("memoir_id = 'mem_geo' AND NOT startswith(id, 'r:')").select("id", "memoir_id", "name", F.when((F.col("revision") == 2) & (F.col("confidence") > 0.35), F.concat("definition", F.lit("!"))).otherwise(F.col("definition")).alias("definition"), "labels")
    new = new.unionByName(t.spark.sql("SELECT 'x:1' AS id, 'mem_geo' AS memoir_id, 'NEW' AS name, 'new one' AS definition, array(named_struct('namespace', 'kind', 'value', 'new')) AS labels"))
    return G.upsert_concepts(c, new).groupBy("action").agg(F.count("*").alias("n"), F.sum("revision").alias("revisions"))


@query("graph_upsert_links", """WITH n AS (SELECT source_id, target_id, 'part_of' AS relation, CASE WHEN source_id LIKE '%1' THEN 0.5 ELSE weight END AS w FROM concept_links WHERE relation = 'part_of' UNION ALL SELECT 'r:0', 'r:1', 'depends_on', 0.4)
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.target_id, n.target_id) AS target_id, coalesce(o.relation, n.relation) AS relation, coalesce(n.w, o.weight)::DOUBLE AS weight, CASE WHEN n.w IS NULL THEN 'kept' WHEN o.weight IS NULL THEN 'created' WHEN abs(o.weight - n.w) > 1.2e-7 THEN 'updated' ELSE 'unchanged' END AS action
FROM concept_links o FULL OUTER JOIN n ON o.source_id = n.source_id AND o.target_id = n.target_id AND o.relation = n.relation""")
def _(t):
    links = t.concept_links
    new = links.where("relation = 'part_of'").select("source_id", "target_id", F.lit("Contains").alias("relation"), F.when(F.col("source_id").endswith("1"), 0.5).otherwise(F.col("weight")).alias("weight"))
    new = new.unionByName(t.spark.sql("SELECT 'r:0' AS source_id, 'r:1' AS target_id, 'imports' AS relation, CAST(0.4 AS DOUBLE) AS weight"))
    return G.upsert_links(links, new)


_EDGES = "SELECT c.name AS source, CASE WHEN c.id LIKE '%3' THEN c.name || '?' ELSE d.name END AS target, 'has' AS relation, 1.0::DOUBLE AS weight FROM concepts c JOIN concepts d ON c.memoir_id = 'mem_geo' AND d.memoir_id = 'mem_geo' AND d.id LIKE 'r:%' AND c.id LIKE 'n:%'"


def _edges(t):
    c = t.concepts.where("memoir_id = 'mem_geo'")
    r = c.where("startswith(id, 'r:')").select(F.col("name").alias("d"), F.lit(1).alias("k"))
    n = c.where("startswith(id, 'n:')").select("id", F.col("name").alias("source"), F.lit(1).alias("k"))
    return n.join(r, "k").select("source", F.when(F.col("id").endswith("3"), F.concat("source", F.lit("?"))).otherwise(F.col("d")).alias("target"), F.lit("has").alias("relation"), F.lit(1.0).alias("weight"))


@query("graph_resolve_errors", f"SELECT source, target, relation FROM ({_EDGES}) WHERE target LIKE '%?'")
def _(t):
    return G.resolve_edges(_edges(t), t.concepts, "mem_geo")[1]


@query("graph_resolve_links", f"SELECT s.id AS source_id, d.id AS target_id, e.relation FROM ({_EDGES}) e JOIN concepts s ON s.name = e.source AND s.memoir_id = 'mem_geo' JOIN concepts d ON d.name = e.target AND d.memoir_id = 'mem_geo'")
def _(t):
    return G.resolve_edges(_edges(t), t.concepts, "mem_geo")[0].drop("weight")


@query("concept_named", "SELECT id, confidence FROM concepts WHERE memoir_id = 'mem_code' AND name = 'part_17'")
def _(t):
    return G.named(t.concepts, "part_17", "mem_code").select("id", "confidence")


@query("memoir_list", "SELECT id, name, (SELECT count(*) FROM concepts c WHERE c.memoir_id = m.id) AS concepts FROM memoirs m")
def _(t):
    n = t.concepts.groupBy(F.col("memoir_id").alias("id")).agg(F.count("*").alias("concepts"))
    return G.listed(t.memoirs).select("id", "name").join(n, "id", "left").fillna(0, ["concepts"])


@query("concept_list", "SELECT id, name FROM concepts WHERE memoir_id = 'mem_geo'")
def _(t):
    return G.listed(t.concepts, "mem_geo").select("id", "name")


@query("concept_memoir_names", "SELECT c.id, m.name AS memoir FROM concepts c LEFT JOIN memoirs m ON m.id = c.memoir_id")
def _(t):
    return G.with_memoir_names(t.concepts, t.memoirs).select("id", "memoir")


@query("links_from", "SELECT target_id, relation FROM concept_links WHERE source_id = 'n:3'")
def _(t):
    return G.links_of(t.concept_links, "n:3").select("target_id", "relation")


@query("links_to", "SELECT source_id, relation FROM concept_links WHERE target_id = 'n:3'")
def _(t):
    return G.links_of(t.concept_links, "n:3", False).select("source_id", "relation")


@query("memoir_add_state", "SELECT id, name, description FROM memoirs UNION ALL SELECT 'mem_new', 'notes', 'new'")
def _(t):
    new = t.spark.sql("SELECT * FROM VALUES ('mem_new', 'notes', 'new'), ('mem_other', 'geo', 'taken') AS v(id, name, description)")
    return G.add_memoirs(t.memoirs, new).select("id", "name", "description")


@query("memoir_update_state", "SELECT id, name, CASE id WHEN 'mem_geo' THEN 'places' ELSE description END AS description FROM memoirs")
def _(t):
    return G.update_memoir(t.memoirs, "mem_geo", AS_OF, description="places").select("id", "name", "description")


@query("memoir_delete_state", "SELECT 'memoir' AS kind, id FROM memoirs WHERE id <> 'mem_code' UNION ALL SELECT 'concept', id FROM concepts WHERE memoir_id <> 'mem_code' UNION ALL SELECT 'link', source_id || '>' || target_id FROM concept_links WHERE source_id NOT LIKE 'p:%' AND target_id NOT LIKE 'p:%'")
def _(t):
    m, c, k = G.delete_memoir(t.memoirs, t.concepts, t.concept_links, "mem_code")
    rows = [m.select(F.lit("memoir").alias("kind"), "id"), c.select(F.lit("concept").alias("kind"), "id"), k.select(F.lit("link").alias("kind"), F.concat_ws(">", "source_id", "target_id").alias("id"))]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("concept_add_state", "SELECT id, name, confidence, revision FROM concepts UNION ALL SELECT 'x:' || n_nationkey, n_name || ' NEW', 0.5::DOUBLE, 1 FROM nation")
def _(t):
    n = t.raw("nation").select(F.concat(F.lit("x:"), "n_nationkey").alias("id"), F.lit("mem_geo").alias("memoir_id"), F.explode(F.array(F.concat("n_name", F.lit(" NEW")), F.col("n_name"))).alias("name"), F.lit("d").alias("definition"))
    return G.add_concepts(t.concepts, n).select("id", "name", "confidence", "revision")


@query("concept_update_state", "SELECT id, CASE id WHEN 'n:4' THEN 'told anew' ELSE definition END AS definition, CASE id WHEN 'n:4' THEN 0.25 ELSE confidence END AS confidence FROM concepts")
def _(t):
    return G.update_concept(t.concepts, "n:4", "told anew", 0.25).select("id", "definition", "confidence")


@query("concept_delete_state", "SELECT 'concept' AS kind, id FROM concepts WHERE NOT (id LIKE 's:%7') UNION ALL SELECT 'link', source_id || '>' || target_id FROM concept_links WHERE NOT (source_id LIKE 's:%7' OR target_id LIKE 's:%7')")
def _(t):
    c, k = G.delete_concepts(t.concepts, t.concept_links, t.concepts.where("id LIKE 's:%7'").select("id"))
    return c.select(F.lit("concept").alias("kind"), "id").unionByName(k.select(F.lit("link").alias("kind"), F.concat_ws(">", "source_id", "target_id").alias("id")))


@query("link_add_state", "SELECT source_id, target_id, relation, weight FROM concept_links UNION ALL SELECT target_id, source_id, 'depends_on', 0.25::DOUBLE FROM concept_links WHERE relation = 'part_of' AND source_id LIKE 'n:%'")
def _(t):
    links = t.concept_links
    new = links.where("relation = 'part_of' AND source_id LIKE 'n:%'")
    back = new.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("Imports").alias("relation"), F.lit(0.25).alias("weight"))
    return G.add_links(links, back.unionByName(new.withColumn("relation", F.lit("contains")))).select("source_id", "target_id", "relation", "weight")


@query("link_delete_state", "SELECT source_id, target_id, relation FROM concept_links WHERE NOT (relation = 'part_of' AND source_id LIKE 'n:%')")
def _(t):
    gone = t.concept_links.where("source_id LIKE 'n:%'").withColumn("relation", F.lit("Contains"))
    return G.delete_links(t.concept_links, gone).select("source_id", "target_id", "relation")


@query("graph_prune", "SELECT id FROM concepts WHERE NOT (memoir_id = 'mem_geo' AND NOT starts_with(id, 'r:'))")
def _(t):
    keep = t.concepts.where("memoir_id = 'mem_geo' AND startswith(id, 'r:')").select("name")
    return G.prune_concepts(t.concepts, t.concept_links, "mem_geo", keep)[0].select("id")


@query("understanding", "SELECT name, count(*) OVER () AS total FROM concepts WHERE memoir_id = 'mem_code' ORDER BY name, id LIMIT 8")
def _(t):
    return G.understanding(t.concepts, "mem_code").select("name", "total")


_SPOKEN = "CASE p_partkey % 4 WHEN 0 THEN 'Contains' WHEN 1 THEN 'uses' WHEN 2 THEN 'Implements' ELSE 'odd One' END"


@query("relation_names", f"SELECT p_partkey, {_SPOKEN} AS relation, CASE p_partkey % 4 WHEN 0 THEN 'part_of' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'refines' ELSE 'odd one' END AS canonical FROM part")
def _(t):
    return t.raw("part").select("p_partkey", F.expr(_SPOKEN).alias("relation")).withColumn("canonical", G.relation(F.col("relation")))


@query("sessions_recent", "SELECT id, started_at FROM sessions WHERE project = 'p2' AND scope = 'review' ORDER BY started_at DESC, id LIMIT 12")
def _(t):
    return SE.of_project(t.sessions, "p2", "review", 12).select("id", "started_at")


@query("sessions_identity", "SELECT id FROM sessions WHERE project = 'p2' AND project_root = '/src/p2' AND worktree_id = 'wt0' ORDER BY started_at DESC, id LIMIT 12")
def _(t):
    return SE.of_identity(t.sessions, "p2", "/src/p2", "wt0", 12).select("id")


@query("sessions_between", "SELECT id, coalesce(ended_at, started_at) AS at FROM sessions WHERE coalesce(ended_at, started_at) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' ORDER BY 2 DESC, id LIMIT 30")
def _(t):
    return SE.between(t.sessions, "2024-01-05 00:00:00", "2024-01-08 00:00:00", 30).select("id", SE.moment().alias("at"))


@query("active_session", "SELECT id FROM sessions WHERE project = 'p1' AND status = 'active' AND scope IS NULL ORDER BY started_at DESC, id LIMIT 1")
def _(t):
    return SE.active_session(t.sessions, "p1").select("id")


@query("session_start_state", "SELECT id, project, status FROM sessions UNION ALL SELECT 'new_' || id, project || '_other', 'active' FROM sessions WHERE status = 'active' AND id LIKE '%7'")
def _(t):
    # Half of the new sessions belong to projects and scopes that are busy, half to projects that nobody works on.
    x = t.sessions.where("status = 'active' AND id LIKE '%7'").withColumn("id", F.concat(F.lit("new_"), "id"))
    return SE.start(t.sessions, x.unionByName(x.withColumn("project", F.concat("project", F.lit("_other"))))).select("id", "project", "status")


@query("session_end_state", f"SELECT 'session' AS kind, id, CASE WHEN id = (SELECT min(id) FROM sessions WHERE status = 'active') THEN 'completed' ELSE status END AS status, CAST(NULL AS BIGINT) AS value FROM sessions UNION ALL SELECT 'signal', 'sig_end_' || min(id), 'session_failure', -2 FROM sessions WHERE status = 'active'")
def _(t):
    first = t.sessions.where("status = 'active'").agg(F.min("id")).first()[0]
    done, signal = SE.end(t.sessions, first, AS_OF, "ended", 3)
    return done.select(F.lit("session").alias("kind"), "id", "status", F.lit(None).cast("long").alias("value")).unionByName(signal.select(F.lit("signal").alias("kind"), "id", F.col("signal_type").alias("status"), F.col("signal_value").alias("value")))


@query("session_status", "SELECT count(*) > 0 AS found, max(status) AS status FROM sessions WHERE id = 'ses_7_3'")
def _(t):
    return SE.status(t.sessions, "ses_7_3")


@query("session_import_state", "SELECT id, project FROM sessions UNION ALL SELECT 'imported_' || id, project FROM sessions WHERE id LIKE '%5'")
def _(t):
    s = t.sessions.where("id LIKE '%5'")
    return SE.import_sessions(t.sessions, s.withColumn("id", F.concat(F.lit("imported_"), "id")).unionByName(s.withColumn("project", F.lit("never")))).select("id", "project")


_TIMELINE = """WITH e AS (SELECT session_id, recalled_at AS ts, 'recall' AS kind, query AS detail FROM recall_events UNION ALL SELECT session_id, occurred_at, 'outcome', signal_type FROM outcome_signals), g AS (SELECT session_id, count(*) FILTER (kind = 'recall') AS recall_count, count(*) FILTER (kind = 'outcome') AS outcome_count, max(ts) AS lst, string_agg(kind || ' ' || detail, ',' ORDER BY ts DESC, kind DESC, detail DESC) AS events FROM e GROUP BY 1)
SELECT id, coalesce(recall_count, 0) AS recall_count, coalesce(outcome_count, 0) AS outcome_count, greatest(started_at, ended_at, lst) AS last_activity, coalesce(events, '') AS events FROM sessions LEFT JOIN g ON g.session_id = id ORDER BY last_activity DESC, id LIMIT 50"""


@query("session_timeline", _TIMELINE)
def _(t):
    x = SE.timeline(t.sessions, t.recall_events, t.outcome_signals, 50)
    said = F.array_join(F.transform("events", lambda e: F.concat_ws(" ", e["kind"], e["detail"])), ",")
    return x.select("id", "recall_count", "outcome_count", "last_activity", F.coalesce(said, F.lit("")).alias("events"))


@query("attribute_signals", """SELECT s.id, s.session_id, r.id AS recall_event_id FROM outcome_signals s JOIN sessions x ON x.id = s.session_id LEFT JOIN LATERAL (SELECT id, recalled_at FROM recall_events q WHERE q.session_id = s.session_id AND q.recalled_at <= s.occurred_at AND q.recalled_at >= s.occurred_at - INTERVAL 60 MINUTE AND (x.ended_at IS NULL OR s.occurred_at <= x.ended_at) ORDER BY recalled_at DESC, id LIMIT 1) r ON true""")
def _(t):
    return FB.attribute(t.outcome_signals, t.recall_events, t.sessions)


_SCORES = """r0 AS (SELECT r.id, r.session_id, recalled_at, least(s.ended_at, recalled_at + INTERVAL 60 MINUTE) AS until, memory_ids FROM recall_events r JOIN sessions s ON s.id = r.session_id WHERE s.ended_at IS NOT NULL),
h0 AS (SELECT r0.id, count(*) AS n, sum(signal_value) AS total, sum(abs(signal_value)) AS size FROM r0 JOIN outcome_signals g ON g.session_id = r0.session_id AND g.occurred_at BETWEEN recalled_at AND until WHERE until > recalled_at AND signal_value <> 0 GROUP BY 1),
sc AS (SELECT memory_ids[i] AS memory_id, r0.id AS recall_event_id, CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE total / greatest(size, 1)::DOUBLE END / (1 + 0.3 * (i - 1)) AS effectiveness, coalesce(n, 0) AS signal_count FROM (SELECT *, unnest(range(1, len(memory_ids) + 1)) AS i FROM r0 WHERE until > recalled_at) r0 LEFT JOIN h0 ON h0.id = r0.id)"""


@query("recall_scores", f"WITH {_SCORES} SELECT memory_id, recall_event_id, round(effectiveness, 9) AS effectiveness, signal_count FROM sc")
def _(t):
    s = FB.score(t.recall_events, t.outcome_signals, t.sessions, AS_OF)
    return s.select("memory_id", "recall_event_id", F.round("effectiveness", 9).alias("effectiveness"), "signal_count")


@query("signal_counts", "SELECT count(*) AS n FROM outcome_signals WHERE occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND signal_type = 'correction' AND project = 'p3'")
def _(t):
    return FB.counts(t.outcome_signals, "2024-01-05 00:00:00", "2024-01-20 00:00:00", "correction", "p3")


def _greedy(name: str, legacy: str, structured: str, seconds: int) -> str:
    """CTEs that end in ``name``: the ids of ``legacy`` (key, tm, id) that nothing of ``structured`` (key, tm) stands for, by a walk through both lists of a key."""
    early, late = f"epoch_us(l.tm) - epoch_us(s.tm) >= {seconds + 1}000000", f"epoch_us(s.tm) - epoch_us(l.tm) < {seconds + 1}000000"
    return f"""{name}_l AS MATERIALIZED (SELECT key, tm, id, row_number() OVER (PARTITION BY key ORDER BY tm, id) AS i FROM ({legacy})), {name}_s AS MATERIALIZED (SELECT key, tm, row_number() OVER (PARTITION BY key ORDER BY tm) AS j FROM ({structured})),
{name}_w AS (SELECT DISTINCT key, 1::BIGINT AS i, 1::BIGINT AS j, CAST(NULL AS VARCHAR) AS id FROM {name}_l
 UNION ALL SELECT w.key, CASE WHEN s.tm IS NOT NULL AND {early} THEN w.i ELSE w.i + 1 END, CASE WHEN s.tm IS NOT NULL AND ({early} OR {late}) THEN w.j + 1 ELSE w.j END, CASE WHEN s.tm IS NULL OR NOT ({early} OR {late}) THEN l.id END
  FROM {name}_w w JOIN {name}_l l ON l.key IS NOT DISTINCT FROM w.key AND l.i = w.i LEFT JOIN {name}_s s ON s.key IS NOT DISTINCT FROM w.key AND s.j = w.j),
{name} AS (SELECT id FROM {name}_w WHERE id IS NOT NULL)"""


@query("unmatched_records", "WITH RECURSIVE " + _greedy("u", "SELECT session_id AS key, occurred_at AS tm, id FROM outcome_signals", "SELECT session_id AS key, recalled_at AS tm FROM recall_events", 1800) + " SELECT id FROM u")
def _(t):
    legacy = t.outcome_signals.select("session_id", F.col("occurred_at").alias("at"), "id")
    return E.unmatched(legacy, t.recall_events.select("session_id", F.col("recalled_at").alias("at")), ["session_id"], 1800)


def _window_sql(name: str, newest: int, oldest: int) -> str:
    lo, hi = f"{NOW} - INTERVAL {oldest} DAY", f"{NOW} - INTERVAL {newest} DAY"
    made, ses = f"invalidated_at IS NULL AND created_at BETWEEN {lo} AND {hi}", f"coalesce(ended_at, started_at) BETWEEN {lo} AND {hi}"
    record = "CASE WHEN task IS NOT NULL THEN 'Session completed: ' || task || '. ' || summary ELSE 'Session completed. ' || summary END"
    sig = f"SELECT * FROM outcome_signals WHERE occurred_at BETWEEN {lo} AND {hi}"
    parts = (
        _greedy(f"{name}x", f"SELECT (coalesce(project, topic), summary) AS key, created_at AS tm, id FROM memories WHERE {made} AND topic LIKE 'session/%'", f"SELECT (project, {record}) AS key, coalesce(ended_at, started_at) AS tm FROM sessions WHERE {ses} AND summary IS NOT NULL", 300),
        _greedy(f"{name}y", f"SELECT project AS key, created_at AS tm, id FROM memories WHERE {made} AND topic = 'corrections'", f"SELECT project AS key, occurred_at AS tm FROM ({sig}) WHERE signal_type = 'correction'", 30),
        _greedy(f"{name}z", f"SELECT id AS key, last_accessed AS tm, id FROM memories WHERE invalidated_at IS NULL AND access_count > 0 AND last_accessed BETWEEN {lo} AND {hi}", f"SELECT unnest(memory_ids) AS key, recalled_at AS tm FROM recall_events WHERE recalled_at BETWEEN {lo} AND {hi}", 300),
    )
    n = lambda kind, topic: f"(SELECT count(*) FROM ({sig}) WHERE signal_type = '{kind}') + (SELECT count(*) FROM memories WHERE {made} AND topic = '{topic}')"
    return ", ".join(parts) + f""", {name} AS (SELECT {n("tool_error", "errors/active")} AS error_count, (SELECT count(*) FROM ({sig}) WHERE signal_type = 'correction') + (SELECT count(*) FROM {name}y) AS correction_count,
 {n("error_resolved", "errors/resolved")} AS resolved_count, (SELECT count(*) FROM memories WHERE {made} AND topic = 'tests/failed') AS failed_test_count, {n("test_passed", "tests/resolved")} AS resolved_test_count,
 (SELECT count(*) FROM sessions WHERE {ses}) + (SELECT count(*) FROM {name}x) AS session_count,
 ((SELECT coalesce(sum(strlen(concat_ws(' ', task, summary))), 0) FROM sessions WHERE {ses}) + (SELECT coalesce(sum(strlen(summary)), 0) FROM memories WHERE id IN (SELECT id FROM {name}x)))::BIGINT AS total_session_length,
 ((SELECT coalesce(sum(len(memory_ids)), 0) FROM recall_events WHERE recalled_at BETWEEN {lo} AND {hi}) + (SELECT count(*) FROM {name}z))::BIGINT AS recalled_memory_count)"""


_TWO = "WITH RECURSIVE " + _window_sql("wr", 0, 15) + ", " + _window_sql("wp", 15, 30)
_METRICS = ", ".join(f"""{w}m AS (SELECT coalesce(error_count / nullif(session_count, 0)::DOUBLE, 0) AS error_rate, coalesce(correction_count / nullif(session_count, 0)::DOUBLE, 0) AS correction_rate, coalesce(resolved_count / nullif(error_count + resolved_count, 0)::DOUBLE, 0) AS resolution_rate,
 coalesce(resolved_test_count / nullif(failed_test_count + resolved_test_count, 0)::DOUBLE, 0) AS test_fix_rate, CASE WHEN session_count = 0 THEN 0 ELSE recalled_memory_count / (recalled_memory_count + 5)::DOUBLE * 100 END AS memory_utilization FROM {w})""" for w in ("wr", "wp"))
_PAIRS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {str(low).lower()} AS low, p.{m} AS previous, r.{m} AS recent FROM wpm p, wrm r" for m, low in E.METRICS.items())
_BETTER = "CASE WHEN low THEN recent < previous ELSE recent > previous END"


def _windows(t):
    args = (t.memories, t.sessions, t.recall_events, t.outcome_signals, AS_OF)
    return E.window(*args, 0, 15), E.window(*args, 15, 30)


@query("eval_window", "WITH RECURSIVE " + _window_sql("wr", 0, 15) + " SELECT * FROM wr")
def _(t):
    return _windows(t)[0]


@query("eval_report", f"{_TWO}, {_METRICS}, t AS ({_PAIRS}) SELECT metric, round(previous, 9) AS previous, round(recent, 9) AS recent, CASE WHEN abs(coalesce((recent - previous) / nullif(previous, 0) * 100, CASE WHEN recent > 0 THEN 100 ELSE 0 END)) <= 2 THEN 'stable' WHEN {_BETTER} THEN 'better' ELSE 'worse' END AS trend FROM t")
def _(t):
    return E.report(*_windows(t)).withColumns({c: F.round(c, 9) for c in ("previous", "recent")})


@query("eval_report_unbanded", f"{_TWO}, {_METRICS}, t AS ({_PAIRS}), n AS (SELECT count(*) FILTER (metric <> 'memory_utilization' AND previous <> 0 AND {_BETTER}) AS n FROM t) SELECT ([{', '.join(repr(v) for v in E.VERDICTS)}])[n + 1] AS assessment FROM n")
def _(t):
    return E.assessment(E.report(*_windows(t), stable_band=False))


@query("feedback_log", "SELECT 'kept' AS kind, id, project FROM outcome_signals UNION ALL SELECT 'kept', 'again_' || g.id, s.project FROM outcome_signals g JOIN sessions s ON s.id = g.session_id WHERE g.id LIKE '%7' AND g.signal_type = 'test_passed' UNION ALL SELECT 'refused', 'other_' || id, 'elsewhere' FROM outcome_signals WHERE id LIKE '%7' UNION ALL SELECT 'refused', 'odd_' || id, NULL FROM outcome_signals WHERE id LIKE '%7'")
def _(t):
    s = t.outcome_signals
    x = s.where("id LIKE '%7'")
    new = x.where("signal_type = 'test_passed'").withColumns({"id": F.concat(F.lit("again_"), "id"), "signal_type": F.lit("test_pass"), "project": F.lit(None).cast("string")})
    other = x.withColumns({"id": F.concat(F.lit("other_"), "id"), "project": F.lit("elsewhere")})
    odd = x.withColumns({"id": F.concat(F.lit("odd_"), "id"), "signal_type": F.lit("sneeze"), "project": F.lit(None).cast("string")})
    kept, refused = FB.log(s, new.unionByName(other).unionByName(odd), t.sessions)
    return kept.select(F.lit("kept").alias("kind"), "id", "project").unionByName(refused.select(F.lit("refused").alias("kind"), "id", F.when(F.col("id").startswith("odd"), None).otherwise(F.col("project")).alias("project")))


@query("signals_between", "SELECT id, occurred_at FROM outcome_signals WHERE project = 'p3' AND occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def _(t):
    return FB.between(t.outcome_signals, "occurred_at", "2024-01-05 00:00:00", "2024-01-09 00:00:00", "p3").select("id", "occurred_at")


@query("recalls_between", "SELECT id, query FROM recall_events WHERE project = 'p1' AND recalled_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def _(t):
    return FB.between(t.recall_events, "recalled_at", "2024-01-05 00:00:00", "2024-01-09 00:00:00", "p1").select("id", "query")


@query("top_recalled_labels", f"WITH {EFFECTS_SQL}, r AS (SELECT id, unnest(memory_ids) AS m FROM recall_events WHERE recalled_at BETWEEN {NOW} - INTERVAL 20 DAY AND {NOW}), p AS (SELECT m AS memory_id, round(avg(effectiveness), 9) AS effectiveness FROM r JOIN fx ON fx.recall_event_id = r.id AND fx.memory_id = r.m GROUP BY m ORDER BY 2 DESC, m LIMIT 5) SELECT memory_id, coalesce(topic, '?') AS topic, coalesce(substr(summary, 1, 60), '?') AS label FROM p LEFT JOIN memories ON id = memory_id")
def _(t):
    return E.with_labels(E.top_recalled(t.recall_events, effects(t), AS_OF, 0, 20), t.memories).select("memory_id", "topic", "label")


@query("effectiveness_window", f"WITH {EFFECTS_SQL}, r AS (SELECT id, unnest(memory_ids) AS m FROM recall_events WHERE recalled_at BETWEEN {NOW} - INTERVAL 20 DAY AND {NOW}) SELECT count(*) AS recalled, count(effectiveness) AS scored, count(*) FILTER (abs(effectiveness) > 1.2e-7) AS non_zero, round(coalesce(sum(effectiveness), 0), 6) AS total FROM r LEFT JOIN fx ON fx.recall_event_id = r.id AND fx.memory_id = r.m")
def _(t):
    return E.effectiveness_window(t.recall_events, effects(t), AS_OF, 0, 20).withColumn("total", F.round("total", 6))


@query("top_recalled", f"WITH {EFFECTS_SQL}, r AS (SELECT id, unnest(memory_ids) AS m FROM recall_events WHERE recalled_at BETWEEN {NOW} - INTERVAL 20 DAY AND {NOW}) SELECT m AS memory_id, round(avg(effectiveness), 9) AS effectiveness FROM r JOIN fx ON fx.recall_event_id = r.id AND fx.memory_id = r.m GROUP BY m ORDER BY 2 DESC, m LIMIT 5")
def _(t):
    return E.top_recalled(t.recall_events, effects(t), AS_OF, 0, 20).withColumn("effectiveness", F.round("effectiveness", 9))


_EX = """ex AS (SELECT topic, summary, weight FROM memories WHERE invalidated_at IS NULL AND (topic IN ('errors/resolved', 'corrections') OR topic LIKE 'decisions/%' OR topic LIKE 'context/%' OR topic LIKE 'session/%')
UNION ALL SELECT 'session/' || project, CASE WHEN task IS NOT NULL THEN 'Session completed: ' || task || '. ' || summary ELSE 'Session completed. ' || summary END, 1.0 FROM sessions WHERE summary IS NOT NULL)"""


@query("export_sft", f"WITH {_EX} SELECT 'What is our convention for: ' || topic AS instruction, summary AS response FROM ex WHERE weight >= 0.3")
def _(t):
    return X.sft(X.quality(X.examples(t.memories, t.sessions), 0.3))


@query("export_alpaca", f"WITH {_EX} SELECT 'Topic: ' || topic AS instruction, '' AS input, summary AS output FROM ex")
def _(t):
    return X.alpaca(X.examples(t.memories, t.sessions))


@query("export_dpo", "SELECT 'Fix the code: ' || topic AS prompt, 'good ' || id AS chosen, 'bad ' || topic AS rejected FROM memories WHERE (topic IN ('errors/resolved', 'corrections') OR topic LIKE 'decisions/%' OR topic LIKE 'context/%' OR topic LIKE 'session/%') AND invalidated_at IS NULL")
def _(t):
    m = t.memories.withColumn("summary", F.concat(F.lit("Original: bad "), "topic", F.lit("\nCorrection: first\nCorrection:  good "), "id", F.lit(" ")))
    return X.dpo(X.examples(m, t.sessions))


@query("export_archive", "SELECT 'link' AS kind, count(*) AS n FROM concept_links UNION ALL SELECT 'concept', count(*) FROM concepts")
def _(t):
    a = SN.export_archive({"link": t.concept_links, "concept": t.concepts})
    return a.groupBy("kind").agg(F.count("*").alias("n"))


@query("chunk_window", """WITH w AS (SELECT id AS document_id, regexp_split_to_array(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ') AS w FROM rag_documents WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> ''),
c AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 40 THEN 1 ELSE (len(w) - 40 + 29) // 30 + 1 END)) AS chunk_index FROM w) SELECT document_id, chunk_index::INT AS chunk_index, array_to_string(w[chunk_index * 30 + 1:chunk_index * 30 + 40], ' ') AS content FROM c""")
def _(t):
    return C.window_chunks(t.rag_documents, 40, 10).select("document_id", "chunk_index", "content")


@query("chunk_blocks", """WITH b AS (SELECT id AS document_id, list_filter(list_transform(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS b FROM rag_documents) SELECT document_id, i::INT AS chunk_index, b[i + 1] AS content FROM (SELECT *, unnest(range(len(b))) AS i FROM b)""")
def _(t):
    d = t.rag_documents.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return C.block_chunks(d).drop("chunk_strategy")


@query("chunk_strategy", "SELECT id, CASE source_type WHEN 'markdown' THEN 'by_heading' WHEN 'code' THEN 'by_ast' ELSE 'sliding_window' END AS chunk_strategy FROM rag_documents")
def _(t):
    return C.strategy(t.rag_documents).select("id", "chunk_strategy")


_FIT = """f AS (SELECT *, regexp_split_to_array(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ') AS w FROM cut WHERE regexp_matches(content, '\\S')),
p AS (SELECT document_id, sec, heading, unnest(range(CASE WHEN len(w) <= 50 THEN 1 ELSE (len(w) - 50 + 44) // 45 + 1 END)) AS k, content, w FROM f),
c AS (SELECT document_id, sec, k, heading, CASE WHEN len(w) <= 50 THEN content ELSE array_to_string(w[k * 45 + 1:k * 45 + 50], ' ') END AS content FROM p)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY sec, k) - 1)::INT AS chunk_index, content, heading, '{name}' AS chunk_strategy FROM c"""
_LINE = "SELECT id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_split_to_array(regexp_replace({content}, '\\n$', ''), '\\n') AS l FROM rag_documents)"


@query("chunk_heading", f"""WITH l AS ({_LINE.format(content="regexp_replace(content, '([^\\n]+)\\n', '## ' || '\\1' || chr(10) || '\\1 and more' || chr(10), 'g')")}),
m AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+$') AS h FROM l), n AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY i) AS sec FROM m),
cut AS (SELECT id AS document_id, sec, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), ''), '^\\s+|\\s+$', '', 'g') AS content, max(CASE WHEN h THEN regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1) END) AS heading FROM n GROUP BY id, sec),
{_FIT.format(name="by_heading")}""")
def _(t):
    d = t.rag_documents.withColumn("content", F.regexp_replace("content", r"([^\n]+)\n", "## $1\n$1 and more\n"))
    return C.heading_chunks(d, 50)


@query("chunk_symbols", """WITH d AS (SELECT id AS document_id, regexp_split_to_array(regexp_replace(content, '\\n$', ''), '\\n') AS l FROM rag_documents WHERE source_type = 'code'),
s AS (SELECT *, len(l) AS n, CASE WHEN len(l) >= 2 THEN 2 ELSE 1 END AS e1, CASE WHEN len(l) >= 5 THEN 1 ELSE 0 END AS two FROM d),
r AS (SELECT document_id, l, 1 AS k, 1 AS a, e1 AS b, 'function main' AS heading, 1 AS x, 2 AS y FROM s UNION ALL SELECT document_id, l, 3, 4, 5, 'struct Pair', 4, 5 FROM s WHERE two = 1 UNION ALL SELECT document_id, l, 2, 3, 3, NULL, 3, 3 FROM s WHERE two = 1
 UNION ALL SELECT document_id, l, 4, CASE WHEN two = 1 THEN 6 ELSE e1 + 1 END, n, NULL, CASE WHEN two = 1 THEN 6 ELSE e1 + 1 END, n FROM s),
c AS (SELECT document_id, k, regexp_replace(array_to_string(l[a:b], chr(10)), '^\\s+|\\s+$', '', 'g') AS content, heading, x, y FROM r WHERE a <= b)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY k) - 1)::INT AS chunk_index, content, heading, x::INT AS line_start, y::INT AS line_end, 'by_ast' AS chunk_strategy FROM c WHERE content <> ''""")
def _(t):
    d = t.rag_documents.where("source_type = 'code'").withColumn("content", F.regexp_replace("content", r"\n[ \t]*(?=\n)", "\n-"))
    long = F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")) >= 5
    one = F.struct(F.lit("function").alias("kind"), F.lit("main").alias("name"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    two = F.struct(F.lit("struct").alias("kind"), F.lit("Pair").alias("name"), F.lit(4).alias("line_start"), F.lit(5).alias("line_end"))
    s = d.select("id", F.explode(F.when(long, F.array(two, one)).otherwise(F.array(one))).alias("s")).select("id", "s.*")
    return C.symbol_chunks(d, s)


_MARK = {0: "error: ", 1: "error[E01] here ", 2: "diff --git a/q b/", 3: "FAIL ", 4: "2024-01-02 03:04:05 ", 5: "test case "}


@query("chunk_output", f"""WITH q AS (SELECT id, project, source_path, source_type, created_at, regexp_replace(content, '\\n', chr(10) || (CASE length(content) % 7 WHEN 4 THEN chr(10) ELSE '' END) || (CASE length(content) % 7 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _MARK.items())} ELSE '' END), 'g') AS content FROM rag_documents),
l0 AS ({_LINE.format(content="content").replace("FROM rag_documents", "FROM q")}), l AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l0),
ty AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(error\\[E|error:)') THEN 'build_error' WHEN regexp_matches(line, '^\\s*diff --git') THEN 'diff' WHEN regexp_matches(line, '^\\s*(test result:|FAIL|---- .* ----$)') THEN 'test_result' WHEN regexp_matches(line, '^\\s*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN 'log' END AS told FROM l),
k AS (SELECT id AS kid, coalesce(arg_min(told, i) FILTER (told IS NOT NULL AND i <= 50), 'generic') AS kind FROM ty GROUP BY id),
m AS (SELECT l.*, kind, CASE kind WHEN 'diff' THEN regexp_matches(line, '^diff --git') WHEN 'build_error' THEN regexp_matches(line, '^(error\\[|warning\\[|error:)') WHEN 'test_result' THEN regexp_matches(line, '^(---- .+ ----|FAIL|test .+\\.\\.\\.)')
  WHEN 'log' THEN s <> '' AND coalesce(lag(s) OVER (PARTITION BY id ORDER BY i), '') = '' ELSE false END AS h FROM l JOIN k ON kid = id),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY i) AS sec FROM m),
o AS (SELECT *, CASE WHEN kind = 'log' THEN nullif(regexp_extract(line, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}'), '') WHEN NOT h THEN NULL
  WHEN kind = 'diff' THEN coalesce(nullif(regexp_extract(s, '^diff --git \\S+ (?:b/)?(\\S+)', 1), ''), s) WHEN kind = 'build_error' THEN coalesce(nullif(regexp_extract(s, '^[^\\]]*\\]'), ''), left(s, 80)) ELSE nullif(regexp_extract(s, '^(FAIL.*)$', 1), '') END AS head FROM n),
cut AS (SELECT id AS document_id, sec, string_agg(line, chr(10) ORDER BY i) FILTER (kind <> 'log' OR s <> '') AS content, arg_min(head, i) FILTER (head IS NOT NULL) AS heading FROM o WHERE kind <> 'generic' GROUP BY id, sec
  UNION ALL SELECT id, 0, string_agg(line, chr(10) ORDER BY i), NULL FROM o WHERE kind = 'generic' GROUP BY id),
{_FIT.format(name="structured_output").replace("ELSE array_to_string", "ELSE array_to_string").replace("THEN content ELSE", "AND NOT (heading IS NULL AND document_id IN (SELECT kid FROM k WHERE kind = 'generic')) THEN content ELSE")}""")
def _(t):
    size = F.length("content") % 7
    mark = F.lit("")
    for k, v in _MARK.items():
        mark = F.when(size == k, v).otherwise(mark)
    return C.output_chunks(t.rag_documents.withColumn("content", F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), F.when(size == 4, "\n").otherwise(""), mark))), 50)


_SENT = "WITH p AS (SELECT id, regexp_extract_all(content, '[^.\\n]*[.\\n]|[^.\\n]+$') AS ss FROM rag_documents), s AS (SELECT id, i::INT AS n, regexp_replace(ss[i + 1], '^\\s+|\\s+$', '', 'g') AS sentence FROM (SELECT *, unnest(range(len(ss))) AS i FROM p)), f AS (SELECT * FROM s WHERE strlen(sentence) BETWEEN 20 AND 500)"
_WORDS = "regexp_split_to_array(sentence, '\\s+')"
_SCORE = f"(CASE WHEN regexp_matches(sentence, '[0-9]') THEN 1.5 ELSE 0 END + CASE WHEN len(list_filter({_WORDS}[2:], lambda w: strlen(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}') AND NOT regexp_matches(w, '^\\p{{Lu}}+$'))) >= 2 THEN 1.5 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(lower(sentence), '{k}') THEN {v} ELSE 0 END" for v, _, ks in FX.CLASSES for k in ks) + " + CASE WHEN " + " OR ".join(f"contains(lower(sentence), '{k}')" for k in FX.CODE) + " THEN 1 ELSE 0 END + CASE WHEN contains(sentence, '/') AND (" + " OR ".join(f"contains(lower(sentence), '{k}')" for k in FX.FILES) + ") THEN 1.5 ELSE 0 END)::DOUBLE"


@query("extract_scores", f"{_SENT} SELECT id, n, {_SCORE} AS score FROM f")
def _(t):
    return FX.scored(FX.sentences(t.rag_documents)).select("id", "n", "score")


_FACTS = f"""{_SENT.replace("WITH ", "WITH RECURSIVE ", 1)}, g AS (SELECT id, n, sentence, {_SCORE} AS score FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, n) AS rank, list_distinct(regexp_split_to_array(sentence, '\\s+')) AS w FROM g WHERE score >= 3),
r AS (SELECT * FROM b WHERE rank <= 30), walk AS (
  SELECT id, rank, [w] AS kept, true AS keep FROM r WHERE rank = 1
  UNION ALL SELECT r.id, r.rank, CASE WHEN ok THEN list_append(kept, r.w) ELSE kept END, ok FROM (SELECT r.*, kept, len(list_filter(kept, lambda k: len(list_intersect(k, r.w)) > 0.6 * len(list_distinct(list_concat(k, r.w))))) = 0 AS ok FROM walk JOIN r ON r.id = walk.id AND r.rank = walk.rank + 1) r),
x AS (SELECT r.id, r.rank, r.sentence, r.score, row_number() OVER (PARTITION BY r.id ORDER BY r.rank) AS nth FROM walk JOIN r ON r.id = walk.id AND r.rank = walk.rank WHERE keep)
SELECT id, rank, sentence, score FROM x WHERE nth <= 20"""


@query("extract_facts", _FACTS)
def _(t):
    return FX.facts(t.rag_documents).select("id", "rank", "sentence", "score")


@query("transcript_summary", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS nth FROM turns) SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, coalesce(string_agg(CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END, ' | ' ORDER BY turn) FILTER (role = 'user' AND nth <= 5), '') AS highlights, 'Session with ' || count(*) || ' messages, ' || count(*) FILTER (role = 'user') || ' by the user' AS summary FROM n GROUP BY conv_id""")
def _(t):
    return TR.summarise(t.turns)


_LIFE = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'tool' WHEN 'click' THEN 'approval_request' WHEN 'purchase' THEN 'approval_response' ELSE 'error' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT id, 0::BIGINT AS k, 'new' AS phase, 0::BIGINT AS pending FROM e WHERE k = 1
 UNION ALL SELECT e.id, e.k, CASE e.kind WHEN 'start' THEN 'active' WHEN 'approval_request' THEN 'waiting' WHEN 'approval_response' THEN CASE WHEN pending > 1 THEN 'waiting' ELSE 'active' END ELSE phase END, CASE e.kind WHEN 'approval_request' THEN pending + 1 WHEN 'approval_response' THEN greatest(0, pending - 1) ELSE pending END FROM w JOIN e ON e.id = w.id AND e.k = w.k + 1),
c AS (SELECT id, count(*) FILTER (kind = 'tool') AS tools, count(*) FILTER (kind = 'error') AS errors FROM e GROUP BY id)
SELECT c.id, arg_max(phase, k) AS phase, tools, arg_max(pending, k) AS pending, errors FROM w JOIN c ON c.id = w.id GROUP BY c.id, tools, errors"""


@query("lifecycle_state", _LIFE)
def _(t):
    kinds = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "click", "approval_request").when(F.col("event_type") == "purchase", "approval_response").otherwise("error")
    e = t.raw("events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), kinds.alias("kind"))
    return TR.lifecycle(e)
