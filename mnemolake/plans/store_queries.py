"""Queries of vectors at ingest, nested redaction, preambles, promotion, timelines, discovery and snapshots."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from mnemolake.functions import embedding as EM
from mnemolake.functions.text import fts_phrases, redact_json
from mnemolake.operators import feedback as FB
from mnemolake.operators import graph as G
from mnemolake.operators import insights as I
from mnemolake.operators import memory as M
from mnemolake.operators import recall as R
from mnemolake.operators import search as S
from mnemolake.operators import sessions as SE
from mnemolake.operators import transcripts as TR
from mnemolake.operators import transitions as T
from mnemolake.sources import snapshot as SN
from mnemolake.sources.adapters import AS_OF

from .registry import Tables, query
from .search_queries import QUERY, TEXT, _bm25, memory_index


def _folder(t: Tables, name: str) -> str:
    return f"{SN.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


class Letters:
    """An embedder that SQL can follow: a text's length and its number of e."""

    dimensions = 2

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(x)), float(x.count("e"))] for x in texts]


class Down(Letters):
    """A service that can't be reached."""

    def __call__(self, texts):
        raise OSError("no answer")


class Short(Letters):
    """A service whose vectors aren't as long as it says."""

    dimensions = 3


_EMBEDDERS = [("down", Down()), ("short", Short()), ("letters", Letters())]


def _texts(t: Tables):
    return t.rag_documents.select("id", F.col("content").alias("text"))


def _changed_texts(t: Tables):
    return _texts(t).withColumn("text", F.when(F.col("id").endswith("3"), F.concat("text", F.lit(" eee!"))).otherwise(F.col("text")))


_NEW_TEXT = "CASE WHEN id LIKE '%3' THEN content || ' eee!' ELSE content END"


@query("ingest_embedded", f"""WITH n AS (SELECT DISTINCT {_NEW_TEXT} AS x FROM rag_documents) SELECT 1 AS pass, count(DISTINCT content) AS embedded FROM rag_documents
UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FROM n WHERE x NOT IN (SELECT content FROM rag_documents)""")
def _(t):
    """How many texts the embedder is asked for: at first, when nothing has changed, and when some have."""
    at, chosen = _folder(t, "vectors"), EM.choose(_EMBEDDERS)
    store = t.spark.createDataFrame([], EM.VECTORS)
    out = None
    for k, rows in enumerate((_texts(t), _texts(t), _changed_texts(t)), 1):
        EM.add_vectors(rows, store, chosen).write.parquet(f"{at}/pass={k}")
        store = t.spark.read.schema(EM.VECTORS).parquet(*[f"{at}/pass={i}" for i in range(1, k + 1)])
        n = t.spark.read.schema(EM.VECTORS).parquet(f"{at}/pass={k}").agg(F.count("*").alias("embedded")).select(F.lit(k).alias("pass"), "embedded")
        out = n if out is None else out.unionByName(n)
    return out


@query("ingest_vectors", f"WITH n AS (SELECT id, {_NEW_TEXT} AS x FROM rag_documents) SELECT id, length(x)::DOUBLE AS chars, (length(x) - length(replace(x, 'e', '')))::DOUBLE AS es FROM n")
def _(t):
    """Documents with their vectors after a second ingest, which only asks for the texts that are new."""
    at, chosen = _folder(t, "vectors"), EM.choose(_EMBEDDERS)
    first = EM.add_vectors(_texts(t), t.spark.createDataFrame([], EM.VECTORS), chosen)
    first.write.parquet(f"{at}/pass=1")
    EM.add_vectors(_changed_texts(t), t.spark.read.schema(EM.VECTORS).parquet(f"{at}/pass=1"), chosen).write.parquet(f"{at}/pass=2")
    rows = EM.with_vectors(_changed_texts(t), t.spark.read.schema(EM.VECTORS).parquet(f"{at}/pass=1", f"{at}/pass=2"), chosen[0])
    return rows.select("id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("es"))


_NOTE = "CASE event_type WHEN 'error' THEN 'password: abcdefghij' ELSE event_type END"
_NESTED = """concat('{{"a":[{{"b":{{"Auth_Token":{token},"note":"', {note}, '","n":', event_id, '}}}},', {props}, '],"c":[["', {note}, '",null,true]],"api_key":{key}}}')"""


@query("redact_nested", "SELECT event_id, " + _NESTED.format(token='"[REDACTED]"', note=f"replace({_NOTE}, 'password: abcdefghij', '[REDACTED]')", props="replace(coalesce(props, '{}'), ' ', '')", key='"[REDACTED]"') + " AS props FROM events")
def _(t):
    """Payloads with secrets three deep in lists and maps, and a sensitive field that holds a list."""
    text = F.expr(_NESTED.format(token='["x",{"y":1}]', note=_NOTE, props="coalesce(props, '{}')", key='["k"]'))
    return t.raw("events").select("event_id", redact_json(text).alias("props"))


_PRE_LINE = "'- ' || CASE WHEN branch IS NOT NULL THEN '[' || branch || '] ' ELSE '' END || summary || chr(10)"
_PRE_HEAD = "'" + R.PREAMBLE.replace("\n", "' || chr(10) || '") + "'"


def _preamble_sql(rows: str) -> str:
    return f"SELECT {_PRE_HEAD} || string_agg({_PRE_LINE}, '' ORDER BY weight DESC, created_at DESC, id) || chr(10) || '---' || chr(10) || chr(10) AS text FROM (SELECT * FROM {rows} LIMIT 5)"


@query("context_preamble", f"WITH {_bm25('h', ' memories', TEXT, fts_phrases(QUERY))} SELECT 'found' AS asked, text FROM ({_preamble_sql('h WHERE invalidated_at IS NULL ORDER BY weight DESC, created_at DESC, id')}) UNION ALL SELECT 'nothing', text FROM ({_preamble_sql('memories WHERE invalidated_at IS NULL ORDER BY weight DESC, id')})")
def _(t):
    """The preamble of a question that full text answers, and of one that it doesn't."""
    index = memory_index(t)
    one = lambda asked, q: R.preamble(t.memories, q, 5, index).select(F.lit(asked).alias("asked"), "text")
    return one("found", QUERY).unionByName(one("nothing", "zzqx"))


_TAKEN = "memoirs_ AS (SELECT name FROM memoirs UNION ALL SELECT 'errors-active')"
_PROMOTIONS = f"""{_TAKEN}, m AS (SELECT * FROM memories WHERE invalidated_at IS NULL), r AS (SELECT topic, replace(topic, '/', '-') AS memoir, count(*) AS n FROM m GROUP BY topic HAVING count(*) >= 15 AND replace(topic, '/', '-') NOT IN (SELECT name FROM memoirs_)),
u AS (SELECT topic, keyword, count(*) AS uses FROM (SELECT topic, unnest(keywords) AS keyword FROM m) WHERE keyword IS NOT NULL GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY uses DESC, keyword) AS place FROM u)"""


def _taken(t: Tables):
    return t.memoirs.unionByName(t.memoirs.limit(1).withColumns({"id": F.lit("mem_taken"), "name": F.lit("errors-active")}))


def _worded(t: Tables):
    """The memories, of whose keywords the missing ones are left out."""
    return t.memories.withColumn("keywords", F.array_compact("keywords"))


@query("promote_candidates", f"WITH {_PROMOTIONS} SELECT r.topic, r.memoir, r.n, p.keyword, p.uses, p.place FROM r LEFT JOIN p ON p.topic = r.topic AND p.place <= 10")
def _(t):
    return I.promotions(_worded(t), _taken(t)).withColumn("place", F.col("place").cast("long"))


@query("promote_state", f"""WITH {_PROMOTIONS}, w AS (SELECT r.topic, 'mem:' || r.memoir AS id, r.n, p.keyword, p.uses FROM r JOIN p ON p.topic = r.topic AND p.place <= 10),
k AS (SELECT DISTINCT m.id AS mid, w.id, w.n, w.keyword FROM (SELECT id, topic, unnest(keywords) AS keyword FROM m) m JOIN w ON w.topic = m.topic AND w.keyword = m.keyword)
SELECT 'memoir' AS kind, 'mem:' || memoir AS id, n::DOUBLE AS value FROM r UNION ALL SELECT 'concept', id || ':' || keyword, round(uses / n, 6) FROM w
UNION ALL SELECT 'link', a.id || ':' || a.keyword || '>' || b.id || ':' || b.keyword, round(count(*) / any_value(a.n), 6) FROM k a JOIN k b ON a.mid = b.mid AND a.id = b.id AND a.keyword < b.keyword GROUP BY a.id, a.keyword, b.id, b.keyword""")
def _(t):
    """What a promotion of all ready topics adds; done twice, it adds nothing more."""
    state = (_taken(t), t.concepts.limit(0), t.concept_links.limit(0))
    for _ in range(2):
        state = I.promote(_worded(t), *state, AS_OF)
    memoirs, concepts, links = state
    n = I.promotions(_worded(t), _taken(t)).select(F.concat(F.lit("mem:"), "memoir").alias("id"), "n").distinct()
    out = memoirs.where(F.col("id").startswith("mem:")).join(n, "id").select(F.lit("memoir").alias("kind"), "id", F.col("n").cast("double").alias("value"))
    out = out.unionByName(concepts.select(F.lit("concept").alias("kind"), "id", F.round("confidence", 6).alias("value")))
    return out.unionByName(links.select(F.lit("link").alias("kind"), F.concat("source_id", F.lit(">"), "target_id").alias("id"), F.round("weight", 6).alias("value")))


_ATTRIBUTED = "SELECT s.id, r.id AS recall_event_id FROM outcome_signals s JOIN sessions x ON x.id = s.session_id LEFT JOIN LATERAL (SELECT id, recalled_at FROM recall_events q WHERE q.session_id = s.session_id AND q.recalled_at <= s.occurred_at AND q.recalled_at >= s.occurred_at - INTERVAL 60 MINUTE AND (x.ended_at IS NULL OR s.occurred_at <= x.ended_at) ORDER BY recalled_at DESC, id LIMIT 1) r ON true"
_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SE.OUTCOME_TITLES.items())


@query("timeline_detail", f"""WITH a AS ({_ATTRIBUTED}), g AS (SELECT s.id, s.session_id, s.signal_type, s.signal_value, s.occurred_at, a.recall_event_id, CASE s.signal_type WHEN 'tool_error' THEN 'hook' END AS source FROM outcome_signals s LEFT JOIN a ON a.id = s.id),
e AS (SELECT id, session_id, 'recall' AS kind, 'Recalled ' || len(memory_ids) || ' memories' AS title, query AS detail, recalled_at AS occurred_at, id AS recall_event_id, len(memory_ids) AS memory_count, NULL AS signal_value FROM recall_events
UNION ALL SELECT g.id, g.session_id, 'outcome', CASE g.signal_type {_TITLES} END, nullif(concat_ws(' · ', r.query, g.source), ''), g.occurred_at, g.recall_event_id, len(r.memory_ids), g.signal_value FROM g LEFT JOIN recall_events r ON r.id = g.recall_event_id AND r.session_id = g.session_id)
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, kind, id) AS place FROM e""")
def _(t):
    recalls = t.recall_events.withColumn("memory_count", F.size("memory_ids").cast("long"))
    signals = t.outcome_signals.drop("recall_event_id").join(FB.attribute(t.outcome_signals, t.recall_events, t.sessions).select("id", "recall_event_id"), "id", "left").withColumn("source", F.when(F.col("signal_type") == "tool_error", "hook"))
    e = SE.timeline_events(recalls, signals)
    return e.select("id", "session_id", "kind", "title", "detail", "occurred_at", "recall_event_id", "memory_count", "signal_value", F.col("place").cast("long").alias("place"))


@query("transcript_discovery", "SELECT 'c' || conv_id AS name, count(*) AS n FROM turns WHERE conv_id % 3 = 0 GROUP BY conv_id")
def _(t):
    """Transcripts that were written after a time, found by their files' times; no others are opened."""
    at = _folder(t, "transcripts")
    lines = t.turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name"), "conv_id", F.to_json(F.struct("role", "text")).alias("value"))
    write = lambda df: df.drop("conv_id").repartition("name").write.mode("append").partitionBy("name").text(at)
    write(lines.where("conv_id % 3 <> 0"))
    time.sleep(1.1)  # file times have whole seconds in some file systems
    since = datetime.now(timezone.utc)
    time.sleep(1.1)
    write(lines.where("conv_id % 3 = 0"))
    return TR.read_discovered(t.spark, at, since.strftime("%Y-%m-%d %H:%M:%S")).groupBy(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name")).agg(F.count("*").alias("n"))


def _snapshots(t: Tables) -> tuple[str, str, str]:
    """(root, first, second): the sessions are the same in both, some memories change, some go, some are new."""
    root = _folder(t, "snapshots")
    m = t.memories.select("id", "weight", "topic", "importance")
    first = SN.commit(t.spark, root, {"memories": m, "sessions": t.sessions}, "0001")
    nth = F.col("id").cast("int") % 20
    new = T.forget(m, []).where(nth != 3).withColumn("weight", F.when(nth == 5, F.col("weight") / 2).otherwise(F.col("weight")))
    new = new.unionByName(m.where(nth == 7).withColumn("id", F.concat(F.lit("n"), "id")))
    return root, first, SN.commit(t.spark, root, {"memories": new, "sessions": t.sessions}, "0002")


@query("snapshot_restored", "SELECT id, weight, topic FROM memories")
def _(t):
    """The newest state once the first snapshot is restored over the second."""
    root, first, _ = _snapshots(t)
    SN.restore(t.spark, root, first)
    return SN.load(t.spark, root, "memories").select("id", "weight", "topic")


@query("snapshot_diff", "WITH n AS (SELECT id, CAST(id AS INT) % 20 AS k, weight FROM memories) SELECT id, 'removed' AS action FROM n WHERE k = 3 UNION ALL SELECT id, 'changed' FROM n WHERE k = 5 AND weight <> weight / 2 UNION ALL SELECT 'n' || id, 'added' FROM n WHERE k = 7")
def _(t):
    root, first, second = _snapshots(t)
    return SN.diff(t.spark, root, "memories", first, second)


@query("snapshot_files", "SELECT '0001' AS snapshot, 'memories' AS \"table\", '0001/memories' AS path, (SELECT count(*) FROM memories) AS rows UNION ALL SELECT '0001', 'sessions', '0001/sessions', (SELECT count(*) FROM sessions) UNION ALL SELECT '0002', 'memories', '0002/memories', (SELECT count(*) FROM memories) - (SELECT count(*) FROM memories WHERE CAST(id AS INT) % 20 = 3) + (SELECT count(*) FROM memories WHERE CAST(id AS INT) % 20 = 7) UNION ALL SELECT '0002', 'sessions', '0001/sessions', (SELECT count(*) FROM sessions)")
def _(t):
    """The manifests: what didn't change is kept once."""
    return SN.snapshots(t.spark, _snapshots(t)[0]).select("snapshot", "table", "path", "rows")


@query("archive_filtered", "SELECT id, topic, weight FROM memories WHERE topic = 'notes' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20' AND weight >= 0.3")
def _(t):
    """An archive of some memories, written and read again."""
    at = _folder(t, "archive")
    m = t.memories.select("id", "topic", "weight", "created_at")
    SN.versioned(SN.export_memories(m, "notes", "2024-01-05 00:00:00", "2024-01-20 00:00:00", 0.3), "1.0").write.json(at)
    back = t.spark.read.schema("kind string, record string, schema_version string").json(at).where("schema_version = '1.0'")
    return SN.import_archive(back, "memory", m.schema)[0].select("id", "topic", "weight")


@query("purge_counts_before", "SELECT 'memories' AS entity, count(*) AS n FROM memories WHERE created_at < TIMESTAMP '2024-01-10' UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE started_at < TIMESTAMP '2024-01-10' UNION ALL SELECT 'documents', count(*) FROM rag_documents WHERE created_at < TIMESTAMP '2024-01-10'")
def _(t):
    return M.purge_counts_before({"memories": (t.memories, "created_at"), "sessions": (t.sessions, "started_at"), "documents": (t.rag_documents, "created_at")}, "2024-01-10 00:00:00")


_CHANGED_AT = "TIMESTAMP '2024-01-20' + to_days(CAST(length(name) % 12 AS INTEGER))"


@query("stale_memoirs", f"WITH c AS (SELECT memoir_id, max({_CHANGED_AT}) AS at FROM concepts GROUP BY 1) SELECT m.id, greatest(TIMESTAMP '2024-01-02', c.at) <= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS stale FROM memoirs m LEFT JOIN c ON c.memoir_id = m.id")
def _(t):
    changed = t.concepts.withColumn("updated_at", F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00' + make_dt_interval(length(name) % 12)"))
    return M.stale_memoirs(t.memoirs.withColumn("updated_at", F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")), changed, AS_OF)


_CONCEPT_TEXT = "concat_ws(' ', id, name, definition, array_to_string(list_transform(labels, lambda y: y.namespace || ':' || y.value), ' '))"


@query("concepts_labelled", f"WITH {_bm25('h', ' concepts', _CONCEPT_TEXT, [['supplier']])} SELECT id, name FROM (SELECT * FROM h ORDER BY rank, name, id LIMIT 60) WHERE list_contains(list_transform(labels, lambda y: y.namespace || ':' || y.value), 'region:2') ORDER BY rank, name, id LIMIT 20")
def _(t):
    """Concepts that full text finds, with a label."""
    return G.search_labelled(t.concepts, S.concept_fts(t.concepts, "supplier", None, 60), "region:2").select("id", "name")
