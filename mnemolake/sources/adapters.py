"""The driver's tables as tables of the data model.

Each view is one SQL text for both engines; ``_dialect`` fills in the few
functions whose names differ. All is arithmetic on ids, so both give the same
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"
TOPICS = ("errors/active", "errors/resolved", "corrections", "tests/failed", "tests/resolved", "decisions/p", "context/p", "session/p", "preferences", "notes")

_VIEWS = {
    "memories": """SELECT {id8}(d.doc_id) AS id, {day0} + {minutes}((d.doc_id % 1000) * 37) AS created_at,
  {day0} + {minutes}((d.doc_id % 1000) * 37 + d.doc_id % 53) AS updated_at, {day0} + {minutes}((d.doc_id % 900) * 41) AS last_accessed,
  d.doc_id % 7 AS access_count, CAST(0.05 AS DOUBLE) + CAST(0.09 AS DOUBLE) * (d.doc_id % 11) AS weight,
  CASE d.doc_id % 10 """ + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOPICS)) + """ END AS topic, coalesce(d.text, '') AS summary,
  {array}(d.source, d.lang) AS keywords, CASE d.doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'ephemeral' END AS importance,
  CASE WHEN d.doc_id % 13 = 0 THEN '_shared' ELSE d.lang END AS project, CASE d.doc_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' END AS branch,
  CASE d.doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS worktree,
  CASE WHEN d.doc_id % 5 = 4 THEN {day0} + {minutes}((d.doc_id % 1000) * 37 + 240 + (d.doc_id % 9) * 10000) END AS expires_at,
  CASE WHEN d.doc_id % 17 = 0 THEN {day0} + {minutes}((d.doc_id % 1000) * 37 + 60) END AS invalidated_at,
  CASE WHEN d.doc_id % 17 = 0 THEN 'outdated' END AS invalidation_reason, e.embedding AS embedding
FROM {t_documents} d LEFT JOIN {t_embeddings} e ON d.doc_id = e.vec_id""",
    "sessions": """SELECT {cat}('ses_', user_id, '_', day) AS id, {cat}('p', user_id % 5) AS project, {cat}('wt', user_id % 2) AS worktree_id, {cat}('/src/p', user_id % 5) AS project_root,
  CASE WHEN user_id % 4 = 0 THEN 'review' END AS scope, CASE WHEN user_id % 3 = 0 THEN {cat}('task ', user_id % 6) END AS task, started_at,
  CASE WHEN (user_id + day) % 9 <> 0 THEN ended_at END AS ended_at, CASE WHEN (user_id + day) % 9 <> 0 THEN 'completed' ELSE 'active' END AS status,
  CASE WHEN (user_id + day) % 6 <> 0 THEN {cat}('summary ', user_id % 7) END AS summary, errors
FROM (SELECT user_id, {epoch_day}(ts) AS day, min(ts) AS started_at, max(ts) AS ended_at, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM {t_events} GROUP BY user_id, {epoch_day}(ts)) s""",
    "recall_events": """SELECT {cat}('rec_', event_id) AS id, {cat}('ses_', user_id, '_', {epoch_day}(ts)) AS session_id, {cat}('q', event_id % 20) AS query, ts AS recalled_at,
  {array}({id8}(event_id % 400), {id8}((event_id * 7) % 400 + 400), {id8}((event_id * 13) % 100 + 800)) AS memory_ids, {cat}('p', user_id % 5) AS project
FROM {t_events} WHERE event_type = 'view'""",
    "outcome_signals": """SELECT {cat}('sig_', event_id) AS id, {cat}('ses_', user_id, '_', {epoch_day}(ts)) AS session_id, CAST(NULL AS STRING) AS recall_event_id,
  CASE event_type WHEN 'error' THEN 'tool_error' WHEN 'click' THEN 'test_passed' WHEN 'purchase' THEN 'build_passed' ELSE 'correction' END AS signal_type,
  CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS BIGINT) AS signal_value, ts AS occurred_at, {cat}('p', user_id % 5) AS project
FROM {t_events} WHERE event_type <> 'view'""",
    "rag_documents": """SELECT {cat}('doc_', doc_id) AS id, {cat}('/', source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.txt' ELSE '' END) AS source_path,
  CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'code' ELSE 'text' END AS source_type, {day0} + {minutes}((doc_id % 1000) * 37) AS created_at, lang AS project, coalesce(text, '') AS content FROM {t_documents}""",
    "memoirs": """SELECT 'mem_geo' AS id, 'geo' AS name, 'regions to suppliers' AS description UNION ALL SELECT 'mem_code', 'code:p1', 'parts'""",
    "concepts": """SELECT {cat}('r:', r_regionkey) AS id, 'mem_geo' AS memoir_id, r_name AS name, {cat}('region ', lower(r_name)) AS definition, {array}({label}('kind', 'region')) AS labels, CAST(0.9 AS DOUBLE) AS confidence, 1 AS revision FROM {t_region}
UNION ALL SELECT {cat}('n:', n_nationkey), 'mem_geo', n_name, {cat}('nation of region ', n_regionkey), {array}({label}('kind', 'nation'), {label}('region', n_regionkey)), CAST(0.5 AS DOUBLE) + CAST(0.01 AS DOUBLE) * n_nationkey, 1 FROM {t_nation}
UNION ALL SELECT {cat}('s:', s_suppkey), 'mem_geo', s_name, {cat}('supplier in nation ', s_nationkey), {array}({label}('kind', 'supplier'), {label}('region', s_nationkey % 5)), CAST(0.3 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (s_suppkey % 500), 2 FROM {t_supplier}
UNION ALL SELECT {cat}('p:', p_partkey), 'mem_code', {cat}('part_', p_partkey), p_name, {array}({label}('kind', 'function'), {label}('brand', p_brand)), CAST(0.7 AS DOUBLE), 1 FROM {t_part}""",
    "concept_links": """SELECT {cat}('n:', n_nationkey) AS source_id, {cat}('r:', n_regionkey) AS target_id, 'part_of' AS relation, CAST(1.0 AS DOUBLE) AS weight FROM {t_nation}
UNION ALL SELECT {cat}('s:', s_suppkey), {cat}('n:', s_nationkey), 'part_of', CAST(1.0 AS DOUBLE) FROM {t_supplier}
UNION ALL SELECT {cat}('p:', p_partkey), {cat}('p:', p_partkey * 7 % 97 + 1), CASE p_partkey % 4 WHEN 0 THEN 'related_to' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'instance_of' ELSE 'refines' END, CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (p_partkey % 5) FROM {t_part} WHERE p_partkey <> p_partkey * 7 % 97 + 1""",
    "audit_log": """SELECT {cat}('aud_', doc_id) AS id, {day0} + {minutes}((doc_id % 1000) * 37) AS timestamp, CASE doc_id % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'update' WHEN 2 THEN 'invalidate' ELSE 'delete' END AS operation,
  {id8}(doc_id % 200) AS memory_id, 'notes' AS topic FROM {t_documents}""",
    "turns": """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {day0} + {minutes}(conv_id * 10 + turn) AS at FROM {t_conversations}""",
}

_SPARK = {"day0": "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "array": "array", "cat": "concat"}
_DUCK = {"day0": "TIMESTAMP '2024-01-01 00:00:00'", "array": "list_value", "cat": "concat"}


def _pair(text: str) -> tuple[str, str]:
    a, b = text.split(", ", 1)
    return a, b


def _expand(text: str, calls: dict) -> str:
    """Fills in ``{name}(...)`` calls, whose arguments are balanced."""
    for name, f in calls.items():
        mark = "{" + name + "}("
        while mark in text:
            a = text.index(mark)
            b, depth = a + len(mark), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(text[b], 0)
                b += 1
            text = text[:a] + f(text[a + len(mark) : b - 1]) + text[b:]
    return text


_SPARK_CALLS = {"label": lambda x: "named_struct('namespace', {}, 'value', CAST({} AS STRING))".format(*_pair(x)), "minutes": lambda x: f"make_dt_interval(0, 0, CAST({x} AS INT), 0)", "id8": lambda x: f"lpad(CAST({x} AS STRING), 8, '0')", "epoch_day": lambda x: f"datediff(DATE({x}), DATE'2024-01-01')"}
_DUCK_CALLS = {"label": lambda x: "struct_pack(namespace := {}, value := CAST({} AS VARCHAR))".format(*_pair(x)), "minutes": lambda x: f"to_minutes(CAST({x} AS BIGINT))", "id8": lambda x: f"lpad(CAST({x} AS VARCHAR), 8, '0')", "epoch_day": lambda x: f"datediff('day', DATE '2024-01-01', CAST({x} AS DATE))"}
_TABLES = ("documents", "embeddings", "events", "region", "nation", "supplier", "part", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the parquet files of ``sf_dir``."""
    text = _expand(_VIEWS[name], _SPARK_CALLS)
    used = [t for t in _TABLES if "{t_" + t + "}" in text]
    text = text.format(**_SPARK, **{f"t_{t}": "{" + t + "}" for t in used})
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def view_sql(name: str) -> str:
    return _expand(_VIEWS[name], _DUCK_CALLS).format(**_DUCK, **{f"t_{t}": f"main.{t}" for t in _TABLES})


def with_views(sql: str) -> str:
    """``sql`` preceded by the views that it names."""
    used = [n for n in _VIEWS if f" {n}" in sql.replace("\n", " ").replace("(", " ").replace(",", " , ")]
    head = ", ".join(f"{n} AS ({view_sql(n)})" for n in used)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if not head:
        return body
    if body.upper().startswith("WITH "):
        body = ", " + body[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"
