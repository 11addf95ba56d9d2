"""Table schemas, enumerations and the clamps of their constructors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model.
IMPORTANCE = ("critical", "high", "medium", "low", "ephemeral")
RELATIONS = ("part_of", "depends_on", "related_to", "contradicts", "refines", "alternative_to", "caused_by", "instance_of", "superseded_by")
SYMMETRIC = ("related_to", "contradicts", "alternative_to")
SOURCE_TYPES = ("code", "markdown", "text", "pdf")

_s, _d, _l, _i, _t = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in spec.items()])


SOURCE = _struct({"type": _s, "host": _s, "session_id": _s, "file_path": _s})
LABEL = _struct({"namespace": _s, "value": _s})
MEMORIES = _struct({"id": _s, "created_at": _t, "updated_at": _t, "last_accessed": _t, "access_count": _l, "weight": _d, "topic": _s, "summary": _s, "raw_excerpt": _s, "keywords": T.ArrayType(_s), "importance": _s, "source": SOURCE, "related_ids": T.ArrayType(_s), "project": _s, "branch": _s, "worktree": _s, "expires_at": _t, "invalidated_at": _t, "invalidation_reason": _s, "superseded_by": _s, "embedding": T.ArrayType(T.FloatType())})
MEMOIRS = _struct({"id": _s, "name": _s, "description": _s, "created_at": _t, "updated_at": _t, "consolidation_threshold": _i})
CONCEPTS = _struct({"id": _s, "memoir_id": _s, "name": _s, "definition": _s, "labels": T.ArrayType(LABEL), "confidence": _d, "revision": _i, "created_at": _t, "updated_at": _t, "source_memory_ids": T.ArrayType(_s)})
LINKS = _struct({"id": _s, "source_id": _s, "target_id": _s, "relation": _s, "weight": _d, "created_at": _t})
SESSIONS = _struct({"id": _s, "project": _s, "project_root": _s, "worktree_id": _s, "scope": _s, "runtime_session_id": _s, "task": _s, "started_at": _t, "ended_at": _t, "summary": _s, "files_modified": _s, "errors": _s, "status": _s})
RECALLS = _struct({"id": _s, "session_id": _s, "query": _s, "recalled_at": _t, "memory_ids": T.ArrayType(_s), "memory_count": _l, "project": _s})
SIGNALS = _struct({"id": _s, "session_id": _s, "recall_event_id": _s, "signal_type": _s, "signal_value": _l, "occurred_at": _t, "source": _s, "project": _s})
EFFECTS = _struct({"memory_id": _s, "recall_event_id": _s, "effectiveness": _d, "signal_count": _l, "computed_at": _t})
DOCUMENTS = _struct({"id": _s, "source_path": _s, "source_type": _s, "chunk_count": _l, "created_at": _t, "updated_at": _t, "project": _s, "runtime_session_id": _s})
CHUNKS = _struct({"id": _s, "document_id": _s, "chunk_index": _i, "content": _s, "source_path": _s, "source_type": _s, "language": _s, "heading": _s, "line_start": _i, "line_end": _i, "created_at": _t, "chunk_strategy": _s, "embedding": T.ArrayType(T.FloatType())})
METADATA = _struct({"key": _s, "value": _s})
PROJECT_LINKS = _struct({"source_project": _s, "target_project": _s, "created_at": _t})
ARTIFACTS = _struct({"artifact_id": _s, "artifact_type": _s, "project": _s, "source_id": _s, "payload": _s, "created_at": _t, "schema_version": _s})
AUDIT = _struct({"id": _s, "timestamp": _t, "operation": _s, "memory_id": _s, "topic": _s, "content_hash": _s, "metadata_json": _s})

VECTORS = _struct({"hash": _s, "model": _s, "embedding": T.ArrayType(T.FloatType())})

TABLES = {"memories": MEMORIES, "memoirs": MEMOIRS, "concepts": CONCEPTS, "concept_links": LINKS, "sessions": SESSIONS, "recall_events": RECALLS, "outcome_signals": SIGNALS, "recall_effectiveness": EFFECTS, "documents": DOCUMENTS, "chunks": CHUNKS, "metadata": METADATA, "project_links": PROJECT_LINKS, "artifacts": ARTIFACTS, "audit_log": AUDIT, "vectors": VECTORS}


def unit(c: Column, default: float) -> Column:
    """A weight or confidence: NaN becomes 0.5, null the default, the rest is held within 0 and 1."""
    held = F.when(F.isnan(c), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return F.coalesce(held, F.lit(default))


def json_strings(c: Column) -> Column:
    """A JSON array of strings; what can't be parsed is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
