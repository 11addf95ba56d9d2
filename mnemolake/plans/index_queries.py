"""A full-text index that follows changes, against texts searched anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions.text import TOKEN, fts_phrases
from mnemolake.operators import search as S
from mnemolake.operators import transitions as T
from mnemolake.operators.segments import SegmentedIndex
from mnemolake.sources.adapters import AS_OF

from .registry import Tables, query
from .search_queries import QUERY, TEXT, _bm25

_NTH = "CAST(id AS INT) % 50"
#: Memories after an update of some, the removal of some, the invalidation of some, and new ones.
CHANGED_SQL = f"""state AS (
  SELECT id, topic, CASE WHEN {_NTH} = 7 THEN 'and thing ' || summary ELSE summary END AS summary, keywords, project, created_at, CASE WHEN {_NTH} = 7 THEN 1.0 ELSE weight END AS weight,
    CASE WHEN {_NTH} = 13 THEN TIMESTAMP '{AS_OF}' ELSE invalidated_at END AS invalidated_at FROM memories WHERE {_NTH} <> 11
  UNION ALL SELECT 'new_' || item_id, 'notes', text, ['bench'], 'en', TIMESTAMP '{AS_OF}', 0.5, NULL FROM benchmark)"""


def _nth(k: int):
    return F.col("id").cast("int") % 50 == k


def changed(t: Tables, index: SegmentedIndex, flush: bool):
    """(memories, index) after the changes, each followed by the index; ``flush`` writes every step."""
    step = lambda i: i.flush() if flush else i
    m = t.memories
    after = m.withColumns({"summary": F.when(_nth(7), F.concat(F.lit("and thing "), "summary")).otherwise(F.col("summary")), "weight": F.when(_nth(7), 1.0).otherwise(F.col("weight"))})
    index = step(index.apply(m.where(_nth(7)), after.where(_nth(7))))
    index = step(index.apply(after.where(_nth(11)), None))
    after = after.where(~_nth(11))
    after = after.withColumn("invalidated_at", F.when(_nth(13), F.lit(AS_OF).cast("timestamp_ntz")).otherwise(F.col("invalidated_at")))
    new = t.raw("benchmark").select(F.concat(F.lit("new_"), "item_id").alias("id"), F.lit("notes").alias("topic"), F.col("text").alias("summary"), F.array(F.lit("bench")).alias("keywords"), F.lit("en").alias("project"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"), F.lit(0.5).alias("weight"))
    return T.store(after, new), step(index.apply(None, new))


def base_index(t: Tables) -> SegmentedIndex:
    at = t.stored("memory_segments", lambda at: SegmentedIndex.create(t.memories, S.memory_text(), at, "base"))
    return SegmentedIndex.open(t.spark, S.memory_text(), at, "base")


_PAGE = f"WITH {CHANGED_SQL}, {_bm25('h', 'state', TEXT, fts_phrases(QUERY))} SELECT id, round(rank, 6) AS rank FROM h WHERE invalidated_at IS NULL ORDER BY rank, weight DESC, created_at DESC, id LIMIT 40"


def _page(state):
    memories, index = state
    return S.fts(memories, QUERY, limit=40, index=index).select("id", F.round("rank", 6).alias("rank"))


@query("index_changed", _PAGE)
def _(t):
    return _page(changed(t, base_index(t), False))


@query("index_flushed", _PAGE)
def _(t):
    return _page(changed(t, base_index(t), True))


@query("index_compacted", _PAGE)
def _(t):
    memories, index = changed(t, base_index(t), True)
    return _page((memories, index.compact(1).compact()))


@query("index_segments", f"WITH {CHANGED_SQL}, x AS (SELECT id, len(regexp_extract_all(lower({TEXT}), '{TOKEN}')) AS dl FROM state) SELECT (SELECT count(*) FROM memories WHERE {_NTH} = 7) AS added, (SELECT count(*) FROM memories WHERE {_NTH} = 11) AS gone, 4 AS segments, count(*) AS n, sum(dl) AS tokens FROM x")
def _(t):
    """What each change wrote: as many rows as it touched; and the merged totals."""
    index = changed(t, base_index(t), True)[1]
    s = index.segments
    return index.live().totals.select(F.lit(s[1].size).cast("long").alias("added"), F.lit(s[2].gone).cast("long").alias("gone"), F.lit(len(s)).alias("segments"), "n", F.round(F.col("avg") * F.col("n")).cast("long").alias("tokens"))
