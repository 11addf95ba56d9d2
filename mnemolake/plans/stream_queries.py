"""Streams over the driver's files, run to their end, with their result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemolake.sources.snapshot import shared_folder
from mnemolake.operators import transcripts as TR
from mnemolake.streaming import pipelines as P
from mnemolake.streaming import watching as W

from .registry import Tables, query


def _shared(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _events(t: Tables):
    schema = t.raw("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _run(t: Tables, stream):
    at = _shared(t)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("stream_event_dedup", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    e = _events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(t, P.dedup_events(e, "event_id", "ts", "40 days").select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_tumbling", "WITH x AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start::TIMESTAMP AS start, event_type, n FROM x WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    e = _events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(t, P.tumbling(e, "ts", "1 day", "1 hour", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


@query("stream_ingest", "SELECT count(*) AS n FROM conversations")
def _(t):
    from mnemolake.operators.chunking import window_chunks

    at = _shared(t)
    src = t.raw("conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    src.write.text(f"{at}/in")
    q = P.ingest(P.watch(t.spark, f"{at}/in"), f"{at}/out", f"{at}/state", lambda d: window_chunks(d.withColumn("content", F.explode(F.split(F.rtrim("content"), "\n"))).withColumn("id", F.sha2("content", 256)), 1_000_000, 0))
    q.awaitTermination()
    return P.latest_chunks(t.spark.read.parquet(f"{at}/out")).agg(F.count("*").alias("n"))


# A folder over three rounds: every conversation is a file of its turns; then some change and some go; then some of those come back, others go.
_FILES = {1: "true", 2: "conv_id % 5 <> 1", 3: "conv_id % 5 <> 2"}
_TURNED = {1: "text", 2: "CASE WHEN conv_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END", 3: "CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN text WHEN conv_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END"}
_LINE = "replace(replace({}, chr(10), ' '), chr(13), ' ')"


def _round_sql(k: int) -> str:
    return f"r{k} AS (SELECT 'c' || conv_id AS name, string_agg({_LINE.format('x')}, chr(10) ORDER BY turn, x) AS body FROM (SELECT conv_id, turn, {_TURNED[k]} AS x FROM turns WHERE {_FILES[k]}) GROUP BY conv_id)"


def _round(t: Tables, k: int, at: str) -> str:
    """The folder as it is in a round."""
    x = t.turns.where(_FILES[k]).select("conv_id", "turn", F.expr(_LINE.format(_TURNED[k])).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda r: r["x"]), "\n")
    x.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name")).agg(body.alias("value")).repartition("name").write.partitionBy("name").text(f"{at}/round{k}")
    return f"{at}/round{k}"


def _name(path):
    return F.concat(F.regexp_extract(path, r"name=([^/]+)/", 1), F.lit(".txt"))


def _lines(docs):
    return docs.select(F.col("id").alias("document_id"), "source_path", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("chunk_index", "content"))


def _watched(t: Tables) -> str:
    """The target after three rounds, each a batch of one stream that is stopped and resumed; the last batch is run again, as after a failure."""
    at = _shared(t)
    for k in _FILES:
        folder = _round(t, k, at)
        t.spark.range(1).selectExpr("CAST(id AS STRING) AS value").write.mode("append").text(f"{at}/ticks")
        ticks = t.spark.readStream.text(f"{at}/ticks")
        W.watch(ticks, folder, f"{at}/out", f"{at}/state", _lines, _name).awaitTermination()
    W.step(t.spark, folder, f"{at}/out", len(_FILES) - 1, _lines, _name)
    return f"{at}/out"


@query("stream_watch_chunks", f"WITH {_round_sql(3)}, x AS (SELECT name || '.txt' AS source_path, string_split(body, chr(10)) AS l FROM r3) SELECT source_path, i - 1 AS chunk_index, l[i] AS content FROM x, unnest(range(1, len(l) + 1)) AS u(i)")
def _(t):
    return W.present(t.spark, _watched(t)).select("source_path", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("stream_watch_actions", f"""WITH {", ".join(_round_sql(k) for k in _FILES)}, s AS (SELECT 0 AS batch, NULL AS a, body AS b FROM r1 UNION ALL SELECT 1, r1.body, r2.body FROM r1 FULL JOIN r2 USING (name) UNION ALL SELECT 2, r2.body, r3.body FROM r2 FULL JOIN r3 USING (name))
SELECT batch::BIGINT AS batch, CASE WHEN b IS NULL THEN 'deleted' WHEN a IS NULL THEN 'created' WHEN a = b THEN 'same' ELSE 'changed' END AS action, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    out = _watched(t)
    m = t.spark.read.option("basePath", f"{out}/manifest").parquet(f"{out}/manifest/batch=*")
    return m.groupBy(F.col("batch").cast("long").alias("batch"), "action").agg(F.count("*").alias("n"))


# Events that come a week at a time, in four files; some come a file late, which the delay allows for, some of the first five days come with
# the last file, which it doesn't (rows are held against the watermark of the batch before the last one).
_DAYS, _DELAY = 7, 8
_LATE = {"late": "event_id % 10 = 0", "lost": "event_id % 97 = 5 AND CAST(ts AS DATE) < DATE'2024-01-06'"}


def _in_weeks(t: Tables, at: str, late: bool, weeks=range(4)):
    """Appends the files of some weeks, one after the other."""
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.least(F.lit(3), F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) / _DAYS))
    if late:
        week = F.when(F.expr(_LATE["lost"]), 3).when(F.expr(_LATE["late"]), F.least(F.lit(3), week + 1)).otherwise(week)
    for w in weeks:
        e.where(week == w).coalesce(1).write.mode("append").parquet(f"{at}/in")


def _weekly(t: Tables, at: str):
    return t.spark.readStream.schema(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


_KEPT = f"e AS (SELECT * FROM events WHERE NOT ({_LATE['lost']}))"


@query("stream_interval_join", f"WITH {_KEPT} SELECT a.event_id AS recall, b.event_id AS signal FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def _(t):
    """Recalls with the signals of the next six hours, from two streams with a watermark each."""
    at = _shared(t)
    _in_weeks(t, at, True)
    side = lambda kind, name: _weekly(t, at).where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", F.col("ts").alias(f"{name}_at"))
    x = P.interval_join(side("view", "recall"), side("purchase", "signal"), "user_id", "recall_at", "signal_at", "6 HOURS", f"{_DELAY} days")
    return _run_at(t, x.select("recall", "signal"), at)


def _run_at(t: Tables, stream, at: str):
    """The stream's rows, run to the end of what there is now; resumed if it has run before."""
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("stream_sessions", f"""WITH {_KEPT}, g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM e WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {_DELAY} DAY""")
def _(t):
    """Sessions of a user with pauses under twelve hours; the stream is stopped after two files and resumed from its checkpoint."""
    at = _shared(t)
    for weeks in (range(2), range(2, 4)):
        _in_weeks(t, at, True, weeks)
        out = _run_at(t, P.sessions(_weekly(t, at), "ts", "12 hours", f"{_DELAY} days", "user_id").select("user_id", F.col("session_window.start").alias("start"), "n"), at)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_KINDS = {"signup": "start", "view": "tool", "click": "approval_request", "purchase": "approval_response", "error": "error"}
_KIND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())


@query("stream_lifecycle", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CASE event_type {_KIND} END AS kind FROM events),
p AS (SELECT *, sum(CASE kind WHEN 'approval_request' THEN 1 WHEN 'approval_response' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, kind) AS s FROM e),
q AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id ORDER BY ts, kind)) AS pending FROM p),
l AS (SELECT id, arg_max(CASE WHEN kind = 'start' THEN 'active' WHEN kind = 'approval_request' THEN 'waiting' WHEN pending > 0 THEN 'waiting' ELSE 'active' END, (ts, kind)) AS phase FROM q WHERE kind IN ('start', 'approval_request', 'approval_response') GROUP BY id)
SELECT q.id, coalesce(any_value(l.phase), 'new') AS phase, count(*) FILTER (kind = 'tool') AS tools, arg_max(pending, (ts, kind))::BIGINT AS pending, count(*) FILTER (kind = 'error') AS errors FROM q LEFT JOIN l ON l.id = q.id GROUP BY q.id""")
def _(t):
    """States of sessions folded from a stream that is stopped after two files and resumed from its checkpoint."""
    at = _shared(t)
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    for weeks in (range(2), range(2, 4)):
        _in_weeks(t, at, False, weeks)
        e = _weekly(t, at).select(F.col("user_id").alias("id"), F.unix_micros("ts").alias("seq"), kinds[F.col("event_type")].alias("kind"))
        out = P.lifecycle(e, "id", "seq", "kind").writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
        out.option("checkpointLocation", f"{at}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    s = t.spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out/batch=*")
    return s.groupBy("id").agg(F.max_by(F.struct("phase", "tools", "pending", "errors"), "batch").alias("s")).select("id", "s.*")


_MD = "'---' || chr(10) || 'name: n' || doc_id || chr(10) || '---' || chr(10) || chr(10) || replace(coalesce(text, ''), chr(13), '')"


@query("stream_memory_folder", f"WITH f AS (SELECT 'hash:' || left(sha256({_MD}), 12) AS hash, 'n' || doc_id AS name FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE doc_id % 10 <> 9 GROUP BY text)) SELECT count(*) AS n, count(DISTINCT hash) AS hashes, min(name) AS first, max(name) AS last FROM f")
def _(t):
    """A folder of memory files: a bootstrap of half of them, then a stream over all, copies and files that aren't memories among them."""
    at = _shared(t)
    d = t.raw("documents").where("doc_id % 10 <> 9").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    body = F.concat(F.lit("---\nname: n"), F.col("doc_id").cast("string"), F.lit("\n---\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")))
    d = d.select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("content"), "doc_id")
    other = d.where("doc_id % 7 = 0").select(F.lit("MEMORY.md").alias("path"), "content", "doc_id").unionByName(d.where("doc_id % 7 = 1").withColumn("path", F.lit("x.txt"))).unionByName(d.where("doc_id % 7 = 2").withColumn("path", F.concat(F.lit("copy-"), "path")))
    files = d.unionByName(other.withColumn("content", F.when(F.col("path").startswith("copy-"), F.col("content")).otherwise(F.concat("content", F.lit("x")))))
    first = files.where("doc_id % 2 = 0").select("path", "content")
    W.import_memory_folder(first, t.spark.createDataFrame([], "hash string"), TR.memory_files).write.parquet(f"{at}/out/batch=-1")
    for k in range(2):
        files.where(F.lit(k == 0) | (F.col("doc_id") % 3 == 0)).select("path", "content").write.mode("append").parquet(f"{at}/in")
        W.watch_memories(t.spark.readStream.schema("path string, content string").parquet(f"{at}/in"), f"{at}/out", f"{at}/state", TR.memory_files).awaitTermination()
    out = t.spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out/batch=*")
    return out.agg(F.count("*").alias("n"), F.countDistinct("hash").alias("hashes"), F.min("name").alias("first"), F.max("name").alias("last"))
