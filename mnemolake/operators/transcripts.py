"""Transcripts of agent sessions: reading, summaries, life cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits of what a summary keeps.
EDITS = ("Edit", "Write", "MultiEdit")
COMMANDS, COMMAND_CHARS, ERRORS, ERROR_CHARS, HIGHLIGHTS, HIGHLIGHT_CHARS = 50, 100, 20, 200, 5, 160


def read(lines: DataFrame) -> DataFrame:
    """(path, n, line) of JSON lines -> (path, n, runtime, session, cwd, at, role, text); unreadable lines go, the first good one tells the runtime."""
    x = lines.withColumn("j", F.try_parse_json("line")).where(F.col("j").isNotNull())

    def get(p: str, kind: str = "string"):
        return F.try_variant_get("j", p, kind)

    first = F.coalesce(get("$.session_id"), get("$.sessionId"), get("$.payload.id"))
    x = x.select("path", "n", get("$.uuid").alias("uuid"), get("$.type").alias("type"), first.alias("session"), get("$.cwd").alias("cwd"), F.coalesce(get("$.timestamp"), get("$.ts")).alias("at"), F.coalesce(get("$.message.role"), get("$.payload.role")).alias("role"), F.coalesce(get("$.message.content"), get("$.message.content[0].text"), get("$.payload.content[0].text"), get("$.text")).alias("text"))
    kind = F.when(F.col("uuid").isNotNull(), "uuid").when(F.col("type").isin("session_meta", "event_msg", "response_item"), "events").otherwise("plain")
    w = Window.partitionBy("path").orderBy("n")
    return x.withColumn("runtime", F.first(kind).over(w)).drop("uuid")


def normalise(lines: DataFrame) -> DataFrame:
    """(path, n, line) of JSON lines -> one row a transcript: session, project, messages, files changed, commands, errors, highlights.

    Tool calls stand in the content of a message: edits name a file, shells a
    command; results that are marked as errors tell what went wrong.
    """
    block = "array<struct<type:string,text:string,name:string,input:struct<file_path:string,command:string>,is_error:boolean,content:string>>"
    x = read(lines).join(lines.select("path", "n", "line"), ["path", "n"])
    x = x.withColumn("b", F.from_json(F.get_json_object("line", "$.message.content"), block))
    each = x.select("path", "n", F.posexplode("b").alias("i", "b")).select("path", "n", "i", "b.*")
    cut = lambda c, most: F.substring(c, 1, most)
    found = F.when((F.col("type") == "tool_use") & F.col("name").isin(*EDITS), F.struct(F.lit("file").alias("kind"), F.col("input.file_path").alias("v")))
    found = found.when((F.col("type") == "tool_use") & F.col("input.command").isNotNull(), F.struct(F.lit("command").alias("kind"), cut(F.col("input.command"), COMMAND_CHARS).alias("v")))
    found = found.when((F.col("type") == "tool_result") & F.col("is_error"), F.struct(F.lit("error").alias("kind"), cut(F.col("content"), ERROR_CHARS).alias("v")))
    each = each.withColumn("f", found).where(F.col("f.v").isNotNull()).select("path", "f.kind", "f.v", "n", "i")
    # What is kept of a transcript is bounded, so it is cut before it is gathered.
    first = each.groupBy("path", "kind", "v").agg(F.min(F.struct("n", "i")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("path", "kind").orderBy("at"))
    top = first.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("kind") == "command", COMMANDS).when(F.col("kind") == "error", ERRORS).otherwise(F.col("nth")))
    lists = top.groupBy("path").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("nth", "v")))), lambda s: s["v"]).alias(c) for k, c in (("file", "files"), ("command", "commands"), ("error", "errors"))])
    said = x.where(F.col("text").isNotNull() & F.col("role").isin("user", "assistant"))
    spoke = said.withColumn("nth", F.row_number().over(Window.partitionBy("path", "role").orderBy("n")))
    base = x.groupBy("path").agg(F.min_by("runtime", "n").alias("runtime"), F.min_by("session", F.when(F.col("session").isNotNull(), F.col("n"))).alias("session"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("n"))).alias("cwd"))
    talk = spoke.groupBy("path").agg(F.count("*").alias("messages"), F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") & (F.col("nth") <= HIGHLIGHTS), F.struct("n", cut(F.col("text"), HIGHLIGHT_CHARS).alias("s"))))), lambda s: s["s"]).alias("highlights"))
    none = F.array().cast("array<string>")
    out = base.join(talk, "path", "left").join(lists, "path", "left")
    project = F.regexp_extract(F.coalesce("cwd", F.lit("")), r"([^/]+)/*$", 1)
    return out.select("path", "runtime", "session", F.nullif(project, F.lit("")).alias("project"), F.coalesce("messages", F.lit(0)).alias("messages"), *[F.coalesce(c, none).alias(c) for c in ("files", "commands", "errors", "highlights")])


def discovered(files: DataFrame, since: str) -> DataFrame:
    """Transcripts (path, modificationTime, ...) changed at or after a time, newest first."""
    keep = F.col("path").endswith(".jsonl") & (F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    return files.where(keep).orderBy(F.desc("modificationTime"), "path")


def read_discovered(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """(path, line) of the files under a folder that changed at or after a time (UTC). The time goes to the file listing, so older files aren't opened."""
    files = spark.read.option("recursiveFileLookup", "true").option("modifiedAfter", since.replace(" ", "T")).option("timeZone", "UTC").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def summarise(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a transcript with counts, highlights and a sentence."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    t = turns.withColumn("nth", nth)
    cut = F.when(F.length("text") > HIGHLIGHT_CHARS, F.concat(F.substring("text", 1, HIGHLIGHT_CHARS), F.lit("..."))).otherwise(F.col("text"))
    g = t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.array_sort(F.collect_list(F.when((F.col("role") == "user") & (F.col("nth") <= HIGHLIGHTS), F.struct("turn", cut.alias("s"))))).alias("h"))
    text = F.concat(F.lit("Session with "), F.col("messages").cast("string"), F.lit(" messages, "), F.col("user_messages").cast("string"), F.lit(" by the user"))
    return g.select("conv_id", "messages", "user_messages", F.array_join(F.col("h.s"), " | ").alias("highlights"), text.alias("summary"))


def dedupe_key(id, path):
    return F.substring(F.sha2(F.concat(id, F.lit("\n"), path), 256), 1, 12)


def fold(state: dict, kind: str) -> dict:
    """One step of the life cycle; pending approvals never go below 0."""
    s = dict(state)
    if kind == "start":
        s["phase"] = "active"
    elif kind == "tool":
        s["tools"] += 1
    elif kind == "approval_request":
        s["pending"], s["phase"] = s["pending"] + 1, "waiting"
    elif kind == "approval_response":
        s["pending"] = max(0, s["pending"] - 1)
        s["phase"] = "waiting" if s["pending"] else "active"
    elif kind == "error":
        s["errors"] += 1
    elif kind == "end":
        s["phase"] = "ended"
    return s


def lifecycle(events: DataFrame) -> DataFrame:
    """(id, seq, kind) -> the state after all events: order matters, so each session is folded in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = {"phase": "new", "tools": 0, "pending": 0, "errors": 0}
        for k in g.sort_values(["seq", "kind"])["kind"]:
            s = fold(s, k)
        return pd.DataFrame([{"id": g["id"].iat[0], **s}])

    return events.select("id", "seq", "kind").groupBy("id").applyInPandas(run, "id string, phase string, tools long, pending long, errors long")


def notifications(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """JSON events (line) as memories: turns weigh 0.75, life-cycle events 0.35; each hash once."""
    x = events.withColumn("j", F.try_parse_json("line")).where(F.col("j").isNotNull())

    def get(p: str):
        return F.try_variant_get("j", p, "string")

    turn = get("$.type").contains("turn")
    x = x.select(F.when(turn, 0.75).otherwise(0.35).alias("weight"), F.when(turn, "medium").otherwise("low").alias("importance"), get("$.type").alias("type"), get("$[\"thread-id\"]").alias("thread"), get("$[\"turn-id\"]").alias("turn"), get("$.cwd").alias("cwd"), get("$[\"last-assistant-message\"]").alias("summary"))
    x = x.withColumn("hash", F.substring(F.sha2(F.concat_ws("\n", "type", "thread", "turn", "summary"), 256), 1, 12)).dropDuplicates(["hash"])
    return x if seen is None else x.join(seen.select("hash"), "hash", "left_anti")


def memory_files(files: DataFrame) -> DataFrame:
    """(path, content) of front-matter markdown as memories; topic and importance by the type it names."""
    head = F.regexp_extract("content", r"\A---\n([\s\S]*?)\n---\n", 1)
    body = F.regexp_replace("content", r"\A---\n[\s\S]*?\n---\n", "")

    def field(name: str):
        return F.trim(F.regexp_extract(head, rf"(?m)^{name}:(.*)$", 1))

    kind = field("type")
    importance = F.when(kind.isin("feedback", "user"), "high").otherwise("medium")
    return files.select("path", F.concat(F.lit("memory/"), F.when(kind == "", "note").otherwise(kind)).alias("topic"), importance.alias("importance"), field("name").alias("name"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("summary"), F.concat(F.lit("hash:"), F.substring(F.sha2("content", 256), 1, 12)).alias("hash"))
