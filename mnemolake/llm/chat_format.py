r"""Chat formatting by event-sourced reconstruction (native).

A log of events is partitioned by conversation, sorted by sequence and folded
into final messages, which a template then renders. Messages are folded each in its own
group, and only the finished ones of a conversation meet, in the row that the
output demands.

Event types: ``message`` starts a message, ``delta`` appends a streamed piece,
``edit`` replaces what the message says, ``regenerate`` throws the answer away
so that later deltas start afresh, ``delete`` removes the message.

Template of one turn: ``<turn ROLE>\nTEXT</turn>\n``. Inside roles and texts
``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``; as every
backslash of the output is followed by one of these letters, reading back is
exact for any text, and no text can forge a turn mark.

Defined cases: a null text or role counts as empty; a null conversation id is a
conversation of its own; equal sequence numbers are ordered by type, role and
text, so reruns agree; null ones come first; messages stand in the order of their
first events, those of equal ones by role and text; repeated rows are repeated
events; an unknown event type is treated as ``message``; an empty log gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import or_empty, running_sums, table

RESETS = ("message", "edit", "regenerate")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    # In escaped text the letter after a backslash tells what it stood for, so the marks are undone before the backslash.
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, type, role, text) -> (conv_id, ord, message, role, text), one row a surviving message.

    ``message`` identifies the message an event is about within its
    conversation; ``ord`` is the sequence number of its first event.
    """
    kind = F.when(F.col("type").isin("delta", "delete", *RESETS), F.col("type")).otherwise("message")
    e = events.select("conv_id", "message", F.struct("seq", kind.alias("type"), or_empty(F.col("role")).alias("role"), or_empty(F.col("text")).alias("text")).alias("e"))
    m = e.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("log")).where(~F.exists("log", lambda x: x["type"] == "delete"))
    last = F.coalesce(F.array_max(F.transform("log", lambda x, i: F.when(x["type"].isin(*RESETS), i))), F.lit(0))
    live = F.transform(F.slice("log", last + 1, F.size("log")), lambda x: F.when(x["type"] == "regenerate", "").otherwise(x["text"]))
    return m.select("conv_id", F.col("log")[0]["seq"].alias("ord"), "message", F.col("log")[0]["role"].alias("role"), F.array_join(live, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, ord, message, role, text) -> (conv_id, formatted, loss_spans).

    ``loss_spans`` are the code-point spans of the assistant's texts within
    ``formatted``, end exclusive.
    """
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text", "message"))).alias("m"))
    parts = F.transform("m", lambda x: F.struct((x["role"] == "assistant").alias("own"), F.concat(F.lit("<turn "), escape(x["role"]), F.lit(">\n")).alias("head"), escape(x["text"]).alias("body")))
    out = whole.select("conv_id", parts.alias("p"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len("</turn>\n")
    ends = running_sums(F.transform("p", lambda x: size(x).cast("long")))
    spans = F.zip_with("p", ends, lambda x, to: F.when(x["own"], F.struct((to - len("</turn>\n") - F.length(x["body"])).alias("start"), (to - len("</turn>\n")).alias("end"))))
    return out.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    whole = F.lit(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
    roles, texts = (F.regexp_extract_all(formatted, whole, F.lit(i)) for i in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def masked(formatted: Column, loss_spans: Column) -> Column:
    """The texts of the loss spans, unescaped, one after the other."""
    text = lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(loss_spans, lambda s: unescape(text(s))), "")


def as_events(rows: DataFrame) -> DataFrame:
    """Finished chat rows (conv_id, turn, role, text) as the log that an interactive session would leave, one message a row.

    An assistant's answer is streamed, thrown away half-way, and streamed anew; what
    others say comes in two pieces, or as a draft that an edit then replaces.
    """
    own = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*own).agg(F.count("*").cast("int").alias("n")).select(*own, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    text = or_empty(F.col("text"))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.left(text, half), F.substr(text, half + 1)
    event = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    none = F.lit(None).cast("string")
    answer = F.array(event("message", none), event("delta", rest), event("regenerate", none), event("delta", first), event("delta", rest))
    streamed = F.array(event("message", first), event("delta", rest))
    edited = F.array(event("message", F.concat(rest, F.lit("draft"))), event("delta", F.lit(" not sent")), event("edit", text))
    log = F.when(F.col("role") == "assistant", answer).when(F.length(text) % 2 == 0, streamed).otherwise(edited)
    e = rows.select(*own, "copy", F.posexplode(log).alias("step", "e"))
    message = F.struct("turn", "role", F.sha2("text", 256).alias("digest"), "copy")
    return e.select("conv_id", message.alias("message"), F.struct("turn", "step").alias("seq"), "e.type", "role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role FROM range(2)").withColumn("text", F.lit(probe))
    out = format_chats(as_events(rows.unionByName(extra.select("conv_id", "turn", "role", "text"))))
    return summary(out)


def summary(out: DataFrame) -> DataFrame:
    """Counts and hashes of rendered conversations: turns as they are read back, loss as the spans have it."""
    turns = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("said"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS body,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS head FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ' || head || '>' || chr(10) || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
