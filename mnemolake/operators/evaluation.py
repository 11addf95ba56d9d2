"""Evaluation windows and reports, and the matching of records that were written twice."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import active, at, days_before, in_project

# How far apart two records of one thing may be, in seconds, and the band that counts as stable.
SESSION_TOLERANCE, CORRECTION_TOLERANCE, STABLE = 300, 30, 2.0
#: Tolerances that a slot of time holds.
SLOT = 64
METRICS = {"error_rate": True, "correction_rate": True, "resolution_rate": False, "test_fix_rate": False, "memory_utilization": False}


def islands(rows: DataFrame, keys: list[str], pause: int) -> DataFrame:
    """``rows`` with ``island``, the number of the run within its key: runs end at pauses of more than ``pause`` seconds.

    Time is cut into slots. Rows are put in order within their key and slot only;
    what goes on across slots is told by the last moment of the slot before,
    from a table with a row a key and slot. Key and slot are one column, whose
    nulls are alike, so rows are dealt out once for the order, the table and the join.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    unit = F.struct(F.struct(*keys).alias("key"), F.floor(micros / (SLOT * pause * 1_000_000)).cast("long").alias("slot"))
    x = rows.select(unit.alias("_unit"), *[c for c in rows.columns if c not in keys])
    inside = Window.partitionBy("_unit").orderBy("at", "old", "id")
    late = lambda gap: F.coalesce(gap > pause * 1_000_000, F.lit(False)).cast("int")
    x = x.withColumn("_cut", late(micros - F.unix_micros(F.lag("at").over(inside).cast("timestamp"))))
    x = x.withColumn("_own", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = x.groupBy("_unit").agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"), F.sum("_cut").alias("cuts"))
    slots = Window.partitionBy("_unit.key").orderBy("_unit.slot")
    edges = edges.withColumn("_new", late(F.col("lo") - F.lag("hi").over(slots)))
    base = F.sum(F.col("_new") + F.col("cuts")).over(slots.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cuts")
    x = x.join(edges.select("_unit", base.alias("_base")), "_unit")
    return x.select(*[F.col(f"_unit.key.{c}").alias(c) if c in keys else F.col(c) for c in rows.columns], (F.col("_base") + F.col("_own")).alias("island"))


def _walk(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of what finds no partner among rows (first of its island, micros, old, id) that stand together by island and in order of time. Held are only rows that wait, of one kind, for less than ``span``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        olds, news = deque(), deque()
        found = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], ["id"])
        for batch in batches:
            left = []
            for first, t, old, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    left += [x for _, x in olds]
                    olds.clear()
                    news.clear()
                while olds and t - olds[0][0] >= span:
                    left.append(olds.popleft()[1])
                while news and t - news[0] >= span:
                    news.popleft()
                if old:
                    if news:
                        news.popleft()
                    else:
                        olds.append((t, i))
                elif olds:
                    olds.popleft()
                else:
                    news.append(t)
            yield found(left)
        yield found([x for _, x in olds])

    return walk


def unmatched(legacy: DataFrame, structured: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Legacy rows (keys, at, id) that no structured row (keys, at) within the tolerance, in whole seconds, stands for, one for one.

    Greedy in the order of time: each legacy row takes the earliest unused
    structured row; nothing stands for a row without a time. A key's rows are cut into
    islands at pauses longer than the tolerance, across which nothing can match. A task
    walks through many islands, one after the other, both kinds once, and keeps what
    the tolerance spans.
    """
    both = legacy.select(*keys, "at", "id", F.lit(1).alias("old")).unionByName(structured.select(*keys, "at", F.lit("").alias("id"), F.lit(0).alias("old")))
    x = islands(both.where(F.col("at").isNotNull()), keys, tolerance + 1)
    order = ["at", "old", "id"]
    first = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)) == 1
    x = x.repartition(*keys, "island").withColumn("first", first).sortWithinPartitions(*keys, "island", *order)
    x = x.select("first", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "old", "id")
    timeless = legacy.where(F.col("at").isNull()).select("id")
    return timeless.unionByName(x.mapInArrow(_walk((tolerance + 1) * 1_000_000), "id string"))


def session_record(task: Column, summary: Column) -> Column:
    """What a session's end was once stored as: the summary of a memory."""
    return F.when(task.isNotNull(), F.concat(F.lit("Session completed: "), task, F.lit(". "), summary)).otherwise(F.concat(F.lit("Session completed. "), summary))


def window(memories: DataFrame, sessions: DataFrame, recalls: DataFrame, signals: DataFrame, as_of: str, newest: float, oldest: float, project: str | None = None) -> DataFrame:
    """The counters of one window, in one row; both bounds belong to it."""
    lo, hi = days_before(as_of, oldest), days_before(as_of, newest)
    m = memories.where(active() & in_project(project))
    made = m.where(F.col("created_at").between(lo, hi))
    counted = made.agg(*[F.count_if(F.col("topic") == t).alias(n) for t, n in (("errors/active", "le"), ("errors/resolved", "lr"), ("tests/failed", "failed_test_count"), ("tests/resolved", "lt"))])
    s = sessions.where(F.coalesce("ended_at", "started_at").between(lo, hi) & in_project(project))
    g = signals.where(F.col("occurred_at").between(lo, hi) & in_project(project))
    r = recalls.where(F.col("recalled_at").between(lo, hi) & in_project(project))
    sig = g.agg(*[F.count_if(F.col("signal_type") == t).alias(n) for t, n in (("tool_error", "se"), ("correction", "sc"), ("error_resolved", "sr"), ("test_passed", "st"))])
    ses = s.agg(F.count("*").alias("s_n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "task", "summary"))), F.lit(0)).alias("s_len"))
    rec = r.agg(F.coalesce(F.sum(F.size("memory_ids")), F.lit(0)).alias("r_n"))
    old_s = made.where(F.col("topic").startswith("session/")).select(F.coalesce("project", "topic").alias("project"), "summary", F.col("created_at").alias("at"), "id")
    new_s = s.where(F.col("summary").isNotNull()).select("project", session_record(F.col("task"), F.col("summary")).alias("summary"), F.coalesce("ended_at", "started_at").alias("at"))
    xs = old_s.join(unmatched(old_s, new_s, ["project", "summary"], SESSION_TOLERANCE), "id", "left_semi").agg(F.count("*").alias("s_x"), F.coalesce(F.sum(F.octet_length("summary")), F.lit(0)).alias("s_more"))
    old_c = made.where(F.col("topic") == "corrections").select("project", F.col("created_at").alias("at"), "id")
    xc = unmatched(old_c, g.where(F.col("signal_type") == "correction").select("project", F.col("occurred_at").alias("at")), ["project"], CORRECTION_TOLERANCE).agg(F.count("*").alias("c_x"))
    old_r = m.where((F.col("access_count") > 0) & F.col("last_accessed").between(lo, hi)).select(F.col("id").alias("memory"), F.col("last_accessed").alias("at"), "id")
    new_r = r.select(F.explode("memory_ids").alias("memory"), F.col("recalled_at").alias("at"))
    xr = unmatched(old_r, new_r, ["memory"], SESSION_TOLERANCE).agg(F.count("*").alias("r_x"))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [counted, sig, ses, rec, xs, xc, xr])  # one row each
    return one.select((F.col("se") + F.col("le")).alias("error_count"), (F.col("sc") + F.col("c_x")).alias("correction_count"), (F.col("sr") + F.col("lr")).alias("resolved_count"), "failed_test_count", (F.col("st") + F.col("lt")).alias("resolved_test_count"), (F.col("s_n") + F.col("s_x")).alias("session_count"), (F.col("s_len") + F.col("s_more")).alias("total_session_length"), (F.col("r_n") + F.col("r_x")).alias("recalled_memory_count"))


def metrics(w: DataFrame) -> DataFrame:
    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    n = F.col("session_count")
    r = F.col("recalled_memory_count")
    return w.select(
        ratio(F.col("error_count"), n).alias("error_rate"),
        ratio(F.col("correction_count"), n).alias("correction_rate"),
        ratio(F.col("resolved_count"), F.col("error_count") + F.col("resolved_count")).alias("resolution_rate"),
        ratio(F.col("resolved_test_count"), F.col("failed_test_count") + F.col("resolved_test_count")).alias("test_fix_rate"),
        F.when(n == 0, 0.0).otherwise(r / (r + 5) * 100).alias("memory_utilization"),
        "session_count",
    )


def report(recent: DataFrame, previous: DataFrame, stable_band: bool = True) -> DataFrame:
    """(metric, previous, recent, trend) of two windows. With a stable band, changes of up to 2 % are stable; without, a previous 0 never improves."""
    names = list(METRICS)
    a = metrics(previous).select(F.posexplode(F.array(*names)).alias("i", "previous"))
    b = metrics(recent).select(F.posexplode(F.array(*names)).alias("i", "recent"))
    x = a.join(b, "i").withColumn("metric", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1))
    lower = F.col("metric").isin(*[n for n, low in METRICS.items() if low])
    change = F.coalesce(F.try_divide(F.col("recent") - F.col("previous"), F.col("previous")) * 100, F.when(F.col("recent") > 0, 100.0).otherwise(0.0))
    better = F.when(lower, F.col("recent") < F.col("previous")).otherwise(F.col("recent") > F.col("previous"))
    if stable_band:
        trend = F.when(F.abs(change) <= STABLE, "stable").when(better, "better").otherwise("worse")
    else:
        trend = F.when((F.col("previous") != 0) & better, "improving").otherwise("not improving")
    return x.select("metric", "previous", "recent", trend.alias("trend"))


# The sentences of the verdict.
VERDICTS = ("Needs attention: Most metrics declining or stable", "Mixed: Limited improvement", "Fair: Some improvement", "Good: Most metrics improving", "Excellent: All metrics improving")


def assessment(rows: DataFrame) -> DataFrame:
    good = F.count_if(F.col("trend").isin("better", "improving") & (F.col("metric") != "memory_utilization"))
    return rows.agg(good.alias("n")).select(F.element_at(F.array(*[F.lit(w) for w in VERDICTS]), F.col("n").cast("int") + 1).alias("assessment"))


def effectiveness_window(recalls: DataFrame, effects: DataFrame, as_of: str, newest: float, oldest: float, project: str | None = None) -> DataFrame:
    """Recalled occurrences in the window with their scores: counts and total."""
    r = recalls.where(F.col("recalled_at").between(days_before(as_of, oldest), days_before(as_of, newest)) & in_project(project)).select(F.col("id").alias("recall_event_id"), F.explode("memory_ids").alias("memory_id"))
    x = r.join(effects.select("recall_event_id", "memory_id", "effectiveness"), ["recall_event_id", "memory_id"], "left")
    return x.agg(F.count("*").alias("recalled"), F.count("effectiveness").alias("scored"), F.count_if(F.abs("effectiveness") > 1.2e-7).alias("non_zero"), F.coalesce(F.sum("effectiveness"), F.lit(0.0)).alias("total"))


def top_recalled(recalls: DataFrame, effects: DataFrame, as_of: str, newest: float, oldest: float, n: int = 5) -> DataFrame:
    r = recalls.where(F.col("recalled_at").between(days_before(as_of, oldest), days_before(as_of, newest))).select(F.col("id").alias("recall_event_id"), F.explode("memory_ids").alias("memory_id"))
    x = r.join(effects.select("recall_event_id", "memory_id", "effectiveness"), ["recall_event_id", "memory_id"])
    return x.groupBy("memory_id").agg(F.avg("effectiveness").alias("effectiveness")).orderBy(F.desc(F.round("effectiveness", 9)), "memory_id").limit(n)


def with_labels(top: DataFrame, memories: DataFrame) -> DataFrame:
    """Recalled memories (memory_id, ...) with topic and the start of the summary; ``?`` for those that are gone."""
    m = memories.select(F.col("id").alias("memory_id"), "topic", F.substring("summary", 1, 60).alias("label"))
    return top.join(m, "memory_id", "left").withColumns({c: F.coalesce(c, F.lit("?")) for c in ("topic", "label")})
