"""Sessions: lookups, timelines, start and end, and the signals they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import at


def moment() -> Column:
    return F.coalesce("ended_at", "started_at")


def of_project(sessions: DataFrame, project: str, scope: str | None = None, limit: int = 20) -> DataFrame:
    keep = F.col("project") == project
    if scope is not None:
        keep &= F.col("scope") == scope
    return sessions.where(keep).orderBy(F.desc("started_at"), "id").limit(limit)


def of_identity(sessions: DataFrame, project: str, root: str | None, worktree: str | None, limit: int = 20) -> DataFrame:
    """By project, root and worktree; with half an identity, by project alone."""
    keep = F.col("project") == project
    if root is not None and worktree is not None:
        keep &= (F.col("project_root") == root) & (F.col("worktree_id") == worktree)
    return sessions.where(keep).orderBy(F.desc("started_at"), "id").limit(limit)


def between(sessions: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    return sessions.where(moment().between(at(start), at(end))).orderBy(moment().desc(), "id").limit(limit)


def active_session(sessions: DataFrame, project: str, scope: str | None = None) -> DataFrame:
    """The newest active session; no scope means those without one."""
    return sessions.where((F.col("project") == project) & (F.col("status") == "active") & F.col("scope").eqNullSafe(F.lit(scope))).orderBy(F.desc("started_at"), "id").limit(1)


def get(sessions: DataFrame, id: str) -> DataFrame:
    return sessions.where(F.col("id") == id)


def status(sessions: DataFrame, id: str) -> DataFrame:
    """(found, status) in one row, whether or not there is such a session."""
    return get(sessions, id).agg((F.count("*") > 0).alias("found"), F.max("status").alias("status"))


def import_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the sessions whose id isn't known; the others stay as they are."""
    return sessions.unionByName(new.dropDuplicates(["id"]).join(sessions.select("id"), "id", "left_anti"), allowMissingColumns=True)


def start(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Adds sessions (like the table) whose project and scope have no active one."""
    busy = sessions.where(F.col("status") == "active").select(F.col("project").alias("p"), F.col("scope").alias("s"))
    fresh = new.join(busy, (F.col("project") == F.col("p")) & F.col("scope").eqNullSafe(F.col("s")), "left_anti")
    return sessions.unionByName(fresh, allowMissingColumns=True)


def end(sessions: DataFrame, id: str, as_of: str, summary: str | None, errors: int) -> tuple[DataFrame, DataFrame]:
    """The ended session's state, and its outcome signal: 2 without errors, -2 with."""
    this = (F.col("id") == id) & (F.col("status") == "active")
    done = sessions.withColumns({"ended_at": F.when(this, at(as_of)).otherwise(F.col("ended_at")), "summary": F.when(this, F.lit(summary)).otherwise(F.col("summary")), "status": F.when(this, "completed").otherwise(F.col("status"))})
    good = errors == 0
    signal = sessions.where(this).select(F.concat(F.lit("sig_end_"), "id").alias("id"), F.col("id").alias("session_id"), F.lit("session_success" if good else "session_failure").alias("signal_type"), F.lit(2 if good else -2).cast("long").alias("signal_value"), at(as_of).alias("occurred_at"), "project")
    return done, signal


def timeline(sessions: DataFrame, recalls: DataFrame, signals: DataFrame, limit: int | None = None) -> DataFrame:
    """Per session its event counts, last activity and events, newest first. Events are gathered for the sessions within the limit only."""
    r = recalls.select("session_id", F.col("recalled_at").alias("at"), F.lit("recall").alias("kind"), F.col("query").alias("detail"))
    s = signals.select("session_id", F.col("occurred_at").alias("at"), F.lit("outcome").alias("kind"), F.col("signal_type").alias("detail"))
    e = r.unionByName(s).withColumnRenamed("session_id", "id")
    n = e.groupBy("id").agg(F.count_if(F.col("kind") == "recall").alias("recall_count"), F.count_if(F.col("kind") == "outcome").alias("outcome_count"), F.max("at").alias("last"))
    x = sessions.join(n, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("recall_count", "outcome_count")})
    x = x.withColumn("last_activity", F.greatest("started_at", "ended_at", "last")).drop("last")
    if limit is not None:
        x = x.orderBy(F.desc("last_activity"), "id").limit(limit)
        e = e.join(x.select("id"), "id", "left_semi")
    events = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "detail")), False).alias("events"))
    out = x.join(events, "id", "left")
    return out.orderBy(F.desc("last_activity"), "id") if limit is not None else out


# Titles of outcomes.
OUTCOME_TITLES = {"build_passed": "Build passed", "correction": "Correction detected", "error_free_run": "Error-free run", "error_resolved": "Error resolved", "explicit_boost": "Manual boost recorded", "session_failure": "Session ended with failures", "session_success": "Session completed successfully", "test_pass": "Tests passed", "test_passed": "Tests passed", "tool_error": "Tool error captured"}


def timeline_events(recalls: DataFrame, signals: DataFrame) -> DataFrame:
    """Both logs' events with titles and details, newest first within a session. A signal's detail names what its recall asked and its source; the recall must be of the same session."""
    asked = F.when(F.col("memory_count") == 1, "memory").otherwise("memories")
    r = recalls.select("id", "session_id", F.lit("recall").alias("kind"), F.concat(F.lit("Recalled "), F.col("memory_count").cast("string"), F.lit(" "), asked).alias("title"), F.col("query").alias("detail"), F.col("recalled_at").alias("occurred_at"), F.col("id").alias("recall_event_id"), "memory_count")
    known = recalls.select(F.col("id").alias("recall_event_id"), "session_id", F.col("query").alias("_query"), F.col("memory_count").alias("_count"))
    s = signals.join(known, ["recall_event_id", "session_id"], "left")
    plain = F.trim(F.replace("signal_type", F.lit("_"), F.lit(" ")))
    title = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTCOME_TITLES.items() for x in kv])[F.col("signal_type")], F.when(plain == "", "Outcome recorded").otherwise(F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, 2, 1 << 30))))
    detail = F.nullif(F.concat_ws(" · ", "_query", "source"), F.lit(""))
    s = s.select("id", "session_id", F.lit("outcome").alias("kind"), title.alias("title"), detail.alias("detail"), "occurred_at", "recall_event_id", F.col("_count").alias("memory_count"), "signal_type", "signal_value", "source")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("occurred_at"), "kind", "id"))
    return r.unionByName(s, allowMissingColumns=True).withColumn("place", place)


def context_query(files: list[str], errors: list[str], branch: str | None) -> str:
    """The search text of a session's signals: file stems, errors, and a telling branch name."""
    stems = [f.rpartition("/")[2].partition(".")[0] for f in files[:5]]
    words = [*[s for s in stems if s], *errors[:3]]
    if branch and branch not in ("main", "master", "develop"):
        words.append(branch.replace("-", " ").replace("/", " "))
    return " ".join(words)
