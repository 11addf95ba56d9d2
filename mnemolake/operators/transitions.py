"""State transitions: (state, arguments, as_of) -> new state. Nothing is written; callers commit the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import active, at, in_project

# How fast kinds of memories fade, and the ranks of importance.
FADING = {"high": 0.5, "low": 2.0}
ACCESS_SHARE = 0.1
AUTO_FACTOR, AUTO_HOURS = 0.95, 24
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "ephemeral": 1}


def _upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def store(memories: DataFrame, new: DataFrame) -> DataFrame:
    return memories.unionByName(new, allowMissingColumns=True)


def replace(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` stand for those of equal id."""
    return _upsert(memories, new, "id")


def update(memories: DataFrame, id: str, as_of: str, summary: str | None = None, importance: str | None = None, keywords: list[str] | None = None) -> DataFrame:
    """New content; the weight starts at 1 again and the vector has to be made anew."""
    this = F.col("id") == id
    change = {"weight": F.lit(1.0), "updated_at": at(as_of)}
    if summary is not None:
        change |= {"summary": F.lit(summary), "embedding": F.lit(None)}
    if importance is not None:
        change["importance"] = F.lit(importance)
    if keywords is not None:
        change["keywords"] = F.array(*[F.lit(k) for k in keywords])
    return memories.withColumns({c: F.when(this, v.cast(memories.schema[c].dataType)).otherwise(F.col(c)) for c, v in change.items()})


def forget(memories: DataFrame, ids: list[str]) -> DataFrame:
    return memories.where(~F.col("id").isin(*ids))


def invalidate(memories: DataFrame, id: str, as_of: str, reason: str | None = None, superseded_by: str | None = None) -> DataFrame:
    if reason is not None and len(reason.encode()) > 1024:
        raise ValueError("a reason has at most 1024 bytes")
    this = F.col("id") == id
    change = {"invalidated_at": at(as_of), "updated_at": at(as_of), "invalidation_reason": F.lit(reason).cast("string")}
    if "superseded_by" in memories.columns:
        change["superseded_by"] = F.lit(superseded_by).cast("string")
    return memories.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in change.items()})


def touch(memories: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Access bump of the memories in ``ids`` (id)."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    m = memories.join(hit, "id", "left")
    return m.withColumns({"last_accessed": F.when(F.col("_hit"), at(as_of)).otherwise(F.col("last_accessed")), "access_count": F.when(F.col("_hit"), F.col("access_count") + 1).otherwise(F.col("access_count"))}).drop("_hit")


def decayed(factor: float) -> Column:
    speed = F.lit(1.0)
    for kind, x in FADING.items():
        speed = F.when(F.col("importance") == kind, x).otherwise(speed)
    loss = (1 - factor) * speed / (1 + ACCESS_SHARE * F.col("access_count"))
    return F.greatest(F.lit(0.0), F.col("weight") * (1 - loss))


def decay(memories: DataFrame, factor: float) -> DataFrame:
    return memories.withColumn("weight", F.when(active() & (F.col("importance") != "critical"), decayed(factor)).otherwise(F.col("weight")))


def auto_decay(memories: DataFrame, hours_since_last: float | None, factor: float = AUTO_FACTOR) -> DataFrame:
    """One step, however long the pause, if a day has passed."""
    return memories if hours_since_last is not None and hours_since_last < AUTO_HOURS else decay(memories, factor)


def prune(memories: DataFrame, threshold: float) -> DataFrame:
    gone = active() & (F.col("weight") < threshold) & ~F.col("importance").isin("critical", "high")
    return memories.where(~gone)


def expire(memories: DataFrame, as_of: str) -> DataFrame:
    return memories.where(~(active() & F.coalesce(F.col("expires_at") < at(as_of), F.lit(False))))


def consolidated(memories: DataFrame, topic: str, project: str | None = None) -> DataFrame:
    """One memory that stands for the topic's active ones.

    Summaries come from the first eight; keywords are put in the order of their
    first use by one aggregate each, so that only the result's own lists are gathered.
    """
    m = memories.where((F.col("topic") == topic) & active() & in_project(project))
    rank = F.lit(0)
    for name, r in RANK.items():
        rank = F.when(F.col("importance") == name, r).otherwise(rank)
    cut = F.when(F.length("summary") <= 120, F.col("summary")).otherwise(F.concat(F.substring("summary", 1, 120), F.lit("…")))
    order = F.struct("created_at", "id")
    g = m.withColumn("rank", rank).groupBy("topic").agg(
        F.count("*").alias("n"),
        F.min_by("summary", order).alias("only"),
        F.max_by("importance", "rank").alias("importance"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]).alias("related_ids"),
        *[F.max_by(c, order).alias(c) for c in ("project", "branch", "worktree")],
    )
    first = m.orderBy("created_at", "id").limit(8).select("created_at", "id", cut.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "s"))), lambda x: x["s"]), " | ").alias("said"))
    used = m.select("created_at", "id", F.posexplode("keywords").alias("i", "k")).groupBy("k").agg(F.min(F.struct("created_at", "id", "i")).alias("at"))
    words = used.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda x: x["k"]).alias("keywords"))
    text = F.when(F.col("n") == 1, F.col("only")).otherwise(F.concat(F.lit("Consolidated "), F.col("n").cast("string"), F.lit(f" memories for topic '{topic}': "), "said"))
    g = g.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(words))  # one row each
    return g.select(F.concat(F.lit("consolidated:"), "topic").alias("id"), "topic", text.alias("summary"), "importance", "keywords", "related_ids", F.lit(1.0).alias("weight"), "project", "branch", "worktree")


def consolidate_as(memories: DataFrame, topic: str, id: str, summary: str, as_of: str, project: str | None = None) -> DataFrame:
    """The topic's active memories give way to one with a given summary, of high importance."""
    gone = (F.col("topic") == topic) & active() & in_project(project)
    new = memories.sparkSession.range(1).select(F.lit(id).alias("id"), F.lit(topic).alias("topic"), F.lit(summary).alias("summary"), F.lit("high").alias("importance"), F.lit(1.0).alias("weight"), at(as_of).alias("created_at"), at(as_of).alias("updated_at"), F.lit(project).cast("string").alias("project"))
    return memories.where(~gone).unionByName(new, allowMissingColumns=True)


def consolidate(memories: DataFrame, topic: str, project: str | None = None) -> DataFrame:
    gone = (F.col("topic") == topic) & active() & in_project(project)
    return memories.where(~gone).unionByName(consolidated(memories, topic, project), allowMissingColumns=True)


def promote(memories: DataFrame, id: str, new_id: str) -> DataFrame:
    """Copies content to the shared project."""
    copy = memories.where(F.col("id") == id).select(F.lit(new_id).alias("id"), "topic", "summary", "importance", "keywords", F.lit("_shared").alias("project"), F.lit(1.0).alias("weight"))
    return memories.unionByName(copy, allowMissingColumns=True)


def link_projects(links: DataFrame, a: str, b: str) -> DataFrame:
    if a == b:
        raise ValueError("a project isn't linked with itself")
    new = links.sparkSession.createDataFrame([(a, b), (b, a)], "source_project string, target_project string")
    return links.unionByName(new, allowMissingColumns=True).dropDuplicates(["source_project", "target_project"])


def purge_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    return {k: t.where(F.col("project").isNull() | (F.col("project") != project)) for k, t in tables.items()}


def purge_before(tables: dict[str, tuple[DataFrame, str]], cutoff: str) -> dict[str, DataFrame]:
    """Each table with its time column; older rows go."""
    return {k: t.where(F.col(c).isNull() | (F.col(c) >= at(cutoff))) for k, (t, c) in tables.items()}


def archive_merge(old: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """Memories of an archive: ``skip`` keeps the old, ``overwrite`` takes the new, ``merge`` joins both."""
    if mode not in ("skip", "overwrite", "merge"):
        raise ValueError("mode: skip, overwrite or merge")
    o = old.select("id", F.struct(*[c for c in old.columns if c != "id"]).alias("o"))
    n = new.select("id", F.struct(*[c for c in new.columns if c != "id"]).alias("n"))
    both = o.join(n, "id", "full_outer")
    out = ["id"]
    for c in (c for c in old.columns if c != "id"):
        a, b = F.col("o")[c], F.col("n")[c] if c in new.columns else F.lit(None)
        in_both = F.col("o").isNotNull() & F.col("n").isNotNull()
        if mode == "merge" and c in new.columns:
            pick = {"keywords": F.array_sort(F.array_union(a, b)), "weight": F.greatest(a, b), "created_at": F.least(a, b)}.get(c, a)
        else:
            pick = b if mode == "overwrite" and c in new.columns else a
        out.append(F.when(in_both, pick).when(F.col("o").isNotNull(), a).otherwise(b).alias(c))
    return both.select(*out)


def delete_document(documents: DataFrame, chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    gone = documents.where(F.col("source_path") == path).select(F.col("id").alias("document_id"))
    return documents.where(F.col("source_path") != path), chunks.join(gone, "document_id", "left_anti")


def reingest(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame, force: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents by path: replaced, or, without ``force``, left as they are."""
    if not force:
        fresh = new_documents.join(documents.select("source_path"), "source_path", "left_anti")
        return documents.unionByName(fresh, allowMissingColumns=True), chunks.unionByName(new_chunks.join(fresh.select(F.col("id").alias("document_id")), "document_id", "left_semi"), allowMissingColumns=True)
    stale = documents.join(new_documents.select("source_path"), "source_path", "left_semi").select(F.col("id").alias("document_id"))
    return _upsert(documents, new_documents, "source_path"), chunks.join(stale, "document_id", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Appends entries (id, timestamp, operation, memory_id, topic, summary) with the hash of their content."""
    e = entries.withColumn("content_hash", fnv1a(F.col("summary"))).drop("summary")
    return log.unionByName(e, allowMissingColumns=True)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits; the product is worked out on 32-bit halves."""
    low = 0xFFFFFFFF
    codes = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), r"(?<=\G..)"), lambda x: x != "")

    def step(h: Column, code: Column) -> Column:
        # The prime is 2^40 + 435.
        lo = h["lo"].bitwiseXOR(F.conv(code, 16, 10).cast("long"))
        product = lo * 435
        hi = (h["hi"] * 435 + F.shiftright(product, 32) + lo * 256).bitwiseAND(F.lit(low))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(codes, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def audit_list(log: DataFrame, since: str | None = None, operation: str | None = None, limit: int = 20) -> DataFrame:
    keep = F.lit(True)
    if since is not None:
        keep &= F.col("timestamp") >= at(since)
    if operation is not None:
        keep &= F.col("operation") == operation
    return log.where(keep).orderBy(F.desc("timestamp"), "id").limit(limit)


def audit_get(log: DataFrame, id: str) -> DataFrame:
    return log.where(F.col("id") == id)


def rollback(memories: DataFrame, log: DataFrame, entry_id: str) -> DataFrame:
    """Undoes a store (unless the memory was updated later) or an invalidation."""
    entry = log.where(F.col("id") == entry_id).select("memory_id", "operation", F.col("timestamp").alias("at"))
    later = log.where(F.col("operation") == "update").join(entry, "memory_id").where(F.col("timestamp") > F.col("at")).select("memory_id")
    stored = entry.where(F.col("operation") == "store").join(later, "memory_id", "left_anti").select(F.col("memory_id").alias("id"))
    undone = entry.where(F.col("operation") == "invalidate").select(F.col("memory_id").alias("id"), F.lit(True).alias("_undo"))
    m = memories.join(stored, "id", "left_anti").join(F.broadcast(undone), "id", "left")  # one entry
    change = {c: F.when(F.col("_undo"), F.lit(None)).otherwise(F.col(c)) for c in ("invalidated_at", "invalidation_reason", "superseded_by") if c in memories.columns}
    return m.withColumns(change).drop("_undo")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
