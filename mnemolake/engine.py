"""One method a verb over a set of tables. Reads are pure; changes return new tables for ``commit``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import embedding
from mnemolake.operators import chunking, evaluation, export, feedback, graph, insights, memory, recall, search, sessions, transitions
from mnemolake.operators.segments import SegmentedIndex
from mnemolake.schema import TABLES
from mnemolake.sources import snapshot
from mnemolake.streaming import pipelines

# Bounds of numeric arguments and byte lengths of texts.
LIMITS = {"limit": (1, 50), "offset": (0, 10_000), "depth": (1, 10), "ttl_hours": (1, 168)}


#: What the full-text index of a table holds.
TEXTS = {"memories": search.memory_text, "concepts": search.concept_text, "chunks": search.chunk_text}


def bounded(name: str, value: int) -> int:
    lo, hi = LIMITS[name]
    return max(lo, min(hi, value))


def required(name: str, value: str) -> str:
    if not value or not value.strip():
        raise ValueError(f"{name} can't be blank")
    return value


@dataclass
class Engine:
    """The tables at one time, ``as_of``; a table that isn't given is empty."""

    spark: SparkSession
    as_of: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    project: str | None = None
    indexes: dict[str, SegmentedIndex] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], TABLES[name])
        return self.tables[name]

    @classmethod
    def open(cls, spark: SparkSession, root: str, as_of: str, project: str | None = None) -> Engine:
        name = snapshot.current(spark, root)
        names = [r["table"] for r in snapshot.snapshots(spark, root).where(F.col("snapshot") == name).collect()]  # a row a table
        found = {t: SegmentedIndex.open(spark, text(), f"{root}/index/{t}", name) for t, text in TEXTS.items() if t in names}
        return cls(spark, as_of, {t: snapshot.load(spark, root, t, name) for t in names}, project, {t: i for t, i in found.items() if i is not None})

    def commit(self, root: str) -> str:
        """Writes a snapshot, and the segments that its indexes have gained, tagged with its name."""
        name = snapshot.commit(self.spark, root, self.tables)
        for t, i in self.indexes.items():
            if i.folder == f"{root}/index/{t}":
                i.flush(name).tidy(name)
        return name

    def having(self, changed: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, **tables: DataFrame) -> Engine:
        """The state with other tables. ``changed`` has the rows of a table before and after whose texts change, none if no text does; an index of a table without it no longer holds."""
        changed = changed or {}
        kept = {n: i.apply(*changed[n]) if changed.get(n, (None, None)) != (None, None) else i for n, i in self.indexes.items() if n not in tables or n in changed}
        return Engine(self.spark, self.as_of, {**self.tables, **tables}, self.project, kept)

    def _memories(self, new: DataFrame, of: Column | None = None) -> Engine:
        """The state with ``new`` memories, whose texts differ from the old ones' where ``of`` holds only (nowhere, if it isn't given)."""
        return self.having({"memories": (None, None) if of is None else (self.table("memories").where(of), new.where(of))}, memories=new)

    # memories
    def recall(self, query: str, vector: list[float] | None = None, limit: int = 10, offset: int = 0, worktree: str | None = None, topic: str | None = None, keyword: str | None = None, session_id: str | None = None, code_context: bool = False, hours_since_decay: float = 0.0) -> tuple[DataFrame, Engine]:
        """Hits (id, score, place), and the state with the day's decay, the access bump and the logged recall."""
        limit, offset = bounded("limit", limit), bounded("offset", offset)
        project = self.project
        if session_id is not None:
            of = sessions.get(self.table("sessions"), session_id).first()
            if of is None or project not in (None, of["project"]):
                raise ValueError("session_id: no such session in this project")
            project = of["project"]
        m = transitions.auto_decay(self.table("memories"), hours_since_decay)
        hits = recall.recall(m, required("query", query), limit, offset, vector, self.table("concepts") if code_context else None, project, worktree, topic, keyword, self.table("recall_effectiveness"), self.as_of, self.indexes.get("memories"), self.indexes.get("concepts"))
        event = recall.recall_event(hits, self.table("sessions"), query, self.as_of, project, session_id)
        after = self.having({"memories": (None, None)}, memories=transitions.touch(m, hits, self.as_of), recall_events=self.table("recall_events").unionByName(event, allowMissingColumns=True))
        return hits, after

    def build_indexes(self, root: str) -> Engine:
        """Writes the full-text indexes of memories, concepts and chunks, and uses them for searches of this state."""
        made = {n: SegmentedIndex.create(self.table(n), text(), f"{root}/index/{n}") for n, text in TEXTS.items()}
        return Engine(self.spark, self.as_of, self.tables, self.project, made)

    def store_dedup(self, id: str, topic: str, summary: str, vector: list[float]) -> Engine:
        """Stores a memory, or updates the one that already says as much under the topic."""
        new = search.store_dedup(self.table("memories"), id, required("topic", topic), required("summary", summary), vector, self.as_of, self.project, self.table("recall_effectiveness"), self.indexes.get("memories"))
        return self._memories(new, F.col("topic") == topic)

    def store(self, new: DataFrame) -> Engine:
        return self.having({"memories": (None, new)}, memories=transitions.store(self.table("memories"), new))

    def update(self, id: str, **change) -> Engine:
        return self._memories(transitions.update(self.table("memories"), id, self.as_of, **change), F.col("id") == id)

    def forget(self, *ids: str) -> Engine:
        return self._memories(transitions.forget(self.table("memories"), list(ids)), F.col("id").isin(*ids))

    def invalidate(self, id: str, reason: str | None = None) -> Engine:
        return self._memories(transitions.invalidate(self.table("memories"), id, self.as_of, reason))

    def list_invalidated(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return memory.list_invalidated(self.table("memories"), self.project, limit, offset)

    def decay(self, hours_since_last: float | None = None) -> Engine:
        return self._memories(transitions.auto_decay(self.table("memories"), hours_since_last))

    def prune(self, threshold: float = 0.1) -> Engine:
        old = self.table("memories")
        new = transitions.expire(transitions.prune(old, threshold), self.as_of)
        return self.having({"memories": (old.join(new, "id", "left_anti"), None)}, memories=new)

    def consolidate(self, topic: str) -> Engine:
        return self._memories(transitions.consolidate(self.table("memories"), required("topic", topic), self.project), F.col("topic") == topic)

    def stats(self) -> DataFrame:
        return memory.stats(self.table("memories"), self.project)

    def topics(self) -> DataFrame:
        return memory.topics(self.table("memories"), self.project)

    def health(self) -> DataFrame:
        return memory.topic_health(self.table("memories"), self.as_of, self.project)

    def lessons(self) -> DataFrame:
        return insights.lessons(self.table("memories"), self.project)

    def analytics(self) -> DataFrame:
        return insights.analytics(self.table("memories"), self.table("memoirs"), self.table("concepts"), self.table("concept_links"), self.as_of, self.project)

    def changelog(self, since: str) -> DataFrame:
        return insights.changelog(self.table("memories"), self.table("sessions"), since, self.project)

    # documents
    def ingest(self, folder: str, recursive: bool = True, force: bool = True, embedders: list[tuple[str, embedding.Embedder]] | None = None) -> tuple[Engine, DataFrame]:
        """Reads and chunks a folder's text files; the second result names files that can't be read.

        The first of ``embedders`` that answers gives the chunks vectors. They are kept by
        the hash of the text, and only asked for where none is kept. If none answers,
        chunks go without.
        """
        docs, rejected = pipelines.read_folder(self.spark, folder, recursive)
        docs = docs.withColumn("id", F.sha2("source_path", 256)).withColumn("project", F.lit(self.project).cast("string"))
        kept = ["document_id", "chunk_index", "content", "heading", "chunk_strategy"]
        head = chunking.heading_chunks(docs.where("source_type = 'markdown'")).select(*kept)
        code = chunking.block_chunks(docs.where("source_type = 'code'")).withColumn("heading", F.lit(None).cast("string")).select(*kept)
        text = chunking.window_chunks(docs.where("source_type = 'text'")).withColumn("heading", F.lit(None).cast("string")).select(*kept)
        chunks = head.unionByName(code).unionByName(text).withColumn("id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")))
        chunks = chunks.join(docs.select(F.col("id").alias("document_id"), "source_path", "source_type"), "document_id")
        d, c = transitions.reingest(self.table("documents"), self.table("chunks"), docs.drop("content", "at"), chunks, force)
        chosen = embedding.choose(embedders or [])
        if chosen is None:
            return self.having(documents=d, chunks=c), rejected
        vectors = self.table("vectors").unionByName(snapshot.cut(embedding.add_vectors(c, self.table("vectors"), chosen, "content")))
        return self.having(documents=d, chunks=embedding.with_vectors(c, vectors, chosen[0], "content"), vectors=vectors), rejected

    def forget_source(self, path: str) -> Engine:
        d, c = transitions.delete_document(self.table("documents"), self.table("chunks"), path)
        return self.having(documents=d, chunks=c)

    def search_docs(self, query: str, limit: int = 10) -> DataFrame:
        c = self.table("chunks")
        c = c if "project" in c.columns else c.join(self.table("documents").select(F.col("id").alias("document_id"), "project"), "document_id", "left")
        return search.chunk_fts(c, query, self.project, bounded("limit", limit), self.indexes.get("chunks"))

    def search_all(self, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
        c = self.table("chunks").join(self.table("documents").select(F.col("id").alias("document_id"), "project"), "document_id", "left")
        index = self.indexes.get("memories")
        base = search.search_all(self.table("memories"), c, query, bounded("limit", limit), offset, self.project, index=index, chunk_index=self.indexes.get("chunks"))
        terms = recall.expansion(self.table("concepts"), query, self.indexes.get("concepts"))
        return search.search_expanded(self.table("memories"), base, terms, limit, self.project, index) if terms else base

    # graph
    def code_query(self, kind: str, memoir: str, id: str | None = None, labels: tuple[str, ...] = (), depth: int = 2) -> DataFrame:
        links, concepts = self.table("concept_links"), self.table("concepts")
        if kind == "symbols":
            return graph.with_labels(concepts, memoir, list(labels)) if labels else concepts.where(F.col("memoir_id") == memoir)
        if kind == "structure":
            return graph.bfs(links, required("id", id or ""), bounded("depth", depth))
        return {"callers": graph.callers, "callees": graph.callees, "implementors": graph.implementors}[kind](links, required("id", id or ""))

    def import_code_graph(self, memoir: str, concepts: DataFrame, edges: DataFrame, prune: bool = True) -> tuple[Engine, DataFrame, DataFrame]:
        """The new state, what happened to the concepts, and edges that name unknown concepts."""
        report = graph.upsert_concepts(self.table("concepts"), concepts)
        merged, links = report.drop("action"), self.table("concept_links")
        good, bad = graph.resolve_edges(edges, merged, memoir)
        links = graph.upsert_links(links, good).drop("action")
        if prune:
            merged, links = graph.prune_concepts(merged, links, memoir, concepts.select("name"))
        return self.having(concepts=merged, concept_links=links), report.groupBy("action").count(), bad

    # sessions and learning
    def end_session(self, id: str, summary: str | None, errors: int = 0) -> Engine:
        done, signal = sessions.end(self.table("sessions"), id, self.as_of, summary, errors)
        signals = self.table("outcome_signals").unionByName(signal, allowMissingColumns=True)
        scores = feedback.score(self.table("recall_events"), signals, done.where(F.col("id") == id), self.as_of)
        return self.having(sessions=done, outcome_signals=signals, recall_effectiveness=feedback.upsert_scores(self.table("recall_effectiveness"), scores))

    def timeline(self, limit: int = 20) -> DataFrame:
        return sessions.timeline(self.table("sessions"), self.table("recall_events"), self.table("outcome_signals"), limit)

    def evaluate(self, days: int = 14) -> DataFrame:
        if days < 2:
            raise ValueError("two windows need at least two days")
        args = (self.table("memories"), self.table("sessions"), self.table("recall_events"), self.table("outcome_signals"), self.as_of)
        return evaluation.report(evaluation.window(*args, 0, days // 2, self.project), evaluation.window(*args, days // 2, days, self.project))

    def export_training(self, kind: str, weight: float | None = None) -> DataFrame:
        rows = export.quality(export.examples(self.table("memories"), self.table("sessions"), self.project), weight)
        return {"sft": export.sft, "alpaca": export.alpaca, "dpo": export.dpo}[kind](rows)

    def purge(self, project: str) -> Engine:
        names = ("memories", "sessions", "documents")
        kept = transitions.purge_project({n: self.table(n) for n in names}, required("project", project))
        chunks = self.table("chunks").join(kept["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
        return self.having(**kept, chunks=chunks)
