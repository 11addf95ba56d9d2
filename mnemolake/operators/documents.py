"""Documents, chunks, artifacts, project links and command output: lookups, pages and inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import output_chunks, output_type
from .memory import active, at, in_project

PAGE = 20


def by_path(documents: DataFrame, path: str, project: str | None = None) -> DataFrame:
    return documents.where((F.col("source_path") == path) & in_project(project))


def listed(documents: DataFrame, project: str | None = None) -> DataFrame:
    return documents.where(in_project(project)).orderBy(F.desc("created_at"), "id")


def chunks_of(chunks: DataFrame, document: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document).orderBy("chunk_index")


def chunk_page(chunks: DataFrame, document: str, offset: int, limit: int) -> DataFrame:
    """A page with the total and whether more follow."""
    limit = min(limit, PAGE)
    w = Window.partitionBy("document_id")
    c = chunks.where(F.col("document_id") == document).withColumn("n", F.row_number().over(w.orderBy("chunk_index")) - 1).withColumn("total", F.count("*").over(w))
    return c.where((F.col("n") >= offset) & (F.col("n") < offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def counts(documents: DataFrame, chunks: DataFrame, project: str | None = None) -> DataFrame:
    d = documents.where(in_project(project))
    c = chunks.join(d.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return d.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(c.agg(F.count("*").alias("chunks"))))  # one row


def artifacts(table: DataFrame, kind: str, project: str | None = None) -> DataFrame:
    return table.where((F.col("artifact_type") == kind) & in_project(project)).orderBy(F.desc("created_at"), "artifact_id")


def latest_artifact(table: DataFrame, kind: str, project: str | None = None) -> DataFrame:
    return artifacts(table, kind, project).limit(1)


def add_artifact(table: DataFrame, id: str, kind: str, payload: str, as_of: str, project: str | None = None) -> DataFrame:
    """``payload`` has to be JSON."""
    new = table.sparkSession.range(1).select(F.lit(id).alias("artifact_id"), F.lit(kind).alias("artifact_type"), F.lit(project).cast("string").alias("project"), F.to_json(F.parse_json(F.lit(payload))).alias("payload"), at(as_of).alias("created_at"), F.lit("1.0").alias("schema_version"))
    return table.unionByName(new, allowMissingColumns=True)


def linked(links: DataFrame, project: str) -> DataFrame:
    return links.where(F.col("source_project") == project).select("target_project").orderBy("target_project")


def shared_with(memories: DataFrame, links: DataFrame, project: str) -> DataFrame:
    """Active memories of a project and of those linked with it."""
    names = linked(links, project).select(F.col("target_project").alias("project")).unionByName(links.sparkSession.createDataFrame([(project,)], "project string"))
    return memories.where(active()).join(names.distinct(), "project", "left_semi")


def command_output(spark, command: str, output: str, as_of: str, ttl_hours: int = 4, project: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One command's output as a document, its chunks, and a short-lived summary memory."""
    ttl = max(1, min(168, ttl_hours))
    doc = spark.createDataFrame([(f"cmd://{command}", output)], "source_path string, content string").withColumn("id", F.sha2("source_path", 256)).withColumn("project", F.lit(project).cast("string"))
    chunks = output_chunks(doc)
    until = at(as_of) + F.make_dt_interval(F.lit(0), F.lit(ttl))
    memory = chunks.agg(F.count("*").alias("n")).select(F.sha2(F.lit(f"cmd://{command}"), 256).alias("id"), F.lit("command-output").alias("topic"), F.concat(F.lit(f"{command}: "), output_type(F.lit(output)), F.lit(", "), F.col("n").cast("string"), F.lit(" chunks")).alias("summary"), F.lit("ephemeral").alias("importance"), F.lit(0.5).alias("weight"), at(as_of).alias("created_at"), until.alias("expires_at"), F.lit(project).cast("string").alias("project"))
    return doc.drop("content").withColumn("created_at", at(as_of)), chunks, memory


def onboard(memories: DataFrame, documents: DataFrame, project: str | None = None) -> DataFrame:
    m = memories.where(active() & in_project(project)).agg(F.count("*").alias("memories"), F.countDistinct("topic").alias("topics"))
    return m.crossJoin(F.broadcast(documents.where(in_project(project)).agg(F.count("*").alias("documents"))))  # one row


def global_recall(hits: DataFrame) -> DataFrame:
    """Hits (id, project, score) of all projects by project, best first."""
    return hits.groupBy(F.coalesce("project", F.lit("(none)")).alias("project")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: x["id"]).alias("ids"))
