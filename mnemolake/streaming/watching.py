"""A watched folder, deletions included.

A file stream tells new and changed files, never deleted ones. So a batch of
ticks, not of files, starts a step: the folder is listed (no content is read), the
listing is compared with the last manifest, files that are new or differ in time
or length are read and hashed, and those whose content differs are chunked. Many
changes of a file between two steps are one, which is what a debounce window does.

Each step writes folders of its own number: the chunks of new content, tombstones
of paths whose older chunks go, and the new manifest, last. A step that is run again
overwrites its folders from the manifest before it, so a replayed batch gives the
same. ``present`` reads what is left of all steps. Spark doesn't list files without
a byte, so a file that is emptied counts as deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake.functions.text import skipped_path, source_type
from mnemolake.sources.snapshot import exists

_MANIFEST = "source_path string, modified timestamp, length long, hash string, action string, batch long"


def listing(spark: SparkSession, folder: str, name: Callable[[Column], Column] = lambda p: p, recursive: bool = True) -> DataFrame:
    """(source_path, file, modified, length) of the files that aren't skipped; ``name`` makes the path that stays the same from a file's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(~skipped_path(F.col("path")))
    return files.select(name(F.col("path")).alias("source_path"), F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")


def contents(spark: SparkSession, folder: str, wanted: DataFrame, recursive: bool = True) -> DataFrame:
    """(source_path, content) of the listed files ``wanted``; null where it isn't text. Files older than all of them aren't opened."""
    since = wanted.agg(F.min("modified")).first()[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if since is not None:
        files = files.where(F.col("modificationTime") >= F.lit(since))
    good = (F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0) & F.expr("is_valid_utf8(CAST(content AS STRING))")
    return files.join(wanted.select("source_path", F.col("file").alias("path")), "path").select("source_path", F.when(good, F.col("content").cast("string")).alias("content"))


def compare(known: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` with what has become of each path: created, changed (its time or length differs), same, or deleted."""
    k = known.select(F.col("source_path"), F.col("modified").alias("_modified"), F.col("length").alias("_length"), F.col("hash").alias("_hash"))
    x = k.join(now, "source_path", "full")
    same = (F.col("modified") == F.col("_modified")) & (F.col("length") == F.col("_length"))
    action = F.when(F.col("file").isNull(), "deleted").when(F.col("_hash").isNull(), "created").when(same, "same").otherwise("changed")
    return x.withColumn("action", action)


def manifest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The newest manifest, of a step before the given one; empty if there is none."""
    none = spark.createDataFrame([], _MANIFEST)
    if not exists(spark, f"{target}/manifest"):
        return none
    all_ = spark.read.schema(_MANIFEST).option("basePath", f"{target}/manifest").parquet(f"{target}/manifest/batch=*")
    all_ = all_ if before is None else all_.where(F.col("batch") < before)
    last = all_.agg(F.max("batch")).first()[0]
    return none if last is None else all_.where(F.col("batch") == last)


def step(spark: SparkSession, folder: str, target: str, number: int, chunk: Callable[[DataFrame], DataFrame], name: Callable[[Column], Column] = lambda p: p, recursive: bool = True) -> None:
    """Brings ``target`` up to the folder's present state. ``chunk`` takes (id, source_path, source_type, content) and gives chunks with ``document_id``."""
    at = lambda kind: f"{target}/{kind}/batch={number}"
    seen = compare(manifest(spark, target, number).where(F.col("action") != "deleted"), listing(spark, folder, name, recursive))
    fresh = seen.where(F.col("action").isin("created", "changed"))
    text = contents(spark, folder, fresh, recursive).withColumn("_new", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256))
    # The texts are read once, into the step's own folder.
    text.write.mode("overwrite").parquet(at("texts"))
    text = spark.read.parquet(at("texts"))
    rows = seen.join(text.select("source_path", "_new"), "source_path", "left")
    action = F.when(F.col("action").isin("same", "changed") & (F.coalesce("_new", "_hash") == F.col("_hash")), "same").otherwise(F.col("action"))
    rows = rows.select("source_path", "modified", "length", F.coalesce("_new", "_hash").alias("hash"), action.alias("action"))
    rows.write.mode("overwrite").parquet(at("rows"))
    rows = spark.read.parquet(at("rows"))
    differ = rows.where(F.col("action").isin("created", "changed"))
    docs = text.where(F.col("content").isNotNull()).join(differ.select("source_path"), "source_path", "left_semi")
    docs = docs.select(F.sha2("source_path", 256).alias("id"), "source_path", source_type(F.col("source_path")).alias("source_type"), "content")
    chunk(docs).write.mode("overwrite").parquet(at("chunks"))
    rows.where(F.col("action").isin("changed", "deleted")).select(F.sha2("source_path", 256).alias("document_id")).write.mode("overwrite").parquet(at("gone"))
    rows.write.mode("overwrite").parquet(at("manifest"))


def watch(ticks: DataFrame, folder: str, target: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], name: Callable[[Column], Column] = lambda p: p, every: str | None = None) -> StreamingQuery:
    """A step a batch of ``ticks``, any stream that says when to look; ``every`` is the time between batches, else what there is now is done and the query ends."""
    spark = ticks.sparkSession
    out = ticks.writeStream.foreachBatch(lambda _, number: step(spark, folder, target, number, chunk, name)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def present(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of all steps but those that a later step has taken back."""
    read = lambda kind: spark.read.option("basePath", f"{target}/{kind}").parquet(f"{target}/{kind}/batch=*")
    last = read("gone").groupBy("document_id").agg(F.max("batch").alias("_gone"))
    held = read("chunks").join(last, "document_id", "left")
    return held.where(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone"))).drop("_gone")


def import_memory_folder(files: DataFrame, known: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Memories of a memory folder's files (path, content) whose hash isn't known yet; MEMORY.md, other suffixes and deletions are passed over."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    good = files.where(name.endswith(".md") & (name != "MEMORY.md"))
    return parse(good).dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")


def watch_memories(stream: DataFrame, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A stream of files (path, content) into ``target``, a folder a batch. Its batches and a bootstrap, which wrote ``batch=-1``, share the hashes of all folders, so what one has imported the other passes over."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        known = spark.read.option("basePath", target).parquet(f"{target}/batch=*").where(F.col("batch") < number) if exists(spark, target) else spark.createDataFrame([], "hash string")
        import_memory_folder(batch, known, parse).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
