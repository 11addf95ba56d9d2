"""Structured Streaming: watched folders, event intake, windows in event time, stateful life cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake.functions.text import skipped_path, source_type
from mnemolake.operators.transcripts import fold


def watch(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A stream of readable text files: path, time, type and content. Binary and badly coded files, and skipped paths, are left out."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    text = files.where(~skipped_path(F.col("path")) & (F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0) & F.expr("is_valid_utf8(CAST(content AS STRING))"))
    return text.select(F.col("path").alias("source_path"), F.col("modificationTime").alias("at"), source_type(F.col("path")).alias("source_type"), F.col("content").cast("string").alias("content"))


def read_folder(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """The batch form of ``watch``: (documents, rejected paths)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(~skipped_path(F.col("path")))
    good = (F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0) & F.expr("is_valid_utf8(CAST(content AS STRING))")
    docs = files.where(good).select(F.col("path").alias("source_path"), F.col("modificationTime").alias("at"), source_type(F.col("path")).alias("source_type"), F.col("content").cast("string").alias("content"))
    return docs, files.where(~good).select("path")


def ingest(stream: DataFrame, target: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every batch's documents, the newest of each path, as chunks in a folder of the batch's own: a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("source_path").agg(F.max_by(F.struct(*batch.columns), "at").alias("d")).select("d.*")
        chunk(newest.withColumn("id", F.sha2("source_path", 256))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Of the chunks of all batches, those of each document's last one."""
    last = chunks.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["document_id", "batch"], "left_semi")


def removed(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths that the listing no longer has: a file stream doesn't tell deletions."""
    return known.select("source_path").distinct().join(listed.select("source_path"), "source_path", "left_anti")


def dedup_events(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, size: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Pairs of equal key with ``right_at`` at most ``within`` after ``left_at``."""
    a, b = left.withWatermark(left_at, delay).alias("a"), right.withWatermark(right_at, delay).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.{right_at} >= a.{left_at} AND b.{right_at} <= a.{left_at} + INTERVAL {within}"))


def lifecycle(stream: DataFrame, id: str, seq: str, kind: str) -> DataFrame:
    """The state of each session after every batch, folded in order of sequence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = ("phase", "tools", "pending", "errors")
        s = dict(zip(names, state.get, strict=True)) if state.exists else {"phase": "new", "tools": 0, "pending": 0, "errors": 0}
        rows = pd.concat(list(frames))
        for k in rows.sort_values([seq, kind])[kind]:
            s = fold(s, k)
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame([{"id": key[0], **s}])

    out = "id string, phase string, tools long, pending long, errors long"
    return stream.select(F.col(id).cast("string").alias(id), seq, kind).groupBy(id).applyInPandasWithState(step, out, "phase string, tools long, pending long, errors long", "update", "NoTimeout")
