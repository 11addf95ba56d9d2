"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns a DataFrame that is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents;
the last returns the documents that the mix takes words of, with how many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm._common import shared_folder, table
from mnemolake.llm.decontaminate import drop_leaks
from mnemolake.llm.line_dedup import dedup_lines
from mnemolake.llm.mixing import mix
from mnemolake.llm.near_dedup import keep_one
from mnemolake.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; ``n_chars`` follows the text."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes words of."""
    return mix(docs).where(F.col("taken") > 0)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mixture)]

#: The classifier is learnt and the sketches are hashed, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of whatever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage before it is written to the shared folder, and goes once the next one is written."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            _delete(spark, f"{at}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
