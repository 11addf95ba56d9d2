"""Helpers that several operators share: tables, checkpoints, strings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a sieve, 64 bits each; 16 bytes a row, so 2 MB to each executor at most.
SIEVE_WORDS = 1 << 17
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine may it be unset (tests); a temporary folder takes its
    place there. A cluster without it is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="mnemolake-")
    return _LOCAL[key]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what ``cut`` does, for rows whose columns compress well."""
    at = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs within sends Python batches of about ``size``, not of 64 MB: the JVM and both ends of the pipe hold each once at least."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SPOT = f"pmod(k, {SIEVE_WORDS})"
_BIT = f"shiftleft(1L, CAST(pmod(shiftright(k, {SIEVE_WORDS.bit_length() - 1}), 64) AS INT))"


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits) of 64-bit hashes: at most ``SIEVE_WORDS`` rows, whatever the number of keys."""
    k = keys.select(F.col(key).alias("k"))
    return k.groupBy(F.expr(_SPOT).alias("_word")).agg(F.bit_or(F.expr(_BIT)).alias("_bits"))


def sift(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows whose key may be in the sieve: all that are, and a few others."""
    x = rows.withColumn("k", key)
    x = x.withColumn("_w", F.expr(_SPOT)).withColumn("_b", F.expr(_BIT))
    x = x.join(F.broadcast(bits), F.col("_w") == F.col("_word")).where(F.col("_b").bitwiseAND(F.col("_bits")) != 0)
    return x.select(*rows.columns)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """The sum of each number of an array and those before it.

    Sums go over blocks of about the root of the array's length and then within a
    block, so a long array takes no more than its length times that root.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def sums(a: Column) -> Column:
        step = F.greatest(F.lit(1), F.sqrt(F.size(a)).cast("int"))
        return let(step, lambda n: let(F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / n).cast("int")), lambda b: total(F.slice(a, F.lit(1), b * n))), lambda base: F.transform(a, lambda _, i: F.get(base, F.floor(i / n).cast("int")) + total(F.slice(a, F.floor(i / n).cast("int") * n + 1, i % n + 1)))))

    return let(numbers, sums)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
