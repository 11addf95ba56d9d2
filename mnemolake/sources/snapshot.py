"""Snapshots: table folders with a manifest, a pointer to the current one, backups and checkpoints."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on one machine only, a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="mnemolake-")
    return _LOCAL[key]


_LOCAL: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Continue from files in the session's reliable checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system that Spark reads ``path`` from has it."""
    p, files = _path(spark, path)
    return files.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.delete(p, True)


_MANIFEST = "table string, rows long, checksum string, path string"


def _manifest(spark: SparkSession, root: str, rows: list[tuple[str, int, str, str]], name: str) -> None:
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/_manifests/{name}")


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row hashes that doesn't depend on order."""
    n, h = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(h)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], name: str | None = None) -> str:
    """Writes a new snapshot, its manifest last, and returns its name. Readers take the newest manifest, so a broken write is never seen.

    Files are addressed by what they hold: a table that is as in the newest snapshot
    isn't kept again, the manifest names the files that are there.
    """
    name = name or f"{uuid.uuid1().time:020d}"
    old = {} if not exists(spark, f"{root}/_manifests") else {(r["table"], r["rows"], r["checksum"]): r["path"] for r in _rows(spark, root, current(spark, root))}
    rows = []
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{t}")
        held = (t, *checksum(spark.read.parquet(f"{root}/{name}/{t}")))
        if old.get(held, f"{name}/{t}") != f"{name}/{t}":
            delete(spark, f"{root}/{name}/{t}")
        rows.append((*held, old.get(held, f"{name}/{t}")))
    _manifest(spark, root, rows, name)
    return name


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, table, rows, checksum, path) of all finished snapshots."""
    m = spark.read.schema(_MANIFEST).json(f"{root}/_manifests/*")
    return m.select(F.regexp_extract(F.input_file_name(), r"/_manifests/([^/]+)/", 1).alias("snapshot"), "table", "rows", "checksum", "path")


def _rows(spark: SparkSession, root: str, name: str) -> list:
    rows = snapshots(spark, root).where(F.col("snapshot") == name).collect()  # a row a table
    if not rows:
        raise ValueError(f"no snapshot {name}")
    return rows


def current(spark: SparkSession, root: str) -> str:
    return snapshots(spark, root).agg(F.max("snapshot")).first()[0]


def load(spark: SparkSession, root: str, table: str, name: str | None = None) -> DataFrame:
    """A table as it was in a snapshot, the newest if none is given."""
    path = next(r["path"] for r in _rows(spark, root, name or current(spark, root)) if r["table"] == table)
    return spark.read.parquet(f"{root}/{path}")


def verify(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The snapshot's tables, if all are what the manifest says."""
    tables = {}
    for r in _rows(spark, root, name):
        tables[r["table"]] = df = spark.read.parquet(f"{root}/{r['path']}")
        if checksum(df) != (r["rows"], r["checksum"]):
            raise ValueError(f"{r['table']} of {name} isn't what its manifest says")
    return tables


def restore(spark: SparkSession, root: str, name: str) -> str:
    """Makes an older snapshot the current one, after checking it against its manifest."""
    return commit(spark, root, verify(spark, root, name))


def diff(spark: SparkSession, root: str, table: str, before: str, after: str, key: str = "id") -> DataFrame:
    """(key, action): rows of a table that are added, removed or changed between two snapshots. Files that both share aren't read."""
    paths = [next((r["path"] for r in _rows(spark, root, n) if r["table"] == table), None) for n in (before, after)]
    hashed = lambda n: (lambda df: df.select(F.col(key), F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")))(load(spark, root, table, n))
    if paths[0] == paths[1]:
        return hashed(before).limit(0).select(key, F.lit("changed").alias("action"))
    a, b = hashed(before).withColumnRenamed("h", "_a"), hashed(after).withColumnRenamed("h", "_b")
    action = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, action.alias("action")).where(F.col("action").isNotNull())


def export_archive(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, record): every row of the tables as JSON, for one text file or many."""
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def export_memories(memories: DataFrame, topic: str | None = None, since: str | None = None, until: str | None = None, weight: float | None = None) -> DataFrame:
    """The archive of memories under a topic, made in a span of time (its end included), of a weight at least."""
    keep = F.lit(True)
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    if topic is not None:
        keep &= F.col("topic") == topic
    if since is not None:
        keep &= F.col("created_at") >= time(since)
    if until is not None:
        keep &= F.col("created_at") <= time(until)
    if weight is not None:
        keep &= F.col("weight") >= weight
    return export_archive({"memory": memories.where(keep)})


def import_archive(archive: DataFrame, kind: str, schema) -> tuple[DataFrame, DataFrame]:
    """Rows of a kind, and the records that can't be read as such."""
    rows = archive.where(F.col("kind") == kind).withColumn("r", F.from_json("record", schema, {"mode": "PERMISSIVE"}))
    key = schema.fieldNames()[0]
    return rows.where(F.col(f"r.{key}").isNotNull()).select("r.*"), rows.where(F.col(f"r.{key}").isNull()).select("record")


def versioned(df: DataFrame, version: str = "1.0") -> DataFrame:
    return df.withColumn("schema_version", F.lit(version))


def pretty(manifest: DataFrame) -> str:
    return json.dumps([r.asDict() for r in manifest.orderBy("snapshot", "table").limit(1000).collect()])
