"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemolake.sources.adapters import view, with_views
from mnemolake.sources.snapshot import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


    def stored(self, name: str, write: Callable[[str], None]) -> str:
        """The folder of something derived from the tables, written once a session: what a store keeps beside its rows."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            at = f"{shared_folder(self.spark)}/derived-{hashlib.sha256('|'.join(key).encode()).hexdigest()[:16]}"
            write(at)
            _STORED[key] = at
        return _STORED[key]


_STORED: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(tables)`` as a query; ``sql`` may name views of the adapters."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add
