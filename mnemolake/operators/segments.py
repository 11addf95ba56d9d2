"""A full-text index that lives through changes.

The index is a list of segments, oldest first. A segment holds the postings of
the rows that it adds, the ids that it takes out of earlier segments (tombstones),
and what that does to the totals, so a change costs as much as the rows it touches.
A search reads the postings of its tokens in all segments, leaves out those whose
id a later segment has taken out, and scores with the merged totals, as an index
written anew from the present rows would.

``apply`` gives a new index whose last segment is a plan over the rows given;
``flush`` writes such segments, and then a new version of the list. Readers take the
newest version, so a broken write is never seen. ``tidy`` merges segments of like
size, which keeps their number logarithmic; tombstones go when nothing is left
before them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.text import tokenize
from mnemolake.sources.snapshot import delete, exists

from .search import TextIndex, postings, write_postings

_LIST = "segment long, n long, total long, size long, gone long, tag string"


@dataclass(frozen=True)
class Segment:
    """What a change adds and takes out. ``n`` and ``total`` are changes of the number of rows and of their tokens; ``size`` and ``gone`` count rows added and ids taken out."""

    number: int
    n: int
    total: int
    size: int
    gone: int


@dataclass(frozen=True)
class SegmentedIndex:
    """The segments of ``folder`` in one version, and changes that aren't written yet, each (rows added, rows before) with id and text."""

    spark: SparkSession
    folder: str
    text: Column
    segments: tuple[Segment, ...] = ()
    changes: tuple[tuple[DataFrame | None, DataFrame | None], ...] = ()
    version: int = 0

    @classmethod
    def create(cls, rows: DataFrame, text: Column, folder: str, tag: str = "") -> SegmentedIndex:
        """An index of rows with an ``id``, in one segment."""
        return cls(rows.sparkSession, folder, text).apply(None, rows).flush(tag)

    @classmethod
    def open(cls, spark: SparkSession, text: Column, folder: str, tag: str | None = None) -> SegmentedIndex | None:
        """The newest version, or the newest with this tag; None if there is none."""
        if not exists(spark, f"{folder}/list"):
            return None
        known = spark.read.schema(_LIST + ", version long").option("basePath", f"{folder}/list").json(f"{folder}/list/version=*")
        known = known if tag is None else known.where(F.col("tag") == tag)
        rows = known.where(F.col("version") == known.agg(F.max("version")).first()[0]).orderBy("segment").collect()  # a row a segment
        if not rows:
            return None
        return cls(spark, folder, text, tuple(Segment(r["segment"], r["n"], r["total"], r["size"], r["gone"]) for r in rows), (), rows[0]["version"])

    def apply(self, before: DataFrame | None, after: DataFrame | None) -> SegmentedIndex:
        """The index once the rows ``after`` stand for the rows ``before``. Rows whose text stays may be left out of both."""
        return replace(self, changes=(*self.changes, (after, before)))

    def _read(self, kind: str, segments: tuple[Segment, ...]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/segment={s.number}" for s in segments])

    def _postings(self, segments: tuple[Segment, ...]) -> DataFrame | None:
        """Postings of written segments that no later one of them takes out."""
        held = tuple(s for s in segments if s.size)
        if not held:
            return None
        p = self._read("postings", held)
        late = tuple(s for s in segments[1:] if s.gone)
        return _without(p, self._read("gone", late)) if late else p

    def _parts(self) -> tuple[DataFrame, DataFrame | None]:
        """(postings with the number of their segment, tombstones) of written segments and of changes."""
        first = 1 + max((s.number for s in self.segments), default=0)
        held = tuple(s for s in self.segments if s.size)
        live = [self._read("postings", held).select("token", "id", "dl", "places", "segment", "bucket")] if held else []
        late = tuple(s for s in self.segments[1:] if s.gone)
        gone = [self._read("gone", late).select("id", "segment")] if late else []
        for k, (after, before) in enumerate(self.changes):
            if after is not None:
                live.append(postings(after, "id", self.text).withColumn("segment", F.lit(first + k)))
            if before is not None:
                gone.append(before.select("id", F.lit(first + k).alias("segment")))
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        if not live:
            live = [self.spark.createDataFrame([], "token string, id string, dl int, places array<int>, segment int, bucket int")]
        return union(live), union(gone) if gone else None

    def live(self) -> TextIndex:
        """The present postings and totals."""
        p, gone = self._parts()
        rows = self.spark.createDataFrame([(sum(s.n for s in self.segments), sum(s.total for s in self.segments))], "n long, total long")
        for after, before in self.changes:
            for df, sign in ((after, 1), (before, -1)):
                if df is not None:
                    rows = rows.unionByName(_totals(df, self.text, sign))
        totals = rows.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("n", F.try_divide("total", "n").alias("avg"))
        return TextIndex((p if gone is None else _without(p, gone)).drop("segment"), totals)

    def hits(self, phrases: list[list[str]], any_of: bool = False) -> DataFrame:
        return self.live().hits(phrases, any_of)

    def flush(self, tag: str = "") -> SegmentedIndex:
        """Writes each change as a segment, then the list with them."""
        segments = list(self.segments)
        for after, before in self.changes:
            k = 1 + max((s.number for s in segments), default=0)
            size = total = gone = less = 0
            if after is not None:
                size, total = _totals(after, self.text).first()
                write_postings(postings(after, "id", self.text), f"{self.folder}/postings/segment={k}")
            if before is not None:
                gone, less = _totals(before, self.text).first()
                before.select("id").write.mode("overwrite").parquet(f"{self.folder}/gone/segment={k}")
            segments.append(Segment(k, size - gone, (total or 0) - (less or 0), size, gone))
        return self._listed(tuple(segments), tag)

    def _listed(self, segments: tuple[Segment, ...], tag: str) -> SegmentedIndex:
        rows = [(s.number, s.n, s.total, s.size, s.gone, tag) for s in segments]
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/list/version={self.version + 1}")
        return replace(self, segments=segments, changes=(), version=self.version + 1)

    def compact(self, keep: int = 0, tag: str = "") -> SegmentedIndex:
        """One segment in place of all but the first ``keep``, all changes written before."""
        if self.changes:
            raise ValueError("flush changes first")
        head, tail = self.segments[:keep], self.segments[keep:]
        k = 1 + max((s.number for s in self.segments), default=0)
        live = self._postings(tail)
        size = 0
        if live is not None:
            write_postings(live.drop("segment"), f"{self.folder}/postings/segment={k}")
            size = sum(s.n for s in tail) if not head else sum(s.size for s in tail)
        gone = 0
        if head and any(s.gone for s in tail):
            ids = self._read("gone", tuple(s for s in tail if s.gone)).select("id").distinct()
            ids.write.mode("overwrite").parquet(f"{self.folder}/gone/segment={k}")
            gone = sum(s.gone for s in tail)
        return self._listed((*head, Segment(k, sum(s.n for s in tail), sum(s.total for s in tail), size, gone)), tag)

    def tidy(self, tag: str = "") -> SegmentedIndex:
        """Merges the last segments as long as the one before is no more than twice as large as they are together."""
        keep, weight = len(self.segments), 0
        while keep and (keep == len(self.segments) or self.segments[keep - 1].size + self.segments[keep - 1].gone <= 2 * weight):
            keep -= 1
            weight += self.segments[keep].size + self.segments[keep].gone
        return self if keep >= len(self.segments) - 1 else self.compact(keep, tag)

    def vacuum(self) -> None:
        """Deletes older versions of the list and the segments that only they name."""
        for v in range(1, self.version):
            delete(self.spark, f"{self.folder}/list/version={v}")
        held = {s.number for s in self.segments}
        for k in range(1, max(held, default=0)):
            if k not in held:
                for kind in ("postings", "gone"):
                    delete(self.spark, f"{self.folder}/{kind}/segment={k}")


def _without(p: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings that no tombstone of a later segment names."""
    g = gone.select(F.col("id").alias("_id"), F.col("segment").alias("_at"))
    return p.join(g, (F.col("id") == F.col("_id")) & (F.col("_at") > F.col("segment")), "left_anti")


def _totals(rows: DataFrame, text: Column, sign: int = 1) -> DataFrame:
    return rows.select(F.size(tokenize(text)).alias("dl")).agg((sign * F.count("*")).alias("n"), F.coalesce(sign * F.sum("dl"), F.lit(0)).alias("total"))
