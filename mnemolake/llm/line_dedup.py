r"""Line dedup by a deletion-neighbourhood join.

Lines are compared in a plain form (lower case, white space squeezed). Equal lines
are one, whatever their length. A line whose form has at least ``LEAST_CHARS``
characters emits hashes of itself and of all its variants with one character
deleted: two lines are within one edit exactly if they have an equal variant with
the same place deleted (substitution) or one equals a variant of the other
(insertion, deletion). Equal keys are joined, the edit distance is verified, and of
lines that are alike the earliest (by doc_id, then line number) is kept: a line
goes if any earlier line equals it or is within one edit of it. Where the earlier
one itself goes, the two belong to a chain, and what stands for both is the
chain's first line, which stays.

The bound is one edit. Halves and single deletions are made for it, so it isn't a
parameter. Shorter lines aren't compared by edits: one edit changes a word of
theirs into another.

So as not to emit variants of every line, lines are first matched by halves:
one edit leaves the first or the second half of the shorter line untouched, so
lines that share neither with another line can't be within the bound of any.
This loses nothing. Where few rows of a large table will find a partner, a bit
sieve of fixed size lets through those that may, and the join that follows is
exact.

Defined cases: null texts stay null and empty ones empty; blank lines are never
removed; repeated lines within a document count too; rows that repeat a doc_id
are told apart by their text, and of rows alike in both all but one repeat every
line; a null doc_id is the earliest; a document all of whose lines go is dropped by
``dedup_lines``; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, free_name, or_empty, sieve, sift, table
from ._components import components
from ._words import U, mix

#: Lines of fewer characters are removed only where they are equal.
LEAST_CHARS = 20


def plain(line: Column) -> Column:
    low = F.lower(line)
    odd = F.trim(F.regexp_replace(low, "[ \\t\\r\\x0B\\x0C]+", " "))
    # Most lines need no replacing, and to see that is cheaper than to replace.
    return F.when(low.rlike("[\\t\\r\\x0B\\x0C]|  "), odd).otherwise(F.trim(low))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, nth, no, form) of the lines that aren't blank; ``nth`` tells rows of one doc_id apart."""
    t = or_empty(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(t).alias("nth"), F.posexplode(F.split(t, "\n", -1)).alias("no", "line"))
    return rows.select("doc", "nth", "no", plain(F.col("line")).alias("form")).where(F.col("form") != "")


def _keys(lines: DataFrame) -> DataFrame:
    """Hashes of each form: two of the whole, and of its halves if it is long enough.

    First halves by their length, second halves by theirs, of the line as the
    shorter of two and as the longer by one; equal keys once.
    """
    n, form = F.length("form"), F.col("form")
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    p1 = F.xxhash64(F.lit("p"), half, F.left(form, half))
    p2 = F.when(half != less, F.xxhash64(F.lit("p"), less, F.left(form, less)))
    s1 = F.xxhash64(F.lit("s"), n - half, F.right(form, n - half))
    s2 = F.when(n - half != n - 1 - less, F.xxhash64(F.lit("s"), n - 1 - less, F.right(form, n - 1 - less)))
    halves = [F.when(n >= LEAST_CHARS, h).alias(c) for c, h in (("p1", p1), ("p2", p2), ("s1", s1), ("s2", s2))]
    return lines.select("doc", "nth", "no", F.xxhash64(form).alias("h1"), F.xxhash64(F.lit("line"), form).alias("h2"), *halves)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, form) -> keys: place -1 and the hash of the form itself, and each place with the hash of the form without it."""
    c = 0x9E3779B97F4A7C15
    for batch in batches:
        forms = batch.column(2).to_pylist()
        size, hashes, places, rows = 0, [], [], []
        for i, form in enumerate(forms):
            x = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(U)
            n = len(x)
            power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, c, U)]))
            term = mix(x + U(1))
            # Characters before the deleted place keep their power, those after it move down by one.
            left = np.concatenate([np.zeros(1, U), np.cumsum(term * power[:n], dtype=U)])
            right = np.concatenate([np.zeros(1, U), np.cumsum(term[1:] * power[: n - 1], dtype=U)])
            less = left[:n] + (right[n - 1] - right[:n])
            hashes.append(np.concatenate([mix(left[n:] + U(n)), mix(less + U(n - 1))]))
            places.append(np.arange(-1, n, dtype=np.int64))
            rows.append(np.full(n + 1, i, np.int64))
            size += n + 1
            if size >= 200_000 or i == len(forms) - 1:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places)), batch.column(0).take(at), batch.column(1).take(at)], ["key", "place", "id", "at"])
                size, hashes, places, rows = 0, [], [], []


def near_lines(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2, near) of the distinct lines (h1, h2, at, p1, p2, s1, s2) that have an earlier line within one edit, with where the first line of their chain stands."""
    halves = F.explode(F.filter(F.array("p1", "p2", "s1", "s2"), lambda h: h.isNotNull()))
    shared = distinct.select("h1", halves.alias("half")).groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    shared = cut(shared.where(F.col("lo") != F.col("hi")).select("half"))
    parts = sift(distinct.select("h1", "h2", "at", halves.alias("half")), F.col("half"), sieve(shared, "half"))
    near = cut(parts.join(shared, "half").select("h1", "h2", "at.doc", "at.nth", "at.no").distinct())

    # Their forms, from the documents where they stand first.
    spot = F.xxhash64(F.col("doc"), F.col("nth"))
    spots = sieve(near.select(spot.alias("spot")), "spot")
    held = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(or_empty(F.col(text))).alias("nth"), F.col(text).alias("text"))
    read = _lines(sift(held, spot, spots).select("doc", "text"), "doc", "text").withColumnsRenamed({"doc": "d", "nth": "t", "no": "o"})
    close = near.join(read, F.col("doc").eqNullSafe(F.col("d")) & (F.col("nth") == F.col("t")) & (F.col("no") == F.col("o")))
    close = cut(close.select("h1", "h2", F.struct("doc", "nth", "no").alias("at"), "form").dropDuplicates(["h1", "h2"]))

    place_type = close.schema["at"].dataType.simpleString()
    keys = close.select(F.struct("h1", "h2").alias("id"), "at", "form").mapInArrow(_variants, f"key long, place long, id struct<h1:long,h2:long>, at {place_type}")
    # Lines of one key and place differ in one character, so these groups are no larger than an alphabet.
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    whole = F.min(F.when(F.col("place") == -1, F.struct("at", "id"))).over(by_key)
    shorter = F.min(F.when(F.col("place") >= 0, F.struct("at", "id"))).over(by_key)
    swap = F.min(F.struct("at", "id")).over(by_place)
    best = F.when(F.col("place") >= 0, F.least(whole, swap)).otherwise(shorter)
    keys = keys.withColumn("best", best).where(F.col("best.at") < F.col("at"))
    found = keys.select("id", "best").distinct()
    forms = close.select(F.struct("h1", "h2").alias("i"), "form")
    found = found.join(forms.withColumnsRenamed({"i": "id", "form": "mine"}), "id").join(forms.withColumnRenamed("form", "other"), F.col("best.id") == F.col("i"))
    found = found.where(F.levenshtein("mine", "other", 1) != -1)
    # Each line's earliest partner: a forest, whose roots have no earlier partner and stay.
    partner = cut(found.groupBy("id").agg(F.min(F.struct("best.at", "best.id")).alias("b")).select(F.col("id").alias("a"), F.col("b.id").alias("b"), F.col("b.at").alias("at")))
    chains = components(partner.select("a", "b"))
    root = partner.join(chains, F.col("a") == F.col("node")).groupBy("component").agg(F.min("at").alias("near"))
    out = partner.join(chains, F.col("a") == F.col("node")).join(root, "component")
    return out.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), "near")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, nth, no, kept, copy) of every line that goes, with the place of the line that stays for it; ``copy`` tells lines that go because their whole row is there before."""
    lines = cut(_keys(_lines(docs, doc_id, text)))
    distinct = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "nth", "no")).alias("at"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("p1", "p2", "s1", "s2")]))
    near = near_lines(docs, distinct, doc_id, text)
    again = distinct.where(F.col("n") > 1).select("h1", "h2", "at")
    known = cut(again.join(near, ["h1", "h2"], "full_outer"))
    rows = sift(lines.select("doc", "nth", "no", "h1", "h2"), F.col("h1"), sieve(known, "h1")).join(known, ["h1", "h2"])
    here = F.struct("doc", "nth", "no")
    rows = cut(rows.select("doc", "nth", "no", F.coalesce("near", "at").alias("kept"), (F.col("near").isNull() & (F.col("at") == here)).alias("first")))
    gone = rows.where(~F.col("first")).select("doc", "nth", "no", "kept", F.lit(False).alias("copy"))
    times = rows.where("first").groupBy("doc", "nth", "no").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where(F.col("n") > 1)
    copies = times.select("doc", "nth", "no", "kept", F.explode(F.array_repeat(F.lit(True), (F.col("n") - 1).cast("int"))).alias("copy"))
    return gone.unionByName(copies)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines, and without the documents that had nothing else."""
    key, doc, nth, gone = (free_name(docs, x) for x in ("_key", "_doc", "_nth", "_gone"))
    found = cut(repeated_lines(docs, doc_id, text))
    sets = found.where(~F.col("copy")).groupBy("doc", "nth").agg(F.collect_set("no").alias(gone)).withColumnsRenamed({"doc": doc, "nth": nth})
    d = docs.withColumn(key, F.xxhash64(or_empty(F.col(text))))
    twice = found.where("copy").select(F.col("doc").alias(doc), F.col("nth").alias(nth)).distinct()
    if not twice.isEmpty():
        # Rows alike in id and text: all but one have no line of their own.
        same = F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(nth))
        d = d.join(twice, same, "left_anti").unionByName(d.join(twice, same, "left_semi").dropDuplicates([doc_id, key]))
    d = d.join(sets, F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(nth)), "left")
    lines = F.split(F.col(text), "\n", -1)
    rest = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col(gone), i), x)), lambda x: x.isNotNull())
    kept = d.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")))
    return kept.where(F.col(gone).isNull() | (F.trim(F.col(text)) != "")).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = repeated_lines(table(spark, sf_dir, "documents"))
    return gone.select(F.col("doc").alias("doc_id"), F.col("no").cast("long").alias("line_no"), F.col("kept.doc").alias("kept_doc_id"), F.col("kept.no").cast("long").alias("kept_line_no"))


OP5_SQL = rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(s))) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
f AS (SELECT doc_id, no, trim(CASE WHEN regexp_matches(lower(line), '[\t\r\x0B\x0C]|  ') THEN regexp_replace(lower(line), '[ \t\r\x0B\x0C]+', ' ', 'g') ELSE lower(line) END, ' ') AS form FROM l),
g AS (SELECT * FROM f WHERE form <> ''),
d AS (SELECT form, min((doc_id, no)) AS pos FROM g GROUP BY form),
e AS (SELECT * FROM d WHERE length(form) >= {LEAST_CHARS}),
v AS (SELECT form, pos, i, hash(substr(form, 1, i - 1) || substr(form, i + 1)) AS h FROM (SELECT form, pos, unnest(range(1, length(form) + 1)) AS i FROM e)),
w AS (SELECT form, pos, hash(form) AS h FROM e),
c AS (SELECT v.form, s.pos FROM v JOIN (SELECT i, h, min(pos) AS pos FROM v GROUP BY i, h) s ON s.i = v.i AND s.h = v.h
  UNION ALL SELECT v.form, w.pos FROM v JOIN w ON w.h = v.h
  UNION ALL SELECT w.form, v.pos FROM w JOIN v ON w.h = v.h),
n AS (SELECT e.form, any_value(e.pos) AS pos, min(c.pos) AS near FROM e JOIN c ON c.form = e.form WHERE c.pos < e.pos GROUP BY e.form),
up AS (SELECT form, near AS root FROM n UNION ALL SELECT up.form, n.near FROM up JOIN n ON n.pos = up.root),
roots AS (SELECT form, min(root) AS root FROM up GROUP BY form),
r AS (SELECT g.doc_id, g.no, coalesce(roots.root, CASE WHEN d.pos <> (g.doc_id, g.no) THEN d.pos END) AS kept FROM g JOIN d ON d.form = g.form LEFT JOIN roots ON roots.form = g.form)
SELECT doc_id, no AS line_no, kept[1] AS kept_doc_id, kept[2] AS kept_line_no FROM r WHERE kept IS NOT NULL
"""
