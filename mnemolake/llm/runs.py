"""Periodic runs of words, after Ellert and Fischer (2021).

A run is a stretch of consecutive words of smallest period q that is at least
twice as long as q and that no neighbouring word extends. Words are ranked, so the
text is a string over an ordered alphabet. For one order and for its reverse, every
suffix gets its next smaller suffix; the words between the two are the longest
Lyndon word that starts there (the Lyndon array). Each run has a root among these
words in one of the two orders, so runs follow from how far a root's period goes on
to the right, which the array's comparisons have found, and to the left.

Comparisons reuse what has been matched before, in two ways: from one candidate of
a suffix to the next by their known common parts, and within the furthest match so
far from the suffix that it mirrors. Words are compared one by one beyond that match
only. No suffix array, suffix tree or fingerprint is made.

Stretches that can hold a run of ``LEAST`` words are told first: every word of such
a run belongs to four words that stand in the text more than once. They are
named exactly, by sorting. All other words end a stretch, and no run crosses them.

Defined cases: a null, empty or blank text has no runs and an empty collapsed text;
rows that repeat an id are worked on each; texts may be of any length; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, let, or_empty, table
from ._words import slices, utf8

#: The least length of a run that is told.
LEAST = 12
#: Words that must stand together elsewhere. With GRAM words, a run of LEAST words and a period q under GRAM needs 2 q + GRAM - 1 <= LEAST.
GRAM = 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def next_smaller(w: list[int]) -> tuple[list[int], list[int]]:
    """Each suffix's next smaller suffix (or the end), and the number of words that both begin with."""
    n = len(w)
    nss, after = [n] * n, [0] * n  # the next smaller suffix, and the common part with it
    pss, before = [-1] * n, [0] * n  # the last smaller suffix, and the common part with it
    far = right = shift = 0  # w[right:far] equals the words ``shift`` earlier; no match has gone further
    for i in range(1, n):
        j, m, exact = i - 1, 0, False
        while True:
            if not exact:
                if right < i < far and j >= right:  # the same two suffixes, mirrored
                    a, b = j - shift, i - shift
                    v = after[a] if nss[a] == b else before[b] if pss[b] == a else -1
                    if v >= far - i:
                        m = max(m, far - i)
                    elif v >= 0:
                        m, exact = v, True
                if not exact:
                    while i + m < n and w[j + m] == w[i + m]:
                        m += 1
                    if i + m > far:
                        far, right, shift = i + m, i, i - j
            if i + m < n and w[j + m] < w[i + m]:
                pss[i], before[i] = j, m
                break
            nss[j], after[j] = i, m
            k = pss[j]
            if k < 0:
                break
            if before[j] < m:
                pss[i], before[i] = k, before[j]
                break
            exact = before[j] > m  # else both go on alike for m words at least
            j = k
    return nss, after


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start and period."""
    found = {}
    for order in (w, [-x for x in w]):
        nss, after = next_smaller(order)
        for i, j in enumerate(nss):
            more = after[i]
            p = j - i
            if not more or 2 * p - 1 + more < least:
                continue
            back = 0
            while back < p and back < i and w[i - 1 - back] == w[j - 1 - back]:
                back += 1
            length = back + p + more
            if back < p and back + more >= p and length >= least:  # else it is no run, or an earlier root tells it
                found[i - back, length] = p
    return sorted((s, n, p) for (s, n), p in found.items())


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct value, and whether it occurs more than once."""
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def stretches(word: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of words, each within a document, that hold all runs of ``least`` words."""
    n = len(word)
    if n < least:
        return []
    name, again = _names(doc * (int(word.max()) + 1) + word)
    at = np.arange(n)
    for step in (1, 2):  # names of two words, then of four
        here = at[: n - step]
        here = here[again[here] & again[here + step] & (doc[here] == doc[here + step])]
        pair, twice = _names(name[here] * (n + 1) + name[here + step])
        name, again = np.full(n, -1), np.zeros(n, bool)
        name[here], again[here] = pair, twice
    cover = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(again)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + GRAM, -1)
    held = np.cumsum(cover[:n]) > 0
    first = held & np.concatenate([[True], ~held[:-1] | (doc[1:] != doc[:-1])])
    last = held & np.concatenate([~held[1:] | (doc[1:] != doc[:-1]), [True]])
    return [(int(a), int(b) + 1) for a, b in zip(np.flatnonzero(first), np.flatnonzero(last), strict=True) if b + 1 - a >= least]


def _runs_and_rest(texts: list[bytes], least: int) -> tuple[list[list], list[str]]:
    """The runs of each text, and its words without what runs repeat."""
    split = [t.split() for t in texts]
    begin = np.cumsum([0, *map(len, split)])
    flat = pa.array([w for ws in split for w in ws], pa.large_binary()).dictionary_encode()
    rank = np.empty(len(flat.dictionary), np.int64)
    rank[pc.sort_indices(flat.dictionary).to_numpy()] = np.arange(len(rank))
    word = rank[flat.indices.to_numpy()] if len(rank) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    runs = [[] for _ in texts]
    for a, b in stretches(word, doc, least):
        d = int(doc[a])
        off = a - int(begin[d])
        runs[d] += [(s + off, n, p) for s, n, p in runs_of(word[a:b].tolist(), least)]
    rest = []
    for ws, found in zip(split, runs, strict=True):
        if found:
            gone = np.zeros(len(ws) + 1, np.int64)
            for s, n, p in found:
                gone[s + p] += 1
                gone[s + n] -= 1
            ws = [w for w, g in zip(ws, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
        rest.append(b" ".join(ws).decode())
    return runs, rest


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: its runs by start and period, and its words without those that a run repeats after its first period.

    ``least`` is the least length of a run, 9 words or more.
    """
    if least < 2 * (GRAM - 1) + GRAM - 1:
        raise ValueError(f"least: {3 * GRAM - 3} words or more")
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in slices(at):
                runs, rest = _runs_and_rest([data[at[d] : at[d + 1]].tobytes() for d in range(a, b)], least)
                fields = [pa.array([r[k] for found in runs for r in found], pa.int64()) for k in range(3)]
                each = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, each), pa.array(rest, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"doc_id {kind}, runs {RUNS}, collapsed string")


def repeat_tail(text: Column, h: Column) -> Column:
    """The text whose words from a number that ``h`` gives on go round in a period that ``h`` gives, for a tenth of all ``h``; the others as they are."""
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")

    def turned(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words, turned)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeat_tail(or_empty(F.col("text")), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = find_runs(docs).withColumn("top", top)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(-1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Every distance at which words are equal, and the islands of words that go on at it.
OP12_SQL = r"""
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT + 1, 1))::UBIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM a),
x AS (
  SELECT r, i, CASE WHEN a IS NOT NULL AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT s.r, s.i, t.i - s.i AS q FROM x s JOIN x t ON s.r = t.r AND s.x = t.x AND t.i > s.i),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m),
e AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM k GROUP BY r, q, k HAVING count(*) >= q AND count(*) + q >= 12),
u AS (SELECT r, s, l, min(q) AS q FROM e GROUP BY r, s, l),
t AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
    arg_max({'s': s, 'l': l, 'q': q}, l * 10000000000000000::HUGEINT - s * 100000000::HUGEINT - q) AS top FROM u GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = x.r AND x.i >= u.s + u.q AND x.i < u.s + u.l) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM p LEFT JOIN t USING (r) LEFT JOIN kept USING (r)
"""
