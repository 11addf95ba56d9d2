r"""Mixing sources to target weights by Sainte-Lague apportionment.

All words of the corpus are the seats' supply. Every source's documents, in
seeded order, form a stream of words that is cut into blocks of equal length.
Seats, one a block's worth of words, go to the sources by highest quotients
``target / (2 k + 1)``, which gives each source an integer quota of blocks. A
quota of q over n blocks takes every block ``q div n`` times, and the
``q mod n`` blocks that come first in seeded order once more.

A source whose target is under ``LEAST_TARGET`` of these blocks would miss it by
much, or win no seat at all. It is given blocks of its own, ``OWN_BLOCKS`` to its
target or one a word, and the seats are dealt to the others without it.

Running positions within a source are sums over hash ranges first and within a
range second, so that a source with a third of all rows is spread over many
tasks; the hash covers id and text, so rows that repeat an id are spread too.

Defined cases: a null text has size 0; documents of size 0 take 0; a null source
is a source, last in order; sources of size 0 have target 0; rows that repeat a
doc_id are each a document; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPACE, WORD, cut, or_empty, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Blocks in all: this many, or SEATS_PER_SOURCE for each source if that is more.
SEATS = 10_000
SEATS_PER_SOURCE = 200
#: Sources whose target is under so many blocks get blocks of their own, this many to the target.
LEAST_TARGET = 50
OWN_BLOCKS = 200
#: Documents that a hash range holds on average.
RANGE_ROWS = 2_000
#: Sources up to this many (about 60 bytes each) are sent to all executors; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` runs: splits at white space, less the empty pieces at the ends."""
    t = or_empty(text)
    edge = F.regexp_like(F.left(t, F.lit(1)), F.lit(SPACE)).cast("int") + F.regexp_like(F.right(t, F.lit(1)), F.lit(SPACE)).cast("int")
    return F.when(F.regexp_like(t, F.lit(WORD)), F.size(F.split(t, SPACE + "+", -1)) - edge).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size) of each source -> with weight, target: the whole shared by weight, the excess over ``most`` sizes reshared until no target is above."""
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], float(weights[x[1] % len(weights)])))
    at = cut(spark.createDataFrame(ordered, "source string, source_size long, weight double").withColumn("full", F.col("source_size") == 0))
    total = at.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left = at.agg(F.sum(F.when(~F.col("full"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("full"), F.col("source_size"))).alias("s")).first()
        rest, w = total - most * (left["s"] or 0), left["w"]
        share = F.lit(float(rest)) * F.col("weight") / F.lit(w or 1.0)
        done = at.withColumn("target", F.when(F.col("full"), F.col("source_size") * F.lit(float(most))).otherwise(share))
        over = ~F.col("full") & (share > F.col("source_size") * float(most))
        if not w or at.where(over).isEmpty():
            return done.drop("full")
        at = cut(at.withColumn("full", F.col("full") | over))


def apportion(sources: DataFrame, seats: int, block: float, most: int = MOST_REPEATS) -> DataFrame:
    """Sainte-Lague quotas: (source, target, source_size, ...) -> with blocks and quota.

    A source has at most ``most`` seats a block. As a source wins ``target / (2 q)``
    seats by quotients of ``q`` or more, give or take a half, those above one bound are
    won for certain and those below another are lost; only what lies between, a few
    for each source, is put in order.
    """
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    able = s.where((F.col("target") > 0) & (F.col("blocks") > 0)).withColumn("all", F.col("blocks") * most)
    n, total, every = able.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    if not n:
        return s.withColumn("quota", F.lit(0).cast("long"))

    def upto(q: float) -> Column:
        """How many of a source's quotients are at least ``q``."""
        return F.least(F.col("all"), F.greatest(F.lit(0), F.floor((F.col("target") / F.lit(q) + 1) / 2)).cast("long"))

    high = total / (2 * (seats - n / 2)) * (1 + 1e-9) if seats > n / 2 else float("inf")
    low = total / (2 * (seats + n)) * (1 - 1e-9)
    # Sources that have no more seats to win leave theirs to others, further down.
    while (held := able.agg(F.sum(upto(low))).first()[0]) < min(seats, every):
        low /= 2
    sure = cut(able.select("source", "target", (upto(high) if high < float("inf") else F.lit(0).cast("long")).alias("sure"), upto(low).alias("end")))
    left = max(0, min(seats, held) - (sure.agg(F.sum("sure")).first()[0] or 0))
    open_ = sure.where(F.col("end") > F.col("sure")).select("source", "target", F.explode(F.sequence(F.col("sure"), F.col("end") - 1)).alias("k"))
    won = open_.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k").limit(left).groupBy("source").agg(F.count("*").alias("more")).withColumnRenamed("source", "_t")
    quota = sure.join(won, F.col("source").eqNullSafe(F.col("_t")), "left").select(F.col("source").alias("_s"), (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))
    return s.join(quota, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("quota", F.coalesce("quota", F.lit(0))).drop("_s")


def quotas_of(sources: DataFrame, seats: int, block: float, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, ...) -> with block, blocks and quota: blocks of one length by ``apportion``, small targets by blocks of their own."""
    t = F.col("target")
    small = t < F.lit(LEAST_TARGET * block)
    held = sources.where(small).agg(F.sum(t)).first()[0] or 0.0
    large = apportion(sources.where(~small), seats - round(held / block), block, most).withColumn("block", F.lit(block))
    own = sources.where(small).withColumn("block", F.greatest(F.lit(1.0), t / F.lit(float(OWN_BLOCKS))))
    own = own.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # A target of all repeats takes every block so often; the last block may be shorter than the others.
    quota = F.when(t >= F.col("source_size") * float(most), F.col("blocks") * most).otherwise(F.least(F.col("blocks") * most, F.round(t / F.col("block")).cast("long")))
    return large.unionByName(own.withColumn("quota", quota))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, with its source and the order it has in the mix."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(or_empty(F.col(text))).alias("mark"))
    rows = cut(rows.withColumn("key", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string"), F.col("mark")), 256), 1, 8), 16, 10).cast("long")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    all_of = sums.agg(F.count("*").alias("sources"), F.sum("source_size").alias("size"), F.sum("n").alias("n")).first()
    total, n_sources, n = all_of["size"] or 0, all_of["sources"], all_of["n"] or 0
    seats = max(1, min(max(SEATS, SEATS_PER_SOURCE * n_sources), total))
    block = max(total / seats, 1.0)
    quotas = cut(quotas_of(targets(sums.select("source", "source_size"), weights), seats, block))
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda x: x

    ranges = max(1, n // RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.col("key") * F.lit(ranges) / F.lit(2**32)).cast("long"))
    held = rows.groupBy("source", "range").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "mark")
    rows = rows.withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(held, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("start", F.col("start") + F.col("base")).drop("s", "r", "base")

    # The extra blocks of a source: those first by a seeded key. Blocks taken are no more than seats and OWN_BLOCKS a small source.
    each = quotas.where(F.col("quota") > 0).select("source", "quota", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), F.col("b").cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(draw, "b"))
    times = each.withColumn("times", F.floor(F.col("quota") / F.col("blocks")) + (rank <= F.col("quota") % F.col("blocks")).cast("long")).where(F.col("times") > 0)

    q = quotas.select(F.col("source").alias("s"), "source_size", "target", "block")
    rows = rows.join(small(q), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = F.floor(F.col("start") / F.col("block")).cast("long")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block")).cast("long")
    # A word belongs to the block that its position falls in: block b holds the words from ceil(b * block) on.
    touched = rows.withColumn("b", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo = F.ceil(F.col("b") * F.col("block")).cast("long")
    hi = F.ceil((F.col("b") + 1) * F.col("block")).cast("long")
    words = F.least(F.col("start") + F.col("size"), hi) - F.greatest(F.col("start"), lo)
    t = times.select(F.col("source").alias("s"), F.col("b").alias("tb"), "times")
    took = touched.join(small(t) if seats <= 20 * BROADCAST_SOURCES else t, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("tb")), "left")
    took = took.groupBy("source", "range", "nth", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(F.col("times").isNotNull(), words * F.col("times"))).alias("taken"))
    return took.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# Targets in closed form: sources in the order of how soon they are full; those before the first that isn't are full.
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents),
k AS (SELECT *, CAST('0x' || substr(sha256(concat_ws(':', '{SEED}', doc_id, size, mark)), 1, 8) AS BIGINT) AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, ([{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::BIGINT AS total, sum(weight) FILTER (source_size > 0) AS w, least(greatest({SEATS}, {SEATS_PER_SOURCE} * count(*)), sum(source_size)) AS seats FROM s0),
s1 AS (SELECT *, coalesce(sum({MOST_REPEATS} * source_size) OVER b, 0) AS full_before, coalesce(sum(weight) OVER b, 0) AS w_before FROM s0 WHERE source_size > 0 WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, (total - full_before)::DOUBLE * weight / (w - w_before) <= {MOST_REPEATS}.0 * source_size AS free FROM s1, t),
cut AS (SELECT full_before, w_before FROM s2 WHERE free ORDER BY w_before LIMIT 1),
s3 AS (SELECT s0.source, s0.source_size, t.total, t.seats, CASE WHEN s0.source_size = 0 THEN 0.0 WHEN s2.w_before < cut.w_before THEN s0.source_size * {MOST_REPEATS}.0 ELSE (t.total - cut.full_before)::DOUBLE * s0.weight / (t.w - cut.w_before) END AS target,
  t.total::DOUBLE / t.seats AS block FROM s0 CROSS JOIN t CROSS JOIN cut LEFT JOIN s2 ON s0.source IS NOT DISTINCT FROM s2.source),
s4 AS (SELECT *, ceil(source_size / block)::BIGINT AS blocks FROM s3),
q AS (SELECT source, target, unnest(range(0, least(blocks * {MOST_REPEATS}, floor(2 * target / block)::BIGINT + 3))) AS k, seats FROM s4 WHERE target > 0),
won AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS n FROM q) WHERE n <= seats GROUP BY source),
b0 AS (SELECT s4.source, s4.block, blocks, quota, unnest(range(0, blocks)) AS b FROM s4 JOIN won ON s4.source IS NOT DISTINCT FROM won.source),
b1 AS (SELECT *, quota // blocks + (row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', '{SEED}', coalesce(source, ''), b)), b) <= quota % blocks)::BIGINT AS times FROM b0),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS n FROM k),
h AS (SELECT p.n, sum((least(p.start + p.size, ceil((b + 1) * block)::BIGINT) - greatest(p.start, ceil(b * block)::BIGINT)) * times)::BIGINT AS taken FROM p JOIN b1 ON p.source IS NOT DISTINCT FROM b1.source AND b1.b >= floor(p.start / block) AND b1.b <= floor((p.start + p.size - 1) / block) WHERE p.size > 0 AND times > 0 GROUP BY p.n)
SELECT p.doc_id, p.size, s4.source_size, s4.target, coalesce(h.taken, 0)::BIGINT AS taken FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source LEFT JOIN h ON h.n = p.n
"""
