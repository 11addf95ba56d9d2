r"""Benchmark decontamination by template canonicalisation (native).

Texts become token sequences in which numbers, names (capitalised words) and
units stand as typed placeholders. Windows of eight template tokens of every
document are hash-joined with those of every benchmark item. Along each
alignment of a document with an item, the slots must be consistent: wherever
the item repeats a value, the document repeats one too. Consistent alignments
that together cover at least half of an item's windows are leaks, exact ones or
re-parameterised ones (same template, other numbers, names or units).

Items of fewer than eight tokens are one window of their own length. A template of
under ``LEAST_TOKENS`` tokens tells no question from another, so such an item is
found only where its very values stand, in full.

Hits are ids and positions until the windows that a document shares with an item
can reach the coverage; only then its text's slots are cut out.

Defined cases: null and empty texts have no tokens and match nothing; repeated
documents are each reported once per (doc_id, item_id); a null doc_id or item_id
is a value like others; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, free_name, let, or_empty, table

WINDOW = 8
#: Items of fewer tokens match by their values only.
LEAST_TOKENS = 5
COVERAGE = 0.5
#: Benchmark windows up to this many (32 bytes each) are sent to all executors; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000

# Units that may follow a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|mph|kmh|l|ml|s|sec|min|h|hr|hrs|hours|minutes|seconds|days|weeks|months|years|dollars|euros|pounds|cents|percent|degrees|miles|meters|metres|kilometers|kilometres|kilograms|grams|liters|litres"
TOKEN = r"[#@&][npu]|[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[%$€£°]"
RAW = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[%$€£°]"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
NAME = r"(^|[^\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*"


def template_tokens(text: Column) -> Column:
    """Lower-cased tokens with ``#n`` for numbers, ``#p`` for names, ``#u`` for units; as many as ``raw_tokens``."""
    t = F.regexp_replace(text, r"[#@&]", " ")
    t = F.regexp_replace(t, NAME, r"$1#p")
    t = F.regexp_replace(t, NUMBER, " #n ")
    t = F.lower(t)
    t = F.regexp_replace(t, rf"(#n  *)(?:(?:{UNITS})(?![\p{{L}}\p{{M}}])|[%$€£°])", "$1#u")
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, r"[#@&]", " "), F.lit(RAW), F.lit(0))


def windows(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order; none when there are fewer tokens."""
    return let(tokens, lambda t: F.when(F.size(t) >= size, F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.xxhash64(F.slice(t, i, size)))).otherwise(F.array().cast("array<bigint>")))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, matched, coverage, kind) of every leak."""
    it = items.select(F.col(item_id).alias("item_id"), or_empty(F.col(text)).alias("t")).distinct()
    it = it.select("item_id", F.xxhash64("t").alias("item_key"), template_tokens(F.col("t")).alias("tpl"), raw_tokens(F.col("t")).alias("raw")).where(F.size("tpl") > 0)
    it = it.withColumn("w", F.least(F.size("tpl"), F.lit(WINDOW)))
    size = F.when(F.col("w") < WINDOW, F.array(F.xxhash64("tpl"))).otherwise(windows(F.col("tpl"), WINDOW))
    bench = cut(it.select("item_id", "item_key", "w", F.size(size).alias("n"), "tpl", "raw", F.posexplode(size).alias("ipos", "hash")).select("item_id", "item_key", "w", "n", "ipos", "hash", F.slice("tpl", F.col("ipos") + 1, F.col("w")).alias("tpl"), F.slice("raw", F.col("ipos") + 1, F.col("w")).alias("ivals")))
    shape = bench.groupBy("w").count().collect()  # a row for each window length, at most eight
    keys = bench.select("item_id", "item_key", "n", "ipos", "w", "hash")
    if sum(r["count"] for r in shape) <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)

    d = docs.select(F.col(doc_id).alias("doc_id"), or_empty(F.col(text)).alias("t"))
    d = d.select("doc_id", F.xxhash64("t").alias("doc_key"), "t")
    # All lengths in one pass; a place is told with its length.
    lengths = sorted(r["w"] for r in shape)
    placed = lambda t, w: F.transform(windows(t, w), lambda h, i: F.struct(F.lit(w).alias("w"), i.alias("dpos"), h.alias("hash")))
    every = let(template_tokens(F.col("t")), lambda t: F.flatten(F.array(*[placed(t, w) for w in lengths]))) if lengths else F.array().cast("array<struct<w:int,dpos:int,hash:bigint>>")
    seen = d.select("doc_id", "doc_key", F.explode(every).alias("x")).select("doc_id", "doc_key", "x.*")
    hits = cut(seen.join(keys, ["w", "hash"]).select("doc_id", "doc_key", "item_id", "item_key", "w", "n", "ipos", "dpos").distinct())
    # What can't reach the coverage, however it is aligned, needs no text.
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    reach = hits.groupBy(*pair, "n", "ipos").agg(F.lit(1).alias("one")).groupBy(*pair, "n").agg(F.count("*").alias("most")).where(F.col("most") >= coverage * F.col("n"))
    reach = reach.select(*[F.col(c).alias(f"_{c}") for c in pair])
    hits = hits.join(reach, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]), "left_semi")

    by_doc = hits.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("item_id", "item_key", "w", "n", "ipos", "dpos")).alias("hits")).withColumnsRenamed({"doc_id": "d", "doc_key": "k"})
    texts = d.join(by_doc, (F.col("doc_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "doc_key", "t", "hits")
    # The text's slots are cut out hit by hit, so that a row carries eight tokens on and not the text.
    slots = let(raw_tokens(F.col("t")), lambda r: F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["item_key"].alias("item_key"), h["n"].alias("n"), h["ipos"].alias("ipos"), h["dpos"].alias("dpos"), F.slice(r, h["dpos"] + 1, h["w"]).alias("dvals"))))
    cuts = texts.select("doc_id", "doc_key", F.explode(slots).alias("h")).select("doc_id", "doc_key", "h.*")
    b = bench.select(F.col("item_id").alias("i"), F.col("item_key").alias("ik"), F.col("ipos").alias("ip"), "w", "tpl", "ivals")
    pairs = cuts.join(b, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("ik")) & (F.col("ipos") == F.col("ip")))
    mapped = F.filter(F.zip_with("tpl", F.arrays_zip("ivals", "dvals"), lambda t, v: F.struct(t.alias("kind"), v["ivals"].alias("from"), v["dvals"].alias("to"))), lambda x: x["kind"].startswith("#"))
    one = ["doc_id", "doc_key", "item_id", "item_key", "n", "w", (F.col("dpos") - F.col("ipos")).alias("shift")]
    pairs = pairs.select(*one, "ipos", mapped.alias("slots"))
    lined = pairs.groupBy("doc_id", "doc_key", "item_id", "item_key", "n", "w", "shift").agg(F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    sources = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["from"])))
    lined = lined.where(F.size(sources) == F.size("slots"))  # each value of the item became one value
    same = F.forall("slots", lambda s: s["from"] == s["to"])
    whole = lined.withColumn("same", same).where(F.col("same") | (F.col("w") >= LEAST_TOKENS)).groupBy("doc_id", "doc_key", "item_id", "item_key", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.min("same").alias("same"))
    whole = whole.withColumn("coverage", F.col("matched") / F.col("n")).where(F.col("coverage") >= coverage)
    best = whole.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched", F.col("n").alias("windows"), "same")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.windows").alias("windows"), F.col("b.matched").alias("matched"), F.col("b.coverage").alias("coverage"), F.when(F.col("b.same"), "exact").otherwise("reparameterised").alias("kind"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    name = free_name(docs, "_leak")
    leaks = find_leaks(docs, items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UNIT_SQL = rf"(#n  *)(?:(?:{UNITS})(?:([^\p{{L}}\p{{M}}])|$)|([%$€£°]))"


def _tokens_sql(t: str) -> str:
    t = f"regexp_replace({t}, '[#@&]', ' ', 'g')"
    names = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{M}}])\p{{Lu}}[\p{{L}}\p{{M}}]*', '\1#p', 'g')"
    return f"regexp_extract_all(regexp_replace(lower(regexp_replace({names}, '{NUMBER}', ' #n ', 'g')), '{_UNIT_SQL}', '\\1#u\\2', 'g'), '{TOKEN}')"


OP3_SQL = rf"""
WITH it AS (SELECT DISTINCT item_id, coalesce(text, '') AS t FROM benchmark),
i1 AS (SELECT item_id, {_tokens_sql('t')} AS tpl, regexp_extract_all(regexp_replace(t, '[#@&]', ' ', 'g'), '{RAW}') AS raw FROM it),
i2 AS (SELECT *, least(len(tpl), {WINDOW}) AS w, len(tpl) - least(len(tpl), {WINDOW}) + 1 AS n FROM i1 WHERE len(tpl) > 0),
b AS (SELECT item_id, w, n, p AS ipos, tpl[p:p + w - 1] AS win, raw[p:p + w - 1] AS ivals FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM i2)),
d1 AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
d2 AS (SELECT doc_id, {_tokens_sql('t')} AS tpl, regexp_extract_all(regexp_replace(t, '[#@&]', ' ', 'g'), '{RAW}') AS raw FROM d1),
d3 AS (SELECT doc_id, tpl, raw, w, unnest(range(1, len(tpl) - w + 2)) AS dpos FROM d2, (SELECT DISTINCT w FROM b) WHERE len(tpl) >= w),
h AS (SELECT d.doc_id, b.item_id, b.n, b.w, b.ipos, d.dpos - b.ipos AS shift, b.win, b.ivals, d.raw[d.dpos:d.dpos + b.w - 1] AS dvals
      FROM (SELECT doc_id, dpos, w, raw, tpl[dpos:dpos + w - 1] AS win FROM d3) d JOIN b ON d.win = b.win),
s AS (SELECT doc_id, item_id, n, w, shift, ipos, unnest(range(1, len(win) + 1)) AS k, win, ivals, dvals FROM h),
bad AS (SELECT doc_id, item_id, shift, win[k] AS kind, ivals[k] AS v FROM s WHERE win[k] LIKE '#%' GROUP BY ALL HAVING count(DISTINCT dvals[k]) > 1),
ok AS (SELECT doc_id, item_id, n, w, shift, ipos, bool_and(NOT win[k] LIKE '#%' OR ivals[k] = dvals[k]) AS same FROM s
       WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = s.doc_id AND bad.item_id = s.item_id AND bad.shift = s.shift) GROUP BY ALL),
full_ok AS (SELECT *, bool_and(same) OVER (PARTITION BY doc_id, item_id, shift) AS all_same FROM ok)
SELECT doc_id, item_id, n::INTEGER AS windows, count(DISTINCT ipos)::BIGINT AS matched, count(DISTINCT ipos) / n::DOUBLE AS coverage,
       CASE WHEN bool_and(same) THEN 'exact' ELSE 'reparameterised' END AS kind
FROM full_ok WHERE w >= {LEAST_TOKENS} OR all_same GROUP BY doc_id, item_id, n HAVING count(DISTINCT ipos) / n::DOUBLE >= {COVERAGE}
"""
