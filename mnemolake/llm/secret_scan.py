r"""Secret scans through an incremental blob ledger (native).

Every historical version of every path is content-addressed (SHA-256 of its
text). Of each blob only the rules, in the version they have, that the ledger
lacks are run, each blob once, whichever paths hold it. Findings are then joined
back to all paths.

Defined cases: a null text is the empty text; a null path is a path; repeated
rows are repeated paths; overlapping findings of different kinds all stay;
an empty table gives no rows; other columns pass by unread. Offsets count code
points, ends are exclusive. Findings of a rule's older versions aren't reported.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, or_empty, running_sums, shared_folder, table


@dataclass(frozen=True)
class Rule:
    """Matches are the leftmost non-overlapping ones of ``pattern`` that ``keep`` then accepts in full."""

    kind: str
    pattern: str
    keep: str
    version: str = "1"

    @property
    def id(self) -> str:
        """What the ledger knows it by; a changed pattern needs a new version."""
        return f"{self.kind}@{self.version}"


#: Order is part of the format: findings with equal starts stand in this order.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    Rule("hex", r"[0-9a-f]+", r"^.{24,}$"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"^"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", r"^"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"^"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"^"),
    Rule("live", r"[sr]k_live_[A-Za-z0-9]{16,}", r"^"),
)
BASE = ("assign", "access", "hex")
#: A pattern whose runs are too common to list, and one with the same kept matches and fewer runs.
FASTER = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}


def address(versions: DataFrame, text: str) -> DataFrame:
    """Adds ``blob``, the SHA-256 of the text."""
    return versions.withColumn("blob", F.sha2(or_empty(F.col(text)), 256))


FOUND = "array<struct<start:bigint,place:int,kind:string,end:bigint,rule:string>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo) -> (blob, findings) of the blobs with any, by the rules whose ids are in ``todo``: an array of (start, place, kind, end, rule), sorted.

    Spark tells no match offsets, but ``split`` and ``regexp_extract_all`` by one
    pattern cut a text into pieces and matches in turn, whose running lengths
    are the offsets.
    """
    fields = ("start", "place", "kind", "end", "rule")

    def spans(place: int, rule: Rule, pattern: str, runs: Column) -> Column:
        gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        ends = running_sums(F.zip_with(gaps, runs, lambda g, m: (g + F.coalesce(F.length(m), F.lit(0))).cast("long")))
        each = F.zip_with(runs, F.slice(ends, F.lit(1), F.size(runs)), lambda m, to: F.struct((to - F.length(m)).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), to.alias("end"), F.lit(rule.id).alias("rule"), m.rlike(rule.keep).alias("ok")))
        return F.transform(F.filter(each, lambda x: x["ok"]), lambda x: F.struct(*[x[c].alias(c) for c in fields]))

    found = []
    for place, rule in enumerate(rules):
        pattern = FASTER.get(rule.kind, rule.pattern)
        hit = F.array_contains("todo", rule.id) & F.col("text").rlike(pattern)
        found.append(F.when(hit, let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), partial(spans, place, rule, pattern))).otherwise(F.array().cast(FOUND)))
    out = blobs.select("blob", F.array_sort(F.flatten(F.array(*found))).alias("findings")).where(F.size("findings") > 0)
    return out.dropDuplicates(["blob"])  # a repeated row of one path is scanned twice


def unseen(versions: DataFrame, path: str, text: str, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo) of one holder of each blob that some rule hasn't been run on.

    The holder is chosen on ids alone, so that copies of a text, however many,
    never meet in one task with their texts.
    """
    every = F.array(*[F.lit(r.id) for r in rules])
    v = address(versions, text).select(F.col(path).alias("_path"), "blob", or_empty(F.col(text)).alias("text"))
    holders = v.groupBy("blob").agg(F.min("_path").alias("_path"))
    if ledger is None:
        holders = holders.withColumn("todo", every)
    else:
        done = ledger.select("blob", "rules")
        holders = holders.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("rules", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    h = holders.select(F.col("blob").alias("_b"), F.col("_path").alias("_p"), "todo")
    return v.join(h, (F.col("blob") == F.col("_b")) & F.col("_path").eqNullSafe(F.col("_p"))).select("blob", "text", "todo")


def scan(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a scan of the versions: (blob, rules, findings), one row a blob, with what ``ledger`` had."""
    none = F.array().cast(FOUND)
    found = scan_blobs(unseen(versions, path, text, ledger, rules), rules)
    here = address(versions, text).select("blob").distinct().join(found, "blob", "left").select("blob", F.array(*[F.lit(r.id) for r in rules]).alias("rules"), F.coalesce("findings", none).alias("findings"))
    if ledger is None:
        return here
    old = ledger.select("blob", F.col("rules").alias("_rules"), F.col("findings").alias("_findings"))
    both = here.join(old, "blob", "full_outer")
    no = F.array().cast("array<string>")
    return both.select("blob", F.array_union(F.coalesce("_rules", no), F.coalesce("rules", no)).alias("rules"), F.array_sort(F.concat(F.coalesce("_findings", none), F.coalesce("findings", none))).alias("findings"))


def report(versions: DataFrame, path: str, text: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) of every version, by the rules in their present versions."""
    now = F.filter("findings", lambda x: x["rule"].isin(*[r.id for r in rules]))
    known = ledger.select("blob", now.alias("findings")).where(F.size("findings") > 0)
    return address(versions, text).select(F.col(path), "blob").join(known, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FOUND)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two scans as they follow each other in time: the second finds the ledger of the first, with half the documents in it.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    earlier = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0)
    scan(earlier, "doc_id", "text").write.parquet(f"{at}/1")
    scan(docs, "doc_id", "text", spark.read.parquet(f"{at}/1")).write.parquet(f"{at}/2")
    found = report(docs, "doc_id", "text", spark.read.parquet(f"{at}/2"))
    have = F.col("findings")

    def said(kinds=None):
        f = have if kinds is None else F.filter(have, lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter(have, of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(BASE), 256).alias("base_sha256"), said().alias("spans"))


def _sql_runs(place: int, rule: Rule) -> str:
    pattern = FASTER.get(rule.kind, rule.pattern).replace("(?i:", "(").replace("'", "''")
    keep = rule.keep.replace("(?i:", "(").replace("'", "''")
    for word in ("password", "passwd", "secret", "token", "key"):
        either = "".join(f"[{x}{x.upper()}]" for x in word)
        pattern, keep = pattern.replace(word, either), keep.replace(word, either)
    either = "[aA][pP][iI]_?"
    pattern, keep = pattern.replace("api_?", either), keep.replace("api_?", either)
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, '{keep}' AS keep, text, regexp_extract_all(text, '{pattern}') AS ms FROM d WHERE regexp_matches(text, '{pattern}')"""


def _sql() -> str:
    # DuckDB tells no offsets either: each match is found from the end of the one before.
    runs = " UNION ALL ".join(_sql_runs(i, r) for i, r in enumerate(RULES))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
runs AS ({runs}),
walk AS (
  SELECT doc_id, place, kind, keep, text, ms, 0 AS i, 0::BIGINT AS start, 0::BIGINT AS stop FROM runs
  UNION ALL
  SELECT doc_id, place, kind, keep, text, ms, i + 1, stop + strpos(substr(text, stop + 1), ms[i + 1]) - 1,
         stop + strpos(substr(text, stop + 1), ms[i + 1]) - 1 + length(ms[i + 1])
  FROM walk WHERE i < len(ms)),
f AS (SELECT doc_id, place, kind, start, stop FROM walk WHERE i > 0 AND regexp_matches(ms[i], keep)),
g AS (SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP2_SQL = _sql()
