"""Rule-based extraction of facts: scores as expressions, near-duplicates among a document's best sentences dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a sentence telling, by class, with the score of each.
CLASSES = (
    (1.5, False, ("maximum", "minimum", "default", "requires", "supports", "timeout", "threshold", "configured", "limited by", "port", "nodes", "cluster", "protocol", "phase")),
    (2.0, False, ("architecture", "module", "pipeline", "component", "design", "structure", "layer", "implementation", "deployed", "system", "framework", "model")),
    (3.0, True, ("algorithm", "implements", "complexity", "o(n", "recursive", "tolerance", "consensus", "replication", "latency", "throughput", "bandwidth", "fault")),
    (2.5, True, ("chose", "chosen", "decided", "because", "instead of", "trade-off", "rather than", "reason", "motivated", "proposed", "introduced", "invented")),
    (2.0, False, ("benchmark", "performance", "measured", "achieves", "tps", "latency", "availability", "scales")),
    (1.0, False, ("licensed", "published", "paper", "team", "professor", "university", "company", "stanford", "mit")),
    (2.5, True, ("fixed", "resolved", "bug", "workaround", "root cause", "regression", "patch")),
    (2.0, False, ("configured", "installed", "migrated", "upgraded", "downgraded", "enabled", "disabled", "deprecated")),
    (2.0, False, ("error:", "failed:", "warning:", "panic", "traceback", "exception", "denied", "unauthorized", "not found", "timed out")),
    (1.5, False, ("version", "release", "v0.", "v1.", "v2.", "changelog", "breaking change")),
    (1.5, False, ("provider", "database", "credential", "endpoint", "webhook", "api key", "token", "connection", "cluster")),
)
CODE, FILES = (".rs", "fn ", "struct "), (".rs", ".ts", ".py", ".toml", ".json")
LEAST, BEST, MOST, ALIKE = 3.0, 30, 20, 0.6


def sentences(docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(id, n, sentence): pieces up to a full stop or line end, of 20 to 500 bytes."""
    parts = F.regexp_extract_all(content, F.lit(r"[^.\n]*[.\n]|[^.\n]+$"), F.lit(0))
    x = docs.select(F.col(id).alias("id"), F.posexplode(parts).alias("n", "s")).select("id", "n", F.regexp_replace("s", r"^\s+|\s+$", "").alias("sentence"))
    return x.where(F.octet_length("sentence").between(20, 500))


def _has(low: Column, word: str) -> Column:
    return F.contains(low, F.lit(word))


def scored(rows: DataFrame) -> DataFrame:
    """With ``score`` and ``importance``."""
    s, low = F.col("sentence"), F.lower(F.col("sentence"))
    words = F.split(s, r"\s+")
    proper = F.size(F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: (F.octet_length(w) > 1) & w.rlike(r"^\p{Lu}") & ~w.rlike(r"^\p{Lu}+$")))
    total = F.when(s.rlike("[0-9]"), 1.5).otherwise(0.0) + F.when(proper >= 2, 1.5).otherwise(0.0)
    high = F.lit(False)
    for value, important, kinds in CLASSES:
        for k in kinds:
            total = total + F.when(_has(low, k), value).otherwise(0.0)
            if important:
                high = high | _has(low, k)
    code, files = F.lit(False), F.lit(False)
    for k in CODE:
        code |= _has(low, k)
    for k in FILES:
        files |= _has(low, k)
    total = total + F.when(code, 1.0).otherwise(0.0) + F.when(_has(s, "/") & files, 1.5).otherwise(0.0)
    return rows.withColumn("score", total).withColumn("importance", F.when(high, "high").otherwise("medium"))


def best(rows: DataFrame, least: float = LEAST, most: int = BEST) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "n"))
    return rows.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def facts(docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """(id, rank, sentence, score, importance): of a document's thirty best, those unlike every better one, at most twenty."""

    def unlike(g: pd.DataFrame) -> pd.DataFrame:
        g, kept, rows = g.sort_values("rank"), [], []
        for i, s in zip(g.index, g["sentence"], strict=True):
            words = set(s.split())
            if all(len(words & k) <= ALIKE * len(words | k) for k in kept):
                kept.append(words)
                rows.append(i)
        return g.loc[rows[:MOST]]

    x = best(scored(sentences(docs, id, content))).select("id", "rank", "sentence", "score", "importance")
    return x.groupBy("id").applyInPandas(unlike, x.schema)  # thirty rows a document at most
