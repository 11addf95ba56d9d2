"""Full text, vectors and their fusion.

Full text is answered from a ``TextIndex``: a query reads the postings of its own
tokens, which folders by hash and sorted files prune to, and rows are fetched by id
without their texts. ``segments`` has the form of it that takes changes. Where there is no index, frequencies
are counted within each row of a scan. Corpus statistics are one aggregate row,
and scores are expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions.text import NO_TOKEN, TOKEN, fts_phrases, redact, tokenize

from .graph import label_texts
from .memory import active, at, in_project

# Constants of the ranking functions.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FTS_SHARE, VECTOR_SHARE, WEIGHT_BIAS, LEARNED_BIAS, MOST = 0.3, 0.7, 0.05, 0.12, 1.5
RRF_K, SHARED_SCALE, EXPANSION_SCALE, POOL = 60, 0.7, 0.5, 1.5
HALF_LIFE_DAYS, DECAY = 14.0, -0.693
MERGE_SCORE = 0.85
#: Queries and rows of vectors that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 1_024, 16_384


def memory_text() -> Column:
    """What the index of memories holds: id, topic, summary and keywords."""
    return F.concat_ws(" ", "id", "topic", "summary", F.array_join("keywords", " "))


def _tokens(low: Column) -> Column:
    """Tokens of a text in lower case."""
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def _frequency(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    n = len(phrase)
    want = F.array(*[F.lit(p) for p in phrase])
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.slice(tokens, i, n) == want))


def _score(x: DataFrame, frequencies: list[Column], any_of: bool, keep: list[str]) -> DataFrame:
    """``keep`` and ``rank`` of rows with ``_len``, ``_n`` (rows in all), ``_avg`` (mean length) and the number of rows of each phrase, ``_n0`` and on."""

    def part(i: int) -> Column:
        idf = F.greatest(F.ln((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = frequencies[i]
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    hit = reduce(lambda a, b: a | b if any_of else a & b, [f > 0 for f in frequencies])
    return x.where(hit).select(*keep, (-reduce(lambda a, b: a + b, [part(i) for i in range(len(frequencies))])).alias("rank"))


#: Folders that tokens are dealt to by hash, and files that the rows of a folder are spread over.
BUCKETS, SPREAD = 32, 4


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, folder: str) -> None:
    """A folder a bucket of tokens, in files sorted by token; a common token is spread over ``SPREAD`` of them."""
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "token", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


@dataclass(frozen=True)
class TextIndex:
    """An inverted index: (token, id, dl, places, bucket), and a row of totals (n, average length)."""

    postings: DataFrame
    totals: DataFrame

    @staticmethod
    def write(rows: DataFrame, id: str, text: Column, folder: str) -> None:
        write_postings(postings(rows, id, text), f"{folder}/postings")
        rows.select(F.size(tokenize(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).write.mode("overwrite").parquet(f"{folder}/totals")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TextIndex:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/totals"))

    def hits(self, phrases: list[list[str]], any_of: bool = False) -> DataFrame:
        """(id, rank) of what holds all phrases, or any."""
        tokens = sorted({t for p in phrases for t in p})
        found = self.postings.where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in tokens]) & F.col("token").isin(*tokens))
        rows = found.groupBy("id", "dl").agg(*[F.first(F.when(F.col("token") == t, F.col("places")), ignorenulls=True).alias(f"_p{i}") for i, t in enumerate(tokens)])

        def frequency(phrase: list[str]) -> Column:
            places = [F.col(f"_p{tokens.index(t)}") for t in phrase]
            follows = [lambda x, k=k, p=p: F.array_contains(p, x + k) for k, p in enumerate(places) if k]
            run = F.filter(places[0], lambda x: reduce(lambda a, b: a & b, [f(x) for f in follows])) if follows else places[0]
            return F.coalesce(F.size(run), F.lit(0))

        n = range(len(phrases))
        rows = rows.select("id", F.col("dl").alias("_len"), *[frequency(p).alias(f"_f{i}") for i, p in enumerate(phrases)])
        stats = rows.agg(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in n]).crossJoin(F.broadcast(self.totals.select(F.col("n").alias("_n"), F.col("avg").alias("_avg"))))
        return _score(rows.crossJoin(F.broadcast(stats)), [F.col(f"_f{i}") for i in n], any_of, ["id"])  # one row


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Counts:
    """What a scan counted of a query's phrases: rows with ``_len`` and how often each phrase stands there, ``_f0`` and on. It answers for these phrases only, where one query doesn't pay for an index."""

    rows: DataFrame
    phrases: list[list[str]]

    @classmethod
    def of(cls, rows: DataFrame, text: Column, phrases: list[list[str]], keep: list[str]) -> Counts:
        def frequency(tokens: Column, low: Column, phrase: list[str]) -> Column:
            held = reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in phrase])  # tokens are looked through only where they can be
            return F.when(held, _frequency(tokens, phrase)).otherwise(0)

        n = range(len(phrases))
        counts = lambda low: _once(_tokens(low), lambda t: F.struct(F.size(t).alias("len"), *[frequency(t, low, p).alias(f"f{i}") for i, p in enumerate(phrases)]))
        x = rows.withColumn("_c", _once(F.lower(text), counts))
        return cls(x.select(*keep, F.col("_c.len").alias("_len"), *[F.col(f"_c.f{i}").alias(f"_f{i}") for i in n]), phrases)

    def ranked(self, any_of: bool = False) -> DataFrame:
        """The rows that hold all phrases (or any), without the counts, with ``rank``."""
        n = range(len(self.phrases))
        stats = self.rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in n])
        keep = [c for c in self.rows.columns if c != "_len" and c not in [f"_f{i}" for i in n]]
        return _score(self.rows.crossJoin(F.broadcast(stats)), [F.col(f"_f{i}") for i in n], any_of, keep)  # one row


def bm25(rows: DataFrame, text: Column, phrases: list[list[str]], any_of: bool = False, index: TextIndex | Counts | None = None) -> DataFrame:
    """Rows that hold all phrases (or any) with ``rank``, negative and the lower the better; statistics cover all of ``rows``."""
    if not phrases:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    if isinstance(index, Counts):
        if index.phrases != phrases:
            raise ValueError(f"counted were {index.phrases}, asked for are {phrases}")
        return index.ranked(any_of)
    if index is not None:
        return rows.join(index.hits(phrases, any_of), "id")
    return Counts.of(rows, text, phrases, rows.columns).ranked(any_of)


def matching(rows: DataFrame, text: Column, phrases: list[list[str]], any_of: bool = False, index: TextIndex | None = None) -> DataFrame:
    """The rows of ``bm25`` without their rank: a scan splits no text into tokens and needs no statistics."""
    if index is not None or not phrases:
        return bm25(rows, text, phrases, any_of, index).drop("rank")

    either = lambda conditions: reduce(lambda a, b: a | b if any_of else a & b, conditions)
    # Substrings are looked for first, which is quicker and loses nothing.
    within = lambda low: either([reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in p]) for p in phrases])
    # A search may begin, and a look behind ends, within a pair of surrogates; so the character before is read, and half a pair isn't one.
    whole = lambda low: either([low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}\p{{Cs}}]){NO_TOKEN.join(p)}(?!{TOKEN[:-1]})") for p in phrases])
    return rows.where(F.exists(F.array(F.lower(text)), lambda low: within(low) & whole(low)))


def postings(rows: DataFrame, id: str, text: Column) -> DataFrame:
    """(token, id, dl, places, bucket): the inverted index as a table. A row's tokens are sorted and grouped within the row, so nothing is shuffled."""

    def grouped(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))
        group = lambda a, b: F.struct(F.get(s, a)["token"].alias("token"), F.transform(F.slice(s, a + 1, b - a), lambda x: x["place"]).alias("places"))
        return _once(F.when(n > 0, first).otherwise(F.array().cast("array<int>")), lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>"))), group))

    toks = rows.select(F.col(id).alias("id"), tokenize(text).alias("toks"))
    placed = F.array_sort(F.transform("toks", lambda t, i: F.struct(t.alias("token"), i.alias("place"))))
    out = toks.select("id", F.size("toks").alias("dl"), F.explode(_once(placed, grouped)).alias("p"))
    return out.select("p.token", "id", "dl", "p.places", _bucket(F.col("p.token")).alias("bucket"))


def search_page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of ranked hits, each row with the number of all of them."""
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy("rank", F.desc("weight"), F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def fts(memories: DataFrame, query: str, project: str | None = None, limit: int = 20, offset: int = 0, topic: str | None = None, ranked: bool = True, include_invalidated: bool = False, worktree: str | None = None, projects: list[str] | None = None, index: TextIndex | None = None) -> DataFrame:
    """Memories that match, by BM25 or by weight; statistics cover all memories."""
    hits = bm25(memories, memory_text(), fts_phrases(query), index=index)
    hits = hits.where(in_project(project))
    if not include_invalidated:
        hits = hits.where(active())
    if topic is not None:
        hits = hits.where(F.col("topic") == topic)
    if worktree is not None:
        hits = hits.where(F.col("worktree") == worktree)
    if projects is not None:
        hits = hits.where(F.col("project").isin(*projects))
    order = ["rank", F.desc("weight"), F.desc("created_at")] if ranked else [F.desc("weight"), F.desc("created_at")]
    return hits.orderBy(*order, "id").offset(offset).limit(limit)


def otherwise(found: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of ``found`` or, if it has none, those of ``other``; which, is told as the plan runs."""
    none = found.agg((F.count("*") == 0).alias("_none"))
    rest = other.crossJoin(F.broadcast(none)).where("_none").drop("_none")  # one row
    return found.unionByName(rest)


def fts_or_keywords(memories: DataFrame, query: str, project: str | None = None, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """Full text, or, where that finds nothing, a substring search for the query's words, both by weight."""
    from .memory import keyword_search

    found = fts(memories, query, project, limit, ranked=False, index=index).drop("rank")
    return otherwise(found, keyword_search(memories, query.split(), project, limit)).orderBy(F.desc("weight"), F.desc("created_at"), "id")


def concept_text() -> Column:
    return F.concat_ws(" ", "id", "name", "definition", F.array_join(label_texts(F.col("labels")), " "))


def concept_fts(concepts: DataFrame, query: str, memoir: str | None = None, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    hits = bm25(concepts, concept_text(), fts_phrases(query), index=index)
    if memoir is not None:
        hits = hits.where(F.col("memoir_id") == memoir)
    return hits.orderBy("rank", "name", "id").limit(limit)


def chunk_text() -> Column:
    return F.concat_ws(" ", "content", "heading")


def chunk_fts(chunks: DataFrame, query: str, project: str | None = None, limit: int = 20, index: TextIndex | Counts | None = None) -> DataFrame:
    hits = bm25(chunks, chunk_text(), fts_phrases(query), index=index).where(in_project(project))
    return hits.withColumn("score", 1 / (1 + F.abs("rank"))).orderBy("rank", "id").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is missing or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(values: list[float]) -> Column:
    return F.lit(values).cast("array<double>")


def knn(rows: DataFrame, query: list[float], k: int, keep: Column | None = None, offset: int = 0, post_filter: bool = False) -> DataFrame:
    """The nearest rows with ``similarity``. Filters come first, or, with ``post_filter``, after the cut."""
    r = rows.where(F.col("embedding").isNotNull())
    keep = F.lit(True) if keep is None else keep
    if not post_filter:
        r = r.where(keep)
    r = r.withColumn("similarity", similarity(F.col("embedding"), vector(query))).where(F.col("similarity").isNotNull())
    r = r.orderBy(F.desc("similarity"), "id").limit(k + offset)
    return r.where(keep).orderBy(F.desc("similarity"), "id").offset(offset) if post_filter else r.offset(offset)


def learned(effects: DataFrame, as_of: str) -> DataFrame:
    """(id, learned): usefulness with halved weight every 14 days, summed and held within -1 and 1."""
    age = F.timestamp_diff("SECOND", F.col("computed_at"), at(as_of)) / 86400.0
    total = F.sum(F.col("effectiveness") * F.exp(F.lit(DECAY) * age / HALF_LIFE_DAYS))
    return effects.groupBy(F.col("memory_id").alias("id")).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)).alias("learned"))


def hybrid(memories: DataFrame, query: str, values: list[float], limit: int, offset: int = 0, project: str | None = None, effects: DataFrame | None = None, as_of: str | None = None, worktree: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Text and vector pools fused with the weight and learned biases: id and score, best first."""
    import math

    pool = limit + offset if worktree is not None else math.ceil(POOL * (limit + offset))
    keep = active() & in_project(project)
    if worktree is not None:
        keep &= F.coalesce(F.col("worktree") == worktree, F.lit(False))
    slim = memories.select("id", "topic", "summary", "keywords", "weight", "project", "worktree", "invalidated_at")
    text = bm25(slim, memory_text(), fts_phrases(query), index=index).where(keep).orderBy("rank", "id").limit(pool).select("id", F.col("weight").alias("w1"), (1 / (1 + F.abs("rank"))).alias("fts"))
    near = knn(memories.select("id", "weight", "project", "worktree", "invalidated_at", "embedding"), values, pool, keep).select("id", F.col("weight").alias("w2"), F.col("similarity").alias("vec"))
    both = text.join(near, "id", "full_outer").select("id", F.coalesce("w1", "w2").alias("weight"), F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce("vec", F.lit(0.0)).alias("vec"))
    if effects is not None:
        both = both.join(learned(effects, as_of), "id", "left")
    else:
        both = both.withColumn("learned", F.lit(0.0))
    raw = FTS_SHARE * F.col("fts") + VECTOR_SHARE * F.col("vec") + WEIGHT_BIAS * (F.col("weight") - 0.5) + LEARNED_BIAS * F.coalesce("learned", F.lit(0.0))
    return both.select("id", F.greatest(F.lit(0.0), F.least(F.lit(MOST), raw)).alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def hybrid_chunks(chunks: DataFrame, query: str, values: list[float], limit: int, project: str | None = None, index: TextIndex | None = None) -> DataFrame:
    import math

    pool = math.ceil(POOL * limit)
    text = chunk_fts(chunks.drop("embedding"), query, project, pool, index).select("id", F.col("score").alias("fts"))
    near = knn(chunks, values, pool, in_project(project)).select("id", F.col("similarity").alias("vec"))
    both = text.join(near, "id", "full_outer")
    score = FTS_SHARE * F.coalesce("fts", F.lit(0.0)) + VECTOR_SHARE * F.coalesce("vec", F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def rrf(lists: list[tuple[str, DataFrame, list, float]], limit: int, offset: int = 0) -> DataFrame:
    """Reciprocal-rank fusion of (kind, rows, order, scale) lists: kind, id, score. Each list is already cut to its pool."""
    parts = [rows.select(F.lit(kind).alias("kind"), "id", (F.lit(scale) / (RRF_K + F.row_number().over(Window.orderBy(*order)) - 1)).alias("s")) for kind, rows, order, scale in lists]
    all_ = reduce(DataFrame.unionByName, parts)
    return all_.groupBy("kind", "id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "kind", "id").offset(offset).limit(limit)


def search_all(memories: DataFrame, chunks: DataFrame, query: str, limit: int, offset: int = 0, project: str | None = None, worktree: str | None = None, shared: str | None = None, index: TextIndex | None = None, chunk_index: TextIndex | Counts | None = None) -> DataFrame:
    """Memories and chunks in one ranking; with a worktree, shared memories follow the scoped ones."""
    pool = limit + offset
    order = [F.desc("weight"), F.desc("created_at"), "id"]
    found = lambda rows: matching(rows, memory_text(), fts_phrases(query), index=index)
    if worktree is None:
        m = found(memories.where(active() & in_project(project))).orderBy(*order).limit(pool).withColumn("leg", F.lit(0))
    else:
        own = found(memories.where(active() & in_project(project) & (F.col("worktree") == worktree))).orderBy(*order).limit(pool).withColumn("leg", F.lit(0))
        other = found(memories.where(active() & (F.col("project") == shared))).orderBy(*order).limit(pool).withColumn("leg", F.lit(1))
        # A hit of both lists counts where it stands first.
        m = own.unionByName(other.join(own.select("id"), "id", "left_anti"))
        m = m.orderBy("leg", *order).limit(pool)
    c = chunk_fts(chunks, query, project, pool, chunk_index)
    return rrf([("memory", m, ["leg", *order], 1.0), ("chunk", c, ["rank", "id"], 1.0)], limit, offset)


def shared_merge(own: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    """Hits of a project with those of the shared one at 0.7 of their score."""
    s = shared.join(own.select("id"), "id", "left_anti").withColumn("score", F.col("score") * SHARED_SCALE)
    return own.unionByName(s).orderBy(F.desc("score"), "id").limit(limit)


def first_seen(branches: list[DataFrame], orders: list[list], limit: int) -> DataFrame:
    """Ids of several ordered lists, each id where it is seen first."""
    parts = [b.select("id", F.lit(i).alias("branch"), F.row_number().over(Window.orderBy(*o)).alias("place")) for i, (b, o) in enumerate(zip(branches, orders, strict=True))]
    all_ = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min(F.struct("branch", "place")).alias("p"))
    return all_.select("id", "p.branch", "p.place").orderBy("branch", "place").limit(limit)


def context_recall(memories: DataFrame, query: str, limit: int, project: str, expanded: list[str] = (), session_like: bool = False, index: TextIndex | None = None, offset: int = 0) -> DataFrame:
    """Ordered branches: session memories, hits of expanded code names, full text, shared hits."""
    by_weight = [F.desc("weight"), F.desc("created_at"), "id"]
    hits = bm25(memories, memory_text(), fts_phrases(query), index=index).where(active())
    branches, orders = [], []
    if session_like:
        branches.append(memories.where(active() & in_project(project) & F.col("topic").startswith("session/")).orderBy(F.desc("created_at"), "id").limit(5))
        orders.append([F.desc("created_at"), "id"])
    if expanded:
        code = bm25(memories, memory_text(), [p for e in expanded for p in fts_phrases(e)], any_of=True, index=index).where(active() & in_project(project)).orderBy(*by_weight).offset(offset).limit(4 * limit)
        branches.append(code)
        orders.append(by_weight)
    branches.append(hits.where(in_project(project)).orderBy(*by_weight).offset(offset).limit(limit))
    orders.append(by_weight)
    if project != "_shared":
        branches.append(hits.where(F.col("project") == "_shared").orderBy(*by_weight).offset(offset).limit(limit))
        orders.append(by_weight)
    return first_seen(branches, orders, limit)


def expand_code(concepts: DataFrame, names: list[str], parts: list[str], most: int = 5, query: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Concept names for code terms: equal names first, then full-text hits of ``query``, then those with a fragment, equal before prefix before inner, in fragment order."""
    low = F.lower("name")
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(parts))):
        kind = F.when(low == p, 0).when(low.startswith(p), 1).when(low.contains(p), 2)
        rank = F.least(rank, kind * 1000 + i)
    exact = F.col("name").isin(*names) if names else F.lit(False)
    own = concepts.select("name", F.when(exact, -1_000_000).otherwise(rank).alias("match"))
    if query is not None:
        found = concept_fts(concepts, query, None, most, index)
        own = own.unionByName(found.select("name", (F.row_number().over(Window.orderBy("rank", "name", "id")) - 1000).alias("match")))  # ``most`` rows
    return own.where(F.col("match").isNotNull()).groupBy("name").agg(F.min("match").alias("match")).orderBy("match", "name").limit(most)


def search_expanded(memories: DataFrame, base: DataFrame, terms: list[str], limit: int, project: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Adds hits of expanded terms, any of them, that the base ranking (kind, id, score) lacks, at half score."""
    seen = base.where(F.col("kind") == "memory").select("id")
    extra = matching(memories.where(active() & in_project(project)), memory_text(), [p for t in terms for p in fts_phrases(t)], any_of=True, index=index).join(seen, "id", "left_anti")
    order = [F.desc("weight"), F.desc("created_at"), "id"]
    extra = rrf([("memory", extra.orderBy(*order).limit(limit), order, EXPANSION_SCALE)], limit)
    return base.unionByName(extra).orderBy(F.desc("score"), "kind", "id").limit(limit)


def term_overlap(text: Column, query: str) -> Column:
    """How many different words of the query a text holds."""
    words = sorted({t for p in fts_phrases(query) for t in p})
    return F.size(F.array_intersect(tokenize(text), F.array(*[F.lit(w) for w in words]).cast("array<string>")))


def gather_context(sections: list[tuple[str, DataFrame, list]], budget_tokens: int, each: int) -> DataFrame:
    """Sections' top rows (id, text), redacted, by relevance within a budget of four bytes a token; the first always stays, all stops at the first that doesn't fit."""
    parts = []
    for i, (name, rows, order) in enumerate(sections):
        top = rows.orderBy(*order).limit(each)  # windows run on these few rows
        parts.append(top.select(F.lit(i).alias("section_no"), F.lit(name).alias("section"), "id", redact(F.col("text")).alias("text"), F.row_number().over(Window.orderBy(*order)).alias("place")))
    all_ = reduce(DataFrame.unionByName, parts).withColumn("relevance", F.greatest(F.lit(0.1), F.lit(0.95) - F.lit(0.1) * (F.col("place") - 1)))
    run = Window.orderBy(F.desc("relevance"), "section_no", "id")
    all_ = all_.withColumn("n", F.row_number().over(run)).withColumn("used", F.sum(F.octet_length("text")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("used") > budget_tokens * 4) & (F.col("n") > 1)
    broken = F.max(over).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return all_.withColumn("broken", broken).where(~F.col("broken")).select("section", "id", "text", "relevance", "n")


def store_decision(new: DataFrame, best: DataFrame) -> DataFrame:
    """(new_id, topic) against each one's best hit (new_id, id, topic, score): update in place or insert."""
    b = best.select("new_id", F.col("id").alias("target"), F.col("topic").alias("found_topic"), "score")
    x = new.join(b, "new_id", "left")
    same = (F.col("score") > MERGE_SCORE) & (F.col("found_topic") == F.col("topic"))
    return x.select("new_id", F.when(same, "update").otherwise("insert").alias("action"), F.when(same, F.col("target")).alias("target"))


def store_dedup(memories: DataFrame, new_id: str, topic: str, summary: str, values: list[float], as_of: str, project: str | None = None, effects: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """The state after a store: the best hybrid hit is updated in place if it scores over 0.85 in the same topic, else a memory is added."""
    best = hybrid(memories, summary, values, 1, 0, project, effects, as_of, index=index).where(F.col("score") > MERGE_SCORE)
    target = best.join(memories.where(F.col("topic") == topic).select("id"), "id").select("id", F.lit(True).alias("_same"))
    m = memories.join(F.broadcast(target), "id", "left")  # one row
    vector_type = memories.schema["embedding"].dataType
    change = {"summary": F.lit(summary), "weight": F.lit(1.0), "updated_at": at(as_of), "embedding": F.lit(values).cast(vector_type)}
    m = m.withColumns({c: F.when(F.col("_same"), v).otherwise(F.col(c)) for c, v in change.items()}).drop("_same")
    none = target.agg((F.count("*") == 0).alias("_none"))
    fresh = none.where("_none").select(F.lit(new_id).alias("id"), F.lit(topic).alias("topic"), F.lit(summary).alias("summary"), F.lit(1.0).alias("weight"), at(as_of).alias("created_at"), at(as_of).alias("updated_at"), F.lit(project).cast("string").alias("project"), F.lit(values).cast(vector_type).alias("embedding"))
    return m.unionByName(fresh, allowMissingColumns=True)


def nearest_of_many(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact k nearest rows, by cosine, of every query (query_id, vector): (query_id, rank, id, similarity).

    Queries and rows are cut into blocks of a bounded size that meet in one task
    each, of which only the k best of each query come out.
    """
    q = queries.where(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    r = rows.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((q, QUERY_BLOCK), (r, ROW_BLOCK)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim in set(a["vector"].map(len)) if len(a) else ():
            x, y = a[a["vector"].map(len) == dim], b[b["embedding"].map(len) == dim].sort_values("id")
            if not len(y):
                continue
            v, w = np.stack(x["vector"].to_numpy()), np.stack(y["embedding"].to_numpy())
            with np.errstate(all="ignore"):
                s = (v @ w.T) / (np.sqrt((v * v).sum(1))[:, None] * np.sqrt((w * w).sum(1))[None, :])
            s = np.where(np.isfinite(s), s, -np.inf)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for i, t in zip(x["query_id"], range(len(x)), strict=True):
                out += [(i, y["id"].iat[j], float(s[t, j])) for j in top[t] if s[t, j] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, similarity double"
    x = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(best, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
