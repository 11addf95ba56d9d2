"""The concept graph: neighbours, breadth-first search, labels, code queries, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.sources.snapshot import cut

# What relations may be called.
SYNONYMS = {
    "part_of": ("part_of", "partof", "contains", "has", "owns", "includes"),
    "depends_on": ("depends_on", "dependson", "depends-on", "imports", "uses", "requires"),
    "related_to": ("related_to", "relatedto", "references", "refers_to", "refers-to"),
    "contradicts": ("contradicts",),
    "refines": ("refines", "implements", "realizes", "satisfies"),
    "alternative_to": ("alternative_to", "alternativeto"),
    "caused_by": ("caused_by", "causedby"),
    "instance_of": ("instance_of", "instanceof"),
    "superseded_by": ("superseded_by", "supersededby"),
}
CALLS = ("related_to", "depends_on")
#: Two weights this near are equal.
SAME = 1.2e-7


def relation(c: Column) -> Column:
    """The canonical name; an unknown one in lower case."""
    low = F.lower(c)
    out = low
    for name, words in SYNONYMS.items():
        out = F.when(low.isin(*words), name).otherwise(out)
    return out


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation").unionByName(links.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "relation"))


def neighbours(links: DataFrame, id: str, kind: str | None = None) -> DataFrame:
    e = both_ways(links).where(F.col("a") == id)
    if kind is not None:
        e = e.where(F.col("relation") == kind)
    return e.select(F.col("b").alias("id")).distinct()


def bfs(links: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, depth) of all that ``depth`` steps reach, either direction. Stops when nothing new is found."""
    depth = max(1, min(depth, 10))
    edges = both_ways(links).select("a", "b").distinct()
    seen = links.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    front = seen
    for level in range(1, depth + 1):
        step = edges.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bfs_links(links: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """Links with an end that was expanded, each once."""
    inner = visited.where(F.col("depth") < depth).select("id")
    out = links.join(inner.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(links.join(inner.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*links.columns))
    return out.distinct()


def with_names(links: DataFrame, concepts: DataFrame) -> DataFrame:
    n = concepts.select("id", "name")
    s = n.withColumnsRenamed({"id": "source_id", "name": "source"})
    t = n.withColumnsRenamed({"id": "target_id", "name": "target"})
    x = links.join(s, "source_id", "left").join(t, "target_id", "left")
    return x.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("source", "target")})


def label_texts(labels: Column) -> Column:
    """``namespace:value`` of each label."""
    return F.transform(labels, lambda x: F.concat_ws(":", x["namespace"], x["value"]))


def with_label(concepts: DataFrame, memoir: str, label: str, limit: int = 20) -> DataFrame:
    return concepts.where((F.col("memoir_id") == memoir) & F.array_contains(label_texts(F.col("labels")), label)).orderBy(F.desc("confidence"), "id").limit(limit)


def with_labels(concepts: DataFrame, memoir: str, labels: list[str]) -> DataFrame:
    """Concepts that have all the labels."""
    want = F.array(*[F.lit(x) for x in labels])
    return concepts.where((F.col("memoir_id") == memoir) & (F.size(F.array_intersect(label_texts(F.col("labels")), want)) == len(set(labels))))


def callers(links: DataFrame, id: str, kinds: tuple[str, ...] = CALLS) -> DataFrame:
    return links.where((F.col("target_id") == id) & F.col("relation").isin(*kinds)).select(F.col("source_id").alias("id"), "relation", "weight")


def callees(links: DataFrame, id: str, kinds: tuple[str, ...] = CALLS) -> DataFrame:
    return links.where((F.col("source_id") == id) & F.col("relation").isin(*kinds)).select(F.col("target_id").alias("id"), "relation", "weight")


def implementors(links: DataFrame, id: str) -> DataFrame:
    return callers(links, id, ("related_to", "instance_of", "refines"))


def memoir_stats(concepts: DataFrame, links: DataFrame, memoir: str) -> DataFrame:
    c = concepts.where(F.col("memoir_id") == memoir)
    n_links = links.join(c.select(F.col("id").alias("source_id")), "source_id", "left_semi").agg(F.count("*").alias("links"))
    return c.agg(F.count("*").alias("concepts"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")).crossJoin(F.broadcast(n_links))  # one row


def label_counts(concepts: DataFrame, memoir: str) -> DataFrame:
    return concepts.where(F.col("memoir_id") == memoir).select(F.explode(label_texts(F.col("labels"))).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def refine(concepts: DataFrame, id: str, definition: str, memory_ids: tuple[str, ...] = ()) -> DataFrame:
    """A new definition, a tenth more confidence, a revision more, and the memories it comes from merged in."""
    this = F.col("id") == id
    if memory_ids and "source_memory_ids" in concepts.columns:
        more = F.array_union(F.coalesce("source_memory_ids", F.array().cast("array<string>")), F.array(*[F.lit(m) for m in memory_ids]))
        concepts = concepts.withColumn("source_memory_ids", F.when(this, more).otherwise(F.col("source_memory_ids")))
    return concepts.withColumns({"definition": F.when(this, definition).otherwise(F.col("definition")), "confidence": F.when(this, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")), "revision": F.when(this, F.col("revision") + 1).otherwise(F.col("revision"))})


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(memoir_id, name, definition, labels, ...) by memoir and name, with ``action``: created, updated, unchanged, kept."""
    key = ["memoir_id", "name"]
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("id", "definition", "labels", "confidence", "revision")])
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("id", "definition", "labels")])
    x = o.join(n, key, "full_outer")
    same = (F.col("o_definition") == F.col("n_definition")) & (F.array_sort("o_labels") == F.array_sort("n_labels"))
    action = F.when(F.col("n_id").isNull(), "kept").when(F.col("o_id").isNull(), "created").when(same, "unchanged").otherwise("updated")
    x = x.withColumn("action", action)
    up = F.col("action") == "updated"
    return x.select(F.coalesce("o_id", "n_id").alias("id"), *key, *[F.when(up | F.col("o_id").isNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in ("definition", "labels")], F.coalesce("o_confidence", F.lit(0.5)).alias("confidence"), (F.coalesce("o_revision", F.lit(1)) + up.cast("int")).alias("revision"), "action")


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """By source, target and canonical relation; a changed weight updates."""
    key = ["source_id", "target_id", "relation"]
    n = new.where(F.col("source_id") != F.col("target_id")).withColumn("relation", relation(F.col("relation"))).groupBy(*key).agg(F.max("weight").alias("n_weight"))
    x = old.select(*key, F.col("weight").alias("o_weight")).join(n, key, "full_outer")
    action = F.when(F.col("n_weight").isNull(), "kept").when(F.col("o_weight").isNull(), "created").when(F.abs(F.col("o_weight") - F.col("n_weight")) > SAME, "updated").otherwise("unchanged")
    return x.select(*key, F.coalesce("n_weight", "o_weight").alias("weight"), action.alias("action"))


def resolve_edges(edges: DataFrame, concepts: DataFrame, memoir: str) -> tuple[DataFrame, DataFrame]:
    """Edges by name (source, target, relation, weight) as links by id, and those that name unknown concepts."""
    ids = concepts.where(F.col("memoir_id") == memoir).select("id", "name")
    x = edges.join(ids.withColumnsRenamed({"id": "source_id", "name": "source"}), "source", "left").join(ids.withColumnsRenamed({"id": "target_id", "name": "target"}), "target", "left")
    good = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    return x.where(good).select("source_id", "target_id", "relation", "weight"), x.where(~good).select("source", "target", "relation")


def prune_concepts(concepts: DataFrame, links: DataFrame, memoir: str, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts of the memoir whose name ``keep`` (name) lacks go, with their links."""
    return delete_concepts(concepts, links, concepts.where(F.col("memoir_id") == memoir).join(keep.select("name"), "name", "left_anti"))


def named(table: DataFrame, name: str, memoir: str | None = None) -> DataFrame:
    """Memoirs, or with ``memoir`` its concepts, of a name."""
    return table.where((F.col("name") == name) & (F.lit(True) if memoir is None else F.col("memoir_id") == memoir))


def listed(table: DataFrame, memoir: str | None = None) -> DataFrame:
    """Memoirs, or the concepts of one, by name."""
    return table.where(F.lit(True) if memoir is None else F.col("memoir_id") == memoir).orderBy("name", "id")


def search_labelled(concepts: DataFrame, found: DataFrame, label: str, limit: int = 20) -> DataFrame:
    """Concepts found by full text (id, rank) that have the label, best first."""
    have = concepts.where(F.array_contains(label_texts(F.col("labels")), label)).select("id", "name")
    return found.select("id", "rank").join(have, "id").orderBy("rank", "name", "id").limit(limit)


def with_memoir_names(concepts: DataFrame, memoirs: DataFrame) -> DataFrame:
    return concepts.join(memoirs.select(F.col("id").alias("memoir_id"), F.col("name").alias("memoir")), "memoir_id", "left")


def add_memoirs(memoirs: DataFrame, new: DataFrame) -> DataFrame:
    """Adds memoirs whose name isn't taken."""
    return memoirs.unionByName(new.dropDuplicates(["name"]).join(memoirs.select("name"), "name", "left_anti"), allowMissingColumns=True)


def update_memoir(memoirs: DataFrame, id: str, as_of: str, name: str | None = None, description: str | None = None) -> DataFrame:
    this = F.col("id") == id
    change = {k: F.lit(v) for k, v in (("name", name), ("description", description)) if v is not None}
    if "updated_at" in memoirs.columns:
        change["updated_at"] = F.lit(as_of).cast("timestamp_ntz")
    return memoirs.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in change.items()})


def add_concepts(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """Adds concepts whose memoir has none of their name, at half confidence unless told, in their first revision."""
    fresh = new.dropDuplicates(["memoir_id", "name"]).join(concepts.select("memoir_id", "name"), ["memoir_id", "name"], "left_anti")
    held = {"confidence": F.lit(0.5), "revision": F.lit(1)}
    fresh = fresh.withColumns({c: F.coalesce(c, v) if c in fresh.columns else v for c, v in held.items()})
    return concepts.unionByName(fresh, allowMissingColumns=True)


def update_concept(concepts: DataFrame, id: str, definition: str | None = None, confidence: float | None = None) -> DataFrame:
    this = F.col("id") == id
    change = {k: F.lit(v) for k, v in (("definition", definition), ("confidence", confidence)) if v is not None}
    return concepts.withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in change.items()})


def delete_concepts(concepts: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The concepts in ``gone`` (id) go, with their links."""
    left = links.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return concepts.join(gone.select("id"), "id", "left_anti"), left.select(*links.columns)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Adds links (source_id, target_id, relation, weight) under their canonical relation; a link that is there stays."""
    key = ["source_id", "target_id", "relation"]
    fresh = new.where(F.col("source_id") != F.col("target_id")).withColumn("relation", relation(F.col("relation"))).groupBy(*key).agg(F.max("weight").alias("weight"))
    return links.unionByName(fresh.join(links.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    key = ["source_id", "target_id", "relation"]
    return links.join(gone.withColumn("relation", relation(F.col("relation"))).select(*key), key, "left_anti").select(*links.columns)


def links_of(links: DataFrame, id: str, outgoing: bool = True) -> DataFrame:
    return links.where(F.col("source_id" if outgoing else "target_id") == id)


def delete_memoir(memoirs: DataFrame, concepts: DataFrame, links: DataFrame, memoir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = prune_concepts(concepts, links, memoir, concepts.where(F.lit(False)))
    return memoirs.where(F.col("id") != memoir), c, k


def understanding(concepts: DataFrame, memoir: str, limit: int = 8) -> DataFrame:
    """The first concepts by name with the memoir's total."""
    c = concepts.where(F.col("memoir_id") == memoir)
    return c.orderBy("name", "id").limit(limit).crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))  # one row
