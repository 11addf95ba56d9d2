"""N-gram Jaccard self-join by prefix filters under several global orders.

A text's set is its distinct three-word shingles. Two sets are linked when their
Jaccard measure is at least ``ALIKE``; then, under any global order of shingles,
they share one of the first few of either (the prefix filter: so many that no
alike set can miss all of them; fewer of the smaller set than of the larger).
Candidates must do so under each of several orders. Filters are intersected, then
sets are compared exactly.

* The first two orders are hashes. A shingle that more than ``FEW`` texts have in their
  prefix is crowded there and lists no pairs. A pair that meets only in crowded
  shingles is left over, which takes two texts with crowded prefixes in each order.
* Only texts that meet another under the first order are looked at under the second.
  There, all shingles of the lowest ``1 / SPAN`` of hashes tell more: an alike text
  misses no more of them than of all shingles, so texts that share fewer are out.
* The texts with crowded prefixes in each order get two more orders: rare shingles
  first (their number of texts, up to ``FEW``), ties by either hash. So shared
  passages and lines leave the prefixes, and what stays crowded are groups of
  near copies.
* In these, all texts of a crowded shingle are compared with one of them, the one with
  the fewest shingles of its own. Where that leaves more than one component, texts of
  different components are compared, if the filters and their own shingles allow a
  link (shingles that no other text has can't be shared).

Links are found or ruled out exactly; pairs within a component are not listed. Equal
sets are one node. Of a crowded shingle, ``FEW + 1`` rows a slice of texts go to its
task and say that it is crowded; the others go elsewhere, so none is gathered.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; with one or two words, the whole sequence is the one shingle; only A-Z
are lower-cased; rows that repeat an id are texts of their own; a component's
id is the least doc_id in it, null if it has none; texts may be of any length; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import kept, table
from ._components import components
from ._words import U, Words, mix, slices, utf8

SHINGLE = 3
#: The least Jaccard measure of a link, as a fraction.
ALIKE = (9, 10)
#: A shingle in the prefixes of more texts than this is crowded.
FEW = 8
#: Hash orders: what a shingle's hash is mixed with.
ORDERS = (0x51AFD7ED558CCD6D, 0x2545F4914F6CDD1D)
#: Rows of keys that are broadcast at most, 16 bytes each.
BROADCAST_KEYS = 1_000_000
#: One in so many hashes of the second order is told of each text that is looked at.
SPAN = 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``spread`` is the token; ``meta`` holds the set's size, a number of its own, and the flags.
POSTING = "spread long, meta long, node long"
SHORT, PREFIX, ALONE = 1, 2, 4


def longest(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix lengths of sets of n: as the larger (or any) side of a pair, and as the smaller."""
    up, down = ALIKE
    least = -(-n * up // down)
    both = -(-2 * n * up // (up + down))
    return n - least + 1, n - both + 1


def sets(data: np.ndarray, at: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, text, first shingle of each text, digest and node of each set); a text's shingles are distinct and sorted."""
    h, doc = Words(LOWER[data], at).shingles(SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    first = np.searchsorted(doc, np.arange(len(at)))
    n, key = np.diff(first).astype(U), np.zeros((len(at) - 1, 2), U)
    for i, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h * U(c) + U(i)), dtype=U)])
        key[:, i] = mix(total[first[1:]] - total[first[:-1]] + n * U(0x9E3779B97F4A7C15))
    return h, doc, first, key, mix(key[:, 0] ^ mix(key[:, 1] + U(salt))).view(np.int64)


def _each_slice(batches: Iterator[pa.RecordBatch], column: int, salt: int) -> Iterator[tuple]:
    for batch in batches:
        data, at = utf8(batch.column(column))
        for a, b in slices(at):
            yield batch.slice(a, b - a), *sets(data[at[a] : at[b]], at[a : b + 1] - at[a], salt)


def _meta(n: np.ndarray, own: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return n.astype(np.int64) << 36 | own.astype(np.int64) << 8 | flags


def _postings(token: np.ndarray, meta: np.ndarray, node: np.ndarray, spread: bool = True) -> pa.RecordBatch:
    """Rows for the tasks of their tokens; if ``spread``, ``FEW + 1`` rows of a token, and the others for any task, each alone."""
    if spread:
        order = np.argsort(token, kind="stable")
        t = token[order]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], t[1:] != t[:-1]])[: len(t)], np.arange(len(t)), 0))
        rank = np.empty(len(t), np.int64)
        rank[order] = np.arange(len(t)) - start
        more = rank > FEW
        token, meta = np.where(more, mix(token ^ node.view(U)), token), np.where(more, meta | ALONE, meta)
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(meta), pa.array(node)], ["spread", "meta", "node"])


def hash_prefixes(seed: int, span: int | None, salt: int):
    """Postings of the prefixes under a hash order and, with ``span``, of all shingles in the lowest part of the hashes; ``own`` is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, doc, first, _, node in _each_slice(batches, 0, salt):
            n = np.diff(first)
            whole, small = longest(n)
            t = mix(h ^ U(seed))
            order = np.lexsort((t, doc))
            t, place = t[order], np.arange(len(doc)) - first[doc]
            low = t < U((1 << 64) // span) if span else np.zeros(len(t), bool)
            own = np.bincount(doc[low], minlength=len(n))
            keep = (place < whole[doc]) | low
            t, d, place = t[keep], doc[keep], place[keep]
            flags = SHORT * (place < small[d]) + PREFIX * (place < whole[d])
            yield _postings(t, _meta(n[d], own[d], flags), node[d])

    return run


def all_shingles(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, doc, first, _, node in _each_slice(batches, 0, salt):
            n = np.diff(first)[doc]
            yield _postings(h, _meta(n, np.zeros(len(n), np.int64), PREFIX), node[doc], False)

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str, whole: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, number of the key's group, size of the group) of batches sorted by ``key``, a group in one piece.

    Unless ``whole``, only ``FEW + 1`` rows of a group wait for its end; of a larger one
    the rest comes in pieces, each with the size ``FEW + 1``.
    """
    kept, crowded = None, False  # rows of the last group; whether it has been told to be crowded

    def groups(t: pa.Table) -> np.ndarray:
        v = t[key].to_numpy()
        return np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))

    def end(t: pa.Table, crowded: bool):
        g = groups(t)
        size = np.bincount(g)[g]
        return t, g, np.where(g == 0, FEW + 1, size) if crowded else size

    for batch in batches:
        new = pa.Table.from_batches([batch])
        if not len(new):
            continue
        t = pa.concat_tables([kept, new]) if kept is not None else new
        g = groups(t)
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield end(t.slice(0, last), crowded)
            crowded = False
        kept = t.slice(last)
        if not whole and len(kept) > FEW + 1:
            t = kept.slice(1)
            yield t, np.zeros(len(t), np.int64), np.full(len(t), FEW + 1)
            kept, crowded = kept.slice(0, 1), True
    if kept is not None:
        yield end(kept, crowded)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What rows sorted by token, size and node tell: pairs (a, b) that share a token; texts ``a`` with a crowded one (n is null); how many tokens of a text are shared (n, of the number ``own``)."""
    up, down = ALIKE
    for t, g, size in _runs(batches, "spread", False):
        meta, node = t["meta"].to_numpy(), t["node"].to_numpy()
        n, own, alone = meta >> 36, meta >> 8 & (1 << 28) - 1, meta & ALONE > 0
        first = meta & PREFIX > 0
        crowd = np.unique(node[((size > FEW) | alone) & first])
        out = [(crowd, None, None, None)]
        for d in range(1, FEW):
            i = np.arange(max(0, len(g) - d))
            i = i[(g[i] == g[i + d]) & (size[i] <= FEW) & first[i + d] & (meta[i] & SHORT > 0) & ~alone[i]]
            i = i[(down * n[i] >= up * n[i + d]) & (node[i] != node[i + d])]
            out.append((node[i], node[i + d], None, None))
        shared, k, times = np.unique(node[(size > 1) | alone], return_index=True, return_counts=True)
        k = np.flatnonzero((size > 1) | alone)[k]
        out.append((shared, None, times, own[k]))
        for a, b, times, own in out:
            if len(a):
                cols = (a, b, times, own)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in cols], ["a", "b", "n", "own"])


def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, token, texts) of shingles that several texts have, with their number up to ``FEW + 1``. Rows come sorted by token."""
    for t, _, size in _runs(batches, "spread", False):
        keep = size > 1
        n, size = t["meta"].to_numpy()[keep] >> 36, np.minimum(size[keep], FEW + 1)
        yield pa.RecordBatch.from_arrays([pa.array(t["node"].to_numpy()[keep]), pa.array(n, pa.int32()), pa.array(t["spread"].to_numpy()[keep]), pa.array(size, pa.int32())], ["node", "n", "token", "texts"])


def rare_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes under the orders that put rare shingles first, with the number of texts of each. Rows come sorted by node."""
    for t, g, _ in _runs(batches, "node", True):
        token = t["token"].to_numpy()
        order = np.lexsort((token, g))
        fresh = np.ones(len(t), bool)  # rows that repeat id and text tell their shingles again
        fresh[1:] = (np.diff(g[order]) > 0) | (token[order][1:] != token[order][:-1])
        t, g = t.take(pa.array(order[fresh])), g[order[fresh]]
        n, token, texts, node = t["n"].to_numpy().astype(np.int64), t["token"].to_numpy().view(U), t["texts"].to_numpy(), t["node"].to_numpy()
        first = np.searchsorted(g, np.arange(g[-1] + 1))
        own = n - np.bincount(g)[g]
        whole, small = longest(n)
        for r, seed in enumerate(ORDERS):
            order = np.lexsort((mix(token ^ U(seed)), texts, g))
            place = np.arange(len(g)) - first[g] + own
            rows = order[place < whole]
            place = place[place < whole]
            flags = PREFIX + SHORT * (place < small[rows])
            cols = (np.full(len(rows), r), token[rows].view(np.int64), node[rows], n[rows], own[rows], _meta(n[rows], own[rows], flags))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(flags & SHORT > 0), pa.array(texts[rows] > FEW)], ["r", "token", "node", "n", "own", "meta", "short", "crowded"])


RARE = "r long, token long, node long, n long, own long, meta long, short boolean, crowded boolean"


def whole_sets(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _, first, _, node in _each_slice(batches, 0, salt):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.LargeListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _possible(x: str, y: str) -> Column:
    """Whether sizes and own shingles of two texts allow a link."""
    shared = F.least(F.col(f"{x}n") - F.col(f"{x}own"), F.col(f"{y}n") - F.col(f"{y}own"))
    return shared * ALIKE[1] >= (F.col(f"{x}n") + F.col(f"{y}n") - shared) * ALIKE[0]


class Join:
    """One run over a table; ``rows`` are (doc_id, key, node, n)."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        kind = dict(docs.dtypes)[doc_id]
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
        self.salt = 0
        while True:

            def describe(batches: Iterator[pa.RecordBatch], salt: int = self.salt) -> Iterator[pa.RecordBatch]:
                for rows, _, _, first, digest, node in _each_slice(batches, 1, salt):
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(node), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array(np.diff(first), pa.int64())], ["doc_id", "key", "node", "digest", "n"])

            self.rows = kept(self.docs.mapInArrow(describe, f"doc_id {kind}, key long, node long, digest binary, n long"))
            self.nodes = self.rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.min("doc_id").alias("least"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
            if self.nodes.where("lo != hi").isEmpty():
                break
            self.salt += 1  # two sets have one number: others, then

    def texts(self, nodes: DataFrame | None) -> DataFrame:
        """(text) of one row for each of the nodes; of more, if rows repeat id and text."""
        keys = self.nodes.join(nodes, "node", "left_semi") if nodes is not None else self.nodes
        keys = keys.select("rep.doc_id", "rep.key")
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        on = self.docs["doc_id"].eqNullSafe(keys["doc_id"]) & (self.docs["key"] == keys["key"])
        return self.docs.join(F.broadcast(keys) if few else keys, on, "left_semi").select("text")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, alike) of the pairs: how many shingles both have, and whether they are linked."""
        pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = kept(self.texts(ends).mapInArrow(whole_sets(self.salt), "node long, shingles array<long>").dropDuplicates(["node"]))
        both = pairs.join(own.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(own.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
        rows = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("n"))
        return kept(rows.select("a", "b", "shared", (F.col("shared") * ALIKE[1] >= (F.col("n") - F.col("shared")) * ALIKE[0]).alias("alike")))

    @staticmethod
    def met(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, nodes with crowded prefixes, nodes that share all but few of the shingles told)."""
        dealt = postings.select("spread", "meta", "node").repartition("spread").sortWithinPartitions("spread", "meta", "node")
        out = kept(dealt.mapInArrow(meet, "a long, b long, n long, own long"))
        counts = out.where("own IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        return out.where("b IS NOT NULL").select("a", "b").distinct(), out.where("b IS NULL AND own IS NULL").select(F.col("a").alias("node")).distinct(), counts

    def hashed(self) -> tuple[DataFrame, DataFrame]:
        """(candidate pairs, nodes that only other orders can tell)."""
        one, crowd, counts = self.met(self.texts(None).mapInArrow(hash_prefixes(ORDERS[0], None, self.salt), POSTING))
        sizes = self.nodes.join(self.rows.groupBy("node").agg(F.first("n").alias("size")), "node").select("node", "size")
        two, crowded, counts = self.met(self.texts(counts.select("node")).mapInArrow(hash_prefixes(ORDERS[1], SPAN, self.salt), POSTING))
        up, down = ALIKE
        # An alike set misses no more of the shingles told than of all.
        alike = kept(counts.join(sizes, "node").where(F.col("n") >= F.col("own") - (F.col("size") - F.ceil(F.col("size") * up / down))).select("node"))
        crowd, crowded = (c.join(alike, "node", "left_semi") for c in (crowd, crowded))
        both = kept(crowd.join(crowded, "node", "left_semi"))

        def held(pairs: DataFrame, crowd: DataFrame) -> DataFrame:
            x, y = (alike.withColumnRenamed("node", c).join(crowd.select(F.col("node").alias(c), F.lit(True).alias(f"c{c}")), c, "left") for c in "ab")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            return pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("ca") & F.col("cb")).alias("crowded"))

        one, two = held(one, crowded), held(two, crowd)  # each with whether the other order leaves it open
        either = one.withColumn("k", F.lit(1)).unionByName(two.withColumn("k", F.lit(2))).groupBy("a", "b").agg(F.bit_or("k").alias("k"), F.bool_or("crowded").alias("crowded"))
        return either.where((F.col("k") == 3) | F.col("crowded")).select("a", "b"), both

    def rare(self, nodes: DataFrame) -> DataFrame:
        """Prefixes of these nodes under the orders with rare shingles first."""
        tokens = self.texts(nodes).mapInArrow(all_shingles(self.salt), POSTING).repartition("spread").sortWithinPartitions("spread")
        shared = tokens.mapInArrow(common, "node long, n int, token long, texts int").repartition("node").sortWithinPartitions("node")
        return kept(shared.mapInArrow(rare_prefixes, RARE))

    def components(self) -> DataFrame:
        """(node, component) of linked nodes."""
        first, nodes = self.hashed()
        prefixes = self.rare(nodes)
        rare = None
        for r in range(len(ORDERS)):
            met = self.met(prefixes.where(~F.col("crowded") & (F.col("r") == r)).withColumnRenamed("token", "spread"))[0].withColumn("orders", F.lit(1 << r))
            rare = met if rare is None else rare.unionByName(met)
        hot = prefixes.where("crowded").select("r", "token", "node", "n", "own", "short").distinct()
        head = hot.groupBy("r", "token").agg(F.min(F.struct("own", "node", "n")).alias("c")).select("r", "token", F.col("c.node").alias("c"), F.col("c.n").alias("cn"), F.col("c.own").alias("cown"))
        star = hot.join(head, ["r", "token"])
        seen = self.compared(first.unionByName(rare.select("a", "b")).unionByName(star.where(_possible("", "c")).select(F.col("node").alias("a"), F.col("c").alias("b"))))
        links = seen.where("alike").select("a", "b")
        at = components(links)
        known = at.withColumnsRenamed({"node": "c", "component": "at_c"})
        place = star.join(at, "node", "left").join(known, "c", "left").withColumns({"component": F.coalesce("component", "node"), "at_c": F.coalesce("at_c", "c")})
        mixed = place.groupBy("r", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("r", "token")
        place = place.join(mixed, ["r", "token"], "left_semi").where("node != c").select("*", F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
        # What a text shares with the centre, and what else of it others have; all that others have, where the two weren't compared.
        held = F.col("n") - F.col("own")
        place = place.join(seen.select("a", "b", "shared"), ["a", "b"], "left").withColumns({"with": F.coalesce("shared", held), "other": F.coalesce(held - F.col("shared"), held)})
        place = kept(place.select("r", "token", "node", "n", "own", "short", "component", "with", "other", (F.col("component") == F.col("at_c")).alias("central")))
        x, y = (place.select("r", "token", *(F.col(c).alias(f"{p}{c}") for c in ("node", "n", "own", "short", "component", "with", "other", "central"))) for p in "xy")
        least = F.least(F.least("xwith", "ywith") + F.least("xother", "yother"), F.col("xn") - F.col("xown"), F.col("yn") - F.col("yown"))
        possible = least * ALIKE[1] >= (F.col("xn") + F.col("yn") - least) * ALIKE[0]
        once = F.col("ycentral") | (F.col("xnode") < F.col("ynode"))
        short = F.when((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & F.col("xshort")), F.col("xshort")).otherwise(F.col("yshort"))
        rest = x.where("NOT xcentral").join(y, ["r", "token"]).where((F.col("xcomponent") != F.col("ycomponent")) & once & short & possible)
        rest = rest.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"), F.expr("shiftleft(1, CAST(r AS INT))").alias("orders"))
        sorted_pairs = rare.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "orders")
        rest = rest.distinct().unionByName(sorted_pairs).groupBy("a", "b").agg(F.bit_or("orders").alias("orders")).where(F.col("orders") == (1 << len(ORDERS)) - 1)
        more = self.compared(rest.join(seen, ["a", "b"], "left_anti")).where("alike").select("a", "b")
        return components(links.unionByName(more))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, and the least doc_id that links lead to."""
    run = Join(docs, doc_id, text)
    at = run.components()
    nodes = run.nodes.select("node", "least").join(at, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id")
    out = run.rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Equal sets are one node; pairs that share a shingle are counted, and the least doc_id spreads along the links.
OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS k, s FROM s),
g AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE k IS NOT NULL GROUP BY k),
x AS (SELECT id, n, unnest(s) AS t FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM x a JOIN x b ON a.t = b.t AND a.id < b.id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT id AS a, id AS c FROM g UNION SELECT e.b, c.c FROM c JOIN e ON c.a = e.a WHERE c.c < e.b),
m AS (SELECT a, min(c) AS c FROM c GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.c, k.doc_id) AS component_id FROM k LEFT JOIN g USING (k) LEFT JOIN m ON m.a = g.id
"""
