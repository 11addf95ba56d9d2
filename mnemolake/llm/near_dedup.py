"""MinHash near-dedup by Order MinHash.

A text's five-word shingles are labelled with their occurrence number. Each of
several hash functions picks the least few labelled shingles, and the sketch
keeps them in text order, so that equal sketches tell of like words in like
order. Texts with an equal sketch are candidates, and a banded alignment decides:
with n and m shingles of which an alignment matches M, in order, the similarity
is M / (n + m - M), the Jaccard measure of what is aligned. Texts of at least
``SIMILARITY`` are linked, classes are the connected components of the links. A
text whose halves are swapped has all its shingles, but aligns only half of them.

How many shingles a sketch picks depends on a text's length (``KINDS``); ranges
of length overlap by more than two similar texts can differ, so both have
sketches of one kind. A pair at the least similarity in like order is missed with
a chance of about 1e-5.

Texts of equal words are one node, so copies never meet. A bucket of at most
``FEW`` texts compares its texts with each other; a larger one compares all
with a centre, the text whose buckets are largest together. Where larger buckets
then hold several components, what a text shares with the centre, and what else of
it other texts have, bound what any two can share (``hopeful``). Texts for which that
is too little for any partner are done, so a bucket of texts that have a passage in
common and are not alike costs no more than its rows; the others are compared if the
bound allows it for both. So within buckets no link is lost.

Defined cases: null and empty texts, and those of white space, are classes of
their own, one for each row; a text of one to four words is one shingle; rows
that repeat a doc_id are each classified; the class id is the least doc_id of
the class, null if it has none; ties in a sketch can't occur but between equal
labels; an empty table gives no rows; other columns are kept by ``keep_one`` and
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, free_name, kept, sieve, sift, small_batches, table
from ._components import components
from ._words import U, Words, mix, slices, utf8

SHINGLE = 5
SIMILARITY = 0.8
#: Kinds of sketches: for texts of these numbers of shingles, how many are picked, and how many sketches there are.
KINDS = ((1, 40, 3, 20), (32, 1 << 62, 5, 32))
#: Buckets of so many texts compare them with each other.
FEW = 8
#: Numbers that a text's sketches are worked out on at a time.
AT_ONCE = 2_000_000
#: Shingles that a lot of texts has beyond their centres.
LOT = 100_000


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def labelled(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingles mixed with their occurrence number: the rank among equal shingles of a text, in text order."""
    order = np.argsort(h ^ mix(doc.astype(U)), kind="stable")
    hs, ds = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    label = np.empty(len(h), U)
    label[order] = mix(hs + run.astype(U) * U(0xC2B2AE3D27D4EB4F))
    return label


def buckets(own: np.ndarray, kinds: tuple) -> np.ndarray:
    """The sketches of one text with the labels ``own``, in text order, each mixed with what kind and number it is."""
    out = []
    for lo, hi, picked, many in kinds:
        if not lo <= len(own) <= hi:
            continue
        k = min(picked, len(own))
        times, plus = _odd(many, picked)[:, None], _odd(many, picked + 1000)[:, None]
        step = max(1, AT_ONCE // len(own))
        for a in range(0, many, step):
            v = own * times[a : a + step] + plus[a : a + step]
            v ^= v >> U(32)
            least = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(own) else np.tile(np.arange(k), (len(v), 1))
            chosen = own[np.sort(least, axis=1)]
            s = mix(np.arange(a, a + len(v), dtype=U) + U(picked << 32))
            for i in range(k):
                s = mix((s ^ chosen[:, i]) * U(0x9E3779B97F4A7C15) + U(1))
            out.append(s)
    return np.concatenate(out) if out else np.zeros(0, U)


def sketches(data: np.ndarray, at: np.ndarray, kinds: tuple = KINDS) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(digest, number of words, buckets) of each text."""
    w = Words(data, at)
    h, doc = w.shingles(SHINGLE)
    label = labelled(h, doc)
    first = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return w.digests(), np.diff(w.bounds), [buckets(label[a:b], kinds) for a, b in zip(first[:-1], first[1:], strict=True)]


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements are equal from the start on."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


def diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Fewest insertions and deletions that turn ``a`` into ``b``, or ``most + 1`` if they are more.

    Furthest-reaching points of each diagonal of the band, one step a round over
    all of them at once; matching runs are measured by binary search on prefix
    hashes.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    c = U(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n, m), c, U)]))
    zero = np.zeros(1, U)
    pa_, pb = (np.concatenate([zero, np.cumsum(mix(x) * powers[: len(x)], dtype=U)]) for x in (a, b))

    def slide(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How far the points (i, i + d) can go along their diagonals."""
        j = i + d
        room = np.minimum(n - i, m - j)
        lo, hi = np.zeros_like(room), np.maximum(room, 0)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            left, right = pa_[i + mid] - pa_[i], pb[j + mid] - pb[j]
            up = np.abs(d)
            same = np.where(d >= 0, left * powers[up] == right, left == right * powers[up])
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return i + lo

    goal = m - n
    reach = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    if goal == 0 and reach[0] == n:
        return 0
    for e in range(1, most + 1):
        d = np.arange(-e, e + 1)
        far = np.full(2 * e + 1, -1, np.int64)
        far[2:] = reach  # a shingle of b more
        far[:-2] = np.maximum(far[:-2], reach + 1)  # a shingle of a more
        far = np.minimum(far, np.minimum(n, m - d))
        ok = (far >= 0) & (far + d >= 0)
        reach = np.where(ok, slide(np.where(ok, far, 0), np.where(ok, d, 0)), -(n + m))
        if -e <= goal <= e and reach[goal + e] == n:
            return e
    return most + 1


def align(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether an alignment of two shingle sequences reaches the similarity ``least``.

    Such an alignment skips no more than ``(n + m) (1 - least) / (1 + least)``
    shingles, so it stays within that many diagonals of the main one. Equal ends
    are taken off, shingles that the other text lacks can't match, and of the
    matches within the band the longest rising chain is the best alignment. Where
    shingles repeat so often that matches are many, the diagonals are followed.
    """
    n, m = len(a), len(b)
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    if abs(n - m) > band:
        return False
    head = _run(a, b)
    a, b = a[head:], b[head:]
    tail = _run(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    short = (n + m - band + 1) // 2 - head - tail  # matches still wanted
    if short <= 0:
        return True
    order = np.argsort(b, kind="stable")
    sb = b[order]
    lo, hi = np.searchsorted(sb, a, "left"), np.searchsorted(sb, a, "right")
    count = hi - lo
    if np.count_nonzero(count) < short or np.isin(b, a).sum() < short:
        return False
    if count.sum() > 8 * (n + m):
        return diagonals(a, b, band) <= band
    # Partners of one shingle from the last to the first, so that a chain takes one of them.
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    i, j = np.repeat(np.arange(len(a)), count), order[np.repeat(hi - 1, count) - nth]
    best: list[int] = []
    for x in j[np.abs(j - i) <= band].tolist():
        k = bisect_left(best, x)
        if k == len(best):
            best.append(x)
        else:
            best[k] = x
    return len(best) >= short


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """The share of unlike shingles, repeats counted: a distance, and no more than one less the similarity."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return 1 - both / max(1, len(a) + len(b) - both)


def _small(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes."""
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for s in range(0, batch.num_rows, step):
        yield batch.slice(s, step)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in column.to_pylist()]


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) -> with ``alike`` and ``apart`` of the two texts (digest, seq)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                x = list(zip(_sequences(part.column(2)), _sequences(part.column(3)), strict=True))
                alike = [align(a, b, least) for a, b in x]
                far = [apart(a, b) for a, b in x]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(alike, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "alike", "apart"])

    with_a = pairs.select("a", "b").join(texts.withColumnsRenamed({"digest": "a", "seq": "sa"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"digest": "b", "seq": "sb"}), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(check, "a binary, b binary, alike boolean, apart double")


def sketch_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest, words, buckets) of each row."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in slices(at):
                digest, n, s = sketches(data[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], ["doc_id", "digest", "words", "buckets"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, digest binary, words long, buckets array<long>")


def digest_rows(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the digest of each row's words, and null where there are no words."""
    schema = docs.select("*", F.lit(b"").alias(name)).schema
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(at_text))
            for a, b in slices(at):
                w = Words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                has = np.diff(w.bounds) > 0
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x if y else None for x, y in zip(w.digests(), has, strict=True)], pa.binary())], [*part.schema.names, name])

    schema[name].nullable = True
    return docs.mapInArrow(run, schema)


def _sequence_rows(docs: DataFrame, text: str) -> DataFrame:
    """(digest, seq): the shingles' hashes of each row with words, in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in slices(at):
                w = Words(data[at[a] : at[b]], at[a : b + 1] - at[a])
                h, doc = w.shingles(SHINGLE)
                first = np.searchsorted(doc, np.arange(w.n_docs + 1))
                rows = [(d, h[x:y].tobytes()) for d, x, y in zip(w.digests(), first[:-1], first[1:], strict=True) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], ["digest", "seq"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "digest binary, seq binary")


def _open(members: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets with two components at least."""
    held = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    return held.where(F.col("lo") != F.col("hi")).select("bucket", "n")


def _long_enough(a: Column, b: Column, least: float) -> Column:
    """Whether texts of so many shingles can be alike: no more can match than the shorter has."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _labelled(members: DataFrame, known: DataFrame) -> DataFrame:
    """``members`` with the component of each text, itself where it has no link."""
    k = known.withColumnsRenamed({"node": "digest", "component": "_c"})
    return members.drop("component").join(k, "digest", "left").withColumn("component", F.coalesce("_c", "digest")).drop("_c")


def _compare(members: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, alike, apart) looked at in the buckets (bucket, digest, size, n), and the crowded buckets with their centres ``a``."""
    few, crowd = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    fame = crowd.groupBy("digest").agg(F.sum("n").alias("fame"))
    centre = crowd.join(fame, "digest").groupBy("bucket").agg(F.max_by(F.struct("digest", "size"), F.struct("fame", "digest")).alias("c"))
    crowd = cut(crowd.select("bucket", "digest", "size").join(centre, "bucket").select("bucket", "digest", "size", F.col("c.digest").alias("a"), F.col("c.size").alias("a_size")))
    stars = crowd.where((F.col("a") != F.col("digest")) & _long_enough(F.col("size"), F.col("a_size"), least)).select("a", F.col("digest").alias("b"))
    pairs = _each_other(few.withColumn("component", F.col("digest")), "bucket", least).unionByName(stars).distinct()
    return cut(_verify(pairs, texts, least)), crowd


def _each_other(groups: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (a, b) of different components and near lengths within groups (key, digest, component, size) of ``FEW`` rows at most."""
    g = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("digest", "component", "size"))).alias("g"))
    x = g.select(F.explode("g").alias("x"), "g").select("x", F.explode("g").alias("y"))
    return x.where((F.col("x.digest") < F.col("y.digest")) & (F.col("x.component") != F.col("y.component")) & _long_enough(F.col("x.size"), F.col("y.size"), least)).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))


def _beyond(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, digest) -> (a, digest, shared, beyond): how many labelled shingles a text shares with its centre ``a``, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda h: labelled(h, np.zeros(len(h), np.int64))
        for batch in batches:
            for part in _small(batch):
                rest = [np.setdiff1d(own(x), own(c), assume_unique=True) for c, x in zip(_sequences(part.column(2)), _sequences(part.column(3)), strict=True)]
                shared = [len(x) // 8 - len(r) for x, r in zip(part.column(3).to_pylist(), rest, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array([r.view(np.int64) for r in rest], pa.list_(pa.int64()))], ["a", "digest", "shared", "beyond"])

    both = pairs.join(texts.withColumnsRenamed({"digest": "a", "seq": "sa"}), "a").join(texts, "digest").select("a", "digest", "sa", "seq")
    return both.mapInArrow(run, "a binary, digest binary, shared long, beyond array<long>")


def _others(far: DataFrame, lot: int = LOT) -> DataFrame:
    """(a, digest, shared, beyond) -> (a, digest, shared, others): how many shingles beyond the centre another text of that centre has, too.

    Rows are dealt into lots of about ``lot`` shingles, or more where there are many. A lot tells which it has once
    and which more often, in parts by hash; a part gathers all lots' shingles and
    tells each lot those that it has once and another lot has, too. So rows are lots
    times parts, not shingles, and one that many texts have comes once from each lot.
    """
    total = far.agg(F.sum(F.size("beyond"))).first()[0] or 0
    n = 1 + total // max(lot, 30 * isqrt(total))  # so rows are fewer than shingles at any size
    far = far.withColumn("lot", F.pmod(F.xxhash64("a", "digest"), F.lit(n)))
    longs = pa.list_(pa.int64())

    def keys(rows: pa.Table) -> list[np.ndarray]:
        return [mix(x.values.to_numpy().view(U) ^ np.frombuffer(a[:8], U)) for a, x in zip(rows["a"].to_pylist(), rows["beyond"].combine_chunks(), strict=True)]

    def tell(rows: pa.Table) -> pa.Table:
        token, count = np.unique(np.concatenate(keys(rows)), return_counts=True)
        part = (token % U(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, count, (parts, first) = token[order], count[order], np.unique(part[order], return_index=True)
        of = [[x[c == 1] if once else x[c > 1] for x, c in zip(np.split(token.view(np.int64), first[1:]), np.split(count, first[1:]), strict=True)] for once in (True, False)]
        return pa.table({"part": pa.array(parts), "lot": pa.array(np.full(len(parts), rows["lot"][0].as_py())), "once": pa.array(of[0], longs), "more": pa.array(of[1], longs)})

    def meet(rows: pa.Table) -> pa.Table:
        once, more = ([x.values.to_numpy() for x in rows[c].combine_chunks()] for c in ("once", "more"))
        token, count = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
        several = token[count > 1]
        return pa.table({"lot": rows["lot"], "tokens": pa.array([x[np.isin(x, several, assume_unique=True)] for x in map(np.concatenate, zip(once, more, strict=True))], longs)})

    def count(rows: pa.Table, told: pa.Table) -> pa.Table:
        several = np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in told["tokens"].combine_chunks())]).view(U)
        others = [np.count_nonzero(np.isin(x, several)) for x in keys(rows)]
        return pa.table({"a": rows["a"], "digest": rows["digest"], "shared": rows["shared"], "others": pa.array(others, pa.int64())})

    told = far.groupBy("lot").applyInArrow(tell, "part long, lot long, once array<long>, more array<long>")
    told = told.groupBy("part").applyInArrow(meet, "lot long, tokens array<long>")
    return far.groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(count, "a binary, digest binary, shared long, others long")


def hopeful(crowd: DataFrame, known: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The members of crowded buckets with several components that may be alike to another one.

    Two texts share no more shingles than the smaller of what each shares with the
    centre, and the smaller of what else of each other texts of the centre have. So a
    text whose part in the centre, with the most that any could add, is too small has
    no partner at all, and isn't compared.
    """
    m = _labelled(crowd, known)
    m = m.join(_open(m).select("bucket"), "bucket").where(F.col("a") != F.col("digest"))  # the centre has been compared
    of_centre = known.withColumnsRenamed({"node": "a", "component": "_ca"})
    m = cut(m.join(of_centre, "a", "left").withColumn("central", F.col("component") == F.coalesce("_ca", "a")).drop("_ca"))
    far = _others(kept(_beyond(m.select("a", "digest").distinct(), texts)))
    m = m.join(far, ["a", "digest"])
    most = m.groupBy("bucket").agg(F.max("others").alias("_most"), F.min("size").alias("_least"))
    both = F.col("shared") + F.least("others", "_most")
    return cut(m.join(most, "bucket").where(both >= least * (F.col("size") + F.greatest(F.col("_least"), both) - both) - 1e-6).drop("_most", "_least"))


def _left_over(crowd: DataFrame, known: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components in crowded buckets that may still be alike, one of them not of the centre's component."""
    m = hopeful(crowd, known, texts, least)
    cols = ("digest", "component", "size", "shared", "others", "central")
    x, y = (m.select("bucket", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "xy")
    both = F.least("x_shared", "y_shared") + F.least("x_others", "y_others")
    near = (F.col("x_component") != F.col("y_component")) & (F.col("y_central") | (F.col("x_digest") < F.col("y_digest")))
    near &= both * (1 + least) >= least * (F.col("x_size") + F.col("y_size")) - 1e-6
    pairs = x.where("NOT x_central").join(y, "bucket").where(near)
    return pairs.select(F.least("x_digest", "y_digest").alias("a"), F.greatest("x_digest", "y_digest").alias("b")).distinct()


def find_links(docs: DataFrame, rows: DataFrame, text: str, least: float = SIMILARITY) -> DataFrame:
    """(digest, component) of every word sequence that is linked to another one."""
    nodes = rows.where(F.col("words") > 0).groupBy("digest").agg(F.first("buckets").alias("buckets"), F.greatest(F.first("words") - (SHINGLE - 1), F.lit(1)).alias("size"))
    keys = nodes.select("digest", "size", F.explode("buckets").alias("bucket"), F.col("digest").alias("component"))
    members = cut(keys.join(_open(keys), "bucket").drop("component"))
    needed = members.select("digest").distinct()
    # A sieve of fixed size keeps most texts that no other is near out of the shuffle.
    near = sift(_sequence_rows(docs, text), F.xxhash64("digest"), sieve(needed.select(F.xxhash64("digest").alias("key")), "key"))
    texts = cut(near.join(needed, "digest").groupBy("digest").agg(F.first("seq").alias("seq")))

    # Pairs carry two texts' shingles each, so a batch of many rows would be large.
    with small_batches(docs.sparkSession):
        seen, crowd = _compare(members, texts, least)
        links = seen.where("alike").select("a", "b")
        rest = cut(_left_over(crowd, components(links), texts, least))
        links = cut(links.unionByName(_verify(rest, texts, least).where("alike").select("a", "b")))
    return components(links).select(F.col("node").alias("digest"), "component")


def _classes(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(digest, class_id, class_size, head) of every word sequence; ``head`` is the one whose row stays."""
    # Rows of one text first, then texts of one component, so that neither copies nor a large class meet as rows.
    own = rows.where(F.col("words") > 0).groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("least"), F.count("*").alias("n"))
    held = own.join(linked, "digest", "left")
    by = held.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("least", "digest")).alias("m"), F.sum("n").alias("size"))
    together = held.where(F.col("component").isNotNull()).join(by, "component").select("digest", F.col("m.least.id").alias("class_id"), F.col("size").alias("class_size"), F.col("m.digest").alias("head"))
    alone = held.where(F.col("component").isNull()).select("digest", F.col("least.id").alias("class_id"), F.col("n").alias("class_size"), F.col("digest").alias("head"))
    return together.unionByName(alone)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every row."""
    rows = cut(sketch_rows(docs, doc_id, text))
    classes = _classes(rows, find_links(docs, rows, text, least))
    out = rows.where(F.col("words") > 0).select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", "class_size")
    empty = rows.where(F.col("words") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(empty)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one with the least id, and of rows that repeat that id one. Rows without words all stay."""
    name, id_, nth = (free_name(docs, x) for x in ("_digest", "_least", "_nth"))
    rows = cut(sketch_rows(docs, doc_id, text))
    heads = _classes(rows, find_links(docs, rows, text, least)).where(F.col("digest") == F.col("head")).select(F.col("digest").alias("_head"), F.col("class_id").alias(id_))
    d = digest_rows(docs, text, name)
    kept = d.where(F.col(name).isNotNull()).join(heads.withColumnRenamed("_head", name), name).where(F.col(doc_id).eqNullSafe(F.col(id_))).drop(id_)
    if not rows.where(F.col("words") > 0).groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        # Rows alike in id and words: one of them, whichever.
        kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(name, doc_id).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return kept.select(*docs.columns).unionByName(d.where(F.col(name).isNull()).select(*docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
