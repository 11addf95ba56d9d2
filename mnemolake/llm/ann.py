"""Approximate nearest neighbours by stable projections in a kd-tree.

Largest inner products are nearest points once every vector gets one more
component that makes all norms equal. The lengthened vectors are projected by a
few Gaussian (2-stable) directions. A kd-tree over the projections is split at
its top into cells, spread over the cluster, and each cell holds its own
subtree. A query first searches its home cell, which bounds its k-th distance;
it then visits the cells that the stopping test can't rule out. Within a cell,
projected neighbours come in growing distance and are verified by their true
distance until the chi-square test holds: squared projected distance over
squared true distance follows chi-square with as many degrees of freedom as
there are directions, so once the projected distance passes that quantile of the
current k-th true distance, a nearer point is still unseen with a chance of at
most ``1 - CONFIDENCE``.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id, which couldn't be named. Vectors of another length have
no inner product with these: each length is searched by itself. Equal vectors are
one point with its least ids, so that copies, however many, meet in no task. Ties
go to the smaller id. Rows that repeat an id are one candidate for each vector
they hold, and one query that gets the best of their answers; fewer candidates
than k give all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, table

DIRECTIONS = 8
CONFIDENCE = 0.97
#: Points of a cell on average, and of a leaf of its subtree.
CELL = 8_192
LEAF = 64
#: Splits are fitted on at most this many points.
SAMPLE = 50_000
QUERY_BLOCK = 2_048
SEED = 11


def chi2_quantile(p: float, k: int) -> float:
    """The p quantile of chi-square with k degrees of freedom, by bisection on the series of its distribution."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 20.0 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def usable(v: Column) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def split_tree(points: np.ndarray, cells: int) -> tuple:
    """[axis, value, left, right] nodes down to leaves that are cell numbers, and the number of cells."""
    n = [0]

    def grow(p: np.ndarray, many: int):
        spread = p.max(0) - p.min(0) if len(p) else np.zeros(1)
        axis = int(np.argmax(spread))
        if many <= 1 or not len(p) or spread[axis] == 0:
            n[0] += 1
            return n[0] - 1
        value = float(np.median(p[:, axis]))
        left = p[:, axis] <= value
        if left.all():
            left = p[:, axis] < value
            value = float(np.nextafter(value, -np.inf))
        half = many // 2
        return [axis, value, grow(p[left], half), grow(p[~left], many - half)]

    return grow(points, cells), max(1, n[0])


def cells_of(tree, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)

    def go(node, at: np.ndarray) -> None:
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            left = p[at, node[0]] <= node[1]
            go(node[2], at[left])
            go(node[3], at[~left])

    go(tree, np.arange(len(p)))
    return out


def boxes_of(tree, m: int, n: int) -> np.ndarray:
    """(cells, 2, m): the region of each cell."""
    out = np.empty((n, 2, m))

    def go(node, lo: np.ndarray, hi: np.ndarray) -> None:
        if isinstance(node, int):
            out[node] = lo, hi
            return
        axis, value, left, right = node
        low, high = lo.copy(), hi.copy()
        high[axis], low[axis] = value, value
        go(left, lo, high)
        go(right, low, hi)

    go(tree, np.full(m, -np.inf), np.full(m, np.inf))
    return out


class KdTree:
    """Leaves of about ``LEAF`` points with their bounding boxes, visited in order of distance, twice as many at each step."""

    def __init__(self, p: np.ndarray):
        boxes, self.leaves = [], []

        def grow(at: np.ndarray) -> None:
            q = p[at]
            lo, hi = q.min(0), q.max(0)
            axis = int(np.argmax(hi - lo))
            if len(at) <= LEAF or hi[axis] == lo[axis]:
                boxes.append((lo, hi))
                self.leaves.append(at)
                return
            half = len(at) // 2
            order = np.argpartition(q[:, axis], half)
            grow(at[order[:half]])
            grow(at[order[half:]])

        grow(np.arange(len(p)))
        self.lo, self.hi = (np.stack(x) for x in zip(*boxes, strict=True))

    def near(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared projected distance of the nearest box, points) of the leaves, nearest first."""
        gap = np.maximum(0, np.maximum(self.lo - q, q - self.hi))
        d = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(d, kind="stable")
        a, step = 0, 1
        while a < len(order):
            part = order[a : a + step]
            yield float(d[part[0]]), np.concatenate([self.leaves[i] for i in part])
            a, step = a + step, 2 * step


def search_cell(points: np.ndarray, projected: np.ndarray, queries: np.ndarray, q_projected: np.ndarray, bound: np.ndarray, k: int, ratio: float, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of up to k points a query, those of equal score in the order of ``points``.

    ``bound`` is the squared true distance within which the k-th point is known to be.
    """
    tree = KdTree(projected)
    qs, ps, ss = [], [], []
    for i, (q, z, near) in enumerate(zip(queries, q_projected, bound, strict=True)):
        kth, score, at = near, np.zeros(0), np.zeros(0, np.int64)
        base = float(q @ q) + top
        for d, leaf in tree.near(z):
            if d > ratio * kth:
                break
            s = points[leaf] @ q
            score, at = np.concatenate([score, s]), np.concatenate([at, leaf])
            if len(score) >= k:
                if len(score) > 4 * k + LEAF:
                    least = -np.partition(-score, k - 1)[k - 1]
                    keep = score >= least
                    score, at = score[keep], at[keep]
                kth = min(kth, max(0.0, base - 2 * float(-np.partition(-score, k - 1)[k - 1])))
        order = np.lexsort((at, -score))[:k]
        score, at = score[order], at[order]
        qs.append(np.full(len(at), i)), ps.append(at), ss.append(score)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((qs, np.int64), (ps, np.int64), (ss, np.float64)))


def neighbours(rows: DataFrame, is_query: Column, k: int, row_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every query row, itself apart."""
    spark = rows.sparkSession
    v = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    v = cut(v.where(F.col("id").isNotNull() & usable(F.col("v"))))
    lengths = sorted(r["dim"] for r in v.groupBy(F.size("v").alias("dim")).count().collect())  # a row a length
    if not lengths:
        kind = v.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    parts = [_of_one_length(v.where(F.size("v") == dim), dim, k, confidence, seed) for dim in lengths]
    return best_of(reduce(DataFrame.unionByName, parts), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of every query with their rank, ties to the smaller id."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(v: DataFrame, dim: int, k: int, confidence: float, seed: int) -> DataFrame:
    """(query_id, vec_id, score) of what may be among the k nearest of every query of (id, v, ask)."""
    v = v.withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    # k + 1 members of a point are all that any answer can hold; a query among them is left out at the end.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    members = cut(v.select("key", "id").distinct().withColumn("n", rank).where(F.col("n") <= k + 1).select("key", "id"))
    points = cut(v.groupBy("key").agg(F.any_value("v").alias("v"), F.max("ask").alias("ask"), F.min("id").alias("least")))
    n, top = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    r = np.random.default_rng(seed)
    lines = r.normal(size=(dim + 1, DIRECTIONS))
    ratio = chi2_quantile(confidence, DIRECTIONS)

    def project(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], 1) @ lines

    def project_query(x: np.ndarray) -> np.ndarray:
        return x @ lines[:-1]

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))

    share = min(1.0, SAMPLE / max(1, n))
    sample = points.where(F.abs(F.xxhash64("key") % 1_000_000) < int(share * 1_000_000)).orderBy("key").limit(SAMPLE).select("v").toPandas()
    tree, cells = split_tree(project(matrix(sample["v"])), max(1, n // CELL))
    boxes = boxes_of(tree, DIRECTIONS, cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": cells_of(tree, project(matrix(b["v"]))), "key": b["key"], "v": b["v"], "least": b["least"]})

    placed = cut(points.select("key", "v", "least").mapInPandas(place, f"cell long, key string, v array<double>, least {points.schema['least'].dataType.simpleString()}"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                gap = np.stack([(np.maximum(0, np.maximum(boxes[:, 0] - z, z - boxes[:, 1])) ** 2).sum(1).argmin() for z in project_query(matrix(b["v"]))])
                yield pd.DataFrame({"cell": gap, "key": b["key"], "v": b["v"], "bound": np.inf})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z, out = project_query(matrix(b["v"])), []
            for i in range(len(b)):
                gap = (np.maximum(0, np.maximum(boxes[:, 0] - z[i], z[i] - boxes[:, 1])) ** 2).sum(1)
                for c in np.flatnonzero(gap <= ratio * b["bound"].iat[i]):
                    if c != b["home"].iat[i]:
                        out.append((c, i))
            if out:
                c, at = map(np.array, zip(*out, strict=True))
                yield pd.DataFrame({"cell": c, "key": b["key"].to_numpy()[at], "v": b["v"].to_numpy()[at], "bound": b["bound"].to_numpy()[at]})

    asked = "cell long, key string, v array<double>, bound double"

    def search(q: DataFrame) -> DataFrame:
        """Every query against the points of the cell it names, in blocks of queries."""
        load = q.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("blocks"))
        q = q.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        p = placed.join(load, "cell").select("cell", "key", "v", "least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(queries):
                return pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": str, "key": str, "score": float})
            points = points.sort_values("least")
            x, y = matrix(points["v"]), matrix(queries["v"])
            i, j, s = search_cell(x, project(x), y, project_query(y), queries["bound"].to_numpy(), k + 1, ratio, top)
            return pd.DataFrame({"query": queries["key"].to_numpy()[i], "key": points["key"].to_numpy()[j], "score": s})

        return p.groupBy("cell", "block").cogroup(q.groupBy("cell", "block")).applyInPandas(run, "query string, key string, score double")

    ask = points.where("ask").select("key", "v")
    first = cut(ask.mapInPandas(home, asked))
    found = cut(search(first))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + F.lit(float(top))
    kth = found.groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("query", F.when(F.size("s") > k, F.get("s", F.lit(k))).alias("kth"))
    second = first.withColumnRenamed("cell", "home").drop("bound").join(kth, F.col("key") == F.col("query"), "left").withColumn("bound", F.coalesce(F.greatest(norm - 2 * F.col("kth"), F.lit(0.0)), F.lit(float("inf"))))
    second = cut(second.select("home", "key", "v", "bound").mapInPandas(rest, asked))
    near = found.unionByName(search(second))
    # Of points that tie, the k + 1 with the least ids hold all that an answer may.
    near = near.join(points.select("key", "least"), "key")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1).select("query", "key")

    # Exact scores of what was found, on the original vectors, and the members of equal vectors.
    exact = best.join(points.select("key", F.col("v").alias("pv")), "key").join(points.select(F.col("key").alias("query"), F.col("v").alias("qv")), "query")
    exact = exact.select("query", "key", F.aggregate(F.zip_with("pv", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))
    listed = exact.join(members, "key").select("query", F.col("id").alias("vec_id"), "score")
    short = cut(listed.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).select("query", "vec_id", "score"))
    queries = v.where("ask").select(F.col("key").alias("query"), F.col("id").alias("query_id")).distinct()
    return queries.join(short, "query").where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
