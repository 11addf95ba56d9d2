"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, runs of ``PASSAGE_WORDS`` words that together
hold its whole text. Each passage is encoded (character classes, word lengths,
repetition within the passage and of its five-word shingles within the
document), a gated attention layer weighs the passages, and the weighted sum of
their encodings is scored. Only document labels are learnt from; the weights
tell which passages spoke.

The model is fitted with numpy on at most ``TRAIN_ROWS`` labelled documents,
taken in the order of a hash of their ids, of ``TRAIN_CHARS`` characters at most; scoring reads every whole text on the
executors. Language, source and ids are never inputs.

Defined cases: a null or empty text is a bag of one passage of zeros; null
labels are not learnt from; repeated labels of a document are averaged and a half
counts as 1; of rows that repeat a doc_id one is learnt from; without
labels of both kinds every score is the share of label 1 (0.5 with no labels);
repeated rows get the same score each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, table
from ._words import Words, mix, slices, utf8

PASSAGE_WORDS = 64
TRAIN_ROWS = 6_000
#: Longer texts aren't fitted on, so that the sample's size is bounded by its rows.
TRAIN_CHARS = 200_000
ACCEPT = 0.7
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 240, 0.02, 1e-4

#: Classes of bytes: upper case, lower case, digits, sentence marks, bars, other symbols, other languages' letters.
_CLASS = np.full(256, 7, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"-()", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8
N_FEATURES = 9 + 8


def encode_passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of all passages, at least one a document."""
    w = Words(data, at)
    count = np.diff(w.bounds)
    n_pass = np.maximum(1, -(-count // PASSAGE_WORDS))
    doc = np.repeat(np.arange(w.n_docs), n_pass)
    x = np.zeros((len(doc), N_FEATURES), np.float32)
    x[:, 9] = np.log1p(count)[doc] / 10
    if not len(w.hash):
        return x, doc
    base = np.concatenate([[0], np.cumsum(n_pass)[:-1]])
    place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], count)
    passage = base[w.doc] + place // PASSAGE_WORDS
    full, words = np.unique(passage, return_counts=True)
    first = np.flatnonzero(place % PASSAGE_WORDS == 0)
    heads = w.starts[first]
    # The bytes of a passage end where its last word ends.
    last = np.append(first[1:], len(w.hash)) - 1
    tails = w.starts[last] + w.length[last]
    size = (tails - heads).astype(np.float32)
    kinds = _CLASS[data]
    for c in range(9):
        total = np.concatenate([[0], np.cumsum(kinds == c, dtype=np.int64)])
        x[full, c] = (total[tails] - total[heads]) / size
    n = words.astype(np.float32)
    mean = np.bincount(passage, w.length, len(doc))[full] / n
    x[full, 10] = np.minimum(mean, 40) / 10
    x[full, 11] = np.minimum(np.sqrt(np.maximum(0, np.bincount(passage, w.length.astype(float) ** 2, len(doc))[full] / n - mean**2)), 40) / 10
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    x[full, 12] = np.bincount(passage, again, len(doc))[full] / n
    key = w.hash ^ mix(passage.astype(np.uint64))
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    x[full, 13] = np.bincount(passage[order[fresh]], minlength=len(doc))[full] / n
    ends = w.starts + w.length - 1
    x[full, 14] = np.bincount(passage, kinds[ends] == 6, len(doc))[full] / n
    x[full, 15] = np.bincount(passage, w.length == 1, len(doc))[full] / n
    h, sdoc = w.shingles(5)
    if len(h):
        start = np.searchsorted(sdoc, np.arange(w.n_docs))
        spot = np.arange(len(h)) - start[sdoc]
        spass = base[sdoc] + spot // PASSAGE_WORDS
        key = h ^ mix(sdoc.astype(np.uint64))
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        x[:, 16] = np.bincount(spass[order[same]], minlength=len(doc)) / np.maximum(1, np.bincount(spass, minlength=len(doc)))
    return x, doc


class AttentionModel:
    """Gated-attention multiple-instance classifier."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of the bags that start at rows ``heads`` of ``x``."""
        p = self.p
        bag = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(x))))
        x = (x - p["mean"]) / p["sd"]
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, heads)[bag])
        a /= np.add.reduceat(a, heads)[bag]
        z = np.add.reduceat(h * a[:, None], heads)
        logit = np.clip(z @ p["c"] + p["c0"], -30, 30)
        return 1 / (1 + np.exp(-logit)), {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag}

    def gradient(self, x: np.ndarray, heads: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, k = self.forward(x, heads)
        h, v, u, a, bag = k["h"], k["v"], k["u"], k["a"], k["bag"]
        d = (score - y) / len(y)
        dz = d[:, None] * p["c"]
        dzb = dz[bag]
        da = (h * dzb).sum(1)
        ds = a * (da - np.add.reduceat(a * da, heads)[bag])
        dg = ds[:, None] * p["w"]
        dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
        dh = (a[:, None] * dzb + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"c": k["z"].T @ d, "c0": d.sum(), "w": (v * u).T @ ds, "V": h.T @ dv, "U": h.T @ du, "E": k["x"].T @ dh, "e": dh.sum(0)}


def fit(x: np.ndarray, heads: np.ndarray, y: np.ndarray, seed: int = 7) -> AttentionModel | float:
    """The fitted model, or a constant score where labels of one kind are missing."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    r = np.random.default_rng(seed)
    p = {"mean": x.mean(0), "sd": x.std(0) + 1e-3, "E": r.normal(0, 0.3, (x.shape[1], HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "c0": np.float64(0)}
    model, m, v = AttentionModel(p), {}, {}
    for t in range(1, EPOCHS + 1):
        for k, g in model.gradient(x, heads, y).items():
            g = g + DECAY * p[k] * (k not in ("e", "c0"))
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g
            v[k] = 0.999 * v.get(k, 0) + 0.001 * g**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> AttentionModel | float:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    # A document without a row in ``docs`` costs a place in the sample; its label can't be learnt from.
    picked = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for a, b in slices(at):
                x, doc = encode_passages(data[at[a] : at[b]], at[a : b + 1] - at[a])
                ends = np.searchsorted(doc, np.arange(b - a), side="right")
                heads = np.searchsorted(doc, np.arange(b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary())], ["id", "y", "x"])

    # The sample has a proven bound, so it may go to all executors. One row an id, of those that repeat it the least text.
    held = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_id").where(F.coalesce(F.length("_text"), F.lit(0)) <= TRAIN_CHARS)
    held = held.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("y").alias("y"))
    read = held.select(F.col("_id").cast("string").alias("id"), F.round("y").alias("y"), "_text")
    got = read.mapInArrow(features, "id string, y double, x binary").collect()
    got = sorted(got, key=lambda r: (r["id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]
    heads = np.cumsum([0, *(len(x) for x in bags)])[:-1]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES))
    return fit(x, heads, np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: AttentionModel | float, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``; the text is read whole."""
    name = free_name(docs, "score")
    params = model if isinstance(model, float) else model.p
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(at_text))
            for a, b in slices(at):
                if isinstance(params, float):
                    s = np.full(b - a, params)
                else:
                    x, doc = encode_passages(data[at[a] : at[b]], at[a : b + 1] - at[a])
                    s, _ = AttentionModel(params).forward(x.astype(np.float64), np.searchsorted(doc, np.arange(b - a)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` whose score is at least ``accept``."""
    scored = score(docs, train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= accept).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
