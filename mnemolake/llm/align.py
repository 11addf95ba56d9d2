"""Alignment of two tokenizers' tokens.

Both encode the same bytes, a space and the text. Byte offsets where a token of
either ends cut the tokens into groups; tokens of one group are linked, each of the
one with each of the other. Ends are running sums of the tokens' lengths, cuts are
the ends of both, and a token's group is the first cut at or behind its end.

A text is encoded and aligned stretch by stretch: a stretch begins at a space after
a character that isn't white space. No token of either vocabulary goes across such
a place (``stretches_end_tokens`` looks at that; where it doesn't hold, a text is
one stretch), so the stretches' tokens are those of the whole text and each stretch
ends a group. For the same reason stretches can be encoded many at once, with
spaces between them, and their tokens told apart by their ends.

Texts are taken in blocks of about ``BLOCK_CHARS`` characters, as they come. A block
encodes and aligns each of its stretches once and tells how many of its texts link
each pair of ids. Spark adds these counts up over the corpus, finds the highest of
each first id, and joins the pairs back to the blocks that have them, where texts
are rows of stretches' numbers and no text is needed any more.

Defined cases: null and empty texts, and those whose joined bytes differ from a space
and the text, have no tokens; rows that repeat are texts of their own; special
tokens' strings are plain text; texts may be of any length; an empty table gives
no rows; other columns are not read. Vocabularies are files whose paths are parameters;
the driver reads them (under 3 MB) and sends their contents.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import kept, or_empty, small_batches, table

#: Where the box keeps its public vocabularies.
A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in a block.
BLOCK_CHARS = 7_000_000
#: Characters of stretches that are encoded together.
BATCH_CHARS = 50_000
MARK = "▁"
#: A space after what isn't white space begins a stretch; so the others are within one.
INSIDE = re.compile(r"\s ")
BEGIN = re.compile(r"(?<=\S) ")
_coders: dict = {}


class Coder:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}
        self.a_bytes = {i: bytes(byte[c] for c in piece) for piece, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in piece)}
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.zeros(1 + max(self.a_bytes), np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.b_size = np.array(list(map(len, self.b_bytes)))

    def stretches_end_tokens(self, a: str) -> bool:
        """Whether no token of either goes on at a space after something else."""
        regex = json.loads(a).get("pre_tokenizer") or {}
        return regex.get("type") == "ByteLevel" and regex.get("use_regex", True) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)

    def encode(self, texts: list[str]) -> Iterator[tuple]:
        """(ids, lengths) of both for each text, or four Nones where the bytes aren't those of a space and the text."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        b = [ids if text else [self.b.piece_to_id(MARK)] for text, ids in zip(texts, b, strict=True)]  # a lone space: the library adds none to nothing
        for text, x, y in zip(texts, a, b, strict=True):
            p, q = [self.a_bytes[i] for i in x], [self.b_bytes[i] for i in y]
            joined = b"".join(p)
            yield (x, list(map(len, p)), y, list(map(len, q))) if joined == b"".join(q) and joined == (" " + text).encode() else (None,) * 4

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, a_sizes, b_sizes, groups) of texts in order, of several at once: ids, how many of each a group has, and how many groups each text has.

        Texts are encoded as one with spaces between them, so all but a last one must
        end in what isn't white space. A text without tokens has no groups; it is found by halving.
        """
        text = " ".join(texts)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text) if text else [self.b.piece_to_id(MARK)]
        if b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == (" " + text).encode():
            a, b = np.array(a, np.int32), np.array(b, np.int32)
            a_ends, b_ends = self.a_size[a].cumsum(), self.b_size[b].cumsum()
            of_a = np.zeros(a_ends[-1] + 1, bool)
            of_b = np.zeros_like(of_a)
            of_a[a_ends] = of_b[b_ends] = True
            a_cuts, b_cuts = np.flatnonzero(of_b[a_ends]), np.flatnonzero(of_a[b_ends])  # the tokens that end where one of the other does
            cuts = a_ends[a_cuts]
            ends = np.cumsum([1 + (len(t) if t.isascii() else len(t.encode())) for t in texts])
            last = np.searchsorted(cuts, ends)
            if (cuts[last] == ends).all():
                yield a, b, *(np.diff(x, prepend=-1) for x in (a_cuts, b_cuts, last))
                return
        if len(texts) > 1:
            yield from self.align(texts[: len(texts) // 2])
            yield from self.align(texts[len(texts) // 2 :])
        else:
            yield *(np.zeros(0, np.int32),) * 4, np.zeros(1, np.int64)


def _coder(a: str, b: bytes) -> Coder:
    key = (a, b)
    if key not in _coders:
        _coders[key] = Coder(a, b)
    return _coders[key]


def stretches(text: str, split: bool = True) -> list[str]:
    """The text's stretches, without the space that each begins with (the first one's is before the text)."""
    if not split:
        return [text]
    return BEGIN.split(text) if INSIDE.search(text) or text[:1] == " " else text.split(" ")


def _sums(x: np.ndarray) -> np.ndarray:
    """Of those before each place, and of all."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])


class _Aligned:
    """What ``Coder.align`` has told of some stretches; of their links, ``pairs`` of ids, those of stretch i are at at[i]:at[i + 1]."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, groups: np.ndarray):
        self.a, self.b, self.a_sizes, self.b_sizes, self.groups = a, b, a_sizes, b_sizes, groups
        self.bounds = _sums(groups)
        self.a_at, self.b_at = _sums(a_sizes), _sums(b_sizes)
        self.at = _sums(np.int64(1) * a_sizes * b_sizes)[self.bounds]

    def pairs(self) -> np.ndarray:
        times = np.repeat(self.b_sizes, self.a_sizes)
        out = np.repeat(self.a.astype(np.int64) << 32, times)
        first = np.repeat(self.b_at[:-1], self.a_sizes) - _sums(times)[:-1]
        out += self.b[np.arange(len(out)) + np.repeat(first, times)]
        return out

    def part(self, i: int, j: int) -> _Aligned:
        """Stretches i to j."""
        g, h = self.bounds[i], self.bounds[j]
        return _Aligned(self.a[self.a_at[g] : self.a_at[h]], self.b[self.b_at[g] : self.b_at[h]], self.a_sizes[g:h], self.b_sizes[g:h], self.groups[i:j])

    def strings(self, at_once: int = 20_000) -> list[str]:
        """The groups of each stretch, ``a1,a2|b1;a3|b2,b3;``."""
        if len(self.groups) > at_once:
            return [s for i in range(0, len(self.groups), at_once) for s in self.part(i, min(i + at_once, len(self.groups))).strings()]
        flat = np.empty(len(self.a) + len(self.b), object)
        ends = self.a_at[1:] - 1, self.b_at[1:] - 1
        before = np.repeat(self.b_at[:-1], self.a_sizes), np.repeat(self.a_at[1:], self.b_sizes)
        for ids, last, more, mark in zip((self.a, self.b), ends, before, "|;", strict=True):
            some, where = np.unique(ids, return_inverse=True)
            names = np.array([f"{i}," for i in some.tolist()], object)[where]
            names[last] = np.array([f"{i}{mark}" for i in some.tolist()], object)[where[last]]
            flat[np.arange(len(ids)) + more] = names
        flat, at = flat.tolist(), (self.a_at + self.b_at)[self.bounds].tolist()
        return ["".join(flat[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]


def _release(coders: bool = False) -> None:
    """Gives back what a block took, which a worker would else keep, and tokenizers that it needs no more."""
    if coders:
        _coders.clear()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of a block: texts (``spots`` are null if they have no tokens), stretches from number ``first`` on, and pairs with the number of texts.
_ROWS = "block long, is_text boolean, doc_id {kind}, spots array<int>, first int, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>, groups array<int>, pairs array<long>, n array<int>"


def _by_length(texts: list[str], most: int) -> Iterator[list[str]]:
    """Slices of about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield texts[begin:]


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row.

    A pair of ids counts the texts that link it anywhere; ``n_best`` counts the links
    whose pair has the highest count of all pairs with its first id, and ``count_sum``
    adds up the counts of all links.
    """
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as f:
        a_raw = f.read()
    with open(b_file, "rb") as f:
        b_raw = f.read()
    sent = spark.sparkContext.broadcast((a_raw, b_raw))
    split = Coder(a_raw, b_raw).stretches_end_tokens(a_raw)
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.limit(0).toArrow().schema.field("doc_id").type
    types = {"block": pa.int64(), "is_text": pa.bool_(), "doc_id": id_type, "first": pa.int32(), "pairs": pa.list_(pa.int64())}
    fields = [(c.split()[0], types.get(c.split()[0], pa.list_(pa.int32()))) for c in _ROWS.split(", ")]

    def block(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        coder, spot = _coder(*sent.value), defaultdict()
        spot.default_factory = spot.__len__
        parts = (stretches(t, split) if t else [] for t in rows["text"].to_pylist())
        spots = [np.fromiter(map(spot.__getitem__, p), np.int32) for p in parts]
        # Those that nothing may follow in one encoding come last, one by one.
        names = list(spot)
        alone = np.array([not split or not t or t[-1].isspace() for t in names], bool)
        order = np.argsort(alone, kind="stable")
        many, single = [names[i] for i in order[: len(names) - alone.sum()]], [names[i] for i in order[len(names) - alone.sum() :]]
        place = np.argsort(order).astype(np.int32)
        told, first = [], 0

        def batch(length: int, /, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(length, number), pa.int64()), *(cols[c].cast(t) if c in cols else pa.nulls(length, t) for c, t in fields[1:])], [c for c, _ in fields])

        for texts, each in ((many, False), (single, True)):
            for some in _by_length(texts, BATCH_CHARS):
                got = (x for t in some for x in coder.align([t])) if each else coder.align(some)
                got = [np.concatenate(x).astype(np.int32) for x in zip(*got, strict=True)]
                told.append(got)
                yield batch(1, first=pa.array([first]), **{c: pa.array([x]) for c, x in zip(("a", "b", "a_sizes", "b_sizes", "groups"), got, strict=True)})
                first += len(some)
        known = _Aligned(*(np.concatenate(x) for x in zip(*told, strict=True))) if told else None
        spots = [place[x] for x in spots]
        has = [len(x) > 0 and bool((known.groups[x] > 0).all()) for x in spots]
        yield batch(len(spots), is_text=pa.array([True] * len(spots)), doc_id=rows["doc_id"].combine_chunks(), spots=pa.array([x if y else None for x, y in zip(spots, has, strict=True)], pa.list_(pa.int32())))
        if any(has):
            codes = pa.array(known.pairs()).dictionary_encode()
            codes, pairs = codes.indices.to_numpy(), codes.dictionary.to_numpy()
            n = np.zeros(len(pairs), np.int32)
            for x in (x for x, y in zip(spots, has, strict=True) if y):
                k = np.unique(x)
                m = known.at[k + 1] - known.at[k]
                n[np.unique(codes[np.repeat(known.at[k] - _sums(m)[:-1], m) + np.arange(m.sum())])] += 1
            yield batch(1, pairs=pa.array([pairs[n > 0]]), n=pa.array([n[n > 0]]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0  # the rows are written before their numbers are used
        for batch in batches:
            upto = _sums(np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0)))
            begin = 0
            while begin < len(batch):
                end = min(len(batch), max(begin + 1, int(np.searchsorted(upto, upto[begin] + block_chars - size, "right")) - 1))
                held.append(batch.slice(begin, end - begin))
                size += int(upto[end] - upto[begin])
                if end < len(batch) or size >= block_chars:
                    yield from block(pa.Table.from_batches(held), number)
                    number, held, size = number + 1, [], 0
                    _release()
                begin = end
        if held:
            yield from block(pa.Table.from_batches(held), number)
        _release()

    def measure(rows: pa.Table, counts: pa.Table) -> pa.Table:
        _release(True)
        texts, parts = rows.filter(pc.is_valid(rows["is_text"])), rows.filter(pc.is_valid(rows["first"])).sort_by("first")
        known = _Aligned(*(pc.list_flatten(parts[c]).to_numpy() for c in ("a", "b", "a_sizes", "b_sizes", "groups")))
        here = pc.fill_null(pc.index_in(pa.array(known.pairs()), value_set=counts["pair"].combine_chunks()), len(counts)).to_numpy()  # pairs that only texts without tokens hold aren't counted, nor used
        of_links = [_sums(np.append(counts[c].to_numpy(), 0).astype(np.int64)[here])[known.at] for c in ("best", "n")]
        upto = [known.a_at[known.bounds], known.b_at[known.bounds], known.bounds, known.at, *of_links]
        spots = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in texts["spots"].combine_chunks()]
        at, flat = _sums([len(x) for x in spots]), np.concatenate([np.zeros(0, np.int32), *spots])
        sums = {c: np.diff(_sums(np.diff(x)[flat])[at]) for c, x in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), upto, strict=True)}
        del here, of_links, upto, flat
        strings = known.strings()
        # A chunk becomes a batch, and the JVM holds one at a time.
        groups = pa.chunked_array([pa.array(["".join(map(strings.__getitem__, x.tolist()))[:-1] for x in spots[i : i + 200]], pa.string()) for i in range(0, len(spots), 200)], pa.string())
        return pa.table({"doc_id": texts["doc_id"], **sums, "groups": groups})

    with small_batches(spark):
        known = kept(rows.mapInArrow(blocks, _ROWS.format(kind=kind)))
    found = known.where(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), "n")).alias("x")).select("block", "x.pair", F.col("x.n").cast("long").alias("n"))
    first = F.shiftright("pair", 32)
    counts = found.groupBy("pair").agg(F.sum("n").alias("n"))
    tops = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", first).join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    told = found.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    texts = known.where(F.col("pairs").isNull()).drop("pairs", "n")
    return texts.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(measure, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _digest(groups: Column) -> Column:
    return F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", _digest(or_empty(F.col("groups"))).alias("groups_sha256"))
