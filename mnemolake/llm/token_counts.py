"""Token counts by offset-mapped attribution.

Every document is encoded once, whole. The tokens' character spans are then
interval-joined to the spans of the document's sections (its lines, or its
paragraphs, each with what ends it), and each token counts for one section:

* ``first``: the section that holds the token's first character;
* ``most``: the section that holds most of its characters, the earlier one in a tie.

So the counts of the sections add up to that of the document, which encoding
section by section does not give. A token that is part of a character's bytes
spans that character.

Defined cases: a null or empty text has no section and counts of 0; special
tokens' strings are ordinary text; repeated rows are counted each; an empty table
gives no rows; other columns are not read; texts may be of any length, white space
alone included. The vocabulary is a file of ranks whose
path is a parameter; it is read on the driver and its bytes go with the code, so
executors need no file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._words import slices, utf8

#: The public pattern that splits text before the pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the box keeps its public vocabularies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "most")
#: What ends a section: a line break, or a run of them with a blank line between.
SECTIONS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
#: White space, as the pattern has it, in runs that its lookahead is not trusted with: it goes back over them on a stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_encoders: dict = {}


def _encoder(raw: bytes):
    import tiktoken

    if raw not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            size[i] = len(piece)
        _encoders[raw] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _encoders[raw]


def ids_of(encoder, text: str) -> list[int]:
    """The ids of a whole text. Of a long run of white space, all but the last character before a word is one piece to the pattern, so it is merged as such, and the rest goes on from that character."""
    ids, begin = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoder.encode_ordinary(text[begin : run.start()]) + encoder._encode_single_piece(text[run.start() : end])
        begin = end
    return ids + encoder.encode_ordinary(text[begin:])


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of the sections that start at ``sections``; spans are sorted and within the text."""
    n = len(sections)
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    owner, crosses = first, last > first
    if rule == "most":
        owner = first.copy()
        bounds = np.append(sections, ends[-1] if len(ends) else 0)
        for i in np.flatnonzero(crosses):
            s = np.arange(first[i], last[i] + 1)
            part = np.minimum(bounds[s + 1], ends[i]) - np.maximum(bounds[s], starts[i])
            owner[i] = s[np.argmax(part)]
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def spans(text: str, ids: list[int], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) character of every token."""
    ends = np.cumsum(size[np.array(ids, dtype=np.int64)])
    head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    at = np.cumsum(head) - 1  # the character that each byte belongs to
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return at[starts], at[ends - 1] + 1


def section_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "first", vocabulary: str = VOCABULARY, section: str = "line") -> DataFrame:
    """(doc_id, tokens, crossing, section_starts, section_tokens) of every document; starts are in characters."""
    if section not in SECTIONS:
        raise ValueError(f"section: one of {', '.join(SECTIONS)}")
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    with open(vocabulary, "rb") as f:
        raw = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(raw)  # one vocabulary, under 2 MB
    kind = dict(docs.dtypes)[doc_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(sent.value)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in slices(at):
                rows = []
                for d in range(a, b):
                    text = data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")
                    if not text:
                        rows.append((0, 0, [], []))
                        continue
                    ids = ids_of(encoder, text)
                    starts, ends = spans(text, ids, size)
                    sections = np.array([0, *(m.end() for m in SECTIONS[section].finditer(text) if m.end() < len(text))])
                    n, crossing = attribute(starts, ends, sections, rule)
                    rows.append((len(ids), int(crossing.sum()), sections, n))
                n, crossing, sections, counts = zip(*rows, strict=True)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(sections, lists), pa.array(counts, lists)], ["doc_id", "tokens", "crossing", "section_starts", "section_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, tokens long, crossing long, section_starts array<long>, section_tokens array<long>")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = section_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "tokens", F.size("section_tokens").cast("long").alias("sections"), "crossing", F.coalesce(F.array_max("section_tokens"), F.lit(0)).alias("largest_section"), F.array_join("section_tokens", ",").alias("section_tokens"))
