"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are runs other than the six ASCII white-space characters, so bytes tell
them apart in any language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
U = np.uint64
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """Starts, lengths, hashes and documents of the words of some texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.n_docs = len(at) - 1
        word = IS_WORD[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = word[heads]
        self.starts = np.flatnonzero(first)
        self.doc = np.searchsorted(at, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.starts, at)
        if not len(self.starts):
            self.length, self.hash = np.zeros(0, np.int64), np.zeros(0, U)
            return
        s0 = self.starts[0]
        word = word[s0:]
        rel = self.starts - s0
        self.length = np.add.reduceat(word.astype(np.int32), rel)
        place = np.arange(len(word), dtype=np.int64) - np.repeat(rel, np.diff(np.append(rel, len(word))))
        place[~word] = 0
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=U))
        value = (data[s0:].astype(U) + U(1)) * word
        self.hash = mix(np.add.reduceat(value * powers[place], rel) + self.length.astype(U))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of every run of ``k`` words; a document of fewer words, but some, is one shingle."""
        h, doc = self.hash, self.doc
        n = len(h)
        out_h, out_d = np.zeros(0, U), np.zeros(0, np.int64)
        if n >= k:
            run = np.zeros(n - k + 1, U)
            for i in range(k):
                run = (run ^ h[i : n - k + 1 + i]) * U(0x9FB21C651E98DF25)
                run ^= run >> U(29)
            same = doc[: n - k + 1] == doc[k - 1 :]
            out_h, out_d = run[same], doc[: n - k + 1][same]
        count = np.diff(self.bounds)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = []
            for d in short:
                x = U(count[d])
                for w in h[self.bounds[d] : self.bounds[d + 1]]:
                    x = mix(np.array([x ^ w], U))[0]
                extra.append(x)
            out_h, out_d = np.concatenate([out_h, np.array(extra, U)]), np.concatenate([out_d, short])
            order = np.argsort(out_d, kind="stable")
            out_h, out_d = out_h[order], out_d[order]
        return out_h, out_d

    def digests(self) -> list[bytes]:
        """16 bytes that tell the documents' word sequences apart."""
        place = np.arange(len(self.hash), dtype=np.int64) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        out = np.zeros((self.n_docs, 2), U)
        for i, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            v = mix(self.hash ^ mix(place.astype(U) * U(c) + U(i)))
            total = np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)])
            out[:, i] = mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + np.diff(self.bounds).astype(U))
        return [x.tobytes() for x in out]
