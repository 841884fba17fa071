"""Words of a batch of texts as numpy arrays: where they start and end, and a 64-bit hash of each.

A batch is an Arrow string column; nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that white space parts: all but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, small letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


@dataclass
class Words:
    buf: np.ndarray  #: the bytes of all texts, with 8 bytes to spare
    text_start: np.ndarray  #: byte offset of each text, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: index of each text's first word, one more than there are texts

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def _eight(self) -> np.ndarray:
        return np.ndarray((len(self.buf) - 7,), dtype="<u8", buffer=self.buf, strides=(1,))

    def hash(self) -> np.ndarray:
        eight, length = self._eight(), self.end - self.start
        h = mix((eight[self.start] & _MASK[np.minimum(length, 8)]) ^ (length.astype(U64) * U64(0xD6E8FEB86659FD93)))
        at, rest = np.flatnonzero(length > 8), 8
        while len(at):
            part = eight[self.start[at] + rest] & _MASK[np.minimum(length[at] - rest, 8)]
            h[at] = mix(h[at] * U64(0x9E3779B97F4A7C15) + part)
            rest += 8
            at = at[length[at] > rest]
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a and b (indexes) have the same bytes."""
        eight, la, lb = self._eight(), self.end[a] - self.start[a], self.end[b] - self.start[b]
        out = la == lb
        at, done = np.flatnonzero(out), 0
        while len(at):
            mask = _MASK[np.minimum(la[at] - done, 8)]
            equal = ((eight[self.start[a[at]] + done] ^ eight[self.start[b[at]] + done]) & mask) == 0
            out[at] = equal
            done += 8
            at = at[equal & (la[at] > done)]
        return out


def split_words(texts: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """texts: strings or bytes; a null counts as an empty text. lower: A-Z become a-z first."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off -= off[0] if len(off) else 0
    buf = np.zeros(len(raw) + 8, dtype=np.uint8)
    buf[: len(raw)] = _LOWER[raw] if lower else raw
    inside = word_bytes[buf[: len(raw)]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return Words(buf, off, start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (windows may span texts; see within)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j, c in enumerate(constants(k, 7919 * (seed + 1))):
        out += h[j : j + n] * c
    return mix(out)


def within(first: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """Which windows of k words lie within one text."""
    ok = np.ones(n_windows, dtype=bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so that the arrays made of them stay small."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    at = 0
    while at < len(col):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def row_slices(ptr: np.ndarray) -> np.ndarray:
    """Index within its row of each element, for rows that begin at ptr."""
    return np.arange(ptr[-1]) - np.repeat(ptr[:-1], np.diff(ptr))
