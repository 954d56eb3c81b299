"""Words of whole texts as byte spans and 64-bit hashes, computed on the buffers of an Arrow column.

Separators are ASCII only, so a word never splits a UTF-8 character. Texts are handled in groups of about GROUP bytes,
or alone if longer; hashes are computed in blocks, so that temporary memory does not grow with a text beyond a few bytes
for each of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP = 1 << 19
_BLOCK = 1 << 17


def _mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads each input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BYTE = _mix64(np.arange(1, 257, dtype=np.uint64) * _SEED)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(separators: bytes) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of `[^\x20\x09-\x0D]+`.
SPACED = word_table(b" \t\n\x0b\x0c\r")
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on text whose A-Z are lower-cased.
ALNUM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            steps = np.full(n, 1, dtype=np.uint64)
            steps[1:] = np.uint64(_BASE)
            up = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(inverse)
            down = np.multiply.accumulate(steps)
            if n > 4 * _BLOCK:  # a huge word's own powers are not held
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of a running polynomial; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
        hi = int(ends[j - 1])
        up, down = _POWERS.upto(hi - lo)
        run = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=run[1:])
        s = starts[i:j] - lo
        out[i:j] = _mix64((run[ends[i:j] - lo] - run[s]) * down[s])
        i = j
    return out


@dataclass
class Group:
    """Rows [first, first + rows) of a batch: their lower-cased bytes, and for each word its row (from 0) and span."""

    first: int
    rows: int
    buf: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: where each row's bytes begin in buf
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and one more."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offs


def groups(column: pa.Array, table: np.ndarray, lower: bool = True) -> Iterator[Group]:
    """Splits a column's texts into words."""
    data, offs = text_buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + GROUP, side="right")) - 1)
        buf = data[offs[first] : offs[last]]
        buf = LOWER[buf] if lower else buf
        at = (offs[first : last + 1] - offs[first]).astype(np.int64)
        word = table[buf]
        begin, end = word.copy(), word.copy()
        if len(buf):
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            inner = at[1:-1]
            inner = inner[(inner > 0) & (inner < len(buf))]
            begin[inner] = word[inner]
            end[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(begin)
        row = np.searchsorted(at, starts, side="right") - 1
        yield Group(first, last - first, buf, row, starts, np.flatnonzero(end) + 1, at[:-1])
        first = last
