"""Words of whole texts as flat numpy arrays, and hashes of word windows.

Used inside Arrow tasks. A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``;
these separators are single bytes in UTF-8, so texts are split on the byte level
without making a Python object per word. Hashes are polynomials modulo 2**64
over prefix sums, finished by a mixing step; they depend on the words alone, so
every task and executor gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20  # texts handled at once; a longer text is a chunk of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing step that spreads every input bit over all output bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 8  # chunks are of about one size
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        return self.up[:n], self.down[:n]


_BYTES = (Powers(0xD1342543DE82EF95), Powers(0xAEF17502108EF2D9))
_WORDS = (Powers(0x9E6C63D0676A9A99), Powers(0xC6BC279692B5C323))


@dataclass
class Words:
    """Words of some texts: ``data`` holds the texts' bytes end to end, text ``i``
    at ``text_at[i]:text_at[i + 1]`` with words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: dict

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hash of the bytes ``start:end`` of each span."""
        up, down = _BYTES[kind].upto(len(self.data) + 1)
        if kind not in self.prefix:
            total = np.zeros(len(self.data) + 1, dtype=U)
            np.cumsum((self.data.astype(U) + U(1)) * up[:-1], dtype=U, out=total[1:])
            self.prefix[kind] = total
        total = self.prefix[kind]
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(U))

    def hashes(self, kind: int = 0) -> np.ndarray:
        return self.span_hash(self.start, self.end, kind)

    def windows(self, hashes: np.ndarray, k: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words that start at each word, and whether all of
        them lie in the same text."""
        n = len(hashes)
        up, down = _WORDS[kind].upto(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(hashes * up[:-1], dtype=U, out=total[1:])
        if n < k:
            return np.zeros(n, dtype=U), np.zeros(n, dtype=bool)
        out = np.zeros(n, dtype=U)
        m = n - k + 1
        out[:m] = mix64((total[k:] - total[:m]) * down[:m])
        last = np.repeat(self.first[1:], self.counts)
        return out, np.arange(n) + k <= last

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def position(self) -> np.ndarray:
        """Number of each word in its own text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)


def split(texts: pa.Array) -> Words:
    """Words of a string array; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = (np.frombuffer(body, dtype=np.uint8)[at[0]:at[-1]] if body is not None and len(texts)
            else np.zeros(0, dtype=np.uint8))
    at = at - at[0] if len(at) else np.zeros(1, dtype=np.int64)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edge = at[1:-1]  # a text's first byte begins a word though the text before ended in one
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    ends = inside[:-1] & ~inside[1:]
    cut = edge[edge > 0] - 1
    ends[cut] = inside[cut]
    end = np.flatnonzero(ends) + 1
    return Words(data, at, start, end, np.searchsorted(start, at), {})


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, one row at least."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        base = total[row - 1] if row else 0
        to = max(int(np.searchsorted(total, base + limit, side="right")), row + 1)
        yield batch.slice(row, to - row)
        row = to


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
