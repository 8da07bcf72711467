"""Vectorised word and n-gram hashing over Arrow text columns.

A *word* is a maximal run of bytes other than space, TAB, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``).  All separators are single ASCII bytes, so splitting the
UTF-8 bytes gives the same words as splitting the code points.

Everything works on the raw Arrow buffers, a bounded block of bytes at a time, so that
no Python object is made per word.  Hashes are polynomials modulo 2**64 over random
tables: the hash of any run of bytes or words is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED_2024)
#: Random byte tables and odd multipliers for two independent 64-bit hashes.
_TABLES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = [0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB53]  # both are 3 modulo 8
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and bytes of other characters.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that one block of work covers; a single longer document is one block.
BLOCK_BYTES = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base & (2**64 - 1)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U64(step)
        done += take
        step = (step * step) & (2**64 - 1)
    return out


class _Powers:
    """Powers of the two bases and of their inverses, grown on demand."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.size:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up = [_powers(b, size) for b in _BASES]
            self.down = [_powers(pow(b, -1, 2**64), size) for b in _BASES]
            self.size = size
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts come out empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def doc_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each, one document at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """The words of some consecutive documents.

    ``starts``/``ends`` are byte positions in ``data``; words of document ``i`` are
    ``bounds[i]`` to ``bounds[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> None:
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = offsets - base
        n = len(self.data)
        word = ~separator[self.data]
        edge = np.zeros(n + 1, dtype=bool)  # a document starts or ends here
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~word[:-1]
            after[:-1] = ~word[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of each word; with ``prefixes``, of each word and its first so many
        bytes, hashes of the latter being 0 where the word is no longer than that."""
        up, down = _POWERS.upto(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_TABLES[which][self.data] * up[which][: len(self.data)], out=sums[1:])
        shift = down[which][self.starts]
        out = mix((sums[self.ends] - sums[self.starts]) * shift)
        if not prefixes:
            return out
        cuts = []
        for k in prefixes:
            to = np.minimum(self.starts + k, self.ends)
            cuts.append(np.where(to < self.ends, mix((sums[to] - sums[self.starts]) * shift + U64(k)), U64(0)))
        return [out, *cuts]


def gram_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of every ``size`` consecutive entries of ``words``, unaware of documents."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(words) + 1)
    sums = np.empty(len(words) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words * up[which][: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[which][:n])


def text_key(col: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text, in the JVM; null counts as empty."""
    text = F.coalesce(F.col(col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("t2")]
