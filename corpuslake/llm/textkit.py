"""Vectorised text work inside tasks: Arrow strings as byte arrays, words, shingles and window hashes in numpy.

All hashes are 64-bit: bytes are mapped to random words, summed with powers of an odd base modulo 2**64 and mixed at
the end. Where equality must be exact over all data, two independent hashes make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Constants of the splitmix64 finaliser (fixed values).
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any byte ranges of an array after one pass; powers are kept and grown on demand."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 4 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return Rolling, (self.seed,)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = -(-n // 65536) * 65536
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.base, np.uint64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.inverse, np.uint64)]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums over bytes, or over 64-bit codes of longer tokens."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        values = self.table[data] if data.dtype == np.uint8 else mix(data ^ self.table[0]) | np.uint64(1)
        np.cumsum(values * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * MIX2)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and where each starts (one more at the end). Null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about so many bytes of text at most (a longer document comes alone)."""
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, min(end, n) - start)
            start = end


def tokens(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no gap, never across documents) and each document's first word."""
    inside = ~gap[data]
    bounds = at[:-1][(at[:-1] > 0) & (at[:-1] < len(data))]
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    before[bounds] = False
    after = np.concatenate([inside[1:], [False]])[-len(data) :] if len(data) else inside
    after[bounds - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


WORDS = Rolling(11)


def word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word (a run of bytes that are no ASCII space), and each document's first word."""
    starts, ends, first = tokens(data, at)
    return WORDS.ranges(WORDS.prefix(data), starts, ends), first


_STEP = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles: A-Z lower-cased, words split at ASCII spaces.

    Fewer words than the width make one shingle of them all; no words make none.
    """
    data, at = utf8(col)
    data = LOWER[data]
    starts, ends, first = tokens(data, at)
    word = WORDS.ranges(WORDS.prefix(data), starts, ends)
    n = len(word)
    whole = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j in range(width):
        whole += mix(word[j : n - width + 1 + j] + _STEP[j]) * _STEP[width + j] if len(whole) else whole
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(mix(word[a + j : a + j + 1] + _STEP[j])[0]) * int(_STEP[width + j]) for j in range(b - a)) % 2**64 ^ (b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
