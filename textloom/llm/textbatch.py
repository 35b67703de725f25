"""Vectorised text primitives shared by the operators of this subpackage.

A batch of strings is handled as one byte buffer with offsets, so that words and n-grams are found, hashed and counted by numpy
over the whole batch instead of once per row.  All hashes are pure functions of the bytes: they don't depend on the batch, the
partition or the process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
#: Bases of the polynomial hashes; the second is for hashes of 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that end a word: ASCII white space and control characters.
SPACE = np.zeros(256, bool)
SPACE[:33] = True
SPACE[127] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = np.full(size, _BASES[which], U64), np.full(size, pow(_BASES[which], -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def buffers(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text.  One space follows every text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    column = pc.binary_join_element_wise(column, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if len(column) == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[:1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that don't end a word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = np.empty(len(data) + 1, np.int8)
    inside[0] = 0
    np.logical_not(breaks[data], out=inside[1:].view(bool))
    step = np.diff(inside)
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def unbroken(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each pair of neighbouring characters of scripts without blanks between words (Han, Kana, Thai, Lao, Khmer, Myanmar), and
    of each such character without such a neighbour."""
    lead = np.flatnonzero((data >= 0xE0) & (data <= 0xE9)) if len(data) else np.zeros(0, np.int64)
    lead = lead[lead + 2 < len(data)]
    a, b = data[lead], data[lead + 1]
    # U+0E00-0EFF, U+1000-109F and U+1780-17FF, U+3040-9FFF
    own = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xE3) & (b > 0x80)) | ((a > 0xE3) & (a <= 0xE9))
    start = lead[own]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    after = np.concatenate([start[1:] == start[:-1] + 3, [False]])
    before = np.concatenate([[False], after[:-1]])
    pairs = after | ~before
    start, end = start[pairs], start[pairs] + np.where(after[pairs], 6, 3)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of what stands for the words of a text in any script: its words(), and its unbroken() pairs in their stead; not in order."""
    start, end, row = unbroken(data, offsets)
    if not len(start):
        return words(data, offsets)
    gaps = data.copy()
    for k in range(3):
        gaps[start + k] = gaps[end - 3 + k] = 32
    return tuple(map(np.concatenate, zip(words(gaps, offsets), (start, end, row))))


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial hash H with H[e] - H[s] = base**s * (hash of data[s:e])."""
    up, _ = _powers(len(data) + 1, which)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes from start to end."""
    _, down = _powers(len(run), which)
    return mix((run[end] - run[start]) * down[start])


def chunks(batch_texts: pa.Array, most_bytes: int = 8 << 20):
    """(first row, slice) of a column cut so that no slice holds much more than most_bytes; one text is never cut."""
    lengths = pc.fill_null(pc.binary_length(batch_texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most_bytes:
            yield first, batch_texts.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if len(batch_texts) > first:
        yield first, batch_texts.slice(first)


def ngrams(data: np.ndarray, n: int, bits: int, salt: int = 0) -> np.ndarray:
    """A bucket below 2**bits for the n bytes from each position on; the last n-1 positions have none.  n is 8 at most."""
    size = max(0, len(data) - n + 1)
    key = data[:size].astype(U64)
    for k in range(1, n):
        key <<= U64(8)
        key |= data[k : k + size]
    key += U64(salt)
    key *= _BASE
    key ^= key >> U64(32)
    key *= U64(0xD6E8FEB86659FD93)
    key >>= U64(64 - bits)
    return key.astype(np.int64)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each character begins and the last one ends, number of characters before each offset)."""
    if not len(data) or data.max() < 128:
        return np.arange(len(data) + 1), offsets
    start = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
    return start, np.searchsorted(start, offsets)


def char_ngrams(run: np.ndarray, start: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n characters from each on; run is prefix(), start is characters()."""
    if len(start) <= n:
        return np.zeros(0, np.int64)
    _, down = _powers(len(run))
    if len(start) == len(run):  # a byte a character
        key = (run[n:] - run[:-n]) * down[: len(run) - n]
    else:
        key = (run[start[n:]] - run[start[:-n]]) * down[start[:-n]]
    key ^= key >> U64(32)
    key *= U64(0xD6E8FEB86659FD93)
    key >>= U64(64 - bits)
    return key.astype(np.int64)


def row_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] for each pair; values may have columns."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[np.maximum(last, first)] - total[first]


def gather(batches, schema: pa.Schema) -> pa.Table:
    """All batches as one table of that schema."""
    batches = list(batches)
    return pa.Table.from_batches(batches).cast(schema) if batches else schema.empty_table()
