"""Words and word shingles of whole texts as 64-bit hashes, by array operations over Arrow buffers.

A word is a run of bytes other than space and \\x09-\\x0D, after A-Z is lower-cased; null counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: The ASCII bytes that aren't letters or digits, for those who take words without punctuation.
PLAIN = np.zeros(256, bool)
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[int, np.ndarray] = {}
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK + 1), np.uint64)
        out[1:] = _U(base)
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without a copy, and where each row begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about CHUNK bytes: first row, bytes, offsets."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + (size or CHUNK), "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split(data: np.ndarray, at: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and where each row's words begin (one more at the end)."""
    word = ~space[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, at)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], alike wherever it lies."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    x = total[end] - total[begin]
    x *= powers(_INVERSE, len(data) + 1)[begin]
    x += (end - begin).astype(np.uint64) * _LANE[63]
    return mix(x)


def word_hashes(data: np.ndarray, at: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of each row; where each row's words begin (one more at the end)."""
    data = _lower[data]
    begin, end, rows = split(data, at, space)
    return hashes(data, begin, end), rows


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each k words in a row, in order; fewer words count as one. Where each row's shingles begin (one more at the end)."""
    count = np.diff(rows)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)])
    index = np.arange(out[-1]) + np.repeat(rows[:-1] - out[:-1], many)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    g = padded[index] * _LANE[0]
    for j in range(1, k):
        g += padded[index + j] * _LANE[j]
    for r in np.flatnonzero((count > 0) & (count < k)):
        own = words[rows[r] : rows[r + 1]]
        g[out[r]] = (own * _LANE[: len(own)]).sum(dtype=np.uint64)
        g[out[r] : out[r] + 1] += _LANE[62:63] * _U(len(own))
    return mix(g), out
