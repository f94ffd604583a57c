"""Vectorised text kernels for Arrow batches: words, shingles and 64-bit hashes of them.

All of them read the UTF-8 buffer of a string column without building Python strings, and
work through a batch in chunks of a few megabytes, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(separators: bytes, fold: bool = True) -> np.ndarray:
    """A random code per byte: 0 for separators; equal for A-Z and a-z unless told otherwise."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    codes[np.frombuffer(separators, np.uint8)] = 0
    if fold:
        codes[65:91] = codes[97:123]
    return codes


#: Words are runs of anything but ASCII white space.
SPACED = byte_codes(_SPACES)
#: The same, but A and a differ.
EXACT = byte_codes(_SPACES, fold=False)
#: Lines, as they stand.
LINES = byte_codes(b"\n", fold=False)
#: Words are runs of ASCII letters, digits and any byte beyond ASCII.
ALNUM = byte_codes(bytes(b for b in range(128) if not chr(b).isalnum()))


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = powers(4096)


@dataclass
class Chunk:
    """Some consecutive texts of a batch. Word arrays run over all words of the chunk."""

    first: int  # row of the batch
    data: np.ndarray  # bytes of the texts, one after another
    offsets: np.ndarray  # where each text starts, and the end
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray  # of each word, A-Z lower-cased
    heads: np.ndarray  # index of the first word of each text, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    blob = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return blob, at.astype(np.int64)


def spans_of(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, first: int = 0) -> Chunk:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``, offsets starting at 0."""
    n = len(data)
    coded = codes[data]
    inside = coded != 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    fresh[at] = inside[at]  # a word ends with its text
    starts = np.flatnonzero(fresh)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        heads = np.zeros(len(offsets), np.int64)
        return Chunk(first, data, offsets, none, none, np.zeros(0, np.uint64), heads)
    stops = np.append(starts[1:], n)
    place = np.arange(starts[0], n) - np.repeat(starts, stops - starts)
    longest = int(place.max()) + 1
    table = _POWERS if longest <= len(_POWERS) else powers(longest)
    coded = coded[starts[0] :] * table[place]
    hashes = mix(np.add.reduceat(coded, starts - starts[0]))
    lengths = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    heads = np.searchsorted(starts, offsets)
    return Chunk(first, data, offsets, starts, starts + lengths, hashes, heads)


def chunks(column: pa.Array, codes: np.ndarray = SPACED) -> Iterator[Chunk]:
    """The texts of a string column, a few megabytes at a time."""
    blob, offsets = string_buffers(column)
    for at, to in spans_of(offsets):
        own = offsets[at : to + 1]
        yield split(blob[own[0] : own[-1]], own - own[0], codes, at)


def head_hashes(chunk: Chunk, codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes of each word; equal to the word's own if it is shorter."""
    places = chunk.starts[:, None] + np.arange(n)
    inside = places < chunk.ends[:, None]
    at = np.minimum(places, max(len(chunk.data) - 1, 0))
    coded = np.where(inside, codes[chunk.data[at]], np.uint64(0)) * _POWERS[:n]
    return mix(coded.sum(axis=1, dtype=np.uint64))


def shingles(hashes: np.ndarray, heads: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, index of the first run of each text and the end).

    A text with fewer words has one run of all its words; one without words has none.
    """
    multipliers = mix(np.arange(11, 11 + width, dtype=np.uint64) * _BASE) | np.uint64(1)
    counts = np.diff(heads)
    n_runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    runs = np.concatenate([[0], np.cumsum(n_runs)])
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    first = np.repeat(heads[:-1] - runs[:-1], n_runs) + np.arange(runs[-1])
    last = np.repeat(heads[1:], n_runs)
    out = np.full(len(first), width, np.uint64)
    for k in range(width):
        at = first + k
        word = np.where(at < last, padded[at], np.uint64(0))
        out = out + word * multipliers[k]
    return mix(out), runs
