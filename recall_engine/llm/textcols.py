"""Arrow text columns as numpy arrays: words, rolling hashes, window minima.

All functions work on one buffer that holds the UTF-8 bytes of many rows, so
that short rows don't pay numpy's cost of a call each.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are worked on at once; one longer row is worked on alone.
SLICE_BYTES = 2 << 20
#: Bytes of words whose rolling hashes are taken in one go.
HASHED_BYTES = 1 << 18

#: Odd base of the rolling hash modulo 2**64, and its inverse.  Such a hash can
#: be made to collide, so it only proposes candidates: what decides a result
#: compares contents or xxh3 digests of them.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: glibc's; other C libraries may have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns what is free to the system.  A Python worker outlives its task and
    lies beside the JVM while later tasks run, so what it keeps counts there."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, dealt into batches of at most ``limit`` text
    bytes (or one row).  After the last one, free memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    batch = sizes = ends = None
    give_back()


def stretches(batches: Iterator[pa.RecordBatch], separator: np.ndarray, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
    """(rows, their text as binary, whether the last row ends here).  A text above
    ``limit`` bytes comes alone, in stretches that end at separators; only a
    longer run without any is not cut."""
    for batch in slices(batches, text, limit):
        column = batch.column(batch.schema.get_field_index(text))
        raw, _ = buffer_of(column)
        at = 0
        while len(raw) - at > limit:
            gaps = np.flatnonzero(separator[raw[at : at + limit]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                step = next((x for x in range(at + limit, len(raw), limit) if separator[raw[x : x + limit]].any()), None)
                to = len(raw) if step is None else step + int(np.argmax(separator[raw[step : step + limit]])) + 1
            if to < len(raw):
                yield batch, pa.array([raw[at:to].tobytes()], pa.large_binary()), False
            else:
                break
            at = to
        yield batch, (pa.array([raw[at:].tobytes()], pa.large_binary()) if at else column), True


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gives any substring's hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal for equal content at any place."""
    inverse = _power(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i:i + width] for every i where it fits."""
    n = len(keys)
    if n < width:
        return keys[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of every row of a text column, or its runs of
    other bytes than ``separator`` marks.

    start, end: byte places in raw; row: each word's row; first: place of each
    row's first word among all words (one more entry than rows).
    """

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        self.raw, self.offsets = buffer_of(column)
        if lower:
            self.raw = np.where((self.raw >= 65) & (self.raw <= 90), self.raw + np.uint8(32), self.raw)
        inside = ~separator[self.raw]
        begin, over = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        over[:-1] &= ~inside[1:]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[edge] = inside[edge]
        edge = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        over[edge] = inside[edge]
        self.inside = inside
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(over) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self._known = None

    def _encoded(self) -> pa.DictionaryArray:
        size = self.end - self.start
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        letters = np.ascontiguousarray(self.raw[self.inside])
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()

    def numbers(self) -> np.ndarray:
        """The number of each word: equal words, and only they, have equal numbers."""
        return self._encoded().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def known(self) -> tuple[np.ndarray, list[bytes]]:
        """(number of each word, the different words)."""
        if self._known is None:
            found = self._encoded()
            self._known = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
        return self._known

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(all words, a space after each, and where each starts and ends there)."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        out, held = np.full(int(size.sum()) + len(size), 0x20, np.uint8), np.ones(int(size.sum()) + len(size), bool)
        held[end] = False
        out[held] = self.raw[self.inside]
        return out.tobytes(), end - size, end

    def rolling(self) -> np.ndarray:
        """A 64-bit rolling hash of each word, of HASHED_BYTES at a time; it can
        be made to collide, hashes() can't."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + HASHED_BYTES, "right")))
            out[at:to] = span_hash(prefix_hash(byte_values(self.raw[low : self.end[to - 1]])), self.start[at:to] - low, self.end[at:to] - low)
            at = to
        return out

    def hashes(self) -> np.ndarray:
        """(words, 2) of uint64: the 128-bit xxh3 of each word."""
        numbers, different = self.known()
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, different)), np.uint64).reshape(-1, 2)[numbers]


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for a sequence of 64-bit hashes, the first ones first."""
    h = parts[0]
    for x in parts[1:]:
        h = mix(h * np.uint64(_BASE) + x)
    return h


def sequence_numbers(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of sequences of numbers below 2**31: equal exactly where the
    sequences are."""
    number = parts[0]
    for x in parts[1:]:
        number = np.unique((number << 32) | x, return_inverse=True)[1]
    return number


def binary_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of raw[start:end] (in order, not overlapping): equal exactly where
    the bytes are."""
    cover = np.zeros(len(raw) + 1, np.int8)
    cover[start] += 1
    cover[end] -= 1
    letters = np.ascontiguousarray(raw[np.cumsum(cover[:-1], dtype=np.int8) > 0])
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
