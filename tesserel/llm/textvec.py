"""Vectorised text primitives on the UTF-8 buffers of Arrow columns.

Everything here works on whole batches of documents: no loop over documents,
words or bytes runs in Python. A word is a maximal run of ASCII letters and
digits and of bytes above 0x7F. Case is folded for ASCII and Latin-1 letters.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
SLICE_BYTES = 1_000_000

_rng = np.random.default_rng(0x7E55E2E1)
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
UNBASE = U64(pow(int(BASE), -1, 2**64))
STEP1, STEP2 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)

_byte = np.arange(256)
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps what it keeps
    _libc = None

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between batches."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES if int(base) in (int(BASE), int(UNBASE)) else 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text (one text at least)."""
    n = batch.num_rows
    if n == 0:
        return
    _, offs = utf8(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give freed memory back: a worker shares its executor's memory with others."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls have length 0."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or len(offs) < 2:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters."""
    low = LOWER[buf]
    if len(low) > 1:
        two = np.flatnonzero(low[:-1] == 0xC3) + 1
        b = low[two]
        two = two[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        low[two] += 32
    return low


@dataclass
class Words:
    """The words of a batch, in order. ``doc`` is the row; starts and ends are bytes of ``buf``."""

    buf: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each document's first word, and the total at the end
    hash: np.ndarray
    sums: np.ndarray
    low: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of arbitrary byte spans of the folded text."""
        return mix((self.sums[end] - self.sums[start]) * powers(UNBASE, len(self.buf) + 1)[start])


def words(column: pa.Array, folded: bool = True) -> Words:
    buf, offs = utf8(column)
    n = len(buf)
    low = fold(buf) if folded else buf
    isw = IS_WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    opens, closes = isw.copy(), isw.copy()
    if n:
        opens[1:] &= ~isw[:-1] | edge[1:n]
        closes[:-1] &= ~isw[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_KEYS[low] * powers(BASE, n), out=sums[1:])
    out = Words(buf, offs, start, end, doc, first, None, sums, low)
    out.hash = out.span_hash(start, end)
    return out


def grams(w: Words, k: int, step: np.uint64 = STEP1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs and the index of their first word, never across documents."""
    h, n = w.hash, len(w.hash)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if k <= 6:
        out = h[: n - k + 1].copy()
        for j in range(1, k):
            out *= step
            out += h[j : n - k + 1 + j]
    else:
        un = U64(pow(int(step), -1, 2**64))
        sums = np.zeros(n + 1, U64)
        np.cumsum(h * powers(step, n), out=sums[1:])
        out = (sums[k:] - sums[:-k]) * powers(un, n)[: n - k + 1]
    ok = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
    return mix(out[ok]), ok


def char_offsets(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Character offsets within their texts of byte positions."""
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    return heads[at] - heads[offs[doc]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values if isinstance(values, pa.Array) else pa.array(values))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values of equal length."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    offs = np.arange(len(rows) + 1, dtype=np.int64) * width
    if offs[-1] >= 2**31:
        return pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def from_binary(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The 2-d array that ``fixed_binary`` stored."""
    buf, _ = utf8(column)
    return buf.view(dtype).reshape(-1, width) if len(buf) else np.zeros((len(column), width), dtype)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Regroup batches sorted by ``key`` so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(key)
        last = col[-1]
        if held and held[-1].column(key)[-1] == last and col[0] == last:
            held.append(batch)
            continue
        same = np.flatnonzero(np.asarray(pa.compute.not_equal(col, last).to_numpy(zero_copy_only=False)))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut or held and held[-1].column(key)[-1] != last:
            parts = [*held, batch.slice(0, cut)]
            yield joined(parts)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
