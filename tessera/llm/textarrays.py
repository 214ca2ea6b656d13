"""Vectorised views of text columns: whole Arrow buffers as bytes, word spans and 64-bit span hashes.

A batch of texts is one uint8 array with offsets; words and their hashes come from a few numpy passes over that
array, so no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one pass holds at once; longer single texts form a pass of their own.
PASS_BYTES = 1 << 20


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Anything but ASCII white space x20, x09-x0D.
SOLID = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, PASS_BYTES + 1024)
        row = np.full(size, _ODD if which == "up" else _ODD_INV, dtype=U64)
        row[0] = 1
        have = np.cumprod(row)
        if size > 4 * PASS_BYTES:
            return have
        _powers[which] = have
    return have


class Texts:
    """One pass of texts: ``buf`` uint8, ``offsets`` int64 (len + 1)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, array: pa.Array) -> Texts:
        array = array.fill_null("") if array.null_count else array
        array = array.cast(pa.large_string())
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        data = array.buffers()[2] if len(array) else None
        buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(buf, offsets - offsets[0])

    def words(self, inside: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each maximal run of bytes in ``inside``."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        on = inside[self.buf]
        first = np.empty(n, bool)
        first[0] = on[0]
        np.greater(on[1:], on[:-1], out=first[1:])
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = on[cuts]
        last = np.empty(n, bool)
        last[-1] = on[-1]
        np.greater(on[:-1], on[1:], out=last[:-1])
        last[cuts - 1] = on[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
        """64-bit hash of each span after mapping its bytes through ``fold``."""
        n = len(self.buf)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_SEEDS[fold][self.buf] * _power("up", n)[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(U64))


def ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of ``n`` words of one owner."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, owner.dtype)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for i in range(1, n):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i : i + m]
    whole = owner[:m] == owner[n - 1 :]
    return mix(out[whole]), owner[:m][whole]


def return_large(size: int = 4 << 20) -> None:
    """From now on, arrays of ``size`` bytes and more go back to the system as they are freed.

    The C library otherwise raises this limit with every large array that it frees, and holes in its heap stay.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, size)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def keep_top(size: int = 128 << 10) -> None:
    """Keep up to ``size`` freed bytes at the top of the heap: steps that use and free small arrays do not fetch them anew."""
    try:
        ctypes.CDLL(None).mallopt(-1, size)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def release() -> None:
    """Give freed memory of this worker back to the system; idle workers then hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def passes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut record batches into passes of about ``size`` bytes of text each; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = Texts.of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + size, side="right")) - 1)
            to = min(to, batch.num_rows)
            lo, hi = texts.offsets[at], texts.offsets[to]
            yield batch.slice(at, to - at), Texts(texts.buf[lo:hi], texts.offsets[at : to + 1] - lo)
            at = to
        del batch, texts
    release()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each row, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
