"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Texts stay bytes: a batch of documents is one buffer with offsets, and words,
hashes and n-grams are numpy arrays over it. Batches are cut to a byte limit,
so temporary memory follows the limit (or one longer document), not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

LIMIT = 512 << 10
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Give freed memory back to the system: workers live long and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def freed(f, *args):
    """f(*args), with what it used given back."""
    out = f(*args)
    release()
    return out


def strings(col) -> pa.Array:
    """One chunk of large strings without nulls; null becomes the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def pieces(col, limit: int = LIMIT):
    """Yield (first row, buffer, offsets) for runs of rows of about limit bytes."""
    col = strings(col)
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    release()


def slices(batches, rows: int = 512):
    """Arrow batches in parts of few rows, for work on Python strings."""
    for b in batches:
        for lo in range(0, max(1, len(b)), rows):
            yield b.slice(lo, rows)
        release()


def runs(batches, keys: tuple[str, ...], values: tuple[str, ...], least: int = 1):
    """Arrays of values of each group of rows with equal keys, from batches sorted by keys; a group may span batches.

    Groups of fewer than `least` rows are passed over.
    """
    held: list[list[np.ndarray]] = []
    now = None
    for b in batches:
        if not len(b):
            continue
        k, v = [np.asarray(b[c]) for c in keys], [np.asarray(b[c]) for c in values]
        begin = np.append(0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1)
        end = np.append(begin[1:], len(b))
        wanted = end - begin >= least
        wanted[[0, -1]] = True  # they may go on
        for i, j in zip(begin[wanted].tolist(), end[wanted].tolist()):
            key = tuple(x[i] for x in k)
            if key != now and held:
                if sum(len(x[0]) for x in held) >= least:
                    yield now, [np.concatenate(x) for x in zip(*held)]
                held = []
            now = key
            held.append([x[i:j] for x in v])
    if held and sum(len(x[0]) for x in held) >= least:
        yield now, [np.concatenate(x) for x in zip(*held)]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't white space."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    ink = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:n]
    ends[:-1] &= ~ink[1:] | edge[1:n]
    st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return st, en, np.searchsorted(off, st, side="right") - 1


def dictionary(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the array of distinct words, told apart by their bytes; numbered as they appear."""
    off = np.zeros(len(st) + 1, np.int64)
    np.cumsum(en - st, out=off[1:])
    ink = buf[~SPACE[buf]] if len(st) else np.zeros(0, np.uint8)
    got = binaries(off, ink).dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False), got.dictionary


def binaries(off: np.ndarray, data) -> pa.Array:
    """Byte strings from their offsets and bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(data)])


def layout(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of byte strings."""
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def strong_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each byte string, mixed after every eight bytes."""
    off, data = layout(words)
    raw = np.append(data, np.zeros(8, np.uint8))
    loads = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    size, at = np.diff(off), off[:-1]
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    left = np.arange(len(size))
    while len(left):
        out[left] = mix((out[left] ^ (loads[at[left]] & keep[np.minimum(size[left], 8)])) * _ROLL)
        left = left[size[left] > 8]
        at, size = at + 8, size - 8
    return out


def span_hashes(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[st:en], from one prefix sum of a polynomial; made to spread, not to identify."""
    up, down = _powers_to(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[en] - total[st]) * down[st] + (en - st).astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of h."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ROLL + h[j : j + n]
    return mix(out)


def byte_ngrams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the n-byte windows within rows whose inner bytes aren't white space."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = SPACE[buf]
    good = np.ones(m, bool)
    for j in range(1, n - 1):
        good &= ~space[j : j + m]
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    good &= rows[:m] == rows[n - 1 :]
    at = np.flatnonzero(good)
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(257) + buf[at + j]
    return mix(h + np.uint64(n * int(_ROLL) % (1 << 64))), rows[at]


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Byte strings as zstd of their bytes, and their packed lengths."""
    off, data = layout(words)
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes()), pack(np.diff(off).astype(np.int32))


def unpack_words(data: bytes, lens: bytes) -> pa.Array:
    off = np.append(0, np.cumsum(unpack(lens, np.int32), dtype=np.int64))
    return binaries(off, zstandard.ZstdDecompressor().decompress(data))


def pack(a: np.ndarray) -> bytes:
    """Numbers as zstd over transposed bytes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """As pack, over the differences of ascending 64-bit values."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of parts equal ranges of the 64-bit space begins in ascending keys."""
    marks = (np.arange(parts, dtype=object) << 64) // parts
    return np.append(np.searchsorted(keys, np.array([int(x) for x in marks], dtype=np.uint64)), len(keys))
