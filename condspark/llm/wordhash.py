"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, the separators of every
word contract in this subpackage.  UTF-8 never uses those bytes inside a longer code
point, so words can be cut on bytes.  A word is hashed in groups of eight bytes, each mixed
into what the groups before and the length gave, all words' k-th groups at once, so no Python object is
made per word; words of equal length up to eight bytes never collide.  The few above ``LONG`` bytes
are hashed one by one.  A second seed gives an independent hash.  Text is handled in pieces of about ``PIECE`` bytes that end between words, which bounds
the temporary arrays whatever a document's length.
"""

from __future__ import annotations

import ctypes
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
STEP = 12_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LONG = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: By the bytes of a group that a word has.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH, _SEED = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hashes of raw[start:end] for each of the spans; with ``lower``, A-Z as a-z."""
    n = end - start
    out = mix(n.astype(np.uint64) * _LENGTH + np.uint64(seed * _SEED % 2**64))
    if not len(n):
        return out
    low, high = int(start.min()), int(end.max())
    held = np.zeros(high - low + 8, np.uint8)
    held[:-8] = _LOWER.take(raw[low:high]) if lower else raw[low:high]
    groups = np.lib.stride_tricks.as_strided(held[:8].view("<u8"), (high - low + 1,), (1,))  # from any byte on
    at, left = start - low, n
    out = mix(out ^ groups[at] & _MASK[np.minimum(left, 8)])
    on = np.flatnonzero((n > 8) & (n <= LONG))
    at, left = at[on], left[on]
    while len(on):
        at, left = at + 8, left - 8
        out[on] = mix(out[on] ^ groups[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        on, at, left = on[more], at[more], left[more]
    for i in np.flatnonzero(n > LONG).tolist():
        long = held[start[i] - low : end[i] - low].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(long, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


#: Every ASCII character but letters and digits parts words.
PLAIN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(column: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE, seed: int = 0):
    """Words of every text: (hash uint64[], start int64[], end int64[], first int64[n + 1], bytes).

    start and end are byte places in ``bytes``; the words of text i are first[i]:first[i + 1].
    With ``lower``, A-Z are hashed as a-z.  ``gaps``: which bytes part words.
    """
    offsets, raw = string_buffers(column)
    n = len(offsets) - 1
    lo, hi = (int(offsets[0]), int(offsets[-1])) if n >= 0 and len(offsets) else (0, 0)
    hashes, starts, ends = [], [], []
    at = lo
    while at < hi:
        to = min(hi, at + PIECE)
        # a piece ends where a word ends: at a separator, or where a text starts
        while to < hi and not gaps[raw[to]]:
            k = int(np.searchsorted(offsets, to))
            edge = int(offsets[k]) if k < len(offsets) else hi
            gap = np.flatnonzero(gaps[raw[to : min(edge, to + 65536)]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(edge, to + 65536)
            if to == edge:
                break
        b = raw[at:to]
        solid = ~gaps.take(b)
        begin, finish = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        edges = edges[edges < len(b)]
        begin[edges] = solid[edges]
        inner = edges[edges > 0] - 1
        finish[inner] = solid[inner]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        hashes.append(spans(b, s, e, seed, lower))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets), raw


_FACTOR = np.uint64(0xA24BAED4963EE407 | 1)


def windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` successive word hashes (len(h) - size + 1 of them).

    Built by doubling, in about 2 log2(size) passes; runs over text borders are the caller's to drop.
    """
    return windows_of(single(h, seed), size)


def single(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """What windows starts from; made once for several sizes."""
    return mix(h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


def windows_of(block: np.ndarray, size: int) -> np.ndarray:
    h, n = block, len(block) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, width, rest = None, 0, 1, size
    factor = _FACTOR
    while True:
        if rest & 1:
            out = block if out is None else out[: len(out) - width] * factor + block[have:]
            have += width
            out = out[: len(h) - have + 1]
        rest >>= 1
        if not rest:
            return mix(out[:n])
        block = block[: len(block) - width] * factor + block[width:]
        if width > 1:  # else long runs of few words would meet in their polynomials
            block ^= block >> np.uint64(32)
        factor = np.uint64(int(factor) ** 2 % 2**64)
        width *= 2


def steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about ``size`` bytes, with the place of each run."""
    offsets, _ = string_buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, column.slice(a, b - a)
        a = b


_trimmed = [0.0]


def trim(every: float = 2.0) -> None:
    """Gives freed memory back to the system, which worker processes, used again, would keep; now and then alone."""
    if time.monotonic() < _trimmed[0] + every:
        return
    _trimmed[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, which trims after every batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fn(batches):
            yield batch
            del batch
            trim()

    return each


def tidied(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """fn for applyInArrow, which trims after every group."""

    def then(out: pa.Table) -> pa.Table:
        trim()
        return out

    # the number of parameters tells whether the key is wanted
    n = fn.__code__.co_argcount
    if n == 1:
        return lambda rows: then(fn(rows))
    if n == 2:
        return lambda a, b: then(fn(a, b))
    return lambda key, a, b: then(fn(key, a, b))
