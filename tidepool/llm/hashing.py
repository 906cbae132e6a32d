"""Vectorised hashing of words, word ranges and byte ranges over Arrow text buffers.

Everything here works on one *chunk*: the texts of some documents laid end to
end in a uint8 array, with the offset at which each begins. Chunks are cut so
that they hold about ``CHUNK`` bytes, or one document if it is longer; texts
are never cut. Hashes have 64 bits; where texts of a whole corpus are told apart,
two of them are used (``again``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
#: The six bytes that end a word, and an odd multiplier.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed one by one.
LONG = 256

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240117)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(U)  # a copy
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value of two, in their order."""
    x = a * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x += b
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(29)
    return x


class Loads:
    """Eight bytes, or fewer, from any place, as one number."""

    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

    def __init__(self, flat: np.ndarray):
        padded = np.zeros((len(flat) + 23) // 8 * 8, np.uint8)
        padded[: len(flat)] = flat
        self.words = padded.view("<u8")

    def __call__(self, at: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        place, shift = at >> 3, ((at & 7) << 3).astype(U)
        x = self.words[place] >> shift
        x |= self.words[place + 1] << U(1) << (U(63) - shift)
        return x if size is None else x & self.MASKS[size]


def span_hash(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes. Different spans of up to eight bytes and one length never agree."""
    size = end - start
    h = mix(size + 1)
    if not len(flat):
        return h
    loads, step = Loads(flat), 0
    at = np.flatnonzero((size > 0) & (size <= LONG))
    while len(at):
        left = size[at] - 8 * step
        h[at] = mix(h[at] * U(BASE) ^ loads(start[at] + 8 * step, np.minimum(left, 8)))
        step += 1
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(blake2b(flat[start[i] : end[i]].data, digest_size=8).digest(), "little")
    return h


class Runs:
    """Hashes of runs of units. A run is told by the two halves, or overlapping parts, of a power of two units that cover it.

    No sums or polynomials: runs that differ by a pattern (signs that alternate
    at every scale, say) agree no likelier than others.
    """

    def __init__(self, base: np.ndarray, level: int = 0):
        self.base, self.level, self.n = base, level, len(base) + (1 << level) - 1 if len(base) else 0
        self._at = (level, base)

    def _upto(self, level: int) -> np.ndarray:
        """Hashes of 2**level units from each place."""
        at, h = self._at if self._at[0] <= level else (self.level, self.base)
        while at < level:
            h = _pair(h[: -(1 << at)], h[1 << at :]) if len(h) > 1 << at else np.zeros(0, U)
            at += 1
        self._at = (at, h)
        return h

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        power = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        out = mix(size ^ 0x5D1E)
        out[size == 0] = 0
        for j in np.unique(power[size > 0]).tolist():
            at = np.flatnonzero((power == j) & (size > 0))
            if j < self.level:
                out[at] = self.short(starts[at], ends[at])
                continue
            h = self._upto(j)
            out[at] = mix(_pair(h[starts[at]], h[ends[at] - (1 << j)]) ^ out[at])
        return out

    def all_of(self, length: int) -> np.ndarray:
        """Of every run of ``length`` units, by start."""
        n = max(0, self.n - length + 1)
        j = max(self.level, length.bit_length() - 1)
        if length < 1 << j:
            at = np.arange(n)
            return self.short(at, at + length)
        h = self._upto(j)
        return mix(_pair(h[:n], h[length - (1 << j) : length - (1 << j) + n]) ^ mix(np.array([length ^ 0x5D1E]))[0]) if n else np.zeros(0, U)


class ByteRuns(Runs):
    """Of bytes: eight are read at once."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        super().__init__(mix(Loads(flat)(np.arange(len(flat) - 7))) if len(flat) >= 8 else np.zeros(0, U), 3)
        self.n = len(flat)

    def short(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(self.flat, starts, ends)


class Prefixes:
    """Hashes of any short spans of bytes, from prefix sums of a polynomial modulo 2**64.

    For lookups of many spans that begin or end at one place. Spans of some
    hundreds of bytes that differ by a pattern can agree: use ``span_hash`` to tell texts apart.
    """

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_TABLE[flat] * up[:n], out=self.sums[1:], dtype=U)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


_held: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, grown on demand."""
    if len(_held[0]) < n:
        n = max(n, 2 * len(_held[0]))
        _held[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U), dtype=U)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _held


class Words:
    """The words of a chunk: byte bounds, 64-bit hashes, and each document's first word."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        is_word = IS_WORD[flat]
        inner = is_word.copy()
        inner[1:] &= is_word[:-1]
        inner[:1] = False
        inner[offsets[:-1][offsets[:-1] < len(flat)]] = False
        self.starts = np.flatnonzero(is_word & ~inner)
        follows = np.zeros(len(flat), bool)
        follows[:-1] = inner[1:]
        self.ends = np.flatnonzero(is_word & ~follows) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hash(flat, self.starts, self.ends) if hashed and len(flat) else np.zeros(0, U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document's place in the chunk, by word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` successive words; those that cross documents are for the caller to leave out."""
    return Runs(hashes).all_of(n)


def again(hashes: np.ndarray) -> np.ndarray:
    """Other values of the same units, for a second hash of runs."""
    return mix(hashes ^ U(0xC2B2AE3D27D4EB4F))


def chunks(batch: pa.RecordBatch, text: int, most: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a batch's binary column ``text``; null counts as empty."""
    column = batch.column(text)
    if column.null_count:
        column = column.fill_null(b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        end = min(end, n)
        yield slice(at, end), flat[bounds[at] : bounds[end]], (bounds[at : end + 1] - bounds[at])
        at = end


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each ``width`` successive values (by their top 40 bits)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    assert n < 1 << 24 or width < 1 << 24
    place = np.arange(n, dtype=U)
    if n >= 1 << 24:  # one very long document: by parts that overlap
        step = (1 << 24) - width
        parts = [sliding_argmin(hashes[i : i + step + width - 1], width) + i for i in range(0, n - width + 1, step)]
        return np.concatenate(parts)
    key = (hashes >> U(24) << U(24)) | place
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if width > size:
        key = np.minimum(key[: n - width + 1], key[width - size :][: n - width + 1])
    return (key & U((1 << 24) - 1)).astype(np.int64)
