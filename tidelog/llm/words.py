"""Words of UTF-8 texts as 64-bit hashes, computed on whole byte buffers.

A word is a maximal run of bytes that a table marks. A polynomial hash over
the whole buffer gives the hash of any slice by one subtraction, so words,
prefixes and suffixes need no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that are words' bytes where words are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Texts are handled in groups of about so many bytes.
CHUNK = 1 << 20
#: A longer text is cut, between words, into pieces of this size.
PIECE = 1 << 22

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (1 << 16))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


@dataclass
class Slices:
    """Byte offsets of the words of a buffer, with the means to hash slices of it."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power("inverse", _R_INV, len(self.sums))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(data: bytes, table: np.ndarray) -> Slices:
    """The words of one buffer, whose letters A-Z the caller has lowered."""
    a = np.frombuffer(data, np.uint8)
    marks = np.zeros(len(a) + 2, bool)
    marks[1:-1] = table[a]
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _power("power", _R, len(a)), out=sums[1:])
    return Slices(a, edges[0::2], edges[1::2], sums)


def _pieces(data: bytes, table: np.ndarray) -> Iterator[bytes]:
    """Cuts of a long text, each between two words."""
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        while cut < len(data) and table[data[cut]] and table[data[cut - 1]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def hashed(texts: Iterable[str | None], table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of groups of texts: ``(first, count, hashes, bounds)``.

    Text ``first + i`` has the hashes ``hashes[bounds[i]:bounds[i + 1]]``.
    A null text has no words.
    """
    first, group, size = 0, [], 0
    k = -1
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if group and size + len(data) > CHUNK:
            yield _group(first, group, table)
            first, group, size = k, [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield _group(first, group, table)


def _group(first: int, group: list[bytes], table: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    if len(group) == 1 and len(group[0]) > PIECE:
        parts = []
        for piece in _pieces(group[0], table):
            s = slices(piece, table)
            parts.append(s.hashes(s.starts, s.ends))
        found = np.concatenate(parts)
        return first, 1, found, np.array([0, len(found)])
    s = slices(b" ".join(group), table)
    offsets = np.cumsum([0, *(len(x) + 1 for x in group)])
    return first, len(group), s.hashes(s.starts, s.ends), np.searchsorted(s.starts, offsets)


_LANES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, ``len(words) - k + 1`` of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k * 0xA0761D6478BD642F % (1 << 64), np.uint64)
    for i in range(k):
        # another odd factor for each place, so that the order of words counts
        total += mix(words[i : i + n] * _LANES[i % 64] + np.uint64(i))
    return mix(total)


def grams(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``k`` words of each text of a group: ``(hash, text)``.

    A text of fewer words, but not none, has its whole sequence as its one
    shingle.
    """
    count = np.diff(bounds)
    every = windows(words, k)
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.zeros(len(every), bool)
    if len(every):
        inside[:] = owner[: len(every)] == owner[k - 1 :]
    short = np.flatnonzero((count > 0) & (count < k))
    extra = np.array([windows(words[bounds[i] : bounds[i + 1]], int(count[i]))[0] for i in short], np.uint64)
    return np.concatenate([every[inside], extra]), np.concatenate([owner[: len(every)][inside], short])


def gram_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text and hash, and each text's bounds in them."""
    h, owner = grams(words, bounds, k)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(bounds)))
