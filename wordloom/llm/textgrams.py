"""Vectorised hashing of words, word shingles and character shingles of UTF-8 batches.

A word's hash is a polynomial in a random odd base over random byte values
(A-Z share the values of a-z), taken from one running sum over the batch, so no
Python object is made per word. Words are ``[^\\x20\\x09-\\x0D]+``. Batches are
cut into pieces of half a MB, at white space or between documents; texts of any
length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_random = np.random.RandomState(20240229)
_value = _random.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = _value.copy()
LOWER[65:91] = _value[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def running_hash(values: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial of values[s:e], still times BASE**s."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=out[1:])
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end between documents or before white space."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            edge = offsets[np.searchsorted(offsets, to, "right") - 1]
            if edge > at + PIECE // 2:
                to = int(edge)
            else:  # inside a long text: on to its next white space or its end
                stop = int(offsets[np.searchsorted(offsets, to, "right")])
                while to < stop:
                    space = np.flatnonzero(SPACE[data[to: min(to + 65536, stop)]])
                    if len(space):
                        to += int(space[0])
                        break
                    to = min(to + 65536, stop)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, split_tail: bool = False):
    """Yields (first byte, words' starts, ends, hashes) for piece after piece.

    ``split_tail`` makes a comma or full stop after an ASCII letter and before
    white space or the end a word of its own.
    """
    inner = np.unique(offsets)
    for lo, hi in _cuts(data, offsets):
        piece = data[lo:hi]
        solid = ~SPACE[piece]
        edge = np.zeros(hi - lo + 1, bool)
        edge[inner[np.searchsorted(inner, lo): np.searchsorted(inner, hi, "right")] - lo] = True
        edge[0] = edge[-1] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        if split_tail and len(piece):
            letter = ((piece | 32) >= 97) & ((piece | 32) <= 122)
            tail = ends & ((piece == 44) | (piece == 46)) & ~starts
            tail[1:] &= letter[:-1]
            tail[0] = False
            where = np.flatnonzero(tail)
            starts[where] = True
            ends[where - 1] = True
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        total = running_hash(LOWER[piece])
        _, down = powers(len(piece) + 1)
        yield lo, s, e, mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per document the index of its first word (one more at the end)."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, s, _, h in word_spans(data, offsets):
        hashes.append(h)
        starts.append(s + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def word_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one."""
    words, first = word_hashes(data, offsets)
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = rolled * BASE + words[k: k + len(rolled)]
    rolled = mix(rolled + np.uint64(n))
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            yield distinct(rolled[a: b - n + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = h * BASE + words[k]
            yield mix(h + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def char_shingles(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every line's k-character shingles (repeats included), and their offsets; a shorter line is one shingle."""
    sizes = np.array([len(x) for x in lines], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = running_hash(mix(codes.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
    _, down = powers(len(codes) + 1)
    width = np.minimum(sizes, k)
    counts = np.where(sizes > 0, sizes - width + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(at[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    wide = np.repeat(width, counts)
    return mix((total[start + wide] - total[start]) * down[start] + wide.astype(np.uint64)), offsets


def sketches(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One MinHash row of ``bins`` values per set, by fast similarity sketching.

    In round i every element falls into one bin with a value above those of the
    rounds before; a set leaves once its bins are full, so long sets cost about
    one hash per element, and short ones still fill every bin alike. From round
    ``bins`` on all elements fall into bin i - bins, which fills the rest. Empty
    sets keep the largest value everywhere.
    """
    sets, empty = len(offsets) - 1, np.uint64((1 << 64) - 1)
    out = np.full((sets, bins), empty, np.uint64)
    owner, x = np.repeat(np.arange(sets), np.diff(offsets)), hashes
    for i in range(2 * bins):
        if not len(x):
            break
        h = mix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & ((1 << 64) - 1)))
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out.reshape(-1), owner * bins + at, (np.uint64(i) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)))
        open_ = (out == empty).any(axis=1)[owner]
        owner, x = owner[open_], x[open_]
    return out


def bands(rows: np.ndarray, width: int) -> np.ndarray:
    """Hash of every band of ``width`` values of every row; bands of another number never agree."""
    parts = rows.reshape(len(rows), -1, width)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(width):
        h = mix(h * BASE + parts[:, :, k])
    return h
