"""Words of many texts at once, as 64-bit hashes, straight from Arrow's string buffers.

A word is a run of bytes of a class. Its hash is a polynomial over its bytes in arithmetic modulo
2**64, read off prefix sums, so the cost is a few numpy operations a byte and no Python object a word.
Such polynomials are known to collide on certain words of 1024 bytes and more; long words are hashed
by xxHash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes from which words are hashed one by one.
_LONG = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text whose A-Z are lower-case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out = np.full(max(n, _PIECE + 4096), _U(base))
        out[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit over all 64."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return buf, off


def blocks(off: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about so many bytes; a longer text is a range of its own."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def hash_words(buf: np.ndarray, off: np.ndarray, word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts buf[off[i]:off[i+1]], in order, and the words before each text (len(off))."""
    first, last = int(off[0]), int(off[-1])
    starts_all, hashes_all = [], []
    edge = off[(off > first) & (off < last)]
    at = first
    while at < last:
        to = min(at + _PIECE, last)
        while to < last and word[LOWER[buf[to - 1]]] and word[LOWER[buf[to]]]:
            nxt = np.flatnonzero(~word[LOWER[buf[to : to + 4096]]])
            to = to + int(nxt[0]) if len(nxt) else min(to + 4096, last)
        low = LOWER[buf[at:to]]
        is_word = word[low]
        begin, end = is_word.copy(), is_word.copy()
        begin[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        cuts = edge[(edge > at) & (edge < to)] - at
        begin[cuts] = is_word[cuts]
        end[cuts - 1] = is_word[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        n = to - at
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((low.astype(_U) + _U(1)) * _power(_BASE, n), out=sums[1:])
        h = (sums[e] - sums[s]) * _power(_INVERSE, n)[s]
        h = mix(h ^ ((e - s).astype(_U) << _U(48)))
        for i in np.flatnonzero(e - s > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(low[s[i] : e[i]].tobytes())
        hashes_all.append(h)
        starts_all.append(s + at)
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes_all) if hashes_all else np.zeros(0, _U)
    return hashes, np.searchsorted(starts, off)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + size[i]] of all i, one after another."""
    upto = np.cumsum(size)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)]


def hash_strings(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each whole string buf[off[i]:off[i+1]], as it stands."""
    out = np.zeros(len(off) - 1, _U)
    for a, b in blocks(off, _PIECE):
        s, e = off[a:b] - off[a], off[a + 1 : b + 1] - off[a]
        own = buf[off[a] : off[b]]
        if len(own) <= _PIECE:
            sums = np.zeros(len(own) + 1, dtype=_U)
            np.cumsum((own.astype(_U) + _U(1)) * _power(_BASE, len(own)), out=sums[1:])
            out[a:b] = mix((sums[e] - sums[s]) * _power(_INVERSE, len(own) + 1)[s] ^ ((e - s).astype(_U) << _U(48)))
        for i in np.flatnonzero(e - s > _LONG):
            out[a + i] = xxhash.xxh3_64_intdigest(own[s[i] : e[i]].tobytes())
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (len - k + 1); runs over the end of a text are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a text's words as one shingle, apart from those of other lengths."""
    out = _U(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = out * _U(0xD6E8FEB86659FD93) + h
    return mix(np.array([out ^ _U(0x5BF03635F0A31B29)]))[0]


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int, word: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; a text of fewer words has its whole sequence as one."""
    for a, b in blocks(off):
        hashes, first = hash_words(buf, off[a : b + 1], word)
        runs = shingles(hashes, k)
        for i in range(b - a):
            s, e = int(first[i]), int(first[i + 1])
            if e == s:
                yield np.zeros(0, _U)
            elif e - s < k:
                yield np.array([whole(hashes[s:e])], dtype=_U)
            else:
                own = np.sort(runs[s : e - k + 1])
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                yield own[keep]
