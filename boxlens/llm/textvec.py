"""Vectorised text helpers for Arrow batches: words and 64-bit word hashes straight from the
UTF-8 buffers, without a Python object per word.

All helpers work on slices of at most ``SLICE_BYTES`` (or one text, if that is longer), so
memory is bounded by the slice and not by the batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_PIECE = 1 << 20          # bytes hashed at once; a longer single word is hashed by blake2b
_SEED = 0x5EED0F7EC7
_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
BASE = np.uint64(_BASE)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in ((0, _BASE), (1, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0], _POW[1]


def byte_table(word: str, fold: dict[str, str] | None = None) -> np.ndarray:
    """256 entries: the byte a word keeps (A-Z lower-cased), 0 for separators.

    ``word`` is 'nonspace' (``[^\\x20\\x09-\\x0D]``) or 'alnum' (letters, digits and every
    non-ASCII byte); ``fold`` replaces single characters."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if word == "nonspace":
        t[[0x20, *range(0x09, 0x0E)]] = 0
        t[0] = 1        # NUL is an ordinary character here; \x01 shares its hash value
    elif word == "alnum":
        t[:0x30] = 0
        t[0x3A:0x41] = 0
        t[0x5B:0x61] = 0
        t[0x7B:0x80] = 0
    else:
        raise ValueError(word)
    for a, b in (fold or {}).items():
        t[ord(a)] = ord(b)
    return t


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last+1) text numbers of slices of at most ``limit`` bytes, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Words of consecutive texts ``data[off[0]:off[-1]]``.

    Returns (mapped bytes, starts, ends, word offsets): positions are relative to off[0];
    text t owns the words woff[t]:woff[t+1]."""
    m = table[data[off[0]:off[-1]]]
    rel = off - off[0]
    ok = m != 0
    prev = np.empty(len(ok) + 1, bool)
    prev[0] = False
    prev[1:] = ok
    begin = ok.copy()
    begin &= ~prev[:-1]
    nonempty = rel[:-1][rel[:-1] < rel[1:]]
    begin[nonempty] = ok[nonempty]          # a text starts a new word
    starts = np.flatnonzero(begin)
    stop = np.empty(len(ok), bool)
    stop[:-1] = ok[:-1] & ~ok[1:]
    if len(ok):
        stop[-1] = ok[-1]
    last = rel[1:][rel[:-1] < rel[1:]] - 1
    stop[last] = ok[last]
    ends = np.flatnonzero(stop) + 1
    return m, starts, ends, np.searchsorted(starts, rel)


def hash_words(m: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word ``m[starts[i]:ends[i]]`` (polynomial over random byte values, mixed)."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + _PIECE, side="right"))
        if j <= i:                                   # one word longer than a piece
            out[i] = np.frombuffer(hashlib.blake2b(m[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            i += 1
            continue
        a, b = int(starts[i]), int(ends[j - 1])
        seg = m[a:b]
        g = _BYTE[seg]
        pw, ipw = _powers(len(g))
        g *= pw[:len(g)]
        s = np.empty(len(g) + 1, np.uint64)
        s[0] = 0
        np.cumsum(g, out=s[1:])
        st, en = starts[i:j] - a, ends[i:j] - a
        h = (s[en] - s[st]) * ipw[st]
        out[i:j] = mix64(h + (en - st).astype(np.uint64))
        i = j
    return out


def shingles(h: np.ndarray, woff: np.ndarray, k: int = 5):
    """Hashes of k-word shingles per text: (hashes, offsets).  A text with fewer, but not no,
    words has one: its whole sequence (which never equals a k-word shingle)."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(soff[-1]), np.uint64)
    mul = np.uint64(_BASE)
    if len(h) >= k:
        g = np.full(len(h) - k + 1, k, np.uint64)
        for t in range(k):
            g *= mul
            g += h[t:len(h) - k + 1 + t]
        long = np.flatnonzero(n >= k)
        # the text of every shingle, then its place inside the text
        t = np.repeat(long, count[long])
        at = np.arange(len(t)) - np.repeat(np.concatenate([[0], np.cumsum(count[long])[:-1]]), count[long])
        out[soff[t] + at] = mix64(g[woff[t] + at])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        g = n[short].astype(np.uint64)
        for t in range(k - 1):
            has = n[short] > t
            g[has] = g[has] * mul + h[woff[short[has]] + t]
        out[soff[short]] = mix64(g)
    return out, soff


def sequence_hash(h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every text's whole word sequence."""
    res = []
    for salt in (np.uint64(0x1F3D5B79), np.uint64(0xA24BAED4963EE407)):
        g = mix64(h ^ salt)
        pos = np.arange(len(h), dtype=np.uint64)
        local = pos - np.repeat(woff[:-1], np.diff(woff)).astype(np.uint64)
        g = mix64(g + local * np.uint64(_BASE))           # a hash of (place, word): order counts
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g, dtype=np.uint64)])
        res.append(mix64(s[woff[1:]] - s[woff[:-1]] + np.diff(woff).astype(np.uint64)))
    return res[0], res[1]
