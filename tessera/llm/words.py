"""64-bit hashes of words and word n-grams, a slice of texts at a time.

A word's hash is a polynomial of its bytes modulo 2**64, got for all words of a
slice at once from one running sum, and mixed; an n-gram's hash mixes the sum of
its words' hashes times one odd constant per place. Equal words give equal
hashes on every machine.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

WHITE = bytes(range(9, 14)) + b" "
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, U(base), U)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def words_of(texts: list[bytes], separators: bytes = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice of texts: their hashes, the number of each one's text,
    and their start and end bytes within the slice; a text begins at the sum of
    (length + 1) of those before it."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    sep = is_sep[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each place on (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.full(m, U(n), U)
    for k in range(n):
        total += h[k:k + m] * _PLACE[k]
    return mix(total)


def shingle_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text: hashes, in ascending order
    within a text, and the bounds of each text's run. A text of 1 to n - 1 words has one
    shingle, its whole sequence; one without words has none."""
    h, doc, _, _ = words_of(texts)
    g = ngrams(h, n)
    if len(g):
        same = doc[: len(g)] == doc[n - 1:]
        g, owner = g[same], doc[: len(same)][same]
    else:
        owner = np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = np.array([ngrams(h[a:a + count[d]], int(count[d]))[0] for d, a in zip(short, first, strict=True)], U)
        g, owner = np.concatenate((g, whole)), np.concatenate((owner, short))
    # one sort for both keys: the text's number above, the hash's leading bits below
    bits = max(1, len(texts).bit_length())
    order = np.argsort((owner.astype(U) << U(64 - bits)) | (g >> U(bits)))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(texts) + 1))
