"""Word shingle sets and fast similarity sketches, vectorised over runs of documents with numpy.

A word is known by 64 mixed bits of its bytes, taken eight at a time (so words of up to eight bytes of one
length never collide), or of a BLAKE2 digest where it is long; a shingle by a mix of its k words' bits.
They propose links and count shingles; links are confirmed on the words themselves (``exact``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(7_919)
_SEEDS = _rng.integers(1, 2**63, 4096, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes from which on a word is digested.
LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works in place on a fresh array."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def runs(texts: list[bytes | str | None], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes (characters); a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space: what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def same(words: list[bytes]) -> bytes:
    """A 128-bit digest of a sequence of words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, split at ASCII white space), and where each text's begin."""
    joined = b"\n".join([b"", *[t or b"" for t in texts], b" " * 8]).lower()
    space = _SPACE[np.frombuffer(joined, dtype=np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    eight = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * _SEEDS[0])
    at = np.flatnonzero(size < LONG)
    for j in range(0, LONG, 8):
        if not len(at):
            break
        left = size[at] - j
        h[at] = mix(h[at] ^ (eight[starts[at] + j] & (_U(2**64 - 1) >> (_U(64) - _U(8) * np.minimum(left, 8).astype(np.uint64)))))
        at = at[left > 8]
    for i in np.flatnonzero(size >= LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    return h, np.searchsorted(starts, np.concatenate([[1], 1 + np.cumsum(lengths + 1)]))


def _chain(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(at), k, dtype=np.uint64)
    for j in range(k):
        h = mix(h * _U(0x2545F4914F6CDD1D) + words[at + j])
    return h


def sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingles; fewer than k words make one shingle, none an empty set."""
    words, begin = word_hashes(texts)
    counts = np.diff(begin)
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    if len(words) >= k:
        every = _chain(words, np.arange(len(words) - k + 1), k)
    for i, (b, n) in enumerate(zip(begin.tolist(), counts.tolist())):
        if n >= k:
            s = np.sort(every[b : b + n - k + 1])
            if n > k:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out[i] = s
        elif n:
            out[i] = _chain(words, np.array([b]), n)
    return out


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch with t coordinates of a non-empty set. In round r < t each element falls
    into a hashed bin with a hashed value; in round t + i all elements fall into bin i, so every
    coordinate fills. A coordinate is the smallest (round, value) in its bin; two sets agree on it
    with a chance equal to their Jaccard similarity, concentrated as if coordinates were independent."""
    out = np.full(t, np.uint64(2**64 - 1))
    low, empty = _U((1 << 48) - 1), _U(2**64 - 1)
    need = t * (np.log(t) + 2.0)
    r = 0
    while r < t:
        many = min(t - r, max(1, int(np.ceil(need / len(s)))))
        v = mix(s[None, :] ^ _SEEDS[r : r + many, None])
        bins = ((v >> _U(32)) * _U(t)) >> _U(32)
        value = (v & low) | (np.arange(r, r + many, dtype=np.uint64)[:, None] << _U(48))
        np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
        r += many
        if not (out == empty).any():
            return out
        need = t * 2.0
    for i in np.flatnonzero(out == empty).tolist():
        v = mix(s ^ _SEEDS[t + i])
        out[i] = (v & low).min() | _U((t + i) << 48)
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` coordinates, the band's number mixed in. (documents, bands)"""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    h = np.tile(_SEEDS[: t // rows], (n, 1))
    for j in range(rows):
        h = mix(h * _U(0x2545F4914F6CDD1D) ^ parts[:, :, j])
    return h


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def exact(a: list[bytes], b: list[bytes], k: int) -> tuple[int, int, int]:
    """Sizes of two texts' sets of k-word shingles and of their intersection, on the words themselves:
    words are numbered, and shingles by their words' numbers, both texts together."""
    if len(a) < k or len(b) < k:
        return max(bool(a), len(set(zip(*(a[i:] for i in range(k)))))), max(bool(b), len(set(zip(*(b[i:] for i in range(k)))))), int(a == b and len(a) > 0)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for w in chain(a, b)), dtype=np.int64, count=len(a) + len(b))
    at = words
    for j in range(1, k):
        at = np.unique((at[:-1] << 32) | words[j:], return_inverse=True)[1]
    x, y = np.unique(at[: len(a) - k + 1]), np.unique(at[len(a) :])
    return len(x), len(y), overlap(x, y)
