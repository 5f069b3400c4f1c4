"""Word shingle sets as sorted 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_MIX = [np.uint64(x) for x in (0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729DA3ED1B1, 0x38495AB5C0B7E3A9)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    out = []
    for base in (_P, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(texts: list[str | None], is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text).  A word's hash is the polynomial of its
    bytes, from prefix sums over the whole batch; A-Z are lower-cased first."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    gap = is_space[b]
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not gap[0]:
        starts = np.concatenate([[0], starts])
    up, down = _powers(len(b) + 1)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    hashes = mix((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[3])
    text_ends = np.cumsum([len(r) for r in raw])
    return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; a text of fewer words has its
    whole word sequence as one shingle, a text without words an empty set."""
    words, counts = word_hashes(texts, SPACES)
    ends = np.cumsum(counts)
    if len(words) >= width:
        m = len(words) - width + 1
        rolled = np.zeros(m, np.uint64)
        for k in range(width):
            rolled = mix(rolled + words[k:m + k] * _MIX[k % 3] + np.uint64(k + 1))
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[end - n:end - width + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for k in range(end - n, end):
                h = mix(h + words[k:k + 1] * _MIX[0] + np.uint64(n + 101))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
