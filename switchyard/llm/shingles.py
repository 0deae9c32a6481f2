"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over a batch.

Words are runs of bytes outside space and U+0009 to U+000D with A-Z lowered.  Word hashes come from one
cumulative sum over the bytes of a batch (a polynomial over random byte values, divided by the power of
the word's place), shingle hashes from five neighbouring word hashes.  A text with one to four words has one
shingle, the whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
STEP_BYTES = 2 << 20
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _Powers.upto(len(data))
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))  # one past the end
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(first, ends)
    return hashes, np.diff(upto, prepend=0)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - WIDTH + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WIDTH:
            found = np.sort(rolled[at : at + n - WIDTH + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            h = np.uint64(n)
            for w in words[at : at + n]:
                h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts are taken a few megabytes at a time."""
    held, size = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= STEP_BYTES:
                yield from _sets(held)
                held, size = [], 0
        if held:
            yield from _sets(held)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
