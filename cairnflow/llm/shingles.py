"""Word shingles as hashes of two 64-bit lanes, computed for many texts at once with numpy.

A word is read eight bytes at a time; each step mixes them into both lanes, so that (unlike in a sum of powers) no structure of a
word can cancel out, and words of at most eight bytes never meet. A word of over ``LONG_WORD`` bytes gets a BLAKE2b digest instead.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_KEY = b"cairnflow words"
#: Start values and odd multipliers of the lanes, for the bytes of a word and for a word's place in a shingle.
_STARTS = (_U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47))
_BYTES = ((_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)), (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)))
_LANES = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_STEP = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of text that are hashed together.
TOGETHER = 1 << 20
#: Bytes of a word from which it is hashed on its own.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_lanes(texts: list[bytes], fold: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Both lanes of the words of all texts in order, A-Z as a-z (unchanged without ``fold``), and the number of words of each text."""
    if not texts:
        return [np.zeros(0, _U)] * 2, np.zeros(0, np.int64)
    joined = b"\n".join([*texts, b""])
    if fold:
        joined = joined.translate(LOWER)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    space = SPACE[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(np.r_[True, space[:-1]] != space)
    starts, ends = edges[::2], edges[1::2]  # by turns, as the last byte is a space
    eights = np.frombuffer(joined + bytes(16 - len(joined) % 8), "<u8")
    left = ends - starts
    lanes = [s + left.astype(_U) * _STEP for s in _STARTS]
    live, at = np.flatnonzero(left <= LONG_WORD), starts
    if len(live) < len(left):
        for i in np.flatnonzero(left > LONG_WORD).tolist():
            digest = np.frombuffer(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=16, key=_KEY).digest(), "<u8")
            lanes[0][i], lanes[1][i] = digest
        at, left = at[live], left[live]
    with np.errstate(over="ignore"):
        while len(live):
            shift = (at & 7).astype(_U) << _U(3)
            chunk = eights[at >> 3] >> shift | eights[(at >> 3) + 1] << (_U(63) - shift) << _U(1)
            chunk &= _MASKS[np.minimum(left, 8)]
            for lane, (one, two) in zip(lanes, _BYTES):
                x = (lane[live] ^ chunk) * one
                x ^= x >> _U(32)
                x *= two
                x ^= x >> _U(29)
                lane[live] = x
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return lanes, np.diff(np.r_[0, np.searchsorted(starts, bounds)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One lane of the words' digests, and the number of words of each text."""
    lanes, counts = word_lanes(texts)
    return lanes[0], counts


def grouped(texts: list[bytes]):
    """Ranges (from, to) of texts of about TOGETHER bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= TOGETHER:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distinct (low, high) as rows sorted by low, then high."""
    order = np.argsort(low)
    low, high = low[order], high[order]
    same = low[1:] == low[:-1]
    if (same & (high[1:] != high[:-1])).any():
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        same = low[1:] == low[:-1]
    new = np.r_[True, ~same | (high[1:] != high[:-1])][: len(low)]
    return np.stack([low[new], high[new]])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles' lanes as two rows, sorted by the first; a text of fewer words has one of all its words, none without words."""
    out = []
    for a, b in grouped(texts):
        lanes, counts = word_lanes(texts[a:b])
        with np.errstate(over="ignore"):
            joined = []
            for h, step in zip(lanes, _LANES):
                s = h[: max(0, len(h) - width + 1)].copy()
                for i in range(1, width):
                    s *= step
                    s += h[i : i + len(s)]
                joined.append(mix(s))
            at = 0
            for n in counts.tolist():
                if n >= width:
                    out.append(_distinct(joined[0][at : at + n - width + 1], joined[1][at : at + n - width + 1]))
                elif n:
                    whole = [_U(n)] * 2
                    for i in range(at, at + n):
                        whole = [w * step + h[i] for w, step, h in zip(whole, _LANES, lanes)]
                    out.append(np.stack([mix(np.array([w], _U)) for w in whole]))
                else:
                    out.append(np.zeros((2, 0), _U))
                at += n
    return out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets have in common, by both lanes."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return int(np.count_nonzero(x[1][i] == y[1][j]))
