"""Elias-Fano sequences and a two-level n-gram trie over them, in one file that is mapped into memory."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

_U = np.uint64
#: Codes of a quantised probability: 0 is none, 255 is 1, each step below is a factor of 10 ** (-1 / STEPS).
STEPS = 28


def quantised(p: np.ndarray) -> np.ndarray:
    """One byte per probability, on a logarithmic scale; 0 for none."""
    with np.errstate(divide="ignore"):
        code = np.rint(255 + STEPS * np.log10(p))
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


#: The place of the nth one (from 0) in each byte; ones in all, or the highest bits, of eight bytes.
_NTH = np.array([[([p for p in range(8) if b >> p & 1] + [8] * 8)[n] for n in range(8)] for b in range(256)], np.uint8).ravel()
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)

LEVELS = np.r_[0.0, 10.0 ** ((np.arange(1, 256) - 255) / STEPS)]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a rank directory of 64-bit words."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(_U)
        low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        # low parts: low_bits bits each, little endian; at most 56, so that eight bytes from the first one hold a value
        low_bits = min(low_bits, 56)
        bits = np.zeros(0, np.uint8)
        if low_bits:
            wide = ((values[:, None] >> np.arange(low_bits, dtype=_U)) & _U(1)).astype(np.uint8)
            bits = np.packbits(wide.ravel(), bitorder="little")
        low = np.r_[bits, np.zeros(8, np.uint8)]
        at = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        size = (universe >> low_bits) + n + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[at] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.r_[0, np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64))]
        return cls(n, low_bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        bit = i.astype(np.int64) * self.low_bits
        byte = bit >> 3
        # eight bytes from each byte on
        word = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))[byte]
        return (word >> (bit & 7).astype(_U)) & _U((1 << self.low_bits) - 1)

    def _in_word(self, word: np.ndarray, nth: np.ndarray, bit: int) -> np.ndarray:
        """The position of the nth (from 0) bit of this value in each 64-bit word of the unary part."""
        bits = self.high.view("<u8")[word]
        if not bit:
            bits = ~bits
        nth = np.minimum(nth, 64).astype(_U)
        # ones of each byte, then of it and those before, as eight bytes
        upto = bits - ((bits >> _U(1)) & _U(0x5555555555555555))
        upto = (upto & _U(0x3333333333333333)) + ((upto >> _U(2)) & _U(0x3333333333333333))
        upto = ((upto + (upto >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
        full = ((((nth * _ONES) | _TOPS) - upto & _TOPS) >> _U(7)) * _ONES >> _U(56)  # bytes whose ones all come before
        shift = np.minimum(full, _U(7)) << _U(3)
        before = (upto << _U(8)) >> shift & _U(0xFF)
        found = _NTH[((bits >> shift & _U(0xFF)) << _U(3) | np.minimum(nth - before, _U(7))).astype(np.int64)]
        return np.where(full < 8, shift.astype(np.int64) + found, 64)

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + self._in_word(word, i - self.ones[word], 1)

    def select0(self, i: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.minimum(np.searchsorted(zeros, i, "right") - 1, len(self.ones) - 2)
        return word * 64 + self._in_word(word, i - zeros[word], 0)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.select1(i) - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The position of the first value that is at least x, n if none."""
        return self.sought(x)[0]

    def sought(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position of the first value that is at least x, n if none, and whether it is x: the run of equal high parts, then its low parts."""
        x = np.asarray(x, _U)
        h = (x >> _U(self.low_bits)).astype(np.int64)
        lo = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        hi = self.select0(h) - h
        want, run = x & _U((1 << self.low_bits) - 1), hi
        while True:
            open_ = lo < hi
            if not open_.any():
                same = lo < run
                same[same] = self._low(lo[same]) == want[same]
                return lo, same
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._low(mid[open_]) < want[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)


class Trie:
    """Contexts (level one) with pointers to their successors (level two) and quantised probabilities and back-off weights.

    ``contexts`` and ``words`` are sorted keys; a successor is stored as context position * number of words + word
    position, a monotone sequence over all contexts, and looked up by successor search from its context's position.
    """

    PARTS = ("contexts", "words", "backoff", "codes")

    def __init__(self, arrays: dict[str, np.ndarray], pointers: EliasFano, successors: EliasFano):
        self.arrays, self.pointers, self.successors = arrays, pointers, successors

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """From rows sorted by (context, word), each pair once, counts over 0: absolute discounting, what is left goes to back-off."""
        contexts, starts = np.unique(context, return_index=True)
        words, word_id = np.unique(word, return_inverse=True)
        ends = np.r_[starts[1:], len(context)]
        total = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
        kinds = ends - starts
        at = np.repeat(np.arange(len(contexts)), kinds)
        p = np.maximum(count - discount, 0.0) / np.maximum(total, 1)[at]
        arrays = {"contexts": contexts, "words": words, "backoff": quantised(discount * kinds / np.maximum(total, 1)), "codes": quantised(p)}
        keys = at.astype(_U) * _U(max(1, len(words))) + word_id.astype(_U)
        return cls(arrays, EliasFano.of(np.r_[starts, len(context)], len(context) + 1), EliasFano.of(keys, max(1, len(contexts) * len(words))))

    def save(self, path: str) -> None:
        parts, head, at = [], {}, 0
        sequences = {f"{name}.{k}": getattr(s, k) for name, s in (("pointers", self.pointers), ("successors", self.successors)) for k in ("low", "high", "ones")}
        for name, x in {**self.arrays, **sequences}.items():
            at += -at % 8
            head[name] = [str(x.dtype), at, len(x)]
            parts.append((at, x))
            at += x.nbytes
        said = json.dumps({"parts": head, "n": {k: [s.n, s.low_bits] for k, s in (("pointers", self.pointers), ("successors", self.successors))}}).encode()
        with open(path, "wb") as f:
            f.write(len(said).to_bytes(8, "little") + said)
            base = f.tell() + -f.tell() % 8
            for at, x in parts:
                f.seek(base + at)
                f.write(np.ascontiguousarray(x).tobytes())
            f.truncate(max(f.tell(), base + 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie of a file, mapped into memory."""
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        n = int.from_bytes(raw[:8].tobytes(), "little")
        said = json.loads(raw[8 : 8 + n].tobytes())
        base = 8 + n + -(8 + n) % 8

        def part(name):
            kind, at, length = said["parts"][name]
            return raw[base + at : base + at + length * np.dtype(kind).itemsize].view(kind)

        sequences = [EliasFano(*said["n"][k], part(f"{k}.low"), part(f"{k}.high"), part(f"{k}.ones")) for k in ("pointers", "successors")]
        return cls({k: part(k) for k in cls.PARTS}, *sequences)

    @classmethod
    def mapped(cls, *rows, discount: float) -> Trie:
        """Built, written to a temporary file and mapped; the file has no name any more and goes with the trie."""
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            cls.build(*rows, discount).save(path)
            return cls.open(path)
        finally:
            os.unlink(path)

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of the pair, code of its context's back-off weight) for each query; 0 where it is not in the trie."""
        contexts, words = self.arrays["contexts"], self.arrays["words"]
        codes, weights = np.zeros(len(context), np.uint8), np.zeros(len(context), np.uint8)
        if not len(contexts) or not len(context):
            return codes, weights
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        seen = contexts[at] == context
        weights[seen] = self.arrays["backoff"][at[seen]]
        w = np.minimum(np.searchsorted(words, word), len(words) - 1)
        live = np.flatnonzero(seen & (words[w] == word))
        for part in np.array_split(live, max(1, len(live) // 65536)):
            if not len(part):
                continue
            # pointers bound the context's range; queries come in order, so each context is read once
            first, where = np.unique(at[part], return_inverse=True)
            end = self.pointers.access(first + 1).astype(np.int64)[where]
            key = at[part].astype(_U) * _U(len(words)) + w[part].astype(_U)
            found, same = self.successors.sought(key)
            same &= found < end
            codes[part[same]] = self.arrays["codes"][found[same]]
        return codes, weights
