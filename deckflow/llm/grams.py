"""Words and n-grams of text as numpy arrays, and Rabin-Karp fingerprints.

A *span* is a stretch of a byte buffer. Its fingerprint is the polynomial of its
bytes modulo 2**64, taken from prefix sums, so any span costs a few array
operations. Fingerprints only propose equality: ``same_spans`` compares bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
A_TO_Z = np.arange(256, dtype=np.uint8)
A_TO_Z[65:91] += 32


class Words:
    """The words of the bytes of several texts, one after another.

    ``blanks`` part words, ``breaks`` end a piece as the end of a text does.
    ``norm`` has the words with A-Z in lower case and one space between words
    of a piece, so a run of words is the span from the first one's ``start`` to
    the last one's ``stop``. ``raw`` and ``raw_stop`` are places in ``data``;
    words of one piece share ``piece``; ``text`` is the number of the text.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, blanks: bytes, breaks: bytes):
        kind = np.zeros(256, np.uint8)
        kind[list(blanks)] = 1
        kind[list(breaks)] = 2
        lut = A_TO_Z.copy()
        lut[list(blanks)] = 32
        kind = kind[data]
        word, n = kind == 0, len(data)
        inner = starts[(starts > 0) & (starts < n)]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[inner - 1] = word[inner - 1]
        self.raw, self.raw_stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        keep = kind == 1
        keep[1:] &= word[:-1]
        keep[:1] = False
        keep |= word
        upto = np.cumsum(keep, dtype=np.int32)
        self.start, self.stop = upto[self.raw] - 1, upto[self.raw_stop - 1]
        self.norm = lut[data[keep]]
        self.text = np.searchsorted(starts, self.raw, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.raw) + self.text if breaks else self.text


class Powers:
    """Powers of the base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int):
        if n > len(self.up):
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 2 ** 64)))
        return self.up, self.down


class Fingerprints:
    """Prefix polynomials of a buffer, modulo 2**64; ``of(start, stop)`` is the
    value of a span with its bits mixed."""

    def __init__(self, norm: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(norm) + 1)
        self.sums = np.zeros(len(norm) + 1, np.uint64)
        np.cumsum((norm.astype(np.uint64) + np.uint64(1)) * up[:len(norm)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def same_spans(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Do the spans from ``a`` and from ``b``, as long as ``length`` says, hold
    the same bytes? Eight bytes of all pairs at a time; ``buffer`` must have
    eight bytes to spare behind the last span."""
    eight = np.ndarray(shape=(len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    same, left, at = np.ones(len(a), bool), np.flatnonzero(length > 0), 0
    while len(left):
        rest = np.minimum(length[left] - at, 8).astype(np.uint64)
        unlike = (eight[a[left] + at] ^ eight[b[left] + at]) << (np.uint64(64) - rest * np.uint64(8))
        same[left[unlike != 0]] = False
        at += 8
        left = left[(unlike == 0) & (length[left] > at)]
    return same


class Membership:
    """A Bloom filter over fingerprints: no false negatives. Its size follows
    the number of members up to ``LARGEST`` bits, so its memory is bounded at
    any size of the corpus; beyond that more strangers pass, at a cost of time."""

    LARGEST = 27  # 2**27 bits, 16 MB
    PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, log2: int, bits: np.ndarray | None = None):
        self.log2 = log2
        self.bits = np.zeros(1 << (log2 - 6), np.uint64) if bits is None else bits

    @classmethod
    def log2_for(cls, members: int) -> int:
        return min(cls.LARGEST, max(12, (16 * members).bit_length()))

    @staticmethod
    def places(fps: np.ndarray, log2: int, probe: int) -> np.ndarray:
        return (fps * np.uint64(probe)) >> np.uint64(64 - log2)

    @classmethod
    def marks(cls, fps: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
        """``(word, bits)`` of these members, each word once."""
        at = np.unique(np.concatenate([cls.places(fps, log2, p) for p in cls.PROBES]))
        word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        words, first = np.unique(word, return_index=True)
        return words.astype(np.int64), np.bitwise_or.reduceat(bit, first) if len(first) else bit

    def has(self, fps: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(fps), bool), np.arange(len(fps))
        for p in self.PROBES:
            at = self.places(fps[left], self.log2, p)
            left = left[(self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1]
        out[left] = True
        return out
