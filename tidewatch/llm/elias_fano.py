"""Elias-Fano coding of a non-decreasing sequence: near-minimal space, any element in constant time.

Each value is split: its ``low_bits`` lowest bits are stored as they are, and its high part h as a
one at bit h + i of a bit vector. Element i's high part is found by select(i), the place of the
i-th one; every 64th place is sampled, so a select reads a sample and scans few bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLED = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class EliasFano:
    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Code values, which are not negative and do not decrease."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(v[-1]) // n).bit_length()
        bits = max(0, bits - 1)
        places = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(),
                   ones[::SAMPLED].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The place of the i-th one (from 0) in the high bits."""
        place = int(np.frombuffer(self.samples, "<u4")[i // SAMPLED])
        left = i % SAMPLED
        bits = np.frombuffer(self.high, np.uint8)
        byte, done = place // 8, place % 8
        word = int(bits[byte]) >> done << done
        while True:
            ones = int(_ONES[word])
            if ones > left:
                for b in range(8):
                    if word >> b & 1:
                        if left == 0:
                            return byte * 8 + b
                        left -= 1
            left -= ones
            byte += 1
            word = int(bits[byte])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (self.low[at // 8] >> at % 8 & 1) << k
        return self.select(i) - i << self.low_bits | low

    def all(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = low.reshape(self.n, self.low_bits).astype(np.int64)
        low = (low << np.arange(self.low_bits)).sum(1) if self.low_bits else 0
        return (ones - np.arange(self.n) << self.low_bits) + low
