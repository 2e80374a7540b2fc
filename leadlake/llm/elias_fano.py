"""Elias-Fano code of ascending integers, with a select structure of 32-bit samples.

Of each value the ``width`` low bits are packed as they are; the high part of value
i sets bit (high + i) of a bit string, so that n values below u take about
n * (2 + log2(u / n)) bits. ``select`` jumps to the sampled place of every
256th set bit and counts on from there.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
_HEAD = struct.Struct("<QQIIII")


def _bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Ascending values of unsigned 64-bit range; the least is kept apart."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    least = int(values[0]) if n else 0
    rest = values - np.uint64(least)
    span = int(rest[-1]) + 1 if n else 1
    width = max(0, (span // max(n, 1)).bit_length() - 1)
    low = rest & np.uint64((1 << width) - 1)
    places = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    samples = places[::EVERY].astype("<u4").tobytes()
    packed, lows = np.packbits(high, bitorder="little").tobytes(), _bits(low, width)
    return _HEAD.pack(n, least, width, len(lows), len(packed), len(samples)) + lows + packed + samples


class EliasFano:
    def __init__(self, data):
        view = memoryview(data)
        self.n, self.least, self.width, lows, high, samples = _HEAD.unpack(view[: _HEAD.size])
        at = _HEAD.size
        self.low, at = np.frombuffer(view[at : at + lows], np.uint8), at + lows
        self.high, at = np.frombuffer(view[at : at + high], np.uint8), at + high
        self.samples, at = np.frombuffer(view[at : at + samples], "<u4"), at + samples
        self.size = at

    def _low(self, i: int) -> int:
        first, last = i * self.width, (i + 1) * self.width
        cut = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (cut >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value number i, without decoding those before its sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        byte, value = place // 8, int(self.high[place // 8]) >> (place % 8)
        base = place
        while left >= (ones := value.bit_count()):
            left -= ones
            byte += 1
            base, value = 8 * byte, int(self.high[byte])
        while left:
            value &= value - 1
            left -= 1
        place = base + (value & -value).bit_length() - 1
        return self.least + (((place - i) << self.width) | self._low(i))

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.width)
        if not self.width:
            return high + np.uint64(self.least)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        low = np.zeros(self.n, np.uint64)
        for i in range(self.width):
            low |= bits[:, i].astype(np.uint64) << np.uint64(i)
        return (high | low) + np.uint64(self.least)
