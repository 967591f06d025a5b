"""A rising sequence of numbers in little more than its information content.

Each number is split: its low bits are stored as they are, its high part as a step in a
bit vector, one set bit per number. The select samples, one per 64 numbers, lead to the
i-th set bit without reading what lies before it.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQQQQ")
SAMPLE = 64
#: Low bits are read from eight bytes at any bit, so a number has at most this many.
LOW_BITS = 56
#: Numbers whose low bits are spread out at a time, a multiple of eight.
CHUNK = 1 << 13

# Place of the k-th set bit in each byte.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    _IN_BYTE[_byte, : len(_set)] = _set


def pack(values: np.ndarray) -> bytes:
    """Encode numbers that never fall, the last being the largest."""
    n, universe = len(values), int(values[-1]) if len(values) else 0
    low_bits = min(LOW_BITS, max(0, (universe // n).bit_length() - 1)) if n else 0
    values = values.astype(np.uint64)
    places = np.arange(low_bits, dtype=np.uint64)
    low = (((values[a : a + CHUNK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel() for a in range(0, n, CHUNK))
    low_bytes = b"".join(np.packbits(bits, bitorder="little").tobytes() for bits in low)
    places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    steps = np.zeros((int(places[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
    steps[places] = 1
    high_bytes = np.packbits(steps, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4" if len(steps) < 1 << 32 else "<u8")
    return HEADER.pack(n, low_bits, len(low_bytes), len(high_bytes), samples.itemsize) + low_bytes + high_bytes + samples.tobytes()


class EliasFano:
    """Read access to ``pack``'s bytes, without unpacking them."""

    def __init__(self, data):
        self.n, self.low_bits, low, high, width = HEADER.unpack_from(data)
        at = HEADER.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        self.samples = np.frombuffer(data, f"<u{width}", -(-self.n // SAMPLE), at + low + high).astype(np.int64)
        self.size = at + low + high + width * len(self.samples)

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit."""
        place = self.samples[i // SAMPLE]
        byte, left = place >> 3, i % SAMPLE
        # Bits before the sampled one in its byte are counted again, so add them.
        left = left + np.bitwise_count(self.high[byte] & ((1 << (place & 7)) - 1).astype(np.uint8)) if len(i) else left
        while True:
            here = np.bitwise_count(self.high[byte])
            on = left >= here
            if not on.any():
                return 8 * byte + _IN_BYTE[self.high[byte], left]
            left = np.where(on, left - here, left)
            byte = np.where(on, byte + 1, byte)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers, for an array of indices."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.int64)
        high = self._place(i) - i
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        padded = np.concatenate([self.low, np.zeros(8, np.uint8)])
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word |= padded[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        low = (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return (high << self.low_bits) | low.astype(np.int64)
