"""Elias-Fano coding of a non-decreasing sequence, with select samples.

A value is cut into `low_bits` low bits, stored packed, and its high part, stored as unary gaps in a bitmap: about
2 + log2(universe / n) bits a value. The place of every 256th set bit is kept in 32 bits, so that one value is found by
scanning a bounded stretch of the bitmap; no table of 64-bit offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = "<QBQQ"  # values, low bits, first value (two's complement), bytes of the bitmap


def encode(values: np.ndarray) -> bytes:
    """values: int64, non-decreasing."""
    n = len(values)
    if n == 0:
        return struct.pack(HEAD, 0, 0, 0, 0)
    first = int(values[0])
    gaps = values.astype(np.uint64) - np.uint64(first & (2**64 - 1))
    low = max(0, (int(gaps[-1]) // n).bit_length() - 1)
    high = (gaps >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    places = high + np.arange(n)
    bits = np.zeros(int(places[-1]) + 1, np.uint8)
    bits[places] = 1
    bitmap = np.packbits(bits, bitorder="little").tobytes()
    shifts = np.arange(low, dtype=np.uint64)
    lows = b"".join(
        np.packbits(((part[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        for part in np.split(gaps, range(65_536, n, 65_536))  # 65,536 values fill whole bytes
    ) if low else b""
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, low, first & (2**64 - 1), len(bitmap)) + samples + bitmap + lows


class EliasFano:
    """Reader over the bytes written by encode(), from `at` on; `end` is where they end."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.n, self.low, self.first, size = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", count, at)
        at += 4 * count
        self.bitmap = np.frombuffer(data, np.uint8, size, at)
        at += size
        bytes_low = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, bytes_low, at)
        self.end = at + bytes_low

    def _low(self, start: int, stop: int) -> np.ndarray:
        if not self.low:
            return np.zeros(stop - start, np.uint64)
        a, b = start * self.low, stop * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return (bits.reshape(-1, self.low).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop - 1 as int64; reads only the stretch of the bitmap that holds them."""
        if stop <= start:
            return np.zeros(0, np.int64)
        block = start // SAMPLE
        begin = int(self.samples[block])
        after = -(-stop // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.bitmap)
        bits = np.unpackbits(self.bitmap[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        ones = begin + np.flatnonzero(bits)[start - block * SAMPLE : stop - block * SAMPLE]
        high = (ones - np.arange(start, stop)).astype(np.uint64)
        gaps = (high << np.uint64(self.low)) | self._low(start, stop)
        return (gaps + np.uint64(self.first)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])
