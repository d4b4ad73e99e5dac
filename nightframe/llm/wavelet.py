"""A wavelet matrix over token ids: bit planes with rank and select, in one compressed byte string."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"WVM1"


class WaveletMatrix:
    """Ids by bit planes, highest bit first; in every next plane the zeros of the last come before its ones."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n = n
        self.planes = planes  # packed, little bit order, padded to 64
        self.ones = [np.concatenate(([0], np.cumsum(np.bitwise_count(p.view("<u8"))))).astype(np.int64) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max(initial=0)).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        ids = np.asarray(ids, kind)
        planes = []
        for bit in reversed(range(levels)):
            ones = (ids & kind(1 << bit)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes.append(np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))))
            ids = np.concatenate((np.compress(~ones, ids), np.compress(ones, ids)))
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        return MAGIC + struct.pack("<QI", self.n, len(self.planes)) + pa.Codec("zstd").compress(b"".join(p.tobytes() for p in self.planes), asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", data, 4)
        size = -(-n // 64) * 8
        raw = np.frombuffer(pa.Codec("zstd").decompress(data[16:], levels * size, asbytes=True), np.uint8)
        return cls(n, [raw[i * size : (i + 1) * size] for i in range(levels)])

    def _rank1(self, level: int, i: int) -> int:
        word, rest = divmod(i, 64)
        more = int(self.planes[level].view("<u8")[word]) & ((1 << rest) - 1) if rest else 0
        return int(self.ones[level][word]) + more.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this value."""
        upto = self.ones[level] if bit else np.arange(len(self.ones[level]), dtype=np.int64) * 64 - self.ones[level]
        word = int(np.searchsorted(upto, k, side="right")) - 1
        bits = int(self.planes[level].view("<u8")[word]) ^ (0 if bit else 2**64 - 1)
        for _ in range(k - int(upto[word])):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _descend(self, token: int, start: int, stop: int) -> tuple[int, int]:
        levels = len(self.planes)
        if token >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            start, stop = (self.zeros[level] + a, self.zeros[level] + b) if token >> (levels - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the token stands in [start, stop)."""
        a, b = self._descend(token, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """The token's places, ascending."""
        a, b = self._descend(token, 0, self.n)
        out = []
        for i in range(a, b):
            for level in reversed(range(len(self.planes))):
                bit = token >> (len(self.planes) - 1 - level) & 1
                i = self._select(level, bit, i - self.zeros[level] if bit else i)
            out.append(i)
        return out

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for depth, level in enumerate(reversed(range(len(self.planes)))):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            back[np.flatnonzero(ones)] = out[self.zeros[level] :] | kind(1 << depth)
            out = back
        return out.astype(np.uint32)
