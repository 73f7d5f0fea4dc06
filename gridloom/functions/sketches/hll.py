"""HyperLogLog over canonical texts, register for register the sidecar's."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

from gridloom.errors import SheetError

try:
    from xxhash import xxh64_intdigest
except ModuleNotFoundError:  # the same function, a few hundred times slower
    from gridloom.functions.sketches.xxh64 import xxh64_intdigest


class HyperLogLog:
    def __init__(self, p: int = 11):
        if not 4 <= p <= 18:
            raise SheetError("badSketch", f"no sketch has 2**{p} registers")
        self.p, self.registers = p, np.zeros(1 << p, dtype=np.uint8)

    def add_many(self, texts: Iterable[str]) -> HyperLogLog:
        found = {t.encode() if isinstance(t, str) else t for t in texts}
        if found:
            place, rank = self.places(np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found)), self.p)
            np.maximum.at(self.registers, place, rank)
        return self

    @staticmethod
    def places(hashes: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Register and rank of each hash: the top p bits, and the place of the first set bit after them."""
        rest = hashes << np.uint64(p)
        rank = np.full(len(hashes), 65 - p, dtype=np.uint8)
        some = rest > 0
        # frexp gives the length in bits of what a double holds exactly.
        high, low = rest[some] >> np.uint64(11), rest[some] & np.uint64(2047)
        length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 11, np.frexp(low.astype(np.float64))[1])
        zeros = 64 - length
        rank[some] = np.minimum(zeros + 1, 65 - p).astype(np.uint8)
        return (hashes >> np.uint64(64 - p)).astype(np.int64), rank

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        if other.p != self.p:
            raise SheetError("badSketch", "sketches of different sizes can't be merged")
        np.maximum(self.registers, other.registers, out=self.registers)
        return self

    def count(self) -> int:
        m = 1 << self.p
        alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        estimate = alpha * m * m / float(np.exp2(-self.registers.astype(np.float64)).sum())
        empty = int((self.registers == 0).sum())
        if estimate <= 2.5 * m and empty:
            estimate = m * math.log(m / empty)
        return int(math.floor(estimate + 0.5))

    def serialize(self) -> bytes:
        return b"\x01\x00" + bytes([self.p]) + self.registers.tobytes()

    @classmethod
    def deserialize(cls, data: bytes) -> HyperLogLog:
        if len(data) < 3 or data[:2] != b"\x01\x00" or not 4 <= data[2] <= 18 or len(data) != 3 + (1 << data[2]):
            raise SheetError("badSketch", "a sketch's head doesn't fit its bytes")
        out = cls(data[2])
        out.registers = np.frombuffer(data, dtype=np.uint8, offset=3).copy()
        if int(out.registers.max()) > 65 - out.p:
            raise SheetError("badSketch", "a register is beyond its hash's bits")
        return out
