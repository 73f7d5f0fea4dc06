"""A merging t-digest in numpy, with the sidecar's byte form."""

from __future__ import annotations

import math
import struct

import numpy as np

from gridloom.errors import SheetError


class TDigest:
    def __init__(self, compression: int = 100):
        if not 1 <= compression <= 0xFFFF:
            raise SheetError("badSketch", f"no digest has the compression {compression}")
        self.compression = compression
        self.means, self.weights = np.empty(0), np.empty(0)
        self.low, self.high = math.inf, -math.inf

    @property
    def count(self) -> int:
        return int(round(float(self.weights.sum())))

    @property
    def min(self) -> float | None:
        return self.low if self.count else None

    @property
    def max(self) -> float | None:
        return self.high if self.count else None

    def add_many(self, values) -> TDigest:
        x = np.asarray(values, dtype=np.float64)
        if not len(x):
            return self
        if not np.isfinite(x).all():
            raise SheetError("badValue", "a digest takes finite values only")
        return self._join(np.sort(x), np.ones(len(x)), float(x.min()), float(x.max()))

    def merge(self, other: TDigest) -> TDigest:
        return self._join(other.means, other.weights, other.low, other.high) if len(other.means) else self

    def _join(self, means: np.ndarray, weights: np.ndarray, low: float, high: float) -> TDigest:
        means, weights = np.concatenate([self.means, means]), np.concatenate([self.weights, weights])
        order = np.argsort(means, kind="stable")
        means, weights = means[order], weights[order]
        upto = np.cumsum(weights)
        total, starts, at = float(upto[-1]), [], 0
        # A cluster reaches as far as one unit of the scale function from where it begins; binary search finds its end.
        while at < len(means):
            starts.append(at)
            done = float(upto[at - 1]) if at else 0.0
            at = max(at + 1, int(np.searchsorted(upto, total * self._reach(done / total), side="right")))
        self.weights = np.add.reduceat(weights, starts)
        middle = np.add.reduceat(means * weights, starts) / self.weights
        ends = np.array([*starts[1:], len(means)], dtype=np.int64) - 1
        self.means = np.clip(middle, means[starts], means[ends])
        self.low, self.high = min(self.low, low), max(self.high, high)
        return self

    def _reach(self, q: float) -> float:
        turn = math.asin(min(1.0, max(-1.0, 2 * q - 1))) + 2 * math.pi / self.compression
        return 1.0 if turn >= math.pi / 2 else (math.sin(turn) + 1) / 2

    def _knots(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and values between which the distribution is linear."""
        middle = np.cumsum(self.weights) - self.weights / 2
        return np.concatenate([[0.0], middle, [float(self.count)]]), np.concatenate([[self.low], self.means, [self.high]])

    def quantile(self, q: float) -> float | None:
        if not 0 <= q <= 1:
            raise SheetError("badQuantile", f"{q} is outside of 0 to 1")
        if not self.count:
            return None
        if q == 0 or self.low == self.high:
            return self.low
        if q == 1:
            return self.high
        ranks, values = self._knots()
        at = q * self.count
        i = int(np.searchsorted(ranks[1:-1], at, side="right"))
        return float(values[i] + (values[i + 1] - values[i]) * (at - ranks[i]) / (ranks[i + 1] - ranks[i]))

    def rank(self, x: float) -> float | None:
        """The share of values of at most x, by the same line."""
        if not self.count:
            return None
        if x <= self.low:
            return 0.0
        if x >= self.high:
            return 1.0
        ranks, values = self._knots()
        i = int(np.searchsorted(values[1:-1], x, side="right"))
        return float((ranks[i] + (ranks[i + 1] - ranks[i]) * (x - values[i]) / (values[i + 1] - values[i])) / self.count)

    def serialize(self) -> bytes:
        pairs = np.stack([self.means, self.weights], axis=1).astype("<f8").tobytes()
        low, high = (self.low, self.high) if self.count else (0.0, 0.0)
        return struct.pack("<HHI", 1, self.compression, len(self.means)) + pairs + struct.pack("<ddQ", low, high, self.count)

    @classmethod
    def deserialize(cls, data: bytes) -> TDigest:
        if len(data) < 32:
            raise SheetError("badSketch", "a digest is cut short")
        version, compression, n = struct.unpack_from("<HHI", data)
        if version != 1 or compression < 1 or len(data) != 32 + 16 * n:
            raise SheetError("badSketch", "a digest's head doesn't fit its bytes")
        out = cls(compression)
        pairs = np.frombuffer(data, dtype="<f8", count=2 * n, offset=8).reshape(n, 2)
        low, high, count = struct.unpack_from("<ddQ", data, 8 + 16 * n)
        out.means, out.weights = pairs[:, 0].copy(), pairs[:, 1].copy()
        good = np.isfinite(pairs).all() and (out.weights > 0).all() and (np.diff(out.means) >= 0).all()
        if not good or abs(float(out.weights.sum()) - count) > 1e-6 * max(1, count):
            raise SheetError("badSketch", "a digest's centroids are out of order or don't add up")
        if count:
            if not (math.isfinite(low) and math.isfinite(high) and low <= out.means[0] and out.means[-1] <= high):
                raise SheetError("badSketch", "a digest's ends don't hold its centroids")
            out.low, out.high = low, high
        return out
