"""Mergeable sketches: t-digests for quantiles, HyperLogLog for distinct counts."""

from gridloom.functions.sketches.hll import HyperLogLog
from gridloom.functions.sketches.tdigest import TDigest

__all__ = ["HyperLogLog", "TDigest"]
