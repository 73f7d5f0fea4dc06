"""XXH64 in plain Python, for machines without the library."""

from __future__ import annotations

import struct

_M = (1 << 64) - 1
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _M


def _lane(acc: int, word: int) -> int:
    return _turn((acc + word * _P[1]) & _M, 31) * _P[0] & _M


def xxh64_intdigest(data: bytes, seed: int = 0) -> int:
    data = data.encode() if isinstance(data, str) else bytes(data)
    at, n = 0, len(data)
    if n >= 32:
        lanes = [(seed + _P[0] + _P[1]) & _M, (seed + _P[1]) & _M, seed & _M, (seed - _P[0]) & _M]
        while at + 32 <= n:
            lanes = [_lane(a, w) for a, w in zip(lanes, struct.unpack_from("<4Q", data, at), strict=True)]
            at += 32
        h = sum(_turn(a, r) for a, r in zip(lanes, (1, 7, 12, 18), strict=True)) & _M
        for a in lanes:
            h = ((h ^ _lane(0, a)) * _P[0] + _P[3]) & _M
    else:
        h = (seed + _P[4]) & _M
    h = (h + n) & _M
    while at + 8 <= n:
        h = (_turn(h ^ _lane(0, struct.unpack_from("<Q", data, at)[0]), 27) * _P[0] + _P[3]) & _M
        at += 8
    if at + 4 <= n:
        h = (_turn(h ^ struct.unpack_from("<I", data, at)[0] * _P[0] & _M, 23) * _P[1] + _P[2]) & _M
        at += 4
    for b in data[at:]:
        h = _turn(h ^ b * _P[4] & _M, 11) * _P[0] & _M
    h = (h ^ h >> 33) * _P[1] & _M
    h = (h ^ h >> 29) * _P[2] & _M
    return h ^ h >> 32
