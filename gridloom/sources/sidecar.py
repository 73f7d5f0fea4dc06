"""The binary index part of a workbook: seek points, zone maps, running checksums and sketches."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from gridloom.errors import SheetError
from gridloom.functions.sketches import HyperLogLog, TDigest

PART = "xl/_kxs/index.bin"
MAGIC, VERSION = b"KXSI", 2
MOST_SHEETS, MOST_PATH = 1024, 256


@dataclass
class Zone:
    min: float
    max: float
    sum: float
    count: int
    other: int


@dataclass
class ColumnZones:
    ascending: bool
    descending: bool
    blocks: list[Zone]


@dataclass
class SheetIndex:
    path: str
    total_rows: int
    crc: int
    #: (row, offset in the deflated data, offset in the inflated data)
    points: list[tuple[int, int, int]] = field(default_factory=list)
    zones: dict[int, ColumnZones] = field(default_factory=dict)
    crcs: list[int] | None = None
    digests: dict[int, bytes] = field(default_factory=dict)
    hlls: dict[int, bytes] = field(default_factory=dict)

    def digest(self, column: int) -> TDigest | None:
        return TDigest.deserialize(self.digests[column]) if column in self.digests else None

    def hll(self, column: int) -> HyperLogLog | None:
        return HyperLogLog.deserialize(self.hlls[column]) if column in self.hlls else None

    def blocks(self) -> list[tuple[int, int, int, int]]:
        """(first row, last row, begin, end in the deflated data); the end of the last is open, -1."""
        starts = [(1, 0), *((p[0], p[1]) for p in self.points)]
        ends = [*((p[0] - 1, p[1]) for p in self.points), (self.total_rows, -1)]
        return [(s[0], e[0], s[1], e[1]) for s, e in zip(starts, ends, strict=True)]

    def seek(self, row: int) -> tuple[int, int, int]:
        """The last point at or before a row."""
        best = (1, 0, 0)
        for p in self.points:
            if p[0] <= row:
                best = p
        return best


@dataclass
class Index:
    period: int
    sheets: list[SheetIndex]

    def sheet(self, path: str) -> SheetIndex | None:
        return next((s for s in self.sheets if s.path == path), None)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise SheetError("corruptIndex", "a length runs past the index's end")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def many(self, n: int, size: int) -> None:
        if n * size > self.left():
            raise SheetError("corruptIndex", "a count runs past the index's end")


def decode(data: bytes) -> Index:
    """The index of a part's bytes; sections of unknown tags are passed over, whatever breaks a rule is refused."""
    if len(data) < 16 or data[:4] != MAGIC:
        raise SheetError("corruptIndex", "these bytes are no index")
    version, flags, count, period, crc = struct.unpack_from("<BBHII", data, 4)
    if version != VERSION or flags:
        raise SheetError("corruptIndex", f"version {version} with flags {flags} isn't known")
    if zlib.crc32(data[16:]) != crc:
        raise SheetError("corruptIndex", "the index's checksum is wrong")
    if not period or count > MOST_SHEETS:
        raise SheetError("corruptIndex", "the period is 0 or there are too many sheets")
    at, sheets = _Cursor(data[16:]), []
    for _ in range(count):
        (size,) = at.read("H")
        if not 1 <= size <= MOST_PATH:
            raise SheetError("corruptIndex", f"a path has {size} bytes")
        path = at.take(size).decode("utf-8", "strict")
        total, sheet_crc, n = at.read("III")
        at.many(n, 24)
        points = [at.read("QQQ") for _ in range(n)]
        if any(a[i] >= b[i] for a, b in zip(points, points[1:], strict=False) for i in range(3)) or (points and points[-1][0] > total + 1):
            raise SheetError("corruptIndex", f"{path} has points out of order")
        if any(s.path == path for s in sheets):
            raise SheetError("corruptIndex", f"{path} comes twice")
        sheets.append(SheetIndex(path, total, sheet_crc, points))
    while at.left() >= 8:
        tag, size = at.read("4sI")
        own = _Cursor(at.take(size))
        reader = {b"STAT": _read_zones, b"SCRC": _read_crcs, b"TDIG": _read_sketches, b"CHLL": _read_sketches}.get(tag)
        for s in sheets if reader else []:
            reader(own, s, tag)
    return Index(period, sheets)


def _column(at: _Cursor) -> int:
    (column,) = at.read("H")
    if column < 1:
        raise SheetError("corruptIndex", "columns count from 1")
    return column


def _read_zones(at: _Cursor, sheet: SheetIndex, tag: bytes) -> None:
    sheet.zones = {}
    for _ in range(at.read("H")[0]):
        column = _column(at)
        flags, n = at.read("BI")
        if n != len(sheet.points) + 1:
            raise SheetError("corruptIndex", "there is one block more than points")
        at.many(n, 32)
        sheet.zones[column] = ColumnZones(bool(flags & 1), bool(flags & 2), [Zone(*at.read("dddII")) for _ in range(n)])


def _read_crcs(at: _Cursor, sheet: SheetIndex, tag: bytes) -> None:
    (n,) = at.read("I")
    if n != len(sheet.points):
        raise SheetError("corruptIndex", "there are as many checksums as points")
    at.many(n, 4)
    sheet.crcs = list(at.read(f"{n}I"))


def _read_sketches(at: _Cursor, sheet: SheetIndex, tag: bytes) -> None:
    own: dict[int, bytes] = {}
    for _ in range(at.read("H")[0]):
        column = _column(at)
        own[column] = at.take(at.read("I")[0])
    if tag == b"TDIG":
        sheet.digests = own
    else:
        sheet.hlls = own


def encode(index: Index) -> bytes:
    body = b""
    for s in index.sheets:
        path = s.path.encode()
        body += struct.pack("<H", len(path)) + path + struct.pack("<III", s.total_rows, s.crc, len(s.points))
        body += b"".join(struct.pack("<QQQ", *p) for p in s.points)

    def section(tag: bytes, parts: list[bytes]) -> bytes:
        joined = b"".join(parts)
        return tag + struct.pack("<I", len(joined)) + joined

    if any(s.zones for s in index.sheets):
        parts = []
        for s in index.sheets:
            parts.append(struct.pack("<H", len(s.zones)))
            for column, z in sorted(s.zones.items()):
                parts.append(struct.pack("<HBI", column, z.ascending | z.descending << 1, len(z.blocks)))
                parts += [struct.pack("<dddII", b.min, b.max, b.sum, b.count, b.other) for b in z.blocks]
        body += section(b"STAT", parts)
    if all(s.crcs is not None for s in index.sheets):
        body += section(b"SCRC", [struct.pack(f"<I{len(s.crcs)}I", len(s.crcs), *s.crcs) for s in index.sheets])
    for tag, name in ((b"TDIG", "digests"), (b"CHLL", "hlls")):
        if any(getattr(s, name) for s in index.sheets):
            body += section(tag, [struct.pack("<H", len(getattr(s, name))) + b"".join(struct.pack("<HI", c, len(d)) + d for c, d in sorted(getattr(s, name).items())) for s in index.sheets])
    return struct.pack("<4sBBHII", MAGIC, VERSION, 0, len(index.sheets), index.period, zlib.crc32(body)) + body
