"""Writes a workbook as a stream in bounded memory, with its index, zone maps and sketches as it goes."""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterable

from gridloom.errors import SheetError
from gridloom.functions.semantics import EPOCH_SECONDS, NUMERIC, clean_sheet_name, column_letters, xml_escape
from gridloom.functions.sketches import HyperLogLog, TDigest
from gridloom.sources import sidecar, store
from gridloom.sources.styles import Styles

FULL_SHEET = 1_048_575
_NUMBER = re.compile(NUMERIC)
_TEXT_NUMBER = re.compile(r"[+-]?0[0-9]|\+")
_SCHEMAS = "http://schemas.openxmlformats.org"
_MAIN = f"{_SCHEMAS}/spreadsheetml/2006/main"
_OFFICE = f"{_SCHEMAS}/officeDocument/2006/relationships"
_PACKAGE = f"{_SCHEMAS}/package/2006"
_KIND = "application/vnd.openxmlformats"


def tag(name: str, inner: str = "", /, **attributes: str | int) -> str:
    """An element; two underscores in an attribute's name stand for a colon."""
    own = "".join(f" {k.replace('__', ':')}='{xml_escape(str(v))}'" for k, v in attributes.items())
    return f"<{name}{own}>{inner}</{name}>" if inner else f"<{name}{own}/>"


def document(body: str) -> str:
    return "<?xml version='1.0' encoding='UTF-8'?>" + body


def number_text(x: float | int) -> str:
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    return repr(x)


def serial(x: dt.date | dt.datetime) -> float:
    if not isinstance(x, dt.datetime):
        x = dt.datetime(x.year, x.month, x.day)
    utc = x.replace(tzinfo=dt.UTC) if x.tzinfo is None else x
    return ((utc - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() + EPOCH_SECONDS) / 86400


def stays_text(text: str) -> bool:
    """A numeric text that would lose a leading zero, a plus or digits as a number."""
    return bool(_TEXT_NUMBER.match(text)) or len(re.sub("[^0-9]", "", re.sub("[eE].*", "", text))) > 15


def as_number(x) -> float | None:
    """What statistics take a cell for."""
    if isinstance(x, bool):
        return float(x)
    if isinstance(x, (int, float)):
        return None if isinstance(x, float) and math.isnan(x) else float(x)
    if isinstance(x, (dt.date, dt.datetime)):
        return serial(x)
    if isinstance(x, str) and _NUMBER.fullmatch(x):
        return float(x)
    return None


def canonical(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "1" if x else "0"
    if isinstance(x, (int, float)):
        return number_text(x)
    if isinstance(x, (dt.date, dt.datetime)):
        return number_text(serial(x))
    return str(x)


def cell(x, ref: str, style: int = 0) -> str:
    r = (f' r="{ref}"' if ref else "") + (f' s="{style}"' if style else "")
    if x is None or x == "":
        return f"<c{r}/>" if not ref else ""
    if isinstance(x, bool):
        return f'<c{r} t="b"><v>{int(x)}</v></c>'
    if isinstance(x, float) and not math.isfinite(x):
        x = str(x)
    if isinstance(x, (int, float)):
        return f"<c{r}><v>{number_text(x)}</v></c>"
    if isinstance(x, (dt.date, dt.datetime)):
        return f"<c{r if style else r + ' s=\"1\"'}><v>{number_text(serial(x))}</v></c>"
    text = str(x)
    if _NUMBER.fullmatch(text) and not stays_text(text):
        return f"<c{r}><v>{text.strip()}</v></c>"
    keep = ' xml:space="preserve"' if text[0] in " \t\n" or text[-1] in " \t\n" else ""
    return f'<c{r} t="inlineStr"><is><t{keep}>{xml_escape(text)}</t></is></c>'


class _Tracked:
    def __init__(self) -> None:
        self.blocks: list[sidecar.Zone] = []
        self.up = self.down = True
        self.last: float | None = None
        self.fresh()

    def fresh(self) -> None:
        self.now = sidecar.Zone(math.inf, -math.inf, 0.0, 0, 0)

    def add(self, x: float | None, header: bool = False) -> None:
        z = self.now
        if x is None:
            z.other += 1
            return
        z.min, z.max, z.sum, z.count = min(z.min, x), max(z.max, x), z.sum + x, z.count + 1
        if not header:
            if self.last is not None:
                self.up &= x >= self.last
                self.down &= x <= self.last
            self.last = x

    def close(self) -> None:
        if not self.now.count:
            self.now.min = self.now.max = 0.0
        self.blocks.append(self.now)
        self.fresh()


class WorkbookWriter:
    """``start_sheet``, ``write_row`` as often as needed, ``finish``. Rows beyond a sheet's ceiling go on in a new one."""

    def __init__(self, path: str, every: int = 10_000, stats: Iterable[str | int] = (), sketches: Iterable[str | int] = (), group_column: str | int | None = None, compact: bool = False, level: int = 5, on_progress: Callable[[int, int], None] | None = None, progress_every: int = 10_000, formats: dict[str | int, str | int] | None = None, bold_header: bool = False, freeze: tuple[int, int] = (0, 0), widths: dict[str | int, float] | None = None, autofilter: bool = False):
        if min(freeze) < 0:
            raise SheetError("badFreeze", "rows and columns to freeze can't be fewer than none")
        if every < 1:
            raise SheetError("badPeriod", "a block has at least one row")
        if not 1 <= level <= 9:
            raise SheetError("invalidCompressionLevel", f"there is no level {level}")
        self.path, self.every, self.level, self.compact = path, every, level, compact
        self.stats, self.sketches, self.group_column = list(stats), list(sketches), group_column
        self.on_progress, self.progress_every = on_progress, progress_every
        self.formats, self.bold_header, self.freeze, self.widths, self.autofilter = formats or {}, bold_header, freeze, widths or {}, autofilter
        self.look = Styles()
        self.file = store.open_output(path)
        self.entries: list[tuple[str, int, int, int, int]] = []
        self.sheets: list[tuple[str, sidecar.SheetIndex]] = []
        self.at = self.rows = 0
        self.open = self.done = False

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        self.entry, self.begun = name, self.at
        raw = name.encode()
        # Sizes follow the data, as they aren't known yet.
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0x0808, 8, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        self.deflate = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        self.crc = self.packed = self.plain = 0

    def _data(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.plain += len(data)
        self._packed(self.deflate.compress(data))

    def _packed(self, data: bytes) -> None:
        self.packed += len(data)
        self._put(data)

    def _end(self) -> None:
        self._packed(self.deflate.flush())
        if max(self.packed, self.plain, self.at) > 0xFFFFFFFF:
            raise SheetError("zip32LimitExceeded", "the file is beyond 4 GiB")
        self._put(struct.pack("<4sIII", b"PK\x07\x08", self.crc, self.packed, self.plain))
        self.entries.append((self.entry, self.begun, self.crc, self.packed, self.plain))

    def _text(self, name: str, text: str | bytes) -> None:
        self._begin(name)
        self._data(text.encode() if isinstance(text, str) else text)
        self._end()

    def _column(self, column: str | int) -> int:
        at = column if isinstance(column, int) else self.headers.index(column) + 1 if column in self.headers else 0
        if not 1 <= at <= len(self.headers):
            raise SheetError("columnIndexOutOfRange", f"there is no column {column!r}")
        return at

    def start_sheet(self, name: str, headers: list[str]) -> WorkbookWriter:
        if self.done:
            raise SheetError("writerAlreadyClosed", "the workbook is finished")
        if not name:
            raise SheetError("badSheet", "a sheet has a name")
        if len(headers) > 16384:
            raise SheetError("tooManyColumns", f"{len(headers)} columns are too many")
        if self.open:
            self._close_sheet()
        self.headers, self.base = list(headers), clean_sheet_name(name)
        self._open_sheet(self.base)
        return self

    def _open_sheet(self, name: str) -> None:
        taken = {n for n, _ in self.sheets}
        unique, k = name, 2
        while unique in taken:
            unique, k = f"{name[: 31 - len(str(k)) - 3]} ({k})", k + 1
        path = f"xl/worksheets/sheet{len(self.sheets) + 1}.xml"
        self._begin(path)
        self.styled = {self._column(c) - 1: self.look.style(self.look.format(f)) for c, f in self.formats.items()}
        rows, columns = self.freeze
        pane = tag("pane", **({"xSplit": columns} if columns else {}), **({"ySplit": rows} if rows else {}), topLeftCell=f"{column_letters(columns)}{rows + 1}", state="frozen") if rows or columns else ""
        view = tag("sheetViews", tag("sheetView", pane, workbookViewId=0)) if pane else ""
        sizes = "".join(tag("col", min=self._column(c), max=self._column(c), width=w, customWidth=1) for c, w in sorted(self.widths.items(), key=lambda x: self._column(x[0])))
        self._data(document(f"<worksheet xmlns='{_MAIN}'>{view}{tag('cols', sizes) if sizes else ''}<sheetData>").encode())
        self.index = sidecar.SheetIndex(path, 0, 0, crcs=[])
        self.sheets.append((unique, self.index))
        self.tracked = {self._column(c): _Tracked() for c in self.stats}
        self.digests = {self._column(c): TDigest() for c in self.sketches}
        self.hlls = {self._column(c): HyperLogLog() for c in self.sketches}
        self.staged: dict[int, list] = {c: [] for c in self.digests}
        self.since, self.group, self.open = 0, None, True
        for c, t in self.tracked.items():
            t.add(as_number(self.headers[c - 1]), header=True)
        bold = self.look.style(0, True) if self.bold_header else 0
        self._row(self.headers, dict.fromkeys(range(len(self.headers)), bold))

    def _row(self, row: Iterable, styles: dict[int, int]) -> None:
        self.index.total_rows += 1
        n = self.index.total_rows
        if self.compact:
            self._data(("<row>" + "".join(cell(x, "", styles.get(i, 0)) for i, x in enumerate(row)) + "</row>").encode())
        else:
            self._data((f'<row r="{n}">' + "".join(cell(x, f"{column_letters(i)}{n}", styles.get(i, 0)) for i, x in enumerate(row)) + "</row>").encode())

    def write_row(self, row: Iterable) -> None:
        if not self.open:
            raise SheetError("headersNotSet", "no sheet is begun")
        row = list(row)
        if len(row) > 16384:
            raise SheetError("tooManyColumns", f"{len(row)} cells are too many")
        if self.index.total_rows >= FULL_SHEET:
            self._close_sheet()
            self._open_sheet(self.base)
        if self.group_column is not None:
            own = canonical(row[self._column(self.group_column) - 1])
            if self.since and own != self.group:
                self._sync()
            self.group = own
        for c, t in self.tracked.items():
            t.add(as_number(row[c - 1]) if c <= len(row) else None)
        for c, staged in self.staged.items():
            staged.append(row[c - 1] if c <= len(row) else None)
            if len(staged) >= 4096:
                self._sketch(c)
        self._row(row, self.styled)
        self.rows += 1
        self.since += 1
        if self.since >= self.every:
            self._sync()
        if self.on_progress and self.rows % self.progress_every == 0:
            self.on_progress(self.rows, self.at)

    def write_rows(self, rows: Iterable[Iterable]) -> None:
        for row in rows:
            self.write_row(row)

    def _sketch(self, c: int) -> None:
        numbers = [x for v in self.staged[c] if (x := as_number(v)) is not None and math.isfinite(x)]
        self.digests[c].add_many(numbers)
        self.hlls[c].add_many(t for v in self.staged[c] if (t := canonical(v)))
        self.staged[c] = []

    def _sync(self) -> None:
        """A place from which the sheet can be inflated without what comes before."""
        self._packed(self.deflate.flush(zlib.Z_FULL_FLUSH))
        self.index.points.append((self.index.total_rows + 1, self.packed, self.plain))
        self.index.crcs.append(self.crc)
        for t in self.tracked.values():
            t.close()
        self.since = 0

    def _close_sheet(self) -> None:
        last = f"{column_letters(max(0, len(self.headers) - 1))}{self.index.total_rows}"
        self._data(f"</sheetData>{tag('autoFilter', ref=f'A1:{last}') if self.autofilter else ''}</worksheet>".encode())
        self._end()
        self.index.crc = self.crc
        for c, t in self.tracked.items():
            t.close()
            self.index.zones[c] = sidecar.ColumnZones(t.up, t.down, t.blocks)
        for c in self.digests:
            self._sketch(c)
            self.index.digests[c], self.index.hlls[c] = self.digests[c].serialize(), self.hlls[c].serialize()
        self.open = False

    def finish(self) -> dict:
        if self.done:
            raise SheetError("writerAlreadyClosed", "the workbook is finished")
        if self.open:
            self._close_sheet()
        if not self.sheets:
            self.abort()
            raise SheetError("emptyWorkbook", "a workbook has a sheet")
        ids = range(1, len(self.sheets) + 1)
        self._text("xl/styles.xml", document(self.look.xml(tag, _MAIN)))
        self._text(sidecar.PART, sidecar.encode(sidecar.Index(self.every, [s for _, s in self.sheets])))
        listed = "".join(tag("sheet", name=n, sheetId=i, r__id=f"rId{i}") for i, (n, _) in zip(ids, self.sheets, strict=True))
        self._text("xl/workbook.xml", document(tag("workbook", tag("sheets", listed), xmlns=_MAIN, xmlns__r=_OFFICE)))

        def links(targets: dict[str, tuple[str, str]]) -> str:
            return document(tag("Relationships", "".join(tag("Relationship", Id=i, Type=f"{_OFFICE}/{kind}", Target=t) for i, (kind, t) in targets.items()), xmlns=f"{_PACKAGE}/relationships"))

        self._text("xl/_rels/workbook.xml.rels", links({f"rId{i}": ("worksheet", f"worksheets/sheet{i}.xml") for i in ids} | {"rId0": ("styles", "styles.xml")}))
        self._text("_rels/.rels", links({"rId1": ("officeDocument", "xl/workbook.xml")}))
        kinds = {"xl/workbook.xml": "sheet.main", "xl/styles.xml": "styles"} | {s.path: "worksheet" for _, s in self.sheets}
        parts = [tag("Default", Extension="rels", ContentType=f"{_KIND}-package.relationships+xml"), tag("Default", Extension="xml", ContentType="application/xml")]
        parts += [tag("Override", PartName=f"/{n}", ContentType=f"{_KIND}-officedocument.spreadsheetml.{k}+xml") for n, k in kinds.items()]
        parts.append(tag("Override", PartName=f"/{sidecar.PART}", ContentType="application/octet-stream"))
        self._text("[Content_Types].xml", document(tag("Types", "".join(parts), xmlns=f"{_PACKAGE}/content-types")))
        begin = self.at
        for name, at, crc, packed, plain in self.entries:
            raw = name.encode()
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 0x0808, 8, 0, 33, crc, packed, plain, len(raw), 0, 0, 0, 0, 0, at) + raw)
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(self.entries), len(self.entries), self.at - begin, begin, 0))
        self.file.close()
        self.done = True
        return {"bytes": self.at, "rows": self.rows, "sheets": len(self.sheets), "sheet_details": [{"name": n, "rows": s.total_rows} for n, s in self.sheets]}

    def abort(self) -> None:
        if not self.file.closed:
            self.file.close()
        store.remove(self.path)
        self.done = True
