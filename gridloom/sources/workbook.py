"""A workbook as a package: its sheets, dictionary, styles and index; rows from any seek point."""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from gridloom.errors import SheetError
from gridloom.functions.semantics import column_index, is_date_format, xml_decode
from gridloom.sources import sidecar
from gridloom.sources.store import open_input

#: Bytes that a row, and the dictionary, may take; forged files end here.
MOST_ROW, MOST_STRINGS = 16 << 20, 320 << 20
_SCHEMAS = "http://schemas.openxmlformats.org"
_NS = {"m": f"{_SCHEMAS}/spreadsheetml/2006/main"}
_REL = f"{{{_SCHEMAS}/officeDocument/2006/relationships}}id"
_BUILT_IN_DATES = {*range(14, 23), 45, 46, 47}
_CELL = re.compile(rb"<c(?=[\s/>])([^>]*?)(?:/>|>(.*?)</c\s*>)", re.S)
_ATTRIBUTE = re.compile(rb"\b([rts])\s*=\s*[\"']([^\"']*)[\"']")
#: A cell whose value is a place in the dictionary, in either kind of quotes.
SHARED = re.compile(rb"""\bt\s*=\s*(?:"s"|'s')""")
_VALUE = re.compile(rb"<v(?:\s[^>]*)?>(.*?)</v\s*>", re.S)
_TEXT = re.compile(rb"<t(?:\s[^>]*)?>(.*?)</t\s*>", re.S)
_PHONETIC = re.compile(rb"<rPh\b.*?</rPh\s*>", re.S)


class Workbook:
    def __init__(self, path: str, date1904: bool | None = None):
        self.path = path
        self.file = open_input(path)
        try:
            self.zip = zipfile.ZipFile(self.file)
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            links = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ET.ParseError, struct.error) as error:
            raise SheetError("notAWorkbook", f"{path} is no workbook: {error}") from error
        targets = {x.get("Id"): x.get("Target") for x in links}
        self.sheets: list[tuple[str, str]] = []
        for x in book.findall("m:sheets/m:sheet", _NS):
            target = targets.get(x.get(_REL))
            if target is None:
                raise SheetError("entryNotFound", f"sheet {x.get('name')} has no part")
            entry = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if entry not in self.zip.NameToInfo:
                raise SheetError("entryNotFound", f"{entry} isn't in the package")
            self.sheets.append((x.get("name"), entry))
        props = book.find("m:workbookPr", _NS)
        self.date1904 = date1904 if date1904 is not None else (props is not None and props.get("date1904") in ("1", "true"))
        self.index = self._index()

    def close(self) -> None:
        self.zip.close()
        self.file.close()

    def entry(self, sheet: str | int | None) -> str:
        """A sheet's part, by its name or its position from 0; the first by default."""
        if isinstance(sheet, str):
            for name, entry in self.sheets:
                if name == sheet:
                    return entry
            raise SheetError("unknownSheet", f"no sheet is called {sheet!r}; there are {[n for n, _ in self.sheets]}")
        at = sheet or 0
        if not 0 <= at < len(self.sheets):
            raise SheetError("unknownSheet", f"there is no sheet {at} among {len(self.sheets)}")
        return self.sheets[at][1]

    def _index(self) -> sidecar.Index | None:
        """The index, if it describes the parts as they are now. A corrupt one is an error, a stale one is none."""
        if sidecar.PART not in self.zip.NameToInfo:
            return None
        found = sidecar.decode(self.zip.read(sidecar.PART))
        for s in found.sheets:
            info = self.zip.NameToInfo.get(s.path)
            if info is None or info.CRC != s.crc or any(p[1] >= info.compress_size for p in s.points):
                return None
        return found

    def strings(self) -> list[str]:
        """The dictionary of files that have one."""
        name = "xl/sharedStrings.xml"
        if name not in self.zip.NameToInfo:
            return []
        if self.zip.NameToInfo[name].file_size > MOST_STRINGS:
            raise SheetError("tooLarge", "the dictionary is too large")
        data = _PHONETIC.sub(b"", self.zip.read(name))
        return [xml_decode(b"".join(_TEXT.findall(m)).decode("utf-8", "replace")) for m in re.findall(rb"<si(?:\s[^>]*)?>(.*?)</si\s*>|<si\s*/>", data, re.S)]

    def date_styles(self) -> set[int]:
        name = "xl/styles.xml"
        if name not in self.zip.NameToInfo:
            return set()
        root = ET.fromstring(self.zip.read(name))
        codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.findall("m:numFmts/m:numFmt", _NS)}
        styles = [int(x.get("numFmtId", "0")) for x in root.findall("m:cellXfs/m:xf", _NS)]
        return {i for i, n in enumerate(styles) if (is_date_format(codes[n]) if n in codes else n in _BUILT_IN_DATES)}

    def inflated(self, entry: str, begin: int = 0, end: int = -1, size: int = 1 << 16) -> Iterator[bytes]:
        """A part's bytes from an offset of its deflated data, read as far as needed only."""
        info = self.zip.NameToInfo[entry]
        self.file.seek(info.header_offset)
        head = self.file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise SheetError("badLocalFileHeader", f"{entry} has no header")
        name, extra = struct.unpack_from("<HH", head, 26)
        at = info.header_offset + 30 + name + extra + begin
        left = (info.compress_size if end < 0 else end) - begin
        self.file.seek(at)
        inflate = zlib.decompressobj(-15) if info.compress_type == zipfile.ZIP_DEFLATED else None
        while left > 0:
            data = self.file.read(min(size, left))
            if not data:
                raise SheetError("inflateFailed", f"{entry} is cut short")
            left -= len(data)
            try:
                yield inflate.decompress(data) if inflate else data
            except zlib.error as error:
                raise SheetError("inflateFailed", f"{entry}: {error}") from error
        if inflate:
            yield inflate.flush()

    def raw_rows(self, entry: str, begin: int = 0, end: int = -1, first: int = 1) -> Iterator[tuple[int, bytes]]:
        """(number, XML) of rows; numbers count the rows' ends, whatever they say of themselves."""
        rest, number = b"", first
        for data in self.inflated(entry, begin, end):
            rest += data
            parts = rest.split(b"</row>")
            rest = parts.pop()
            if len(rest) > MOST_ROW:
                raise SheetError("tooLarge", f"row {number} is too long")
            for part in parts:
                start = part.rfind(b"<row")
                while start >= 0 and part[start + 4 : start + 5] not in (b" ", b">", b"\t", b"\n", b"\r"):
                    start = part.rfind(b"<row", 0, start)
                yield number, part[start:] if start >= 0 else part
                number += 1

    def header(self, entry: str) -> list[str]:
        strings: list[str] | None = None
        for _, xml in self.raw_rows(entry):
            if SHARED.search(xml):
                strings = self.strings()
            return [v if t != "b" else ("1" if v else "") for t, v, _ in cells(xml, strings)]
        return []

    def verify(self) -> list[dict]:
        """Each sheet's checksums: by block where there is an index, else as a whole."""
        out = []
        for name, entry in self.sheets:
            info = self.zip.NameToInfo[entry]
            own = self.index.sheet(entry) if self.index else None
            marks = list(zip([p[2] for p in own.points], own.crcs, strict=True)) if own and own.crcs is not None else []
            crc, at, corrupt, good, whole = 0, 0, [], True, True
            pending = list(enumerate(marks))
            try:
                for data in self.inflated(entry):
                    while pending and at + len(data) >= pending[0][1][0]:
                        block, (place, want) = pending.pop(0)
                        cut = place - at
                        crc, data, at = zlib.crc32(data[:cut], crc), data[cut:], place
                        if crc != want and good:
                            corrupt.append(block)
                            good = False
                    crc, at = zlib.crc32(data, crc), at + len(data)
            except SheetError:
                whole = False
                if good:
                    corrupt.append(pending[0][0] if pending else len(marks))
            sound = whole and crc == info.CRC
            if not sound and not corrupt:
                corrupt.append(len(marks))
            out.append({"sheet": name, "blocks_checked": len(marks) + 1, "corrupt_blocks": corrupt, "sheet_crc_ok": sound, "inflate_ok": whole})
        return out


def cells(xml: bytes, strings: list[str] | None = None) -> list[tuple[str, str, int]]:
    """(type, text, style) by column; gaps are empty, a repeated reference's last cell counts, one without follows on."""
    out: list[tuple[str, str, int]] = []
    at = -1
    for m in _CELL.finditer(xml):
        own = {k: v for k, v in _ATTRIBUTE.findall(m[1])}
        ref = own.get(b"r")
        at = column_index(re.sub(rb"[^A-Z].*", b"", ref).decode()) if ref else at + 1
        if at > 16383:
            raise SheetError("badColumn", "a row has cells beyond XFD")
        kind, body = own.get(b"t", b"n").decode(), m[2] or b""
        if kind == "inlineStr":
            text = xml_decode(b"".join(_TEXT.findall(_PHONETIC.sub(b"", body))).decode("utf-8", "replace"))
        else:
            found = _VALUE.search(body)
            text = xml_decode(found[1].decode("utf-8", "replace")) if found else ""
            if kind == "s" and strings is not None and text:
                if not text.isdigit() or int(text) >= len(strings):
                    raise SheetError("badString", f"the dictionary has no entry {text}")
                text = strings[int(text)]
        while len(out) <= at:
            out.append(("n", "", 0))
        style = own.get(b"s", b"0")
        out[at] = (kind, text, int(style) if style.isdigit() else 0)
    return out
