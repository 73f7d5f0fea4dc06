"""The styles part: number formats, bold headers, and what else a column can look like."""

from __future__ import annotations

from gridloom.errors import SheetError

#: Formats by name: a built-in number, or a code.
PRESETS: dict[str, int | str] = {"general": 0, "integer": 1, "decimal": 2, "thousands": 3, "money": 4, "percent": 9, "percent2": 10, "scientific": 11, "date": 14, "time": 21, "datetime": 22, "text": 49, "isodate": "yyyy-mm-dd", "isodatetime": "yyyy-mm-dd hh:mm:ss"}


class Styles:
    """Cell styles, each held once; 0 is plain and 1 a date with a time."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.cells: dict[tuple[int, bool], int] = {}
        self.style(0)
        self.style(22)

    def style(self, number: int, bold: bool = False) -> int:
        return self.cells.setdefault((number, bold), len(self.cells))

    def format(self, spec: str | int) -> int:
        """The number of a preset, a built-in format or a code."""
        if isinstance(spec, int):
            if not 0 <= spec <= 49:
                raise SheetError("badFormat", f"no built-in format has the number {spec}")
            return spec
        found = PRESETS.get(spec, spec)
        if isinstance(found, int):
            return found
        if spec not in PRESETS and spec.isalpha() and spec.islower() and not set(spec) <= set("ymdhs"):
            raise SheetError("badFormat", f"no format is called {spec!r}")
        return self.codes.setdefault(found, 164 + len(self.codes))

    def xml(self, tag, namespace: str) -> str:
        parts = []
        if self.codes:
            parts.append(tag("numFmts", "".join(tag("numFmt", numFmtId=n, formatCode=c) for c, n in self.codes.items()), count=len(self.codes)))
        parts.append(tag("fonts", tag("font") + tag("font", tag("b")), count=2))
        parts += [tag(many, tag(one), count=1) for many, one in (("fills", "fill"), ("borders", "border"), ("cellStyleXfs", "xf"))]
        held = "".join(tag("xf", numFmtId=n, fontId=int(bold), applyNumberFormat=int(n > 0)) for n, bold in self.cells)
        parts.append(tag("cellXfs", held, count=len(self.cells)))
        return tag("styleSheet", "".join(parts), xmlns=namespace)
