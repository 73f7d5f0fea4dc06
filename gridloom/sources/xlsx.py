"""``spark.read.format("sheet")`` and ``df.write.format("sheet")``: workbooks as a Spark data source.

Reading: a workbook, or a folder of indexed ones with one header, which continue
each other in the order of their names. An indexed sheet is split at its seek points, and blocks that pushed
filters on ``_row`` or on a number column rule out aren't read at all; a sheet
without an index is one deflate stream, hence one partition. Options: sheet,
sheetIndex, shards, numbers (columns to add as ``NAME__num`` doubles), raw
(cells with their types), header (false keeps row 1), dates (styled cells as
timestamps' text), chain (false reads one sheet of a chain only), rttMicros and
bandwidth (a store's latency and bytes a second: gaps cheaper than a request
are read through).

Writing: every task writes a workbook of its own into the folder, indexed as it
is written; a task that fails leaves nothing. Options: every, stats, sketches,
sheet, compact, level.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.errors import SheetError
from gridloom.functions.semantics import EPOCH_SECONDS, NUMERIC
from gridloom.operators.chain import chains, offsets
from gridloom.sources import store
from gridloom.sources.workbook import SHARED, Workbook, cells
from gridloom.sources.writer import WorkbookWriter

_NUMBER = re.compile(NUMERIC)
ROWS_A_BATCH = 4096


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("1", "true", "yes")


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()] if text else []


@dataclass
class Stretch(InputPartition):
    """Rows of one part of a workbook: where to begin and end in its deflated data, and which rows to keep."""

    path: str
    entry: str
    begin: int
    end: int
    first: int
    last: int | None
    shift: int
    member: int


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def paths(self) -> list[str]:
        """The workbook, or those of the folder."""
        path = self.options["path"]
        if not store.is_folder(path):
            return [path]
        found = [store.joined(path, n) for n in store.names(path) if n.endswith(".xlsx")]
        if not found:
            raise SheetError("notAWorkbook", f"{path} holds no workbook")
        return found

    def _plan(self, path: str | None = None) -> tuple[Workbook, list[str], list[str]]:
        book = Workbook(path or self.paths()[0])
        at = self.options.get("sheetIndex")
        entry = book.entry(self.options.get("sheet") or (int(at) if at is not None else None))
        header = book.header(entry)
        members = [entry]
        if book.index and _flag(self.options, "chain", True):
            totals = [s.total_rows if (s := book.index.sheet(e)) else None for _, e in book.sheets]
            full = any(t == 1_048_575 for t in totals)
            headers = [book.header(e) if full else [str(i)] for i, (_, e) in enumerate(book.sheets)]
            for run in chains(totals, headers):
                if book.sheets[run[0]][1] == entry:
                    members = [book.sheets[i][1] for i in run]
        return book, header, members

    def columns(self, header: list[str]) -> list[str]:
        out: list[str] = []
        for i, name in enumerate(header):
            name = name or f"_c{i + 1}"
            out.append(name if name not in out else f"{name}_{i + 1}")
        return out

    def schema(self) -> str:
        book, header, _ = self._plan()
        book.close()
        if _flag(self.options, "raw", False):
            return "_row BIGINT, cells ARRAY<STRUCT<t: STRING, v: STRING, s: INT>>"
        quoted = lambda n: "`" + n.replace("`", "``") + "`"
        own = [f"{quoted(c)} STRING" for c in self.columns(header)]
        return ", ".join(["_row BIGINT", *own, *(f"{quoted(n + '__num')} DOUBLE" for n in _names(self.options.get("numbers")))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options, schema, overwrite)


class SheetReader(DataSourceReader):
    def __init__(self, source: SheetSource, schema: StructType):
        self.options, self.source, self.paths = dict(source.options), source, source.paths()
        book, header, self.members = source._plan(self.paths[0])
        self.names = source.columns(header)
        self.raw = _flag(self.options, "raw", False)
        self.numbers = _names(self.options.get("numbers"))
        if missing := [n for n in self.numbers if n not in self.names]:
            raise SheetError("unknownColumnName", f"no column is called {missing[0]!r}; there are {self.names[:20]}")
        self.bounds: dict[str, tuple[float, float]] = {}
        book.close()

    def pushFilters(self, filters: list) -> Iterator:
        """Notes what bounds numbers; every filter is handed back, so that Spark looks again."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            value = getattr(f, "value", None)
            if (name == "_row" or name.endswith("__num")) and isinstance(value, (int, float)) and not isinstance(value, bool):
                lo, hi = self.bounds.get(name, (float("-inf"), float("inf")))
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, value), min(hi, value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    hi = min(hi, value)
                self.bounds[name] = (lo, hi)
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        before = members = 0
        for path in self.paths:
            found, rows, count = self._stretches(path, before, members)
            out += found
            before, members = before + rows, members + count
        return out or [Stretch(self.paths[0], self.members[0], 0, 0, 1, 0, 0, 0)]

    def _stretches(self, path: str, before: int, members: int) -> tuple[list[Stretch], int, int]:
        """What is to be read of a workbook that so many rows and sheets come before, its rows without headers, its sheets."""
        book, header, entries = self.source._plan(path)
        entries = self.members if path == self.paths[0] else entries
        try:
            held = [book.index.sheet(e) if book.index else None for e in entries]
            if len(self.paths) > 1 and None in held:
                raise SheetError("unindexedMember", f"{path} has no index, so the rows after it have no numbers")
            if self.source.columns(header) != self.names:
                raise SheetError("badChain", f"{path} has another header")
            shift = [before + o for o in (offsets([h.total_rows for h in held]) if len(held) > 1 else [0])]
            out: list[Stretch] = []
            for at, (entry, own) in enumerate(zip(entries, held, strict=True)):
                member = members + at
                if own is None:
                    out.append(Stretch(path, entry, 0, -1, 1, None, shift[at], member))
                    continue
                # Up to so many bytes between runs are read through, as a new request would take as long.
                bridge = int(float(self.options.get("rttMicros", 0)) / 1e6 * float(self.options.get("bandwidth", 50 << 20)))
                runs: list[list[int]] = []
                for block, (first, last, begin, end) in enumerate(own.blocks()):
                    if last >= first and self._fits(own, block, first + shift[at], last + shift[at]):
                        if runs and begin - runs[-1][1] <= bridge:
                            runs[-1][1], runs[-1][3] = end, last
                        else:
                            runs.append([begin, end, first, last])
                out += self._cut(own, path, entry, runs, shift[at], member)
            return out, sum(h.total_rows - 1 for h in held if h), len(entries)
        finally:
            book.close()

    def _fits(self, own, block: int, first: int, last: int) -> bool:
        lo, hi = self.bounds.get("_row", (float("-inf"), float("inf")))
        if first > hi or last < lo:
            return False
        for name, (lo, hi) in self.bounds.items():
            if name.endswith("__num") and name[:-5] in self.names:
                zones = own.zones.get(self.names.index(name[:-5]) + 1)
                if zones is not None:
                    zone = zones.blocks[block]
                    if not zone.count or zone.min > hi or zone.max < lo:
                        return False
        return True

    def _cut(self, own, path: str, entry: str, runs: list[list[int]], shift: int, member: int) -> list[Stretch]:
        """Runs of blocks, cut so that there are about as many stretches as were asked for."""
        inner = [[b for b in own.blocks() if b[0] >= first and b[1] <= last] for _, _, first, last in runs]
        size = max(1, -(-sum(map(len, inner)) // max(1, int(self.options.get("shards", 16)) // len(self.paths))))
        out = []
        for blocks in inner:
            for at in range(0, len(blocks), size):
                part = blocks[at : at + size]
                out.append(Stretch(path, entry, part[0][2], part[-1][3], part[0][0], part[-1][1], shift, member))
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        book = Workbook(part.path)
        try:
            keep_header = _flag(self.options, "header", False)
            dates = book.date_styles() if _flag(self.options, "dates", False) else set()
            strings: list[str] | None = None
            numbers: list[int] = []
            rows: list[list[tuple]] = []
            for number, xml in book.raw_rows(part.entry, part.begin, part.end, part.first):
                if part.last is not None and number > part.last:
                    break
                if number == 1 and (part.member or not keep_header):
                    continue
                if strings is None and SHARED.search(xml):
                    strings = book.strings()
                numbers.append(number + part.shift)
                rows.append(cells(xml, strings))
                if len(rows) == ROWS_A_BATCH:
                    yield self._batch(numbers, rows, dates, book.date1904)
                    numbers, rows = [], []
            if rows:
                yield self._batch(numbers, rows, dates, book.date1904)
        finally:
            book.close()

    def _batch(self, numbers: list[int], rows: list[list[tuple]], dates: set[int], date1904: bool) -> pa.RecordBatch:
        row = pa.array(numbers, pa.int64())
        if self.raw:
            kind = pa.list_(pa.struct([("t", pa.string()), ("v", pa.string()), ("s", pa.int32())]))
            return pa.RecordBatch.from_arrays([row, pa.array([[{"t": t, "v": v, "s": s} for t, v, s in r] for r in rows], kind)], names=["_row", "cells"])
        columns, companions = [], {}
        for i, name in enumerate(self.names):
            own = [r[i] if i < len(r) else ("n", "", 0) for r in rows]
            if name in self.numbers:
                companions[name] = [float(v) if t != "b" and _NUMBER.fullmatch(v) else None for t, v, _ in own]
            columns.append(pa.array([_dated(v, date1904) if dates and s in dates and t == "n" else v or None for t, v, s in own], pa.string()))
        return pa.RecordBatch.from_arrays([row, *columns, *(pa.array(companions[n], pa.float64()) for n in self.numbers)], names=["_row", *self.names, *(n + "__num" for n in self.numbers)])


def _dated(text: str, date1904: bool) -> str | None:
    from datetime import UTC, datetime, timedelta

    if not _NUMBER.fullmatch(text):
        return text or None
    serial = float(text)
    if not 0 <= serial <= 2958465:
        return None
    days = int(serial)
    seconds = days * 86400 + round((serial - days) * 86400) - EPOCH_SECONDS + (1462 * 86400 if date1904 else 0)
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    rows: int
    bytes: int


class FolderWriter(DataSourceArrowWriter):
    """Workbooks in a folder that all executors share, renamed into place when all tasks are done."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder = options["path"]
        self.options, self.names, self.overwrite = dict(options), [f.name for f in schema.fields], overwrite
        # Of this write alone, so that one that is added later replaces nothing, and comes after it by name.
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        final = store.joined(self.folder, f"part-{self.job}-{task.partitionId():05d}.xlsx")
        temporary = f"{final}.{task.taskAttemptId()}.tmp"
        out = WorkbookWriter(temporary, every=int(self.options.get("every", 10_000)), stats=_names(self.options.get("stats")), sketches=_names(self.options.get("sketches")), compact=_flag(self.options, "compact", False), level=int(self.options.get("level", 5)))
        try:
            out.start_sheet(self.options.get("sheet", "Sheet1"), self.names)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write_row(row)
            done = out.finish()
        except BaseException:
            out.abort()
            raise
        return Written(temporary, final, done["rows"], done["bytes"])

    def commit(self, messages: list) -> None:
        old = [n for n in store.names(self.folder) if n.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)
        # The new ones are in place before the old ones go.
        for name in old:
            store.remove(store.joined(self.folder, name))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                store.remove(m.temporary)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, rows, blocks_checked, corrupt_blocks, sheet_crc_ok) of a workbook, or of all in a folder, one task each; rows are what the index says."""
    paths = SheetSource({"path": path}).paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column("path").to_pylist():
                book = Workbook(own)
                try:
                    totals = [s.total_rows - 1 if book.index and (s := book.index.sheet(e)) else None for _, e in book.sheets]
                    rows += [{"path": own, "sheet": v["sheet"], "rows": n, "blocks_checked": v["blocks_checked"], "corrupt_blocks": v["corrupt_blocks"], "sheet_crc_ok": v["sheet_crc_ok"]} for v, n in zip(book.verify(), totals, strict=True)]
                finally:
                    book.close()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("sheet", pa.string()), ("rows", pa.int64()), ("blocks_checked", pa.int64()), ("corrupt_blocks", pa.list_(pa.int64())), ("sheet_crc_ok", pa.bool_())]))

    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, path string").repartitionByRange(len(paths), "i").select("path")
    return listed.mapInArrow(run, "path string, sheet string, rows long, blocks_checked long, corrupt_blocks array<long>, sheet_crc_ok boolean")


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)
