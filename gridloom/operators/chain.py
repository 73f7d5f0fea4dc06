"""Sheets that continue each other, read as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import SheetError
from gridloom.operators.frame import SheetFrame

FULL_SHEET = 1_048_575


def chains(totals: list[int | None], headers: list[list[str]]) -> list[list[int]]:
    """Runs of sheets, each but the last full and with the next one's header; a sheet of unknown size is alone."""
    out: list[list[int]] = []
    for i, total in enumerate(totals):
        last = out[-1][-1] if out else None
        if last is not None and total is not None and totals[last] == FULL_SHEET and headers[last] == headers[i]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def offsets(totals: list[int]) -> list[int]:
    """What is added to a member's row numbers: later members' headers don't count."""
    out = [0]
    for total in totals[:-1]:
        out.append(out[-1] + total - (1 if len(out) > 1 else 0))
    return [o if i == 0 else o - 1 for i, o in enumerate(out)] if len(out) > 1 else out


def locate(totals: list[int], row: int) -> tuple[int, int] | None:
    """Member and local row of a global row."""
    for member, (off, total) in enumerate(zip(offsets(totals), totals, strict=True)):
        local = row - off
        if (1 if member == 0 else 2) <= local <= total:
            return member, local
    return None


def chained(frames: list[SheetFrame], totals: list[int]) -> SheetFrame:
    """The union of members, rows numbered on; each row keeps ``_member`` and ``_local_row``. Nothing is shuffled."""
    if not frames or len(frames) != len(totals) or any(f.columns != frames[0].columns for f in frames):
        raise SheetError("badChain", "members of a chain have one header and a size each")
    row = frames[0].row
    parts: list[DataFrame] = []
    for member, (f, off) in enumerate(zip(frames, offsets(totals), strict=True)):
        parts.append(f.df.where(F.col(f.row) >= 2).select((F.col(f.row) + off).alias(row), *(F.col(f"`{c}`") for c in f.columns), F.lit(member).alias("_member"), F.col(f.row).alias("_local_row")))
    return SheetFrame(reduce(DataFrame.unionByName, parts), row, frames[0].columns)
