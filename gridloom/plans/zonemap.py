"""Zone maps: statistics by block of rows, and the blocks that a predicate can't rule out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import SheetError
from gridloom.operators.frame import SheetFrame


def block_of(row: Column, every: int) -> Column:
    """Blocks of ``every`` data rows; the header shares block 0."""
    if every < 1:
        raise SheetError("badPeriod", "a block has at least one row")
    return F.greatest(F.floor((row - 2) / every), F.lit(0)).cast("long")


def build_zone_map(frame: SheetFrame, columns: list[int | str], every: int = 10_000, exact_sum: str | None = None, header: bool = False) -> DataFrame:
    """(column, block, first_row, last_row, min, max, sum, count, other).

    One pass and one shuffle of a row a block and task for all columns. With
    ``header`` the header's cell counts as non-numeric in block 0, as in a
    sheet's own statistics; NaN counts as non-numeric.
    """
    names = [frame.resolve(c) for c in columns]
    cells = F.array(*(F.struct(F.lit(n).alias("column"), frame.number(n, booleans=True).alias("x")) for n in names))
    long = frame.df.select(F.col(frame.row).alias("r"), block_of(F.col(frame.row), every).alias("block"), F.explode(cells).alias("c")).select("r", "block", "c.column", "c.x")
    total = F.sum(F.col("x").cast(exact_sum)).cast("double") if exact_sum else F.sum("x")
    other = F.count_if(F.col("x").isNull()) + (F.when(F.col("block") == 0, 1).otherwise(0) if header else F.lit(0))
    return long.groupBy("column", "block").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.min("x").alias("min"), F.max("x").alias("max"), F.coalesce(total, F.lit(0.0)).alias("sum"), F.count("x").alias("count"), other.alias("other"))


def block_may_match(op: str, value: float, value2: float | None = None) -> Column:
    """On a zone map's row: some cell of the block may fit. Bounds only ever widen."""
    lo, hi = F.col("min"), F.col("max")
    if op == "between":
        if value2 is None:
            raise SheetError("badOperator", "between takes two values")
        return (lo <= float(max(value, value2))) & (hi >= float(min(value, value2)))
    v = float(value)
    tests = {"=": (lo <= v) & (hi >= v), "<": lo <= v, "<=": lo <= v, ">": hi >= v, ">=": hi >= v}
    if op not in tests:
        raise SheetError("badOperator", f"no operator is called {op!r}")
    return tests[op]


def surviving_blocks(zones: DataFrame, predicates: list[tuple]) -> DataFrame:
    """(block, first_row, last_row) of blocks that every predicate on a mapped column lets through."""
    if not predicates:
        return zones.groupBy("block").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))
    hits = [F.bool_or((F.col("column") == p[0]) & (F.col("count") > 0) & block_may_match(*p[1:])) for p in predicates]
    known = [F.bool_or(F.col("column") == p[0]) for p in predicates]
    fits = reduce(lambda a, b: a & b, (h | ~k for h, k in zip(hits, known, strict=True)))
    grouped = zones.groupBy("block").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), fits.alias("fits"))
    return grouped.where("fits").drop("fits")


def plan_runs(blocks: list[tuple[int, int, int]], bridge_rows: int = 0) -> list[tuple[int, int, int, int]]:
    """(first block, last block, first row, last row): neighbours as one run, and runs with at most ``bridge_rows`` rows between."""
    out: list[list[int]] = []
    for block, first, last in sorted(blocks):
        if out and (block == out[-1][1] + 1 or first - out[-1][3] - 1 <= bridge_rows):
            out[-1][1], out[-1][3] = block, last
        else:
            out.append([block, block, first, last])
    return [tuple(r) for r in out]


#: Surviving blocks whose bounds are brought to the driver.
MOST_BLOCKS = 10_000


def pruned(frame: SheetFrame, zones: DataFrame, predicates: list[tuple], bridge_rows: int = 0, most_runs: int = 500) -> DataFrame:
    """The rows that fit all predicates, read from surviving runs only.

    Run bounds become ranges of the row number, which the scan's own
    statistics prune; with more runs than ``most_runs``, or more blocks than
    ``MOST_BLOCKS``, one range holds them all.
    """
    blocks = surviving_blocks(zones, [(frame.resolve(p[0]), *p[1:]) for p in predicates])
    found = [(r.block, r.first_row, r.last_row) for r in blocks.limit(MOST_BLOCKS + 1).collect()]
    if len(found) > MOST_BLOCKS:
        ends = blocks.agg(F.min("first_row"), F.max("last_row")).first()
        return frame.rows_where_all(predicates).where(frame.rows_between(ends[0], ends[1]))
    runs = plan_runs(found, bridge_rows)
    rows = frame.rows_where_all(predicates)
    if not runs:
        return rows.where(F.lit(False))
    if len(runs) > most_runs:
        runs = [(runs[0][0], runs[-1][1], runs[0][2], runs[-1][3])]
    return rows.where(reduce(lambda a, b: a | b, (frame.rows_between(r[2], r[3]) for r in runs)))
