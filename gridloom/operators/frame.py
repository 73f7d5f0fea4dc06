"""A table of numbered rows, and what can be asked of it.

Row 1 is the header, so data rows are numbered from 2 in a column of the frame.
Every method gives a DataFrame (or a Column) and leaves the physical plan to
Catalyst: predicates reach the scan, top-k keeps k rows a task, aggregates
are summed before they are shuffled.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import SheetError
from gridloom.functions.semantics import calendar_bucket, canonical_text, cast_cell, numeric_view
from gridloom.functions.sketches.distributed import digest_of, hll_of

OPERATORS = ("=", "<", "<=", ">", ">=", "between")
#: Draws of a sample that are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_DRAWS = 100_000


class SheetFrame:
    """``key``: a column of the source and what is added to it to give the row number, so that ranges of rows reach the scan."""

    def __init__(self, df: DataFrame, row: str = "_row", columns: list[str] | None = None, key: tuple[str, int] | None = None):
        self.df, self.row, self.key = df, row, key
        self.columns = columns or [c for c in df.columns if c != row]

    @classmethod
    def numbered(cls, df: DataFrame, key: str, offset: int = 2, row: str = "_row") -> SheetFrame:
        """A table whose dense key, from 0, is the order of its rows."""
        return cls(df.withColumn(row, F.col(key) + offset), row, list(df.columns), (key, offset))

    def rows_between(self, first: int | None, last: int | None) -> Column:
        """A predicate on the row number, put on the key where there is one."""
        name, shift = self.key or (self.row, 0)
        tests = [F.col(name) >= first - shift] if first is not None else []
        tests += [F.col(name) <= last - shift] if last is not None else []
        return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)

    # -- columns

    def resolve(self, column: int | str) -> str:
        """A name, matched exactly, or a position from 1."""
        if isinstance(column, int):
            if not 1 <= column <= len(self.columns):
                raise SheetError("badColumn", f"there is no column {column} among {len(self.columns)}")
            return self.columns[column - 1]
        at = [i + 1 for i, c in enumerate(self.columns) if c == column and c]
        if len(at) > 1:
            raise SheetError("ambiguousColumnName", f"columns {at} are all called {column}")
        if not at:
            raise SheetError("unknownColumnName", f"no column is called {column!r}; there are {self.columns[:20]}")
        return column

    def number(self, column: int | str, booleans: bool = False) -> Column:
        return numeric_view(self.df, self.resolve(column), booleans)

    def _with(self, df: DataFrame) -> SheetFrame:
        return SheetFrame(df, self.row, self.columns, self.key)

    # -- rows by their number

    def row_count(self) -> DataFrame:
        """With the header."""
        return self.df.agg((F.count(F.lit(1)) + 1).alias("row_count"))

    def rows(self, skip: int = 0, limit: int | None = None) -> DataFrame:
        """Rows after the first ``skip``, of which the header is one; a filter on numbers, not an offset that is read through."""
        after = self.df.where(self.rows_between(max(0, skip) + 1, None))
        if limit is None:
            return after
        return after.where(F.lit(limit > 0)).orderBy(self.row).limit(max(0, limit))

    def chunked(self, size: int, skip: int = 1) -> DataFrame:
        """With the number of each row's batch, from 0."""
        if size < 1:
            raise SheetError("badSize", "a batch has at least one row")
        skip = max(0, skip)
        return self.df.where(self.rows_between(skip + 1, None)).withColumn("batch", F.floor((F.col(self.row) - 1 - skip) / size).cast("long"))

    def row_at(self, number: int) -> DataFrame:
        return self.df.where(self.rows_between(number, number))

    def row_range(self, first: int, last: int) -> DataFrame:
        """Both ends included; none if they are reversed."""
        return self.df.where(self.rows_between(max(1, first), last))

    # -- rows by their cells

    def predicate(self, column: int | str, op: str, value: float, value2: float | None = None) -> Column:
        if op not in OPERATORS:
            raise SheetError("badOperator", f"no operator is called {op!r}")
        if op == "between":
            if value2 is None:
                raise SheetError("badOperator", "between takes two values")
            return self.predicate(column, ">=", min(value, value2)) & self.predicate(column, "<=", max(value, value2))
        name = self.resolve(column)
        kind, cell = self.df.schema[name].dataType, F.col(f"`{name}`")
        v = F.lit(float(value))
        # Plain comparisons, where a type allows them, reach the scan; NaN, which Spark holds to be the largest, doesn't match.
        if isinstance(kind, T.IntegralType) and float(value).is_integer() and abs(value) < 2**31:
            v = F.lit(int(value))
        elif not isinstance(kind, (T.DoubleType, T.IntegralType)):
            cell = self.number(column)
        elif isinstance(kind, T.IntegralType):
            cell = cell.cast("double")
        test = {"=": cell == v, "<": cell < v, "<=": cell <= v, ">": cell > v, ">=": cell >= v}[op]
        return test & ~F.isnan(cell) if isinstance(kind, T.DoubleType) and op in (">", ">=") else test

    def rows_where(self, column: int | str, op: str, value: float, value2: float | None = None) -> DataFrame:
        return self.df.where(self.predicate(column, op, value, value2))

    def rows_where_all(self, predicates: list[tuple]) -> DataFrame:
        if not predicates:
            raise SheetError("badPredicates", "there is no predicate")
        return self.df.where(reduce(lambda a, b: a & b, (self.predicate(*p) for p in predicates)))

    def find_row(self, column: int | str, value: float) -> DataFrame:
        """The first match, or none."""
        return self.rows_where(column, "=", value).orderBy(self.row).limit(1)

    def top_rows(self, column: int | str, k: int, desc: bool = False) -> DataFrame:
        """k rows in the order of their numeric cells; of equal cells the earlier row comes first."""
        cell = self.number(column)
        order = cell.desc() if desc else cell.asc()
        return self.df.where(cell.isNotNull() & F.lit(k > 0)).orderBy(order, self.row).limit(max(0, k))

    def sample_rows(self, k: int, seed: int | None = None, total: int | None = None) -> DataFrame:
        """Exactly min(k, rows) data rows, the same for a seed (else others each time): numbers are drawn first, then looked up."""
        seed = secrets.randbits(32) if seed is None else seed
        last = total if total is not None else self.df.count() + 1
        if k >= last - 1:
            return self.df
        drawn = draw_rows(2, last, max(0, k), seed)
        if len(drawn) <= 1000:
            return self.df.where(F.col(self.row).isin(drawn)) if drawn else self.df.where(F.lit(False))
        names = self.df.sparkSession.createDataFrame([(n,) for n in drawn], f"`{self.row}` long")
        return self.df.join(F.broadcast(names) if len(drawn) <= BROADCAST_DRAWS else names, self.row, "left_semi")

    # -- aggregates

    def column_stats(self, column: int | str, exact_sum: str | None = None) -> DataFrame:
        """min, max, sum, avg, count, other of the data rows. ``exact_sum``: a decimal type in which to sum, so that order doesn't matter."""
        cell = self.number(column, booleans=True)
        total = F.sum(cell.cast(exact_sum)).cast("double") if exact_sum else F.sum(cell)
        return self.df.agg(F.min(cell).alias("min"), F.max(cell).alias("max"), total.alias("sum"), F.count(cell).alias("count"), F.count_if(cell.isNull()).alias("other")).select("min", "max", F.coalesce("sum", F.lit(0.0)).alias("sum"), (F.col("sum") / F.nullif("count", F.lit(0))).alias("avg"), "count", "other")

    def sorted_as(self, column: int | str, blocks: int = 4096) -> DataFrame:
        """Whether numeric cells rise or fall throughout: one row, ``sorted`` asc, desc or null.

        Ranges of row numbers are judged each on its own, and then their ends
        against each other, so no task sorts the whole column.
        """
        from pyspark.sql import Window

        cell = self.number(column, booleans=True)
        numbered = self.df.select(F.col(self.row).alias("r"), cell.alias("x")).where("x IS NOT NULL")
        span = numbered.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
        cut = numbered.crossJoin(F.broadcast(span)).withColumn("b", F.floor((F.col("r") - F.col("lo")) * blocks / (F.col("hi") - F.col("lo") + 1)).cast("int"))
        before = F.lag("x").over(Window.partitionBy("b").orderBy("r"))
        judged = cut.withColumn("p", before).groupBy("b").agg(F.coalesce(F.bool_and(F.col("x") >= F.col("p")), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("x") <= F.col("p")), F.lit(True)).alias("down"), F.min_by("x", "r").alias("first"), F.max_by("x", "r").alias("last"))
        across = judged.withColumn("p", F.lag("last").over(Window.orderBy("b")))
        ends = across.agg(F.bool_and(F.col("up") & F.coalesce(F.col("first") >= F.col("p"), F.lit(True))).alias("up"), F.bool_and(F.col("down") & F.coalesce(F.col("first") <= F.col("p"), F.lit(True))).alias("down"))
        return ends.select(F.when(F.coalesce("up", F.lit(True)), "asc").when(F.col("down"), "desc").alias("sorted"))

    def bucket(self, column: int | str, bucket: str | Callable[[Column], Column] | None) -> Column:
        """A group cell's key: itself, year, month, day, or what a function of the number gives."""
        cell = self.number(column, booleans=True)
        if bucket is None:
            return cell
        return calendar_bucket(cell, bucket) if isinstance(bucket, str) else bucket(cell)

    def group_stats(self, group: int | str, value: int | str, bucket: str | Callable[[Column], Column] | None = None, exact_sum: str | None = None) -> DataFrame:
        """group, sum, count, min, max and the first row of each group; groups without a numeric value stay, with a sum of 0."""
        cell = self.number(value, booleans=True)
        rows = self.df.select(self.bucket(group, bucket).alias("group"), cell.alias("x"), F.col(self.row).alias("r")).where("`group` IS NOT NULL")
        total = F.sum(F.col("x").cast(exact_sum)).cast("double") if exact_sum else F.sum("x")
        return rows.groupBy("group").agg(F.coalesce(total, F.lit(0.0)).alias("sum"), F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.min("r").alias("first_row"))

    def quantiles(self, column: int | str, named: dict[str, float]) -> DataFrame:
        """Exact, interpolated; one row. Ranges around the ranks are narrowed by sketches until they hold few rows, so no task holds a whole column."""
        for q in named.values():
            if not 0 <= q <= 1:
                raise SheetError("badQuantile", f"{q} is outside of 0 to 1")
        values = self.df.select(self.number(column, booleans=True).cast("double").alias("x")).where("x IS NOT NULL")
        n = values.count()
        if not n:
            return self.df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(k) for k in named))
        ranks = sorted({r for q in named.values() for r in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))})
        found = selected(values, ranks, n)
        at = lambda q: (lambda r: found[int(r)] + (r - int(r)) * (found[min(n - 1, int(r) + 1)] - found[int(r)]))((n - 1) * q)
        return self.df.sparkSession.range(1).select(*(F.lit(float(at(q))).alias(k) for k, q in named.items()))

    def quantile(self, column: int | str, q: float) -> DataFrame:
        """Exact, interpolated."""
        return self.quantiles(column, {"quantile": q})

    def median(self, column: int | str) -> DataFrame:
        return self.quantile(column, 0.5).withColumnRenamed("quantile", "median")

    def digest(self, column: int | str, compression: int = 100):
        """The column's t-digest, for quantiles and ranks that need no further pass."""
        return digest_of(self.df, self.number(column, booleans=True), compression)

    def count_distinct(self, column: int | str) -> DataFrame:
        """Exact, over canonical texts."""
        return self.df.agg(F.count_distinct(canonical_text(self.df, self.resolve(column))).alias("distinct_count"))

    def hyperloglog(self, column: int | str, p: int = 11):
        return hll_of(self.df, canonical_text(self.df, self.resolve(column)), p)

    # -- projections

    def cast_columns(self, casts: dict[str, str | Callable[[Column], Column]], date1904: bool = False, zone: str | None = None) -> SheetFrame:
        made = {self.resolve(c): kind for c, kind in casts.items()}
        values = {c: kind(F.col(f"`{c}`")) if callable(kind) else cast_cell(self.df, c, kind, date1904, zone) for c, kind in made.items()}
        return self._with(self.df.withColumns(values))

    # -- shards

    def shards(self, count: int, total: int) -> list[tuple[int, int]]:
        """Ranges of rows, first and last, that together are all rows."""
        if count < 1:
            raise SheetError("badShards", "there is at least one shard")
        cuts = sorted({1 + total * i // count for i in range(count)} | {total + 1})
        return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def shard_of(self, count: int, total: int) -> DataFrame:
        """With the number of each row's shard."""
        self.shards(count, 1)
        number = F.expr(f"(`{self.row}` * {count} - 1) div {total}") if total >= count else F.col(self.row) - 1
        return self.df.withColumn("shard", number.cast("int"))

    def rows_for_shard(self, shard: tuple[int, int]) -> DataFrame:
        return self.row_range(*shard)


#: Values that are brought to the driver to pick ranks from.
PICKED = 20_000


def selected(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values of a column ``x`` without nulls at ranks from 0, exactly.

    Each pass takes quantile sketches within the open ranges, counts what is
    below them and in them, and leaves ranges of about a hundredth.
    """
    out: dict[int, float] = {}
    ends = values.agg(F.min("x"), F.max("x")).first()
    # (lowest, highest, how many values are lower than the lowest) by ranks
    ranges = [(float(ends[0]), float(ends[1]), 0, n, list(ranks))]
    while ranges:
        small = [r for r in ranges if r[3] <= PICKED]
        for lo, hi, below, _, own in small:
            got = sorted(x[0] for x in values.where(F.col("x").between(lo, hi)).collect())
            out |= {k: got[k - below] for k in own}
        ranges = [r for r in ranges if r[3] > PICKED]
        if not ranges:
            break
        asked = []
        for lo, hi, below, size, own in ranges:
            inside = F.when(F.col("x").between(lo, hi), F.col("x"))
            shares = [min(1.0, max(0.0, (k - below + 0.5) / size + d)) for k in own for d in (-0.004, 0.004)]
            asked.append(F.percentile_approx(inside, [float(s) for s in shares], 1000))
        cuts = values.agg(*(a.alias(f"c{i}") for i, a in enumerate(asked))).first()
        narrowed = []
        for (lo, hi, _, _, own), found in zip(ranges, cuts, strict=True):
            points = sorted({lo, hi, *found})
            # Between two points, and each point by itself, as a value may fill many ranks.
            narrowed.append((points, own))
        counts = values.agg(*(F.count_if(test).alias(f"n{i}_{j}_{e}") for i, (points, _) in enumerate(narrowed) for j, p in enumerate(points) for e, test in (("lt", F.col("x") < p), ("le", F.col("x") <= p)))).first()
        ranges = []
        for i, (points, own) in enumerate(narrowed):
            for k in own:
                for j, p in enumerate(points):
                    less, upto = counts[f"n{i}_{j}_lt"], counts[f"n{i}_{j}_le"]
                    if less <= k < upto:
                        out[k] = p
                        break
                    if k < less:  # strictly between the point before and this one
                        low = points[j - 1]
                        ranges.append((float(np.nextafter(low, np.inf)), float(np.nextafter(p, -np.inf)), counts[f"n{i}_{j - 1}_le"], less - counts[f"n{i}_{j - 1}_le"], [k]))
                        break
        merged: dict[tuple, list[int]] = {}
        for lo, hi, below, size, own in ranges:
            merged.setdefault((lo, hi, below, size), []).extend(own)
        ranges = [(*r, own) for r, own in merged.items()]
    return out


def draw_rows(lo: int, hi: int, k: int, seed: int) -> list[int]:
    """k distinct numbers of lo .. hi, ascending, by Marsaglia's xorshift32 with the triple 13, 17, 5.

    Values beyond the last whole multiple of the range are drawn again, so that
    all numbers are equally likely.
    """
    size, mask = hi - lo + 1, 0xFFFFFFFF
    if size < 1 or size > 1 << 32 or k > size:
        raise SheetError("badSample", f"{k} numbers can't be drawn from {lo} to {hi}")
    x = (seed & mask) ^ 0x9E3779B9 or 0x9E3779B9
    usable, drawn = (1 << 32) // size * size, set()
    while len(drawn) < k:
        for turn in (13, -17, 5):
            x ^= (x << turn if turn > 0 else x >> -turn) & mask
        if x < usable:
            drawn.add(lo + x % size)
    return sorted(drawn)
