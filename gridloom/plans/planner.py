"""Estimates, explanations, and group aggregates that are answered from zone maps where those suffice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import SheetError
from gridloom.operators.frame import OPERATORS, SheetFrame
from gridloom.plans.zonemap import block_of, pruned, surviving_blocks

#: What a sheet row takes compressed, where nothing better is known.
ROW_BYTES = 24


@dataclass
class IndexedFrame:
    """A frame with zone maps of some columns, and sketches where they were asked for.

    ``zones`` is read by every query, so it should be a table that was written
    (``shared.stored``); ``columns`` are the mapped ones, found out where they aren't given.
    """

    frame: SheetFrame
    zones: DataFrame
    every: int
    total_rows: int
    digests: dict = field(default_factory=dict)
    distinct: dict = field(default_factory=dict)
    _on_full_scan: Callable[[dict], None] | None = None
    columns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        self.mapped = set(self.columns) if self.columns is not None else {r.column for r in self.zones.select("column").distinct().collect()}

    def on_full_scan(self, callback: Callable[[dict], None]) -> IndexedFrame:
        """``callback`` gets {query, column, reason} whenever a query can't use an index."""
        self._on_full_scan = callback
        return self

    def _tell(self, query: str, column, reason: str) -> None:
        if self._on_full_scan:
            self._on_full_scan({"query": query, "column": column, "reason": reason})

    def _checked(self, predicates: list[tuple]) -> list[tuple]:
        if not predicates:
            raise SheetError("badPredicates", "there is no predicate")
        for p in predicates:
            if p[1] not in OPERATORS or (p[1] == "between" and (len(p) < 4 or p[3] is None)):
                raise SheetError("badOperator", f"{p[1]!r} doesn't fit {p}")
        return [(self.frame.resolve(p[0]), *p[1:]) for p in predicates]

    def rows_where_all(self, predicates: list[tuple], bridge_rows: int = 0) -> DataFrame:
        own = self._checked(predicates)
        if not any(p[0] in self.mapped for p in own):
            one = len(own) == 1
            self._tell("rowsWhere" if one else "rowsWhereAll", own[0][0] if one else None, "column-not-indexed" if one else "no-indexed-predicate")
            return self.frame.rows_where_all(own)
        return pruned(self.frame, self.zones, own, bridge_rows)

    def rows_where(self, column, op: str, value: float, value2: float | None = None) -> DataFrame:
        return self.rows_where_all([(column, op, value, value2)])

    def find_row(self, column, value: float) -> DataFrame:
        return self.rows_where(column, "=", value).orderBy(self.frame.row).limit(1)

    def top_rows(self, column, k: int, desc: bool = False) -> DataFrame:
        """As the frame's own. Blocks whose worst cells are best hold k rows that are at least as good as the last of these: what is worse isn't read."""
        name = self.frame.resolve(column)
        if name not in self.mapped or k < 1:
            self._tell("topRows", name, "column-not-indexed")
            return self.frame.top_rows(name, k, desc)
        worst = F.col("min") if desc else F.col("max")
        own = self.zones.where((F.col("column") == name) & (F.col("count") > 0)).select(worst.alias("worst"), "count")
        held, bound = 0, None
        for r in own.orderBy(F.desc("worst") if desc else F.asc("worst")).limit(k).collect():  # a block has a row at least, so k of them will do
            held, bound = held + r["count"], r.worst
            if held >= k:
                break
        if held < k:
            return self.frame.top_rows(name, k, desc)
        rows = pruned(self.frame, self.zones, [(name, ">=" if desc else "<=", bound)])
        return SheetFrame(rows, self.frame.row, self.frame.columns, self.frame.key).top_rows(name, k, desc)

    def column_stats(self, column, exact_sum: str | None = None) -> DataFrame:
        """As the frame's own, from the zone map alone."""
        name = self.frame.resolve(column)
        if name not in self.mapped:
            self._tell("columnStats", name, "column-not-indexed")
            return self.frame.column_stats(name, exact_sum)
        total = F.sum(F.col("sum").cast(exact_sum)).cast("double") if exact_sum else F.sum("sum")
        own = self.zones.where(F.col("column") == name).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.coalesce(total, F.lit(0.0)).alias("sum"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("other"), F.lit(0)).alias("other"))
        return own.select("min", "max", "sum", (F.col("sum") / F.nullif("count", F.lit(0))).alias("avg"), "count", "other")

    def quantile(self, column, q: float) -> float | None:
        """From the digest, without a pass; None where there is no digest."""
        digest = self.digests.get(self.frame.resolve(column))
        return None if digest is None else digest.quantile(q)

    def estimated_rows(self, column, op: str, value: float, value2: float | None = None) -> dict | None:
        """``upper``, which no answer exceeds, and an ``estimate`` where a sketch gives one; None without a zone map."""
        (own,) = self._checked([(column, op, value, value2)])
        name = own[0]
        if name not in self.mapped:
            return None
        blocks = surviving_blocks(self.zones.where(F.col("column") == name), [own])
        upper = self.zones.where(F.col("column") == name).join(blocks.select("block"), "block", "left_semi").agg(F.sum("count")).first()[0] or 0
        digest, estimate = self.digests.get(name), None
        if op == "=":
            if name in self.distinct and digest is not None:
                estimate = max(1, round(digest.count / max(1, self.distinct[name])))
        elif digest is not None and digest.count:
            lo, hi = {"<": (None, value), "<=": (None, value), ">": (value, None), ">=": (value, None)}.get(op) or (min(value, value2), max(value, value2))
            share = (1.0 if hi is None else digest.rank(hi)) - (0.0 if lo is None else digest.rank(lo))
            estimate = round(digest.count * max(0.0, share))
        return {"upper": int(upper), "estimate": estimate if estimate is None else min(estimate, int(upper))}

    def explain(self, predicates: list[tuple]) -> dict:
        """How ``rows_where_all`` would run; nothing is read but the zone map."""
        own = self._checked(predicates)
        zoned = any(p[0] in self.mapped for p in own)
        every_block = self.zones.select("block").distinct().count()
        if not zoned:
            return {"strategy": "full-scan", "candidateBlocks": every_block, "prunedBlocks": 0, "runs": 1, "estimatedRows": {"upper": self.total_rows, "estimate": None}, "estimatedBytes": self.total_rows * ROW_BYTES}
        # A run begins with a block whose neighbour below doesn't survive; only sums come to the driver.
        blocks = surviving_blocks(self.zones, own)
        before = blocks.select((F.col("block") + 1).alias("block"), F.lit(1).alias("inner"))
        found = blocks.join(before, "block", "left").agg(F.count("*").alias("n"), F.count_if(F.col("inner").isNull()).alias("runs"), F.coalesce(F.sum(F.col("last_row") - F.col("first_row") + 1), F.lit(0)).alias("upper")).first()
        upper = found.upper
        share, known = 1.0, True
        for p in own:
            guess = self.estimated_rows(*p)
            known &= guess is not None and guess["estimate"] is not None
            if known:
                share *= min(1.0, guess["estimate"] / max(1, self.total_rows))
        return {"strategy": "zone-map-prune", "candidateBlocks": found.n, "prunedBlocks": every_block - found.n, "runs": found.runs, "estimatedRows": {"upper": upper, "estimate": min(upper, round(self.total_rows * share)) if known else None}, "estimatedBytes": upper * ROW_BYTES}

    def group_stats(self, group, value, bucket=None, exact_sum: str | None = None) -> DataFrame:
        """As the frame's own, but blocks that lie in one group are answered from the zone map.

        A block will do if all its group cells are numeric and its lowest and
        highest fall into one bucket, which holds for all between as buckets
        don't decrease. What is left is scanned, and both are summed up together.
        """
        g, v = self.frame.resolve(group), self.frame.resolve(value)
        if g not in self.mapped or v not in self.mapped:
            self._tell("groupStats", g, "column-not-indexed")
            return self.frame.group_stats(g, v, bucket, exact_sum)
        to_bucket = (lambda c: c) if bucket is None else (lambda c: _calendar(c, bucket)) if isinstance(bucket, str) else bucket
        keys = self.zones.where(F.col("column") == g).select("block", "first_row", to_bucket(F.col("min")).alias("lo"), to_bucket(F.col("max")).alias("hi"), F.col("count").alias("n"), F.col("other").alias("o"))
        own = self.zones.where(F.col("column") == v).select("block", "sum", "count", "min", "max")
        pure = keys.where("n > 0 AND o = 0 AND lo = hi").join(own, "block").select("block", F.col("lo").alias("group"), "sum", "count", "min", "max", "first_row")
        mixed = keys.where("n > 0 AND NOT (o = 0 AND lo = hi)").select("block")
        if not pure.take(1):
            self._tell("groupStats", g, "groupby-not-sorted")
            return self.frame.group_stats(g, v, bucket, exact_sum)
        left = self.frame.df.withColumn("_block", block_of(F.col(self.frame.row), self.every)).join(mixed.withColumnRenamed("block", "_block"), "_block", "left_semi").drop("_block")
        scanned = SheetFrame(left, self.frame.row, self.frame.columns).group_stats(g, v, bucket, exact_sum)
        both = pure.drop("block").unionByName(scanned)
        total = F.sum(F.col("sum").cast(exact_sum)).cast("double") if exact_sum else F.sum("sum")
        return both.groupBy("group").agg(F.coalesce(total, F.lit(0.0)).alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("first_row").alias("first_row"))


def _calendar(cell, unit: str):
    from gridloom.functions.semantics import calendar_bucket

    return calendar_bucket(cell, unit)
