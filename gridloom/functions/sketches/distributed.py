"""Sketches of columns, built where the rows are and merged before they reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.sketches.hll import HyperLogLog, xxh64_intdigest
from gridloom.functions.sketches.tdigest import TDigest

#: Digests that are left for the driver to merge, whatever the number of partitions.
FAN_IN = 32


def digest_of(df: DataFrame, number: Column, compression: int = 100) -> TDigest:
    """The t-digest of an expression's finite values: one partial digest a task, merged in FAN_IN groups, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TDigest(compression)
        for batch in batches:
            own.add_many(batch.column(0).to_numpy(zero_copy_only=False))
        part = TaskContext.get().partitionId() % FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.serialize()], pa.binary())], names=["part", "sketch"])

    def merged(rows: pa.Table) -> pa.Table:
        own = TDigest(compression)
        for data in rows.column("sketch").to_pylist():
            own.merge(TDigest.deserialize(data))
        return pa.table([pa.array([own.serialize()], pa.binary())], names=["sketch"])

    finite = df.select(number.alias("x")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')")
    out = TDigest(compression)
    for row in finite.mapInArrow(partial, "part int, sketch binary").groupBy("part").applyInArrow(merged, "sketch binary").collect():
        out.merge(TDigest.deserialize(bytes(row.sketch)))
    return out


def hll_of(df: DataFrame, text: Column, p: int = 11) -> HyperLogLog:
    """The HyperLogLog of an expression's non-empty texts: merging is a max by register, in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = HyperLogLog(p)
        for batch in batches:
            own.add_many(batch.column(0).to_pylist())
        at = np.flatnonzero(own.registers)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own.registers[at].astype(np.int32))], names=["register", "rank"])

    some = df.select(text.alias("t")).where("t IS NOT NULL AND t <> ''")
    out = HyperLogLog(p)
    for row in some.mapInArrow(partial, "register int, rank int").groupBy("register").agg(F.max("rank").alias("rank")).collect():
        out.registers[row.register] = row["rank"]
    return out


__all__ = ["digest_of", "hll_of", "xxh64_intdigest"]
