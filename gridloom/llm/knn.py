"""Exact top-k by inner product, as a Voronoi join.

Pivots come from a bounded sample by a few k-means rounds. Every vector, query or not, goes to
its nearest pivot's group; a group's summary is its size, its radius and that of its queries.
From the summaries alone come bounds of the scores between a group's queries and
a group's vectors: groups that surely hold k better ones for all of the queries rule out others. For
the groups that are left, each query's k-th best score among the sample is a floor that its true k-th best
can't be under, and ``q.p + |q| * radius`` a ceiling on what a group holds. A part is
at most about ``BLOCK_QUERIES`` queries of one group, or of several that are near each other; a group's vectors are sent only to parts
with a query whose ceiling reaches its floor. Groups are cut
into blocks of ``BLOCK_ROWS`` rows, so that a group of any size, such as
copies of one vector, takes many tasks. Each block gives k rows a query.

Vectors that are null, empty, or hold null or non-finite components take no
part; nor do rows without an id. Only vectors of a query's own length are its
candidates. Ties go to the smaller id. Scores outside of 64 bits are set to
the nearest end of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

#: Vectors from which pivots and floors come; the sample's bound.
SAMPLE_VECTORS = 2048
PIVOTS = 64
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Room for rounding in bounds, as a share of their terms.
SLACK = 1e-9


def quantised(rows: list) -> np.ndarray:
    """floor(1024 * x) as doubles, which hold it exactly, or as Python's integers if they might not hold a product."""
    return np.floor(1024.0 * np.asarray(rows, dtype=np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows, as int64."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object).reshape(len(a), len(b))
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near].astype(object) if (score == -(2**63)).any() else -score[near]))[:k]]


def _centres(x: np.ndarray) -> np.ndarray:
    if len(x) <= PIVOTS:
        return x
    p = x[:: len(x) // PIVOTS][:PIVOTS].copy()
    for _ in range(5):
        near = _nearest(x, p)[0]
        for j in range(len(p)):
            if (near == j).any():
                p[j] = x[near == j].mean(axis=0)
    return p


def _nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = max(1.0, np.abs(x).max(initial=0), np.abs(p).max(initial=0))
    x, p = x / scale, p / scale
    group = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
    return group, np.sqrt(((x - p[group]) ** 2).sum(axis=1)) * scale


def _parts(summary: list, lengths: dict) -> dict:
    """For each group, the first of its queries' parts and how many there are. Small groups share a part with those next to them."""
    out, at = {}, 0
    for length in sorted({r.length for r in summary}):
        left = sorted((r for r in summary if r.length == length), key=lambda r: r.pivot)
        centres, filled, here = lengths[length][2] if length in lengths else None, 0, None
        at += 1
        while left:
            if here is None or here.pivot < 0:
                here = left[0]
            else:
                here = min(left, key=lambda r: np.inf if r.pivot < 0 else float(((centres[r.pivot] - centres[here.pivot]) ** 2).sum()))
            left.remove(here)
            own = -(-here.queries // BLOCK_QUERIES)
            if own > 1 or filled + here.queries > BLOCK_QUERIES:
                at, filled = at + 1, 0
            out[length, here.pivot] = at, max(1, own)
            filled += here.queries
            if own > 1:
                at, filled = at + own, 0
    return out


def _plan(summary: list, lengths: dict, k: int) -> dict:
    """For each group that has queries: the pivots, sizes and radii of the groups that may hold some of their best."""
    plan = {}
    for q in summary:
        own = [r for r in summary if r.length == q.length]
        pivots, n, radii = (np.array([getattr(r, c) for r in own]) for c in ("pivot", "n", "radius"))
        if not q.queries:
            continue
        keep = np.ones(len(own), dtype=bool)
        if q.pivot >= 0:
            centres = lengths[q.length][2]
            p, c = centres[q.pivot], centres[np.maximum(pivots, 0)]
            size = np.sqrt((c * c).sum(axis=1))
            # A query is p + a, a vector is c + b, with |a| and |b| known at most.
            spread = q.reach * size + radii * np.sqrt((p * p).sum()) + q.reach * radii
            spread += SLACK * (spread + np.abs(c @ p) + 1)
            low, high = np.where(pivots >= 0, c @ p - spread, -np.inf), np.where(pivots >= 0, c @ p + spread, np.inf)
            order = np.argsort(-low, kind="stable")
            enough = np.flatnonzero(np.cumsum(n[order]) >= k + 1)  # one of them may be the query itself
            if len(enough):
                keep = high >= low[order[enough[0]]]
        plan[q.length, q.pivot] = pivots[keep], n[keep], radii[keep]
    return plan


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``queries`` holds."""
    spark = vectors.sparkSession
    valid = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("is_query"))
    valid = valid.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))
    first = valid.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "v").limit(SAMPLE_VECTORS).collect()
    lengths: dict[int, tuple] = {}
    for n in sorted({len(r.v) for r in first}):
        own = [r for r in first if len(r.v) == n]
        x = quantised([r.v for r in own])
        lengths[n] = (np.array([r.vec_id for r in own]), x, _centres(x))
    sent = spark.sparkContext.broadcast(lengths)  # SAMPLE_VECTORS vectors and as many pivots, at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            size = np.array([len(r) for r in rows], dtype=np.int64)
            pivot, far = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows))
            for n in set(size.tolist()) & sent.value.keys():
                at = np.flatnonzero(size == n)
                pivot[at], far[at] = _nearest(quantised([rows[i] for i in at]), sent.value[n][2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(pivot), pa.array(far)], names=[*batch.schema.names, "length", "pivot", "far"])

    assigned = written(valid.mapInArrow(assign, "vec_id long, v array<double>, is_query boolean, length long, pivot long, far double"), "assigned")
    # One row a pivot and length; lengths that the sample lacks have the pivot -1 and are searched whole.
    asks = F.when(F.col("is_query"), F.col("far"))
    summary = assigned.groupBy("length", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if("is_query").alias("queries"), F.coalesce(F.max(asks), F.lit(0.0)).alias("reach")).collect()
    groups = spark.sparkContext.broadcast(_plan(summary, lengths, k))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            own = list(zip(batch.column("length").to_pylist(), batch.column("pivot").to_pylist(), strict=True))
            keep, piv, blk = [], [], []
            for group in set(own):
                at = np.array([i for i, g in enumerate(own) if g == group])
                x, ids = quantised([rows[i] for i in at]), batch.column("vec_id").to_numpy()[at]
                pivots, sizes, radii = groups.value[group]
                if group[1] < 0:
                    reached = np.ones((len(at), len(pivots)), dtype=bool)
                else:
                    known, centres = sent.value[group[0]][:2], sent.value[group[0]][2][np.maximum(pivots, 0)]
                    score = np.where(known[0][None, :] != ids[:, None], products(x, known[1]).astype(float), -np.inf)
                    floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(at), -np.inf)
                    norm = np.sqrt((x * x).sum(axis=1))[:, None]
                    room = SLACK * (norm * (np.sqrt((centres * centres).sum(axis=1)) + radii)[None, :] + 1)
                    reached = (x @ centres.T + norm * radii[None, :] + room >= floor[:, None]) | (pivots < 0)[None, :]
                for i, j in zip(*np.nonzero(reached), strict=True):
                    blocks = -(-int(sizes[j]) // BLOCK_ROWS)
                    keep += [int(at[i])] * blocks
                    piv += [int(pivots[j])] * blocks
                    blk += range(blocks)
            q = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([q.column("vec_id"), q.column("v"), q.column("length"), pa.array(piv, pa.int64()), pa.array(blk, pa.int64()), q.column("pivot")], names=["vec_id", "v", "length", "pivot", "block", "own"])

    # Of a proven size: a row a pivot and length.
    dealt = _parts(summary, lengths)
    sizes = spark.createDataFrame([(r.length, r.pivot, r.n, *dealt[r.length, r.pivot]) for r in summary], "length long, pivot long, n long, first long, parts long")
    part = F.col("first") + F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.col("parts"))
    routed = assigned.where("is_query").mapInArrow(route, "vec_id long, v array<double>, length long, pivot long, block long, own long")
    routed = routed.join(F.broadcast(sizes.select("length", F.col("pivot").alias("own"), "first", "parts")), ["length", "own"]).withColumn("part", part).drop("own", "first", "parts")
    routed = written(routed, "routed")
    needed = routed.select("length", "pivot", "part").distinct().toDF("length", "pivot", "part")
    data = assigned.join(F.broadcast(sizes.select("length", "pivot", "n")), ["length", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK_ROWS).cast("long")))
    data = data.join(needed, ["length", "pivot"]).select("vec_id", "v", "length", "pivot", "block", "part")
    by = ["length", "pivot", "block", "part"]

    def solve(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and rows.num_rows:
            ids, b = rows.column("vec_id").to_numpy(), quantised(rows.column("v").to_pylist())
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                own, score = part.column("vec_id").to_numpy(), products(quantised(part.column("v").to_pylist()), b)
                for i, q in enumerate(own):
                    other = np.flatnonzero(ids != q)
                    hit = other[best(score[i][other], ids[other], k)]
                    out[0].append(np.full(len(hit), q)), out[1].append(ids[hit]), out[2].append(score[i][hit])
        flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out]
        return pa.table([pa.array(x) for x in flat], names=["query_id", "vec_id", "score"])

    local = routed.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
