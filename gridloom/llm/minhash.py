"""MinHash near-dedup with b-bit signatures.

A document's shingle set is hashed by ``BANDS * ROWS`` functions. Equal minima
of a whole band make candidates; of each minimum the low ``LOW_BITS`` bits are
kept and packed, and the share of equal fields, corrected for chance
collisions, estimates the similarity of candidates. What may reach the
threshold is confirmed on full sets. At a similarity of 0.8 a pair shares no
band with a probability of 9e-7.

Texts with equal sets are one class, and only its first document takes part.
A class is first held against the smallest member that it shares a band with.
Bands whose classes are not yet in one component are then searched in blocks:
first for each class's likeliest partners elsewhere, then for all pairs of
different components whose estimate doesn't rule the threshold out. So no
group's pairs are all listed, and none is cut off.

Null texts, and texts without a word, have an empty set and are linked with
nothing. With fewer words than a shingle has, the whole sequence is the only
shingle. ``id`` must be unique and not null. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import WordHashes, bloom_of, bytes_of, mix64, pieces, table, written
from gridloom.llm.components import components

BANDS, ROWS, LOW_BITS = 46, 6, 4
#: Rows of a band that are compared at once with as many others.
BLOCK = 4096
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 4.5
_HASHES = WordHashes()


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = _HASHES.of(found)
    width = min(words, len(h))
    last = len(h) - width + 1
    out = np.full(last, width, dtype=np.uint64)
    for j in range(width):
        out = mix64(out ^ h[j : j + last])
    return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factors), np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 512):
        part = np.multiply.outer(low[at : at + 512], factors)
        part += high[at : at + 512, None]
        np.minimum(best, part.min(axis=0), out=best)
    return best


def _pack(low: np.ndarray) -> bytes:
    """Fields of LOW_BITS bits, most significant first."""
    bits = (low[:, None] >> np.arange(LOW_BITS - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected similarities of packed signatures, rows of bytes: a field counts if none of its bits differ."""
    differ = np.bitwise_xor(a, b)
    if LOW_BITS == 4:
        other = (differ & 0xF0 != 0).sum(axis=-1, dtype=np.int64) + (differ & 0x0F != 0).sum(axis=-1, dtype=np.int64)
    else:
        bits = np.unpackbits(differ, axis=-1)[..., : BANDS * ROWS * LOW_BITS]
        other = bits.reshape(*bits.shape[:-1], BANDS * ROWS, LOW_BITS).any(axis=-1).sum(axis=-1)
    equal = 1.0 - other / (BANDS * ROWS)
    chance = 1.0 / (1 << LOW_BITS)
    return (equal - chance) / (1.0 - chance)


def least_estimate(similarity: float) -> float:
    chance = 1.0 / (1 << LOW_BITS)
    equal = similarity + (1 - similarity) * chance
    return similarity - ERRORS * np.sqrt(equal * (1 - equal) / (BANDS * ROWS)) / (1 - chance)


def sign(docs: DataFrame, words: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, sig): sets that are equal have equal n_shingles, set_a and set_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salts = _functions()
        powers = mix64(np.arange(1, ROWS + 1, dtype=np.uint64))
        seeds = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in pieces(batches, text):
            n, set_a, set_b, bands, sig = [], [], [], [], []
            for t in bytes_of(batch.column(text)):
                s = shingle_hashes(t, words)
                n.append(len(s))
                set_a.append(int(s.sum().view(np.int64)) if len(s) else 0)
                set_b.append(int(mix64(s ^ np.uint64(0x5BD1E995)).sum().view(np.int64)) if len(s) else 0)
                if not len(s):
                    bands.append(None), sig.append(None)
                    continue
                m = minima(s, factors)
                keys = mix64((m.astype(np.uint64).reshape(BANDS, ROWS) * powers).sum(axis=1) ^ seeds)
                bands.append(keys.view(np.int64))
                sig.append(_pack(m))
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n_shingles", "set_a", "set_b", "bands", "sig"])

    return docs.select(F.col(id).cast("long").alias(id), text).where(F.col(id).isNotNull()).mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, count: int, words: int, id: str, text: str) -> DataFrame:
    """(id, shingles): sorted hashes of the documents in ids; the filter lets a few others through, which join nothing."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(ids, "id", count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            hit = np.flatnonzero(wanted.value.has(batch.column(id).to_numpy(zero_copy_only=False)))
            own = batch.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([own.column(id), pa.array([shingle_hashes(t, words).tobytes() for t in bytes_of(own.column(text))], pa.binary())], names=["id", "shingles"])

    return docs.select(F.col(id).cast("long").alias(id), text).where(F.col(id).isNotNull()).mapInArrow(run, "id long, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance) of pairs: whether their sets reach the similarity, and one less the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "x"):
            linked, distance = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
                distance.append(1.0 - shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], names=["a", "b", "linked", "distance"])

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean, distance double")


def _across(members: DataFrame, floor: float, best: int | None, reach: float) -> DataFrame:
    """Pairs of different components within a band, by blocks; each class's ``best`` likeliest, or all above the floor.

    Both kinds leave out pairs whose distances from the same leader differ by
    more than ``reach``: one less the similarity is a metric, so these are
    further than that from each other.
    """

    def compare(ids, comps, sigs, sides, leaders, far) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
        found_a, found_b = [], []
        names, size = np.unique(comps, return_counts=True)
        largest = names[size.argmax()]
        # Pairs within the largest component are none: each side is held against the other's rest.
        inner = left[comps[left] == largest] if not np.array_equal(left, right) else left[:0]
        rest = right[comps[right] != largest]
        left = left[comps[left] != largest]
        for one, other in ((left, right), (inner, rest)):
            against(one, other, ids, comps, sigs, leaders, far, found_a, found_b)
        if not found_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return np.minimum(a, b), np.maximum(a, b)

    def against(left, right, ids, comps, sigs, leaders, far, found_a, found_b) -> None:
        step = max(1, (1 << 22) // max(1, len(right) * sigs.shape[1]))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            value = estimates(sigs[rows][:, None, :], sigs[right][None, :, :])
            value[comps[rows][:, None] == comps[right][None, :]] = -1
            value[(leaders[rows][:, None] == leaders[right][None, :]) & (np.abs(far[rows][:, None] - far[right][None, :]) > reach + 1e-9)] = -1
            i, j = np.nonzero(value >= floor)
            if best is not None and len(i):
                order = np.lexsort((-value[i, j], i))
                i, j = i[order], j[order]
                begins = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
                i, j = i[rank < best], j[rank < best]
            found_a.append(ids[rows[i]]), found_b.append(ids[right[j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def groups(rows: pa.Table, end: bool):
            key = rows.column("part").to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            stop = len(key) if end else (int(cut[-1]) if len(cut) else 0)
            ids, comps, sides, leaders, far = (rows.column(c).to_numpy() for c in ("id", "component", "side", "leader", "distance"))
            sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(len(key), -1) if len(key) else None
            a, b = [], []
            for s, e in zip(cut, [*cut[1:], len(key)], strict=True):
                if s < stop and e - s > 1:
                    one, two = compare(ids[s:e], comps[s:e], sigs[s:e], sides[s:e], leaders[s:e], far[s:e])
                    a.append(one), b.append(two)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
            return rows.slice(stop), pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

        left: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            left, out = groups(pa.concat_tables([left, now]) if left is not None else now, False)
            yield out
        if left is not None and left.num_rows:
            yield groups(left, True)[1]

    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A pair of blocks i <= j is one part; a row goes to every part that its block is in, on the side of i, of j or both.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "component", "sig", "leader", "distance", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("part"), F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row a document; a component's smallest id is kept."""
    signed = written(sign(docs, words, id, text), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("first"))
    classes = written(classes, "classes")
    own = signed.join(classes.select(F.col("first").alias("id")), "id", "left_semi")
    band = own.select("id", F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("key", "leader")
    members = written(band.join(shared, "key").join(own.select("id", "sig"), "id"), "members")
    ids = members.select("id").distinct()
    sets = written(_sets(docs, ids, ids.count(), words, id, text), "sets")
    floor = least_estimate(percent / 100)

    first = members.groupBy("id").agg(F.min("leader").alias("leader")).where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    compared = written(_compared(first, sets, percent), "compared")
    edges = compared.where("linked").select("a", "b")
    found = written(components(edges), "components")
    # Each class's distance from its leader is known; a class that leads is none from itself.
    known = compared.select(F.col("b").alias("id"), F.col("a").alias("first"), "distance")
    bands = members.select("key", "id", "sig").join(known, "id", "left").select("key", "id", "sig", F.coalesce("first", "id").alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    for best in (3, None):
        now = bands.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = _across(now.select("key", "id", "component", "sig", "leader", "distance"), floor, best, 1 - percent / 100)
        more = written(_compared(pairs, sets, percent).where("linked").select("a", "b"), "links")
        if more.isEmpty():
            continue
        edges = edges.unionByName(more)
        found = written(components(edges), "components")
    return (
        signed.select("id", "n_shingles", "set_a", "set_b")
        .join(classes, ["n_shingles", "set_a", "set_b"], "left")
        .join(found.withColumnRenamed("node", "first"), "first", "left")
        .select(F.col("id").alias(id), "n_shingles", F.coalesce("component", "first", "id").alias("component_id"))
        .withColumn("kept", F.col(id) == F.col("component_id"))
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


ORACLE_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS h FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r(a, b) AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
  UNION
  SELECT r.a, CASE WHEN e.x = r.b THEN e.y ELSE e.x END FROM r JOIN e ON e.x = r.b OR e.y = r.b
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
