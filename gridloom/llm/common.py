"""What the corpus operators share: tables of a query, written intermediate tables, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that a worker handles at once; bounds its memory.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("gridloom.checkpoint.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="gridloom-checkpoint-")
            spark.conf.set("gridloom.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that ``column`` holds about ``limit`` bytes; one longer text is one slice.

    When all are done the worker, which stays for later tasks, gives freed memory back.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    give_back()


def give_back() -> None:
    """Hands unused memory of this process to the system, where its allocators can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: list[dict] = []


def hold(store: dict) -> None:
    """Keeps ``store`` in this worker, which stays for later tasks, and empties what another operator's tasks have left there."""
    if not _HELD or _HELD[0] is not store:
        for other in _HELD:
            other.clear()
        _HELD[:] = [store]
        give_back()


def texts_of(column: pa.Array) -> list[str]:
    """Texts, a null as an empty one."""
    return [x if x is not None else "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, a null as an empty one."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for a worker's later texts up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        hold(self)
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x):
    """A bijection of 64-bit numbers under which all bits depend on all (splitmix64's finish)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The largest Bloom filter that is broadcast: 2**27 bits, 16 MiB, whatever the input's size.
BLOOM_BITS_MOST = 27


class Bloom:
    """A set of 64-bit keys with false positives: only ever a first look before an exact join."""

    def __init__(self, words, bits: int):
        self.words, self.bits = words, bits

    def has(self, keys):
        import numpy as np

        keys = mix64(np.asarray(keys).astype(np.uint64))
        found = np.ones(len(keys), dtype=bool)
        for turn in (0, 29):
            at = (keys >> np.uint64(turn)) & np.uint64((1 << self.bits) - 1)
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_of(keys: DataFrame, column: str, count: int) -> Bloom:
    """A filter of a bigint column, of about 20 bits a key up to ``BLOOM_BITS_MOST``; its size has that fixed bound."""
    import numpy as np

    bits = min(BLOOM_BITS_MOST, max(12, (20 * max(count, 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            hashed = mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            for turn in (0, 29):
                at = (hashed >> np.uint64(turn)) & np.uint64((1 << bits) - 1)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], names=["at", "word"])

    from pyspark.sql import functions as F

    rows = keys.select(F.col(column).cast("long").alias("k")).where("k IS NOT NULL").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return Bloom(words, bits)
