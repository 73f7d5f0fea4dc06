"""Exact removal of passages that repeat, by parsing at rolling-hash triggers.

Texts are byte strings. A trigger is the place whose rolling hash is the
smallest in some ``length``-byte string; each such string has one, found from its
bytes alone, so equal strings have it at equal places. The strings that share a
trigger form a phrase: the bytes that they cover, with the trigger's place.
Triggers and phrases (the dictionary) are counted over all documents:

* a trigger's gram that is found once: none of its strings repeats;
* a phrase that is found twice or more: all of its strings repeat;
* a gram whose phrases differ: the strings of one representative of each
  phrase are compared one by one: as neighbours in the order of the phrases'
  suffixes where a gram's phrases are few, so that they are in one task. Where
  they are many, each string reaches far to the left or to the right of the gram:
  hashes of the gram with that half are counted first, and only strings whose half is
  found again are counted one by one, by a distributed count of hashes.

So strings are compared only where repeats begin and end. The other scans of the
texts look phrases up in Bloom filters of a fixed size first; the joins that
follow are exact. Hashes have 128 bits together with the gram.

A null text is an empty one; texts shorter than ``length`` bytes lose nothing.
Strings never cross texts. Rows that are equal repeat each other. ``id`` may be
null or repeated: rows are told apart by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bloom_of, bytes_of, forget, mix64, pieces, table, written

LENGTH, GRAM = 200, 64
#: Phrases of one gram whose strings are counted in one task; of grams with more, all strings are dealt out by their hashes.
KINDS_AT_ONCE = 2000
#: Bytes of texts that are looked at together, and bytes that are hashed at once; positions within have so many bits.
PARSED_BYTES = 1 << 20
SEGMENT_BITS = 20
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_B, _B_INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


class Hashed:
    """Hashes of all stretches of a byte string, from sums over its beginnings."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * down[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.up[begin] ^ ((end - begin).astype(np.uint64) << np.uint64(40)))


def parse(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """As ``parsed``, without the trigger's place."""
    for *phrases, _ in parsed(texts, length, gram):
        yield tuple(phrases)


def parsed(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Phrases as (text, begin of its first string, strings, gram hash, phrase hash), and the hashes by segment.

    Yields one tuple for each segment of concatenated texts: (hashed, text
    number, begin in the text, begin in the segment, strings, gram, phrase, place of the
    trigger in the phrase).
    """
    most = (1 << SEGMENT_BITS) - 1
    span = length - gram + 1
    parts: list[tuple[int, int, bytes]] = []
    for number, t in enumerate(texts):
        if len(t) >= length:
            step = most - length
            parts += [(number, at, t[at : at + step + length - 1]) for at in range(0, len(t) - length + 1, step)]
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop][2]) <= most):
            size += len(parts[stop][2])
            stop += 1
        own = parts[at:stop]
        at = stop
        data = np.frombuffer(b"".join(p[2] for p in own), dtype=np.uint8)
        hashed = Hashed(data)
        places = np.arange(len(data) - gram + 1)
        grams = hashed.of(places, places + gram)
        key = (grams >> np.uint64(SEGMENT_BITS) << np.uint64(SEGMENT_BITS)) | places.astype(np.uint64)
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(key) - span + 1], least[span - width :][: len(key) - span + 1])
        trigger = (least & np.uint64(most)).astype(np.int64)
        sizes = np.array([len(p[2]) for p in own])
        begins = np.append(0, np.cumsum(sizes)[:-1])
        counts = sizes - length + 1
        first = np.repeat(begins - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        which = np.repeat(np.arange(len(own)), counts)
        trigger = trigger[first]
        cut = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (which[1:] != which[:-1])))
        strings = np.diff(np.append(cut, len(first)))
        begin, place, part = first[cut], trigger[cut], which[cut]
        phrase = hashed.of(begin, begin + strings - 1 + length)
        phrase = mix64(phrase ^ mix64((place - begin).astype(np.uint64)))
        text = np.array([p[0] for p in own])[part]
        shift = np.array([p[1] for p in own])[part] - begins[part]
        yield hashed, text, begin + shift, begin, strings, grams[place], phrase, place - begin


def _place(row: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return mix64(row.astype(np.uint64) ^ mix64(begin.astype(np.uint64)))


def _both(gram: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    return mix64(gram ^ mix64(phrase))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, phrase = (batch.column(c).to_numpy().view(np.uint64) for c in ("gram", "phrase"))
        yield pa.RecordBatch.from_arrays([_signed(_both(gram, phrase))], names=["k"])


def _spread(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The place of each suffix in the order of their first ``length`` bytes; equal beginnings share a place.

    Prefix doubling: ranks of twice the length come from pairs of ranks.
    """
    rank, width = data.astype(np.int64), 1
    while width < length:
        step = min(width, length - width)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        width += step
    return rank


#: Edges whose suffixes are ordered at once; those of one gram are never parted.
EDGES_AT_ONCE = 2000


def _counted_locally(length: int):
    """From edges in the order of their gram to the stretches of strings that two of them share: neighbours in suffix order."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = rows.column("gram").to_numpy()
        cuts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])).tolist()
        begin = 0
        for cut, after in zip(cuts, [*cuts[1:], len(gram)], strict=True):
            if after - begin > EDGES_AT_ONCE and cut > begin:
                yield shared(rows.slice(begin, cut - begin))
                begin = cut
        yield shared(rows.slice(begin))

    def shared(rows: pa.Table) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype=np.uint8)
        row, begin, strings = (rows.column(c).to_numpy() for c in ("row", "begin", "strings"))
        inner = np.cumsum(strings + length - 1) - (strings + length - 1)
        own = suffix_ranks(data, length)[np.repeat(inner, strings) + _spread(strings)]
        hit = np.bincount(own)[own] > 1
        edge = np.repeat(np.arange(len(strings)), strings)
        starts = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (edge[1:] != edge[:-1])))
        stops = np.flatnonzero(hit & np.append(~hit[1:] | (edge[1:] != edge[:-1]), True))
        where = edge[starts]
        return pa.RecordBatch.from_arrays([pa.array(row[where], pa.int64()), pa.array(begin[where] + starts - (np.cumsum(strings) - strings)[where], pa.int64()), pa.array(stops - starts + 1, pa.int64())], names=["row", "begin", "strings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            gram = now.column("gram").to_numpy()
            last = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
            rest = now.slice(last)
            if last:
                yield from found(now.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from found(rest)

    return run


def _strings(length: int):
    """From stretches to their strings, one by one, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", PARSED_BYTES):
            size = batch.column("strings").to_numpy()
            data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), dtype=np.uint8)
            at = np.repeat(np.cumsum(size + length - 1) - (size + length - 1), size) + _spread(size)
            hashes = Hashed(data).of(at, at + length)
            gram, row, begin = (np.repeat(batch.column(c).to_numpy(), size) for c in ("gram", "row", "begin"))
            yield pa.RecordBatch.from_arrays([pa.array(gram), _signed(hashes), pa.array(row), pa.array(begin + _spread(size)), pa.array(np.ones(len(at), dtype=np.int64))], names=["gram", "hash", "row", "begin", "strings"])

    return run


def repeated_strings(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, at): of (row, text), stretches of repeated strings: the first's begin and their number."""
    spark = rows.sparkSession

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PARSED_BYTES):
            row = batch.column("row").to_numpy()
            for _, text, begin, _, _, gram, phrase in parse(bytes_of(batch.column("text")), length):
                yield pa.RecordBatch.from_arrays([_signed(gram), _signed(phrase), _signed(_place(row[text], begin))], names=["gram", "phrase", "place"])

    found = rows.mapInArrow(phrases, "gram long, phrase long, place long")
    # Copies are summed up before they are dealt out, so a phrase's rows are at most one from each task.
    counted = found.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    counted = written(counted, "phrases")
    # Partial counts, and a join of tables that can be dealt anew: no gram's phrases meet in one task.
    grams = written(counted.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "grams")
    dictionary = written(counted.join(grams, "gram", "left").where("n > 1 OR kinds IS NOT NULL").withColumn("kinds", F.coalesce("kinds", F.lit(1))), "dictionary")
    forget(counted)
    whole = dictionary.where("n > 1").select("gram", "phrase")
    few, many = f"kinds > 1 AND kinds <= {KINDS_AT_ONCE}", f"kinds > {KINDS_AT_ONCE}"
    sizes = dictionary.agg(*(F.count_if(F.expr(e)) for e in ("n > 1", few, many))).first()
    # Only a first look: what a filter lets through by mistake is joined or counted exactly.
    keyed = whole.mapInArrow(_key_batches, "k long")
    filters = spark.sparkContext.broadcast((bloom_of(keyed, "k", sizes[0]), *(bloom_of(dictionary.where(e), "place", n) for e, n in zip((few, many), sizes[1:], strict=True))))

    half = (length - GRAM) // 2

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, few_kinds, many_kinds = filters.value
        for batch in pieces(batches, "text", PARSED_BYTES):
            row, texts = batch.column("row").to_numpy(), bytes_of(batch.column("text"))
            for hashed, text, begin, inner, strings, gram, phrase, trigger in parsed(texts, length):
                parts = []
                hit = np.flatnonzero(same.has(_both(gram, phrase)))
                parts.append((0, gram[hit], phrase[hit], row[text[hit]], begin[hit], strings[hit], [None] * len(hit)))
                place = _place(row[text], begin)
                held = lambda hit, b, n: [texts[t][x : x + s + length - 1] for t, x, s in zip(text[hit].tolist(), b.tolist(), n.tolist(), strict=True)]
                hit = np.flatnonzero(few_kinds.has(place))
                parts.append((1, gram[hit], phrase[hit], row[text[hit]], begin[hit], strings[hit], held(hit, begin[hit], strings[hit])))
                hit = np.flatnonzero(many_kinds.has(place))
                # Strings with more than ``half`` bytes before the gram, then the others.
                at, left = inner[hit] + trigger[hit], np.clip(trigger[hit] - half, 0, strings[hit])
                for kind, n, first, here, reach in ((2, left, begin[hit], at - half - 1, at + GRAM), (3, strings[hit] - left, begin[hit] + left, at, at + length - half)):
                    own = np.flatnonzero(n > 0)
                    parts.append((kind, gram[hit][own], hashed.of(here[own], reach[own]), row[text[hit[own]]], first[own], n[own], held(hit[own], first[own], n[own])))
                for kind, gram_, hash_, row_, begin_, strings_, bytes_ in parts:
                    if len(gram_):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram_), kind, np.int32)), _signed(gram_), _signed(hash_), pa.array(row_, pa.int64()), pa.array(begin_, pa.int64()), pa.array(strings_, pa.int64()), pa.array(bytes_, pa.binary())], names=["kind", "gram", "hash", "row", "begin", "strings", "bytes"])

    seen = written(rows.mapInArrow(looked_up, "kind int, gram long, hash long, row long, begin long, strings long, bytes binary"), "seen")
    all_of = seen.where("kind = 0").join(whole.withColumnRenamed("phrase", "hash"), ["gram", "hash"], "left_semi").select("row", "begin", "strings")
    edges = seen.where("kind = 1").select("gram", "row", "begin", "strings", "bytes")
    local = edges.repartition("gram").sortWithinPartitions("gram").mapInArrow(_counted_locally(length), "row long, begin long, strings long")
    halves = seen.where("kind > 1").select("kind", "gram", "hash", "row", "begin", "strings", "bytes")
    again = written(halves.groupBy("kind", "gram", "hash").agg(F.count("*").alias("n")).where("n > 1").select("kind", "gram", "hash"), "halves")
    singles = written(halves.join(again, ["kind", "gram", "hash"], "left_semi").select("gram", "row", "begin", "strings", "bytes").mapInArrow(_strings(length), "gram long, hash long, row long, begin long, strings long"), "singles")
    twice = written(singles.groupBy("gram", "hash").agg(F.count("*").alias("n")).where("n > 1").select("gram", "hash"), "twice")
    spread = singles.join(twice, ["gram", "hash"], "left_semi").select("row", "begin", "strings")
    return all_of.unionByName(local).unionByName(spread).groupBy("row").agg(F.collect_list(F.struct("begin", "strings")).alias("at"))


def uncovered(text: bytes, begins: np.ndarray, strings: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and maximal removed runs."""
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + strings - 1 + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int((gone & np.append(True, ~gone[:-1])).sum()) if len(gone) else 0
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept binary, n_bytes, n_removed, n_spans): what is left of each text; cuts may split code points."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    strings = written(repeated_strings(rows.select("row", "text"), length), "strings")
    filter_ = rows.sparkSession.sparkContext.broadcast(bloom_of(strings, "row", strings.count()))
    names = ["id", "kept", "n_bytes", "n_removed", "n_spans"]
    schema = "id long, kept binary, n_bytes long, n_removed long, n_spans long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = batch.filter(pa.array(~filter_.value.has(batch.column("row").to_numpy())))
            texts = bytes_of(own.column("text"))
            zero = pa.array(np.zeros(len(texts), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(texts, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), zero, zero], names=names)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(filter_.value.has(batch.column("row").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], []]
            at = batch.column("at")
            for i, t in enumerate(bytes_of(batch.column("text"))):
                own = at[i].values
                begin, strings_ = (np.empty(0, np.int64),) * 2 if own is None else (own.field(j).to_numpy() for j in (0, 1))
                for column, value in zip(out, (*uncovered(t, begin, strings_, length), len(t)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.binary()), *(pa.array(out[i], pa.int64()) for i in (3, 1, 2))], names=names)

    fine = rows.mapInArrow(whole, schema)
    rest = rows.mapInArrow(touched, rows.schema).join(strings, "row", "left").select("id", "text", "at").mapInArrow(cut, schema)
    return fine.unionByName(rest).withColumnRenamed("id", id)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
