"""BPE encoding and decoding with a public word-level vocabulary.

Words are merged in batches: the symbols of many words lie in one flat array,
each round looks every neighbouring pair up in the sorted pair keys by binary
search, and each word then merges all places of its lowest-ranked pair. A
word's ids are kept for later batches, up to ``CACHED_CHUNKS`` words.

Null or empty texts have no ids. Repeated rows are encoded alike. Other
columns are left out of the general operators' work and kept in their output.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from xxhash import xxh64_intdigest
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import hold, pieces, table, texts_of
from gridloom.llm.repeats import Hashed

#: Stretches of text whose ids a worker keeps, in about 30 bytes each; beyond it the store starts anew.
CACHED_CHUNKS = 600_000
#: Bytes of text that are hashed at once, and of a stretch that the fast hash is trusted with.
HASHED_BYTES, SHORT = 1 << 17, 200
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Separators that str.split() takes for white space and the vocabulary doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII's.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
END = "</w>"
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def gather(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``values[b:e]`` of all pairs, one after another."""
    size = end - begin
    last = np.cumsum(size)
    total = int(last[-1]) if len(last) else 0
    return values[np.repeat(begin - (last - size), size) + np.arange(total)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cached_chunks: int = CACHED_CHUNKS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.specials.values()) + 1
        if size > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.id_text = [str(i) for i in range(size)]
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + END] for x in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.cached_chunks = cached_chunks
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint16)
        self.starts = np.zeros(1, dtype=np.int64)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's begin (one more than words)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        if len(data) > lengths.sum():  # from code points to bytes
            begins = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
            lengths = np.diff(begins[np.append(0, np.cumsum(lengths))])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        symbol = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[data[ends]]
        rank = np.full(len(symbol), _NONE, dtype=np.int32)
        place = np.zeros(len(symbol), dtype=np.int32)
        fresh = np.arange(len(symbol) - 1)
        done_word, done_symbol = [], []
        while len(symbol):
            # Only pairs with a new neighbour are looked up again.
            pair = symbol[fresh] << 16 | symbol[fresh + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[fresh] = np.where((self.keys[at] == pair) & (word[fresh] == word[fresh + 1]), self.ranks[at], _NONE)
            place[fresh] = at
            rank[-1] = _NONE
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            finished = best == _NONE
            hit = np.flatnonzero((rank == best) & ~finished)
            keep = ~finished
            if not keep.all():
                done_word.append(word[finished])
                done_symbol.append(symbol[finished])
            if not len(hit):
                break
            # In a run such as "aaaa" every place matches; only every other one may merge.
            begins = np.append(True, np.diff(hit) != 1)
            since = np.arange(len(hit)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hit = hit[since % 2 == 0]
            symbol[hit] = self.made[place[hit]]
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, word, rank, place = symbol[keep], word[keep], rank[keep], place[keep]
            hit = moved[hit]
            near = np.zeros(len(symbol) + 1, dtype=bool)
            near[hit] = near[hit - 1] = True
            fresh = np.flatnonzero(near[: len(symbol) - 1])
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        return symbol[order].astype(np.uint16), np.append(0, np.cumsum(counts))

    def _plain(self, part: str) -> str:
        """Normalised, in lower case."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
            if "Σ" in part:  # lower-cased on its own, whatever follows
                part = "".join(map(str.lower, part))
        return part.lower()

    def _rare(self, text: str) -> np.ndarray:
        """A text's ids, where it may hold special tokens or odd separators."""
        out: list[np.ndarray] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.specials:
                out.append(np.array([self.specials[part]], dtype=np.uint16))
            elif words := WORD.findall(self._plain(part)):
                each = list(dict.fromkeys(words))
                ids, starts = self.merge_words(each)
                number = dict(zip(each, range(len(each)), strict=True))
                at = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                out.append(gather(ids, starts[at], starts[at + 1]))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint16)

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of stretches, from sums over short pieces of the text."""
        out = np.empty(len(begin), dtype=np.uint64)
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + HASHED_BYTES, side="right")))
            out[at:to] = Hashed(data[begin[at] : end[to - 1]]).of(begin[at:to] - begin[at], end[at:to] - begin[at])
            at = to
        for i in np.flatnonzero(end - begin > SHORT).tolist():
            out[i] = xxh64_intdigest(data[begin[i] : end[i]].tobytes())
        return out

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Adds stretches to the store; their places there."""
        # Stretches of letters are one word each; others are cut. No word crosses white space.
        whole = list(map(str.isalpha, chunks))
        plain, cut = list(compress(chunks, whole)), list(compress(chunks, map(not_, whole)))
        words = list(map(WORD.findall, cut))
        each = plain + list(set(chain.from_iterable(words)).difference(plain))
        number = dict(zip(each, range(len(each)), strict=True))
        ids, starts = self.merge_words(each)
        counts = np.append(np.ones(len(plain), dtype=np.int64), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        at = np.append(np.arange(len(plain)), np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts[len(plain) :].sum())))
        size = np.append(0, np.cumsum(starts[at + 1] - starts[at]))
        base = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, len(self.flat) + size[np.cumsum(counts)]])
        self.flat = np.concatenate([self.flat, gather(ids, starts[at], starts[at + 1])])
        order = np.array(whole, dtype=bool)
        out = np.empty(len(chunks), dtype=np.int64)
        out[order], out[~order] = base + np.arange(len(plain)), base + len(plain) + np.arange(len(cut))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, as 16-bit numbers."""
        if len(self.known) > self.cached_chunks:
            self._forget()
        parts, rare = [], {}
        for i, text in enumerate(texts):
            if ("<|" in text and self.specials) or ODD_SPACE.search(text):
                rare[i] = self._rare(text)
                parts.append(b"")
                continue
            text = self._plain(text)
            parts.append((text if text.isascii() else WIDE_SPACE.sub(" ", text)).encode())
        joined = b" ".join(parts)
        data = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[data]
        begin, end = np.flatnonzero(~space & np.append(True, space[:-1])[: len(space)]), np.flatnonzero(~space & np.append(space[1:], True)[: len(space)]) + 1
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        first = np.searchsorted(begin, np.append(0, np.cumsum(sizes + 1)))
        hashes, found, place = np.unique(self._hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        old = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)
        where = self.known_at[at] if len(self.known) else np.zeros(len(hashes), dtype=np.int64)
        new = np.flatnonzero(~old)
        if len(new):
            where[new] = self._learn([joined[b:e].decode() for b, e in zip(begin[found[new]].tolist(), end[found[new]].tolist(), strict=True)])
            inside = np.searchsorted(self.known, hashes[new])
            self.known, self.known_at = np.insert(self.known, inside, hashes[new]), np.insert(self.known_at, inside, where[new])
        at = where[place]
        begin, end = self.starts[at], self.starts[at + 1]
        ids = gather(self.flat, begin, end)
        last = np.append(0, np.cumsum(end - begin))[first[1:]]
        out = np.split(ids, last[:-1]) if texts else []
        for i, own in rare.items():
            out[i] = own
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary has no decoder: its tokens, with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each worker and vocabulary."""
    hold(_LOADED)
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids; a null text has an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in pieces(batches, text):
            found = model.encode(texts_of(batch.column(text)))
            offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            keep = [i for i, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), ids])

    names = [f for f in df.schema.fields if f.name != ids]
    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*names, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; a null list has an empty text."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(ids).to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in keep), text])

    names = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, T.StructType([*names, T.StructField(text, T.StringType())]))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    path = default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in pieces(batches):
            found = model.encode(texts_of(batch.column("text")))
            ids = [hashlib.sha256(" ".join(map(model.id_text.__getitem__, x.tolist())).encode()).hexdigest() for x in found]
            back = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
