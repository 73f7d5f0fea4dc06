"""Toxicity by boosted trees over dense features, calibrated by isotonic regression.

From a bounded sample of labelled documents come a lexicon (words and word
beginnings whose log-odds of a toxic document are high), trees over densities
of the lexicon, its nearness to words of address, capitals, punctuation and
obfuscation rates, and an isotonic map from the trees' score to a
probability, fitted on a fourth of the sample that neither lexicon nor trees see
(they do where the other three fourths lack one of the classes).
The score of a document depends on its text alone.

Null and empty texts have features of 0 and get that score. Repeated rows get the
same score. A text of any length is read whole, in one piece. A column called as the
score is replaced; other columns pass through. Without labelled
rows every document gets 0.5 - toxic only by name, and the model says that it
has learnt nothing - and with rows of one class that class's smoothed rate.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pieces, table, texts_of
from gridloom.llm.gbt import BoostedTrees, calibrated, isotonic
from gridloom.llm.labelled import SAMPLE_ROWS, labelled_sample

#: Terms of the lexicon, at most.
LEXICON = 4000
#: Lengths of word beginnings that can be terms.
STEMS = (4, 5, 6)
ADDRESS = frozenset("you your yours u ur youre yourself tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer usted ustedes tú ti tus vosotros".split())
NEAR = 6
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_LEET = str.maketrans("013457@$!|", "oieastasil")


def bare(chunk: str) -> str:
    """A stretch of text in lower case without punctuation at its ends."""
    return _EDGE.sub("", chunk.lower())


def plain(word: str) -> str:
    """A word with look-alikes read as letters, inner punctuation gone and letters at most doubled."""
    return re.sub(r"(.)\1{2,}", r"\1\1", _INNER.sub("", word.translate(_LEET)))


def terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)] if word else []


class Reader(dict):
    """From a stretch of text to (weight, disguised, address), kept for later texts."""

    def __init__(self, lexicon: dict[str, float], limit: int = 150_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, chunk: str) -> int:
        """Weight in thousandths, plus 1 << 20 if disguised, plus 1 << 21 if it addresses someone."""
        word = bare(chunk)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        hidden = 0
        if weight == 0 and not word.isalpha() and word:
            weight = max((self.lexicon.get(t, 0.0) for t in terms(plain(word))), default=0.0)
            hidden = int(weight > 0)
        if len(self) > self.limit:
            self.clear()
        value = self[chunk] = int(weight * 1000) + (hidden << 20) + (int(word in ADDRESS) << 21)
        return value


FEATURES = 19


def features(text: str, read: Reader) -> list[float]:
    chunks = text.split()
    if not chunks:
        return [0.0] * FEATURES
    n = len(chunks)
    code = np.fromiter(map(read.__getitem__, chunks), dtype=np.int64, count=n)
    hit = np.flatnonzero(code)
    weight = (code[hit] & 0xFFFFF) / 1000.0
    hidden = (code[hit] >> 20) & 1
    address = hit[(code[hit] >> 21) & 1 == 1]
    toxic = hit[weight > 0]
    weight = weight[weight > 0]
    near = 0
    if len(address) and len(toxic):
        at = np.searchsorted(address, toxic)
        gap = np.minimum(np.abs(toxic - address[np.minimum(at, len(address) - 1)]), np.abs(toxic - address[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    # single letters in a row, spelled out
    spelled = len(re.findall(r"(?:(?<=\s)|^)(?:\w[\s.\-_*]){3,}\w(?=\s|$)", text)) if n >= 4 and re.search(r"(?:^|\s)\w[\s.\-_*]\w[\s.\-_*]\w[\s.\-_*]\w", text) else 0
    bytes_ = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size = max(1, int(bytes_.sum()))
    upper, lower = int(bytes_[65:91].sum()), int(bytes_[97:123].sum())
    strong = int((weight >= 4).sum())
    close = np.diff(toxic)
    return [
        np.log1p(n),
        float(weight.max()) if len(weight) else 0.0,
        float(weight.sum()) / n,
        float(np.log1p(weight.sum())),
        float(np.log1p(strong)),
        strong / n,
        len(toxic) / n,
        float(np.sort(weight)[-2]) if len(weight) > 1 else 0.0,
        float(np.sort(weight)[-3]) if len(weight) > 2 else 0.0,
        float(np.log1p(hidden.sum())),
        float(hidden.sum()) / n,
        len(address) / n,
        near / n,
        float(np.log1p(near)),
        upper / max(1, upper + lower),
        (int(bytes_[33]) + int(bytes_[63])) / size,
        int(bytes_[[35, 36, 37, 38, 42, 64, 94, 95]].sum()) / size,
        spelled / n,
        float((close <= 3).mean()) if len(close) else 0.0,
    ]


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, knots: np.ndarray, values: np.ndarray, learnt: bool = True):
        self.lexicon, self.trees, self.knots, self.values, self.learnt = lexicon, trees, knots, values, learnt

    def scores(self, texts: list[str], read: Reader) -> np.ndarray:
        x = np.array([features(t, read) for t in texts], dtype=float).reshape(len(texts), FEATURES)
        return np.clip(calibrated(self.trees.score(x), self.knots, self.values), 0.0, 1.0)


def _counted(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(term, toxic documents, others) of the terms that stand out most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in pieces(batches):
            for t, y in zip(texts_of(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                found: set[str] = set()
                for word in set(map(bare, set(t.split()))):
                    found.update(terms(word))
                (toxic if y else clean).update(found)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())], names=["term", "toxic", "clean"])

    total = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    ones, zeros = total[0] or 0, total[1] or 0
    if not ones or not zeros:
        return []
    odds = F.log((F.col("toxic") + 0.1) / (ones + 0.2)) - F.log((F.col("clean") + 0.1) / (zeros + 0.2))
    rows = (
        sample.mapInArrow(run, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 4")
        .withColumn("weight", odds)
        .where("weight >= 1.5")
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term")
        .limit(LEXICON)
        .collect()
    )
    return [(r.term, float(r.weight)) for r in rows]


def fit_toxicity(sample: DataFrame, trees: int = 60) -> ToxicityModel:
    """A model from (doc_id, text, y); features come to the driver, of at most SAMPLE_ROWS documents.

    The rows that the isotonic map is fitted on have no part in the lexicon and the trees.
    """
    fourth = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))
    lexicon = dict(_counted(sample.where(fourth != 0)) or _counted(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(lexicon)
        for batch in pieces(batches):
            x = [features(t, read) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sample.mapInArrow(run, "doc_id long, y int, x array<double>").withColumn("h", fourth).orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(rows.num_rows, FEATURES)
    y, held = rows.column("y").to_numpy().astype(float), rows.column("h").to_numpy() == 0
    if not rows.num_rows:
        return ToxicityModel(lexicon, BoostedTrees(0.0, []), np.array([0.0]), np.array([0.5]), learnt=False)
    if held.all() or not held.any():
        held = np.arange(len(y)) % 4 == 0
    grown = BoostedTrees.fit(x[~held], y[~held], trees=trees, depth=3, rate=0.15)
    return ToxicityModel(lexicon, grown, *isotonic(grown.score(x[held]), y[held]))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with a column of probabilities."""
    from pyspark.sql import types as T

    # Of a proven size: LEXICON terms and the trees.
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        read = Reader(own.lexicon)
        for batch in pieces(batches, text):
            found = pa.array(own.scores(texts_of(batch.column(text)), read), pa.float64())
            keep = [i for i, n in enumerate(batch.schema.names) if n != score]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), found], names=[*(batch.schema.names[i] for i in keep), score])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != score), T.StructField(score, T.DoubleType())]))


def fold(id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 5


def fitted(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fitted on labelled rows that aren't held out."""
    return fit_toxicity(labelled_sample(docs, labels, "toxic", fold() != 0, SAMPLE_ROWS))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
