"""Quality rules: text statistics and a decision list learned from labels.

Sequential covering grows one conjunction of thresholds after another on two
thirds of a bounded sample of labelled documents, prunes each on the rest, and
keeps it if it is precise there. The list becomes one ordered CASE expression,
so that it can be read, and runs inside Spark's generated code.

A null or empty text has no words, fails the base rule and isn't kept.
Without labels the list is empty and keeps all that the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bytes_of, pieces, table
from gridloom.llm.labelled import SAMPLE_ROWS, labelled_sample

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "pipe_share", "digit_share", "distinct_share", "top_share", "comma_share", "double_share"]
RULES, CONDITIONS, PRECISE = 16, 4, 0.9
#: Of the covered bad documents' values; thresholds are tried there.
QUANTILES = sorted({*(x / 100 for x in (0, 2, 5, 10, 25)), *(1 - x / 100 for x in (0, 2, 5, 10, 25)), 1 / 2})
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    later = int(count[128:192].sum())  # bytes of a code point after its first
    chars = int(count.sum()) - later - int(count[32]) - int(count[9:14].sum())
    symbols = int(count[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = double = 0
    distinct = top = 0
    if n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        freq = np.bincount(ids)
        distinct, top = len(number), int(freq.max())
        double = int((ids[1:] == ids[:-1]).sum())
        if n >= 3:
            width = len(number)
            if width < 2_000_000:
                window = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
            else:
                pair = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)[1]
                window = pair[:-1] * width + ids[2:]
            _, back, times = np.unique(window, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            covered = np.zeros(n, dtype=bool)
            for j in range(3):
                covered[j : n - 2 + j] |= twice
            repeat = int(covered.sum())
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    per = lambda x, y: x / y if y else 0.0
    return [
        n, chars, symbols, dup, repeat,
        per(chars, n), per(symbols, chars), per(dup, len(lines)), per(repeat, n), per(upper, upper + lower),
        per(int(count[33]), chars), per(int(count[124]), chars), per(int(count[48:58].sum()), chars), per(distinct, n), per(top, n), per(int(count[44]), n), per(double, n),
    ]


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with COUNTS as long and SHARES as double instead of ``text``."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = np.array([statistics(t) for t in bytes_of(batch.column(text))], dtype=float).reshape(batch.num_rows, len(COUNTS) + len(SHARES))
            keep = [i for i, c in enumerate(batch.schema.names) if c not in (text, *COUNTS, *SHARES)]
            made = [pa.array(x[:, j].astype(np.int64) if j < len(COUNTS) else x[:, j]) for j in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *COUNTS, *SHARES])

    keep = [f for f in df.schema.fields if f.name not in (text, *COUNTS, *SHARES)]
    made = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES]
    return df.mapInArrow(run, T.StructType([*keep, *made]))


Rule = list[tuple[str, str, float]]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for name, op, value in rule:
        out &= x[name] > value if op == ">" else x[name] <= value
    return out


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered conjunctions, each of which rejects what it covers."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    live, rules = np.ones(n, dtype=bool), []
    while len(rules) < RULES and (live & bad & ~prune).sum() >= 5:
        grow = live & ~prune
        rule: Rule = []
        inside = grow.copy()
        while len(rule) < CONDITIONS:
            p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p or not q:
                break
            base, best = np.log2(p / (p + q)), (0.0, None)
            for name, v in x.items():
                own = v[inside & bad]
                for cut in np.unique(np.quantile(own, QUANTILES)):
                    for op in (">", "<="):
                        edge = float(np.nextafter(cut, -np.inf)) if op == ">" else float(cut)
                        hit = inside & (v > edge if op == ">" else v <= edge)
                        a, b = int((hit & bad).sum()), int((hit & ~bad).sum())
                        if a:
                            gain = a * (np.log2(a / (a + b)) - base)
                            if gain > best[0] + 1e-9:
                                best = (gain, (name, op, edge))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _covered(rule[-1:], x, n)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = live & prune & _covered(rule[:k], x, n)
            a, b = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append((a - b) / (a + b) if a + b else -1.0)
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = live & _covered(rule, x, n)
        a, b = int((hit & prune & bad).sum()), int((hit & prune & ~bad).sum())
        if not a or a < PRECISE * (a + b):
            break
        rules.append(rule)
        live &= ~hit
    return rules


def rules_sql(rules: list[Rule]) -> str:
    """The list as one expression: true keeps. The first rule that holds decides."""
    cases = " ".join("WHEN " + " AND ".join(f"`{c}` {op} {v!r}D" for c, op, v in rule) + " THEN false" for rule in rules)
    return f"CASE {cases} ELSE true END" if cases else "true"


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from a bounded sample; its statistics come to the driver."""
    found = text_statistics(labelled_sample(docs, labels, "quality", None, rows)).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not found.num_rows:
        return []
    x = {c: found.column(c).to_numpy().astype(float) for c in SHARES}
    return learn_rules(x, found.column("y").to_numpy() == 0)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"))
    found = text_statistics(docs).withColumn("base_failed", base_failed())
    return found.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.expr(rules_sql(rules))).alias("kept"))
