"""Personal data: patterns give base spans, boosted trees judge further candidates.

All of it is SQL on the main path: generators with a high recall propose
all spans of several lengths at every start, which overlap; trees over their format and their context, grown once
on the driver from examples that ``labelled_examples`` writes, become nested IF
expressions; thresholds that reach ``PRECISION`` on held-out examples of each
kind select spans. Base spans always stay; of chosen candidates that overlap no
base span, the best are taken one by one, each if it overlaps none taken. No row leaves its task.

The time goes with the length of a text and its number of matches. Where more than
``COMPETING`` candidates overlap in one run, they are gone through in so many from the left.

A null text has no spans and stays null; an empty text has none. Repeated rows have
the same spans. Positions are code points. Other columns of the input pass through.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.gbt import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Share of true spans that a kind's threshold must reach on held-out examples.
PRECISION = 0.97
#: Examples that ``labelled_examples`` writes for the trees.
EXAMPLES = 3000
TREES = 20
LOCAL = "[A-Za-z0-9._%+-]"
#: A local part begins where its run of letters does, or where the last match ended; so a long run is tried once.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _PART = r"(?:@|[\x20]?[\[(]at[\])][\x20]?|[\x20]at[\x20])", r"[A-Za-z0-9-]{1,63}+"
_DOT = r"(?:\.|[\x20]?[\[(]dot[\])][\x20]?|[\x20]dot[\x20])"
_CARD_GAP, _PHONE_GAP = r"[\x20./-]{0,2}+", r"\)?+[\x20./-]{0,3}+\(?+"
#: Generators with a high recall: where a candidate may begin, and the longest stretch that it may be the beginning of.
#: Numbers take one digit more than the longest candidate has, so that the end of a group of digits can be told.
WIDE = {
    "email": (rf"(?<!{LOCAL})", rf"{LOCAL}{{1,64}}+{_AT}{_PART}(?:{_DOT}{_PART}){{1,6}}"),
    "ip": (r"(?<![0-9A-Fa-f:.])", r"(?:[0-9]{1,3}(?:\.|[\x20]?[\[(](?:\.|dot)[\])][\x20]?)){3}[0-9]{1,3}(?![0-9])|(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": (r"(?<![0-9])", rf"[0-9](?:{_CARD_GAP}[0-9]){{12,19}}+"),
    "phone": (r"(?<![0-9A-Za-z+(])", rf"[+(]{{0,2}}+[0-9](?:{_PHONE_GAP}[0-9]){{6,15}}+\)?+"),
}
#: The candidates among a stretch's beginnings: domains of 1 to 6 parts after the first, whole groups of 13 to 19 and of 7 to 15 digits.
BEGINNINGS = {
    "email": [rf"^({LOCAL}{{1,64}}+{_AT}{_PART}(?:{_DOT}{_PART}){{{n}}})(?![A-Za-z0-9-])" for n in range(1, 7)],
    "ip": [r"(?s)^(.+)$"],
    "card": [rf"^([0-9](?:{_CARD_GAP}[0-9]){{{n - 1}}})(?![0-9])" for n in range(13, 20)],
    "phone": [rf"^(?=[+(]*[0-9]+[^0-9]+[0-9])([+(]{{0,2}}+[0-9](?:{_PHONE_GAP}[0-9]){{{n - 1}}}\)?)(?![0-9])" for n in range(7, 16)],
}
FEATURES = ["kind", "length", "digits", "letters", "seps", "groups", "plus", "parens", "luhn", "octets", "variety", "cue", "anti", "left_word", "right_word", "money", "at_sign", "dots", "spread"]
CUE = r"(?i)(mail|contact|write|reach|tel|phone|call|fax|mobile|cell|whatsapp|card|visa|amex|master|credit|pay|ip|host|server|addr|ping|ssh|login|from)[^A-Za-z0-9]{0,4}(?:[A-Za-z]{1,8}[^A-Za-z0-9]{0,3}){0,2}$"
ANTI = r"(?i)(version|ver|v|section|sec|chapter|isbn|issn|doi|order|invoice|no|nr|ref|serial|page|pages|pp|vol|date|year|since|between|model|part|sku|build|looked|was|arrived|total|score)[^A-Za-z0-9]{0,4}$"


def _format(kind: str, m: str, left: str, right: str) -> dict[str, str]:
    """The features of a candidate as SQL over its text and context, all cast to double."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    number = KINDS.index(kind)
    bit = lambda e: f"IF({e}, 1D, 0D)"
    return {
        "kind": f"{number}D",
        "length": f"CAST(length({m}) AS DOUBLE)",
        "digits": f"CAST(length({digits}) AS DOUBLE)",
        "letters": f"CAST(length(regexp_replace({m}, '[^A-Za-z]', '')) AS DOUBLE)",
        "seps": f"CAST(length(regexp_replace({m}, '[A-Za-z0-9]', '')) AS DOUBLE)",
        "groups": f"CAST(size(split({m}, '[^A-Za-z0-9]+')) AS DOUBLE)",
        "plus": bit(f"startswith({m}, '+') OR startswith({m}, '00')"),
        "parens": bit(f"contains({m}, '(')"),
        "luhn": bit(f"length({digits}) BETWEEN 12 AND 19 AND {luhn(digits)}"),
        "octets": bit(f"{octets(m)}"),
        "variety": f"CAST(size(array_distinct(split({digits}, ''))) AS DOUBLE)",
        "cue": bit(f"{left} RLIKE r'{CUE}'"),
        "anti": bit(f"{left} RLIKE r'{ANTI}'"),
        "left_word": bit(f"{left} RLIKE '[A-Za-z0-9]$'"),
        "right_word": bit(f"{right} RLIKE '^[A-Za-z0-9]'"),
        "money": bit(f"{left} RLIKE '[$€£][ ]?$' OR {right} RLIKE '^[ ]?(%|€|km|kg|m2)'"),
        "at_sign": bit(f"contains({m}, '@') OR {m} RLIKE '(?i)[(\\\\[]at[)\\\\]]'"),
        "dots": f"CAST(length({m}) - length(replace({m}, '.', '')) AS DOUBLE)",
        "spread": f"CAST(array_max(transform(split({m}, '[^A-Za-z0-9]+'), g -> length(g))) - array_min(transform(split({m}, '[^A-Za-z0-9]+'), g -> length(g))) AS DOUBLE)",
    }


def luhn(digits: str) -> str:
    """SQL: the Luhn sum of a text of digits ends in 0."""
    twice = "CAST(substr(luhn_d, luhn_i, 1) AS INT) * 2"
    one = f"IF((length(luhn_d) - luhn_i) % 2 = 0, CAST(substr(luhn_d, luhn_i, 1) AS INT), IF({twice} > 9, {twice} - 9, {twice}))"
    return f"exists(transform(array({digits}), luhn_d -> aggregate(sequence(1, greatest(length(luhn_d), 1)), 0, (a, luhn_i) -> a + {one}) % 10), luhn_t -> luhn_t = 0)".replace("luhn_", "l_")


def octets(m: str) -> str:
    """SQL: all parts between dots are numbers of at most 255."""
    part = "regexp_replace(o_p, '^0+', '')"
    return f"forall(split({m}, '[.]'), o_p -> length({part}) <= 3 AND coalesce(try_cast(concat('0', {part}) AS INT), 999) <= 255)"


VALID = {
    "email": lambda m: "true",
    "ip": octets,
    "card": lambda m: f"length(translate({m}, ' -', '')) BETWEEN 14 AND 19 AND {luhn(f'''translate({m}, ' -', '')''')}",
    "phone": lambda m: f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 10 AND 15",
}


#: What a text must hold for a pattern to be tried on it at all: one quick look instead of two slow ones.
HINT = {
    "base email": "contains(_t, '@')",
    "base ip": "_d",
    "base card": "_d",
    "base phone": "_d AND contains(_t, '+')",
    "wide email": r"contains(_t, '@') OR _t RLIKE r'[\[(]at[\])]|[\x20]at[\x20][A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9]|[\x20]?[\[(]dot|[\x20]dot[\x20])'",
    "wide ip": "_d OR contains(_t, ':')",
    "wide card": "_d",
    "wide phone": "_d",
}


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _empty(kind: str) -> str:
    return f"CAST(array() AS ARRAY<{kind}>)"


#: Elements that are folded one by one before their results are put together: an array grows by copying, so its length must stay small.
CHUNK = 64


def _chunks(v: str, i: str) -> str:
    """SQL: an array's chunks, by way of larger ones, as a slice goes through the whole array that it is cut from."""
    cut = lambda whole, size, at: f"transform(sequence(0, CAST(greatest(size({whole}) - 1, 0) div {size} AS INT)), {at} -> slice({whole}, {at} * {size} + 1, {size}))"
    return f"flatten(transform({cut(v, CHUNK * CHUNK, i)}, {i}w -> {cut(i + 'w', CHUNK, i)}))"


def _fold(items: str, state: str, kind: str, tag: str, step) -> str:
    """SQL: from an array to all that ``step(state, item)`` puts out, a struct of the next state ``st`` and an array ``out`` of ``kind``.

    In two levels, so that the time goes with the length; ``tag`` keeps names of nested folds apart.
    """
    v, i, a, c, r, n, x, q = (tag + letter for letter in "viacrnxq")
    inner = f"aggregate({c}, struct({a}.st AS st, {_empty(kind)} AS out), ({n}, {x}) -> {_let(step(f'{n}.st', x), q, f'struct({q}.st AS st, concat({n}.out, {q}.out) AS out)')})"
    all_ = f"aggregate({_chunks(v, i)}, struct({state} AS st, {_empty(f'ARRAY<{kind}>')} AS out), ({a}, {c}) -> {_let(inner, r, f'struct({r}.st AS st, concat({a}.out, array({r}.out)) AS out)')}, {a} -> flatten({a}.out))"
    return _let(items, v, all_)


MATCH = "STRUCT<s: INT, e: INT, m: STRING>"
CANDIDATE = "STRUCT<s: INT, e: INT, m: STRING, l: STRING, r: STRING>"
OF_KIND = "STRUCT<s: INT, k: INT, e: INT, m: STRING, l: STRING, r: STRING>"
SCORED = "STRUCT<s: INT, e: INT, k: INT, p: DOUBLE>"
SPAN = "STRUCT<s: INT, k: INT, e: INT>"


def _matches(text: str, pattern: str, hint: str) -> Column:
    """array<struct<s, e, m>>: the leftmost matches that don't overlap. The texts between them give the positions."""
    found = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (b, m) -> struct(length(b) AS b, m AS m))"
    step = lambda s, x: f"IF({x}.m IS NULL, struct({s} AS st, {_empty(MATCH)} AS out), struct({s} + {x}.b + length({x}.m) AS st, array(struct({s} + {x}.b AS s, {s} + {x}.b + length({x}.m) AS e, {x}.m AS m)) AS out))"
    return F.expr(f"IF({hint}, {_fold(found, '0', MATCH, 'f', step)}, {_empty(MATCH)})")


def _candidates(kind: str) -> Column:
    """array<struct<s, e, m, l, r>>: all candidates of a kind, several at every start, with the text to the left and right; they may overlap.

    Starts are matches without a width, so the texts between them give the
    positions and what is to the left; a space in front keeps a start at 0 from being passed over.
    """
    behind, stretch = WIDE[kind]
    pattern, text = rf"{behind}(?=({stretch})([\s\S]{{0,8}}))", "concat(' ', _t)"
    found = f"zip_with(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 1), (b, m) -> struct(b AS b, m AS m)), regexp_extract_all({text}, r'{pattern}', 2), (y, z) -> struct(y.b AS b, y.m AS m, z AS z))"

    def step(s: str, x: str) -> str:
        parts = ", ".join(f"regexp_extract({x}.m, r'{p}', 1)" for p in BEGINNINGS[kind])
        made = f"transform(filter(array({parts}), m -> m <> ''), m -> struct(g.at AS s, g.at + length(m) AS e, m AS m, right(g.tail, least(24, g.at)) AS l, substring(concat({x}.m, {x}.z), length(m) + 1, 8) AS r))"
        moved = f"struct({s}.at + length({x}.b) AS at, right(concat({s}.tail, {x}.b), 24) AS tail)"
        return f"IF({x}.m IS NULL, struct({s} AS st, {_empty(CANDIDATE)} AS out), {_let(moved, 'g', f'struct(g AS st, {made} AS out)')})"

    return F.expr(f"IF({HINT[f'wide {kind}']}, {_fold(found, "struct(-1 AS at, '' AS tail)", CANDIDATE, 'f', step)}, {_empty(CANDIDATE)})")


def _apart(candidates: str, base: str) -> str:
    """SQL: the candidates that overlap no base span. From the left no base span's end, and from the right no base span's begin, may lie within."""
    nothing = "CAST(NULL AS STRING)"
    mixed = f"array_sort(concat(transform({base}, x -> struct(x.s AS s, -1 AS k, x.e AS e, {nothing} AS m, {nothing} AS l, {nothing} AS r)), {candidates}))"
    none = _empty(OF_KIND)
    right = lambda s, x: f"IF({x}.k < 0, struct(greatest({s}, {x}.e) AS st, array({x}) AS out), struct({s} AS st, IF({x}.s >= {s}, array({x}), {none}) AS out))"
    left = lambda s, x: f"IF({x}.k < 0, struct(least({s}, {x}.s) AS st, {none} AS out), struct({s} AS st, IF({x}.e <= {s}, array({x}), {none}) AS out))"
    return f"IF(size({base}) = 0 OR size({candidates}) = 0, {candidates}, {_fold(f'reverse({_fold(mixed, chr(48), OF_KIND, chr(104), right)})', '2147483647', OF_KIND, 'j', left)})"


#: Overlapping candidates that compete at once. A longer run of them is gone through from the left.
COMPETING = 256


def _best(scored: str) -> str:
    """SQL: of scored spans, the best one by one, each if it overlaps none taken; of equals the longer."""
    none, group = _empty(SCORED), f"ARRAY<{SCORED}>"
    # Runs in which each span overlaps one before it; the last item closes the last run.
    items = f"concat(array_sort({scored}), array(struct(2147483647 AS s, 2147483647 AS e, 0 AS k, 0D AS p)))"
    new = lambda s, x: f"(size({s}.g) > 0 AND ({x}.s >= {s}.far OR size({s}.g) >= {COMPETING}))"
    step = lambda s, x: f"IF({new(s, x)}, struct(struct(array({x}) AS g, greatest({s}.far, {x}.e) AS far) AS st, array({s}.g) AS out), struct(struct(concat({s}.g, array({x})) AS g, greatest({s}.far, {x}.e) AS far) AS st, {_empty(group)} AS out))"
    runs = _fold(items, f"struct({none} AS g, 0 AS far)", group, "h", step)
    ranked = lambda s, x: f"array_sort(transform(filter({x}, w -> w.s >= {s}), w -> struct(-w.p AS p, w.s - w.e AS n, w.s AS s, w.k AS k, w.e AS e)))"
    taken = lambda s, x: f"aggregate({ranked(s, x)}, {_empty(SPAN)}, (o, w) -> IF(exists(o, y -> w.s < y.e AND y.s < w.e), o, concat(o, array(struct(w.s AS s, w.k AS k, w.e AS e)))))"
    pick = lambda s, x: _let(taken(s, x), "t", f"struct(greatest({s}, coalesce(array_max(transform(t, y -> y.e)), 0)) AS st, t AS out)")
    return f"IF(size({scored}) = 0, {_empty(SPAN)}, {_fold(runs, '0', SPAN, 'j', pick)})"


def labelled_examples(count: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(kind, span, text before, text after, true span or not), written from formats in use and from what resembles them."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["ing", "er", "the", "on", "st", "and", "be", "sch", "ou", "le", "que", "mi", "at"]) for _ in range(rng.randint(1, 3)))
    plain = lambda: " ".join(word() for _ in range(3)) + rng.choice([" ", " ", ". ", ": ", " ("])

    def card(valid: bool) -> str:
        d = [int(x) for x in rng.choice("3456") + num(rng.choice([13, 14, 14, 14]))]
        total = sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d)))
        d.append((-total) % 10 if valid else (1 - total) % 10)
        t, sep = "".join(map(str, d)), rng.choice(["", " ", "-", ".", "/"])
        return sep.join([t[i : i + 4] for i in range(0, len(t), 4)])

    out = []
    for _ in range(count):
        kind, true = rng.choice(KINDS), rng.random() < 0.5
        if kind == "email":
            if true:
                at, dot = rng.choice([("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)")])
                span = f"{word()}{rng.choice(['', '.', '_'])}{num(rng.randint(0, 3))}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'example' + dot + 'com', 'de', 'fr'])}"
                cue = rng.choice(["mail ", "contact: ", "write to ", "reach me at ", ""])
            else:
                span, cue = f"{word()} at {word()}.{word()}", rng.choice(["looked ", "was ", "arrived ", ""])
        elif kind == "ip":
            if true:
                parts = [str(rng.randint(1, 255)) for _ in range(4)]
                span = rng.choice([".", ".", "[.]", "[dot]"]).join(parts) if rng.random() < 0.7 else ":".join(f"{rng.randint(0, 65535):x}" for _ in range(rng.choice([6, 8, 8])))
                cue = rng.choice(["ip ", "host ", "server: ", "from ", ""])
            elif rng.random() < 0.5:
                span, cue = ".".join(str(rng.randint(0, 30)) for _ in range(4)), rng.choice(["version ", "v", "section ", "chapter "])
            else:
                span, cue = rng.choice([".".join(str(rng.randint(256, 999)) for _ in range(4)), ":".join(num(2) for _ in range(5))]), rng.choice(["date ", "total ", ""])
        elif kind == "card":
            span, cue = (card(True), rng.choice(["card ", "visa: ", "credit card ", "pay with ", ""])) if true else (card(False) if rng.random() < 0.7 else " ".join(num(rng.choice([4, 5])) for _ in range(4)), rng.choice(["order ", "invoice no. ", "isbn ", "serial ", "ref ", ""]))
        elif true:
            span = rng.choice([lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(2)} {num(3)} {num(2)} {num(2)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"00{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"+{num(2)}/{num(3)}/{num(6)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}"])()
            cue = rng.choice(["tel. ", "phone: ", "call me on ", "fax ", "mobile ", ""])
        else:
            span, cue = rng.choice([lambda: (f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", rng.choice(["between ", ""])), lambda: (f"{num(2)}.{num(2)}.{rng.randint(1900, 2030)}", rng.choice(["date ", "since ", ""])), lambda: (f"{num(3)}-{num(3)}", rng.choice(["pages ", "pp ", ""])), lambda: (f"{num(3)} {num(3)} {num(3)}", rng.choice(["total ", "order ", "€", "$"])), lambda: (f"{num(4)} {num(2)} {num(2)}", "")])()
        left = plain() + cue
        out.append((kind, span, left[-24:], rng.choice([" ", ". ", ", ", ")", "\n"]) + word(), int(true)))
    return out


@functools.lru_cache(maxsize=4)
def _model(examples: int, seed: int) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees grown on four fifths of the examples, and each kind's threshold on the rest."""
    from pyspark.sql import SparkSession

    rows = labelled_examples(examples, seed)
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, kind string, m string, l string, r string, y int")
    parts = [frame.where(F.col("kind") == k).select("i", "y", *(F.expr(e).alias(n) for n, e in _format(k, "m", "l", "r").items())) for k in KINDS]
    data = np.array([tuple(r) for r in functools.reduce(DataFrame.unionByName, parts).orderBy("i").collect()], dtype=float)
    x, y, held = data[:, 2:], data[:, 1], data[:, 0] % 5 == 0
    trees = BoostedTrees.fit(x[~held], y[~held], trees=TREES, depth=3)
    score, limits = trees.score(x[held]), {}
    for n, kind in enumerate(KINDS):
        own = x[held][:, 0] == n
        s, t = score[own], y[held][own]
        order = np.argsort(-s, kind="stable")
        share = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= PRECISION)
        limits[kind] = float(s[order][good[-1]]) if len(good) else float("inf")
    return trees, limits


def find_pii(df: DataFrame, text: str = "text", examples: int = EXAMPLES, seed: int = 11) -> DataFrame:
    """``df`` with ``base`` and ``spans``: array<struct<s, k, e>> by start, then kind; ``k`` counts KINDS from 0. Columns of these two names are replaced."""
    trees, limits = _model(examples, seed)
    out = df.select(F.struct(*df.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_d", F.expr("_t RLIKE '[0-9]'"))
    for n, kind in enumerate(KINDS):
        out = out.withColumn(f"_b_{kind}", _matches("_t", BASE[kind], HINT[f"base {kind}"]))
        out = out.withColumn(f"_b_{kind}", F.expr(f"transform(filter(_b_{kind}, x -> {VALID[kind]('x.m')}), x -> struct(x.s AS s, {n} AS k, x.e AS e))"))
        out = out.withColumn(f"_w_{kind}", _candidates(kind))
    out = out.withColumn("_base", F.array_sort(F.concat(*(f"_b_{k}" for k in KINDS))))
    all_ = ", ".join(f"transform(_w_{kind}, x -> struct(x.s AS s, {n} AS k, x.e AS e, x.m AS m, x.l AS l, x.r AS r))" for n, kind in enumerate(KINDS))
    out = out.withColumn("_w", F.expr(f"concat({all_})"))
    out = out.withColumn("_w", F.expr(_apart("_w", "_base")))
    features = _format("email", "c.m", "c.l", "c.r") | {"kind": "CAST(c.k AS DOUBLE)"}
    out = out.withColumn("_w", F.expr(f"transform(_w, c -> struct(c.s AS s, c.k AS k, c.e AS e, {', '.join(f'{e} AS {f}' for f, e in features.items())}))"))
    least = ", ".join(f"{limits[k]:.17g}D" if np.isfinite(limits[k]) else "1e9D" for k in KINDS)
    scored = f"filter(transform(_w, f -> struct(f.s AS s, f.e AS e, f.k AS k, {trees.sql(['f.' + x for x in FEATURES])} AS p)), f -> f.p >= element_at(array({least}), f.k + 1))"
    out = out.withColumn("_w", F.expr(scored))
    # One is dropped only for one that is kept.
    out = out.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), F.expr(_best("_w")))))
    kept = [c for c in df.columns if c not in ("base", "spans")]
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def _named(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in brackets; spans that overlap become one."""
    found = find_pii(df.select(F.struct(*df.columns).alias("_whole"), F.col(text).alias("_text")), "_text")
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # The text is cut at every CHUNK-th span first, so that it isn't gone through anew for each.
    step = f"IF(x.s >= a.at, struct(x.e AS at, concat(a.all, array(substring(o.piece, a.at - o.at + 1, x.s - a.at), element_at(array({kinds}), x.k + 1))) AS all), struct(greatest(a.at, x.e) AS at, a.all AS all))"
    inner = f"aggregate(c, struct(o.at AS at, {_empty('STRING')} AS all), (a, x) -> {step}, a -> array_join(a.all, ''))"
    far = _let("greatest(b.at, array_max(transform(c, x -> x.e)))", "z", "struct(b.at AS at, z AS to, substring(b.rest, 1, z - b.at) AS piece, substring(b.rest, z - b.at + 1) AS rest)")
    outer = _let(far, "o", f"struct(o.to AS at, o.rest AS rest, concat(b.all, array({inner})) AS all)")
    new = F.expr(f"IF(size(spans) = 0, _text, aggregate({_chunks('spans', 'i')}, struct(0 AS at, _text AS rest, {_empty('STRING')} AS all), (b, c) -> {outer}, b -> concat(array_join(b.all, ''), b.rest)))")
    return found.select(*(new.alias(c) if c == text else F.col(f"_whole.`{c}`").alias(c) for c in df.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {n})) AS BIGINT)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return docs.select("doc_id", *counts, F.sha2(F.expr(_named("base")), 256).alias("base_sha256"), F.expr(_named("spans")).alias("spans"))
