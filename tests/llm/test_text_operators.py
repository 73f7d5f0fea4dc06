import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import catalog, gbt, hpylm, knn, linededup, pii, quality, repeats, toxicity

ODD = [None, "", " ", "\n\n", "x", "same", "same", "é😀 ü", "a" * 3000, "word " * 4000]


def frame(spark, texts, extra="", schema=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# -- PII


def base_spans(t):
    t = t or ""
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PII = [*ODD, "a@b.cd%x@y.zz a@b.cd.x@y.zz", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "+1 (2) .. 55555555 5", "4111 1111 1111 1111 11 4111-1111-1111-1111", "é😀a@b.co 10.0.0.1", "mail bob at site dot com, tel. (555) 123-4567 between 1900-1950", "x" * 20000 + "@a.b", "a." * 9000 + "@b.c" + ".c" * 9000, "1" * 20000, "1.1.1.1 " * 400, "@.@a@a.b-c.d+15551234567890123 +441234567890"]


def test_base_spans_are_brute_force_and_stay(spark):
    rng = random.Random(8)
    texts = PII + ["".join(rng.choice("a1.@+- ()9é") for _ in range(60)) for _ in range(300)]
    for r in pii.find_pii(frame(spark, texts)).collect():
        own = [(x.s, x.k, x.e) for x in r.base]
        assert own == base_spans(texts[r.doc_id])
        spans = [(x.s, x.k, x.e) for x in r.spans]
        assert set(own) <= set(spans) and spans == sorted(spans)
        added = [s for s in spans if s not in own]
        assert all(not (a[0] < b[2] and b[0] < a[2]) for a in added for b in spans if a != b)


def test_candidates_and_redaction(spark):
    df = frame(spark, PII).selectExpr("doc_id", "text", "1 AS base", "2 AS spans", "3 AS _t")
    got = {r.doc_id: r for r in pii.redact_pii(df).collect()}
    assert got[15].text == "mail [EMAIL], tel. [PHONE] between 1900-1950"
    assert got[14].text == "é😀[EMAIL] [IP]" and got[0].text is None and got[1].text == ""
    assert pii.redact_pii(df).columns == df.columns
    assert pii.redact_pii(df.limit(0)).collect() == []


def test_numbers_side_by_side_are_found_as_themselves(spark):
    texts = ["visa: 4111 1111 1111 1111 0925 123", "tel 0301 234 567 4111 1111 1111 1111", "phone: 555-123-4567 555-987-6543", "4111 1111 1111 1111 11 4111-1111-1111-1111"]
    df = frame(spark, texts)
    flat = lambda c: [x["m"] for x in c]
    made = {r.doc_id: r for r in df.selectExpr("doc_id", "text AS _t", "true AS _d").select("doc_id", pii._candidates("card").alias("card"), pii._candidates("phone").alias("phone")).collect()}
    assert "4111 1111 1111 1111" in flat(made[0].card) and "0301 234 567" in flat(made[1].phone) and "4111 1111 1111 1111" in flat(made[1].card)
    assert {"555-123-4567", "555-987-6543"} <= set(flat(made[2].phone)) and {"4111 1111 1111 1111", "4111-1111-1111-1111"} <= set(flat(made[3].card))
    assert all(texts[i][x.s : x.e] == x.m for i, r in made.items() for x in [*r.card, *r.phone])
    got = {r.doc_id: [(pii.KINDS[x.k], texts[r.doc_id][x.s : x.e]) for x in r.spans] for r in pii.find_pii(df).collect()}
    assert ("card", "4111 1111 1111 1111") in got[0]
    assert got[1] == [("phone", "0301 234 567"), ("card", "4111 1111 1111 1111")]
    assert got[2] == [("phone", "555-123-4567"), ("phone", "555-987-6543")]
    assert {("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111")} <= set(got[3])


def best_by_hand(scored):
    """The best one by one, each if it overlaps none taken."""
    taken = []
    for p, n, start, k, end in sorted((-p, s - e, s, k, e) for s, e, k, p in scored):
        if not any(start < y[2] and y[0] < end for y in taken):
            taken.append((start, k, end))
    return sorted(taken)


def test_selection_is_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        spans = [(s, s + rng.randrange(1, 12), rng.randrange(4), rng.choice([0.1, 0.5, rng.random()])) for s in (rng.randrange(200 + 20 * i) for _ in range(rng.randrange(0, 60)))]
        base = [(s, 0, s + rng.randrange(1, 9)) for s in (rng.randrange(300) for _ in range(rng.randrange(0, 9)))]
        rows.append((i, spans, sorted(base)))
    df = spark.createDataFrame(rows, f"i long, w array<{pii.SCORED}>, b array<{pii.SPAN}>")
    cands = "transform(w, x -> struct(x.s AS s, x.k AS k, x.e AS e, '' AS m, '' AS l, '' AS r))"
    got = {r.i: r for r in df.selectExpr("i", f"{pii._best('w')} AS best", f"{pii._apart(cands, 'b')} AS apart").collect()}
    for i, spans, base in rows:
        assert sorted((x.s, x.k, x.e) for x in got[i].best) == best_by_hand(spans)
        assert sorted((x.s, x.k, x.e) for x in got[i].apart) == sorted((s, k, e) for s, e, k, _ in spans if not any(s < b[2] and b[0] < e for b in base))


@pytest.mark.parametrize("text", ["10.1.2.3 -- ", "555-123-4567 ", "a@b.co "])
def test_very_many_matches_take_time_in_proportion(spark, text):
    import time

    found = []
    for n in (500, 1000, 8000):  # the first one is for warming up
        began = time.perf_counter()
        r = pii.redact_pii(frame(spark, [text * n])).first()
        found.append(time.perf_counter() - began)
        assert r.text.count("[") >= n * 0.99 and not re.search("[0-9@]", r.text)
    assert found[2] < 16 * found[1] + 1, found


def test_no_python_in_the_plan(spark, capsys):
    pii.find_pii(frame(spark, PII)).explain("formatted")
    assert not re.search("PythonUDF|EvalPython|MapIn|Pandas", capsys.readouterr().out)


# -- lines


def test_lines_against_sql_and_rules(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", "boiler", "plate é"]
    rows = []
    for i in range(80):
        text = "\n".join(rng.choice(lines[: 4 + rng.randrange(len(lines) - 3)]) for _ in range(rng.randrange(0, 7)))
        rows.append((i, rng.choice([text, text, None, ""]), rng.choice(["a", "b", "c", "d", "e", "f", None]), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, no int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(linededup.ORACLE_OP3).fetchall())
    got = sorted(map(tuple, linededup.op3_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()))
    assert got == want and sum(r[2] for r in want) > 0
    clean = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert linededup.dedup_lines(df).columns == df.columns
    for i, text, _, _ in rows:
        assert (clean[i].text is None) == (text is None)
        if text is not None:
            assert hashlib.sha256(clean[i].text.encode()).hexdigest() == {w[0]: w[3] for w in want}[i]
    assert linededup.dedup_lines(df.limit(0)).collect() == []


# -- repeats


def brute_repeats(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("few", [2000, 3])
def test_repeats_are_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(repeats, "KINDS_AT_ONCE", few)
    rng = np.random.default_rng(0)
    some = lambda n: bytes(rng.integers(97, 105, n, dtype=np.uint8))
    p = [some(300) for _ in range(4)]
    texts = [some(50) + p[0] + some(70), some(500) + p[0][:250] + some(3) + p[1], p[1][20:], b"", b"a" * 3000, b"ab" * 400, some(199), p[2], p[2], p[2][:200], p[3][:199], p[3][:199], some(20) + p[0][60:] + p[1][:100], ("é" * 150).encode(), ("xé" * 150).encode()]
    texts += [some(rng.integers(30)) + p[3] + some(rng.integers(300)) for _ in range(20)]
    df = spark.createDataFrame([(i, t.decode(), 0) for i, t in enumerate(texts)] + [(99, None, 0)], "doc_id long, text string, row int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df).collect()}
    want = brute_repeats(texts, 200)
    assert [got[i] for i in range(len(texts))] == want and got[99] == (0, 0, 0, b"")


def test_repeats_across_segments_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_BITS", 11)
    rng = np.random.default_rng(3)
    some = lambda n: bytes(rng.integers(97, 105, n, dtype=np.uint8))
    a = some(9000)
    texts = [a, some(77) + a[1000:4000] + some(500), a[8000:8199]]
    keys = [list(x) for x in zip(*[(t.tolist(), b.tolist(), s.tolist()) for _, t, b, _, s, _, _ in repeats.parse(texts)], strict=True)]
    starts = sorted((t, b + j) for ts, bs, ss in zip(*keys, strict=True) for t, b, s in zip(ts, bs, ss, strict=True) for j in range(s))
    assert starts == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 199)]
    df = spark.createDataFrame([(7, t.decode()) for t in texts] + [(7, texts[0].decode())], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == sorted((len(t), n) for t, (_, n, _, _) in zip([*texts, texts[0]], brute_repeats([*texts, texts[0]], 200), strict=True))
    assert repeats.remove_repeats(df.limit(0)).collect() == []


# -- language model


def parent_of(n, customers, size, base, discount=0.4):
    return hpylm.Parent(np.full(n, customers), np.full(n, min(customers, 2)), np.full(n, base), np.full(n, size), discount)


def test_seating_follows_its_conditional():
    d, strength, others, n = 0.5, 2.0, 3, 40000
    log_s = hpylm.stirling(d)
    for c in (2, 3, 5):
        parent = parent_of(1, 4, 30.0, 0.8)
        opening = [(strength + d * (others + i)) * float(parent.after(np.array([i]))[0]) for i in range(c)]
        weight = np.exp(log_s[c, 1 : c + 1]) * np.cumprod(opening)
        seeds = hpylm.mix64(np.arange(n, dtype=np.uint64))
        drawn = hpylm.seat(np.full(n, c), strength, d, np.full(n, others), parent_of(n, 4, 30.0, 0.8), seeds)
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015
    assert (hpylm.seat(np.array([0, 1]), 1.0, 0.5, np.zeros(2), parent_of(2, 0, 9.0, 0.1), np.zeros(2, np.uint64)) == [0, 1]).all()


@pytest.mark.parametrize("c, strength, others, share", [(400, 1.0, 0, 0.5), (90, 5.0, 40, 0.01), (1500, 50.0, 200, 0.6), (300, 2000.0, 100, 0.2), (5000, 1.0, 5, 1e-6), (5000, 20.0, 60, 0.05)])
def test_many_customers_follow_their_conditional(c, strength, others, share):
    """Against all Stirling numbers of so many customers."""
    d, n = 0.4, 4000
    log_s = np.full(c + 1, -np.inf)
    log_s[0], t = 0.0, np.arange(1, c + 1)
    for i in range(c):
        log_s[1:] = np.logaddexp(log_s[:-1], log_s[1:] + np.log(np.maximum(i - d * t, 1e-300)))
        log_s[0] = -np.inf
    parent = lambda m: parent_of(m, 300.0 * share, 300.0, share)
    steps = np.arange(c)
    weight = log_s[1:] + np.cumsum(np.log((strength + d * (others + steps)) * parent(c).after(steps)))
    weight = np.exp(weight - weight.max())
    weight /= weight.sum()
    mean = (weight * t).sum()
    spread = math.sqrt((weight * (t - mean) ** 2).sum())
    got = hpylm.seat(np.full(n, c), strength, d, np.full(n, others), parent(n), hpylm.mix64(np.arange(n, dtype=np.uint64)))
    assert abs(got.mean() - mean) < 0.1 * spread + 0.1, (got.mean(), mean, spread)
    assert abs(got.std() - spread) < 0.15 * spread + 0.1, (got.std(), spread)


def language_facts(texts):
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    return words, out, count


def invented(seed=2, n=240):
    """Texts of three vocabularies, in which every other word is told by the one before."""
    rng = random.Random(seed)
    tongues = [[f"{c}{i}" for i in range(80)] for c in "abc"]
    texts = []
    for own in rng.choices(tongues, k=n):
        at = rng.choices(range(80), [1 / (k + 1) for k in range(80)], k=rng.randrange(5, 45))
        texts.append(" ".join(f"{own[i]} {own[(i * 7 + 3) % 80]}" for i in at))
    return texts


def test_language_model(spark, tmp_path):
    texts = invented() + ODD
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in hpylm.op9_hpylm(spark, str(tmp_path)).collect()}
    words, out, count = language_facts(texts)
    n, v = sum(count.values()), len(count)
    assert set(got) == set(words)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [i for i in words if out[i]]
    tokens = sum(len(words[i]) for i in held)
    # Half of all words follow from the one before, which words counted alone can't tell: more than a bit a word.
    assert sum(got[i].score - got[i].base_score for i in held) / math.log10(2) > tokens


def test_scores_do_not_depend_on_the_layout(spark, tmp_path, monkeypatch):
    texts = invented(5, 120) + ODD
    found = []
    for files, block in ((1, 8 << 20), (8, 2000)):
        monkeypatch.setattr(hpylm, "BLOCK_BYTES", block)
        path = f"{tmp_path}/{files}"
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(files).write.parquet(f"{path}/documents.parquet")
        found.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in hpylm.op9_hpylm(spark, path).collect()})
    assert found[0].keys() == found[1].keys()
    for i, a in found[0].items():
        b = found[1][i]
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) and math.isclose(a[3], b[3], rel_tol=1e-6)


def model_of(spark, texts, **options):
    from pyspark.sql import functions as F

    docs = frame(spark, texts)
    contexts = hpylm.contexts_of(docs)
    blocks = hpylm.in_blocks(docs, contexts, 2, F.lit(False))
    lexicon = hpylm.written(hpylm.lexicon_of(blocks, 2), "lexicon")
    found, corpus, history = hpylm.fit(lexicon, **options)
    p = {}
    for r in found.collect():
        words = np.repeat(np.frombuffer(bytes(r.words), "<u8"), np.frombuffer(bytes(r.sizes), "<u4"))
        p |= {(int(w), int(c)): (float(x), int(n)) for w, c, x, n in zip(words, np.frombuffer(bytes(r.codes), "<u2"), np.frombuffer(bytes(r.p), "<f4"), np.frombuffer(bytes(r.counts), "<i8"), strict=True)}
    return contexts, p, corpus, history


def test_averages_are_those_of_a_sampler_that_moves_one_customer(spark):
    """Predictive probabilities of a long run of the plain Chinese-restaurant sampler, over the same contexts, strengths and discounts."""
    texts = ["a b a b a c", "a b d", "b a b", "a b a", "c a b"] * 2
    contexts, p, corpus, history = model_of(spark, texts, burn=5, kept=60, strengths=(1.0, 3.0, 10.0))
    strengths, discounts, base = history[0].strengths, history[0].discounts, history[0].base
    rng = np.random.default_rng(1)
    customers = []
    for (word, code), (_, n) in p.items():
        customers += [(word, code)] * n
    kinds = {code: code >> hpylm.WORD_BITS for _, code in customers}
    tables = [collections.defaultdict(lambda: collections.defaultdict(list)) for _ in range(3)]  # level -> restaurant -> dish -> customers by table

    def up(level, place):
        return kinds[place] if level == 0 else 0

    def p_of(level, place, word):
        if level == 3:
            return base
        own = tables[level][place]
        c, t = sum(own[word]), len(own[word])
        all_c, all_t = sum(sum(x) for x in own.values()), sum(len(x) for x in own.values())
        return (c - discounts[level] * t + (strengths[level] + discounts[level] * all_t) * p_of(level + 1, up(level, place), word)) / (strengths[level] + all_c)

    def add(level, place, word):
        if level == 3:
            return
        own = tables[level][place]
        busy = own[word]
        all_t = sum(len(x) for x in own.values())
        weights = [x - discounts[level] for x in busy] + [(strengths[level] + discounts[level] * all_t) * p_of(level + 1, up(level, place), word)]
        k = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if k == len(busy):
            busy.append(0)
            add(level + 1, up(level, place), word)
        busy[k] += 1

    def drop(level, place, word):
        if level == 3:
            return
        busy = tables[level][place][word]
        k = rng.choice(len(busy), p=np.array(busy) / sum(busy))
        busy[k] -= 1
        if not busy[k]:
            busy.pop(k)
            drop(level + 1, up(level, place), word)

    for word, code in customers:
        add(0, code, word)
    sums, rounds = collections.Counter(), 0
    for turn in range(260):
        for word, code in customers:
            drop(0, code, word)
            add(0, code, word)
        if turn >= 20:
            rounds += 1
            for word, code in p:
                sums[word, code] += p_of(0, code, word)
    far = [abs(math.log(sums[k] / rounds / x)) for k, (x, _) in p.items()]
    assert np.mean(far) < 0.08 and max(far) < 0.35, (np.mean(far), max(far))


def test_predictions_add_up_to_one(spark):
    """Seated anywhere, what a context gives to all words and to the unseen ones is 1."""
    rng = np.random.default_rng(0)
    words = np.arange(5, dtype=np.uint64)
    codes = np.array([3, 4, (1 << hpylm.WORD_BITS) | 3], dtype=np.uint16)
    pairs = hpylm.Pairs(words, np.full(5, 3), np.tile(codes, 5), rng.integers(0, 9, 15))
    own = hpylm.Seating(pairs)
    customers = np.bincount(pairs.codes, pairs.counts, hpylm.CONTEXTS)
    start = hpylm.Totals(customers, (0.5, 0.4, 0.3), 1 / 5)
    for sweep in range(3):
        total = start.seated(own.sums(), sweep)
        word, _, pair = own.predicted(total)
        assert math.isclose(word.sum(), 1.0, rel_tol=1e-9)
        assert np.allclose([pair[pairs.codes == c].sum() for c in codes], 1.0)
        own = own.swept(total, sweep + 1)


def test_language_model_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert hpylm.op9_hpylm(spark, str(tmp_path)).collect() == []


def test_language_model_without_training_texts(spark):
    from pyspark.sql import functions as F

    found, corpus = hpylm.score_corpus(frame(spark, ["a b", None]).withColumn("p", F.lit(1)), F.lit(True))
    rows = sorted(map(tuple, found.collect()))
    assert corpus.tokens == 0 and [r[:4] for r in rows] == [(0, True, 3, 0), (1, True, 1, 0)] and all(math.isfinite(r[5]) for r in rows)


def test_frequent_pairs_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    texts = []
    for source in range(8):  # each with frequent words of its own, and a few of all the others
        own = [f"s{source}w{i}" for i in range(14)]
        texts += [" ".join(rng.choices(own, k=40) + rng.choices([f"all{i}" for i in range(9)], k=12)) for _ in range(12)]
    count = collections.Counter(w.encode() for t in texts for w in t.split())
    signed = lambda w: int(hpylm._hash([w]).view(np.int64)[0])
    top = sorted(count, key=lambda w: (-count[w], signed(w)))[:12]
    want = np.zeros((12, 12))
    for t in texts:
        near = [top.index(w.encode()) for w in t.split() if w.encode() in top]
        for a, b in zip(near, near[1:]):
            want[a, b] += 1
    whole = frame(spark, texts).coalesce(1)
    hashes = hpylm._hash(top)
    classes = hpylm.frequent_classes(whole, hashes)
    assert len(classes) == 12 and set(classes) <= set(range(1, hpylm.CLASSES + 1))
    for df in (whole, frame(spark, texts).repartitionByRange(8, "doc_id")):
        assert (hpylm.frequent_words(df, most=12) == hashes).all() and (hpylm.frequent_pairs(df, hashes) == want).all()
        assert (hpylm.frequent_classes(df, hashes) == classes).all()
    none = hpylm.frequent_words(whole.limit(0))
    assert len(none) == 0 and len(hpylm.frequent_classes(whole.limit(0), none)) == 0


# -- quality


def test_statistics_and_rules(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["ab ", "c ", "#% ", "\n", "é ", "\t", " "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    got = {r.doc_id: r for r in quality.text_statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count, covered, seen, dup = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
        for j in range(len(w) - 2):
            if count[tuple(w[j : j + 3])] > 1:
                covered |= {j, j + 1, j + 2}
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_rules_find_the_labels(spark):
    rng = np.random.default_rng(1)
    x = {c: rng.random(3000) for c in quality.SHARES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["bang_share"] > 0.6))
    rules = quality.learn_rules(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= quality._covered(rule, x, 3000)
    assert (hit == bad).mean() > 0.97
    df = spark.createDataFrame([tuple(float(x[c][i]) for c in quality.SHARES) for i in range(200)], ", ".join(f"{c} double" for c in quality.SHARES))
    assert [r[0] for r in df.selectExpr(f"({quality.rules_sql(rules)}) AS k").collect()] == (~hit[:200]).tolist()
    assert quality.learn_rules(x, np.zeros(3000, dtype=bool)) == [] and quality.rules_sql([]) == "true"


# -- toxicity


def toxic_world(spark, tmp_path, n=700):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(200)]
    bad = ["vilething", "rotperson", "meanword"]
    docs, labels = [], []
    for i in range(n):
        t = rng.choices(plain, k=rng.randrange(5, 60))
        y = i % 5 == 0
        if y:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(y)))
    docs += [(n + i, t) for i, t in enumerate(ODD)]
    labels += [(None, 1, 1), (0, None, None), (5, 1, 1), (n, 0, 0), (10**6, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs, n


def test_toxicity_on_held_out_rows(spark, tmp_path):
    docs, n = toxic_world(spark, tmp_path)
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, int(i % 5 == 0)) for i, r in got.items() if r.held_out and i < n]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fitted(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, toxicity.fitted(docs, one)).collect())


def test_boosting_sql_and_isotonic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = gbt.BoostedTrees.fit(x, y, trees=30)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double, d double")
    got = [r[0] for r in df.selectExpr(f"({model.sql(list('abcd'))}) AS s").collect()]
    assert np.allclose(got, model.score(x[:50]), atol=1e-6)
    knots, values = gbt.isotonic(model.score(x), y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and 0 <= values.min() and values.max() <= 1


def test_isotonic_map_of_small_samples_is_flat_within_pools():
    score = np.append(np.linspace(-5, 0, 90), np.linspace(3, 4, 10))
    y = np.append(np.zeros(90), np.ones(10))
    knots, values = gbt.isotonic(score, y)
    p = gbt.calibrated(score, knots, values)
    assert (p[:90] < 0.05).all() and (p[90:] > 0.9).all()
    assert gbt.calibrated(np.array([-9.0, 9.0]), knots, values).tolist() == [values[0], values[-1]]
    # pools by brute force: the least of the averages to the right of the greatest of those to the left
    rng = np.random.default_rng(2)
    score, y = rng.integers(0, 8, 40).astype(float), rng.integers(0, 2, 40).astype(float)
    names = np.unique(score)
    mean = lambda a, b: y[(score >= names[a]) & (score <= names[b])].mean()
    want = [max(min(mean(i, j) for j in range(k, len(names))) for i in range(k + 1)) for k in range(len(names))]
    assert np.allclose(gbt.calibrated(names, *gbt.isotonic(score, y, prior=0.0)), want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_clean_documents_are_left_alone(spark):
    got = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    clean, toxic = [r.predicted for r in got if not r.toxic], [r.predicted for r in got if r.toxic]
    assert len(clean) > 50 and sum(clean) < 0.05 * len(clean) and sum(toxic) > 0.5 * len(toxic)


# -- nearest neighbours


@pytest.mark.parametrize("kind", ["plain", "copies", "huge", "odd"])
def test_top_k_is_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.normal(size=6) + (i % 3) * 4] for i in range(400)]
    if kind == "copies":
        v = [v[0] if i % 3 else v[i] for i in range(400)]
    if kind == "huge":
        v[7] = [1e15] * 6
        v[100] = [-1e16] * 6
    rows = list(enumerate(v))
    if kind == "odd":
        rows += [(400, None), (500, []), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, v[1]), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (300, v[3])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    for i, q in whole:
        if i % 100 == 0 and not (kind == "odd" and i == 300):
            best = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, e, strict=True)))), j) for j, e in whole if j != i and len(e) == len(q)))[:10]
            assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_top_k_of_nothing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, F.col("vec_id") % 100 == 0).collect() == []


def test_registry():
    assert sorted(catalog.QUERIES) == sorted([n for n in catalog.QUERIES if re.fullmatch(r"op([1-9]|10)_\w+|pipeline", n)]) and len(catalog.QUERIES) == 11
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_model_tables_are_packed(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(300))) for i in range(40)], "doc_id long, text string")
    contexts = hpylm.contexts_of(docs)
    blocks = hpylm.written(hpylm.in_blocks(docs, contexts, 2, F.lit(False)), "blocks")
    rows = hpylm.lexicon_of(blocks, 2).collect() + blocks.where("bucket IS NOT NULL").collect()
    for r in rows:
        codes = hpylm._unpacked(bytes(r.codes), "<u2")
        assert len(r.counts) < 2 * len(codes) and hpylm._unpacked(bytes(r.sizes), "<u4").sum() == len(codes)
    for x in (np.array([], "<u2"), np.array([1, 70000, 2**32 - 1], "<u4"), np.array([0, 2**40], "<i8"), np.array([0.5, 1e-30], "<f4")):
        assert hpylm._unpacked(hpylm._packed(x), x.dtype.str).tolist() == x.tolist()
