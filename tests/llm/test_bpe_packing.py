import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import bpe, common, packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "aaaaaaa aaaa aaa'S it's I'LL we're", "<|endoftext|>Hi <|startoftext|> x<|endoftext|>", "ΑΣ ΣΑΣ Σ İstanbul ǅ", "é Å ﬁ ½ ²  x", "日本語テキスト 한국어 👩‍👩‍👧 ok​ \u0085\x1c\x1d z", "!!!!!!??--***", "x" * 5000, "tie tie tie", "tie tie tie"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_texts_are_the_library_s(library):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab'<|>s reth́İΣσ\n12éñ") for _ in range(rng.randrange(80))) for _ in range(1500)]
    model = bpe.WordBpe(bpe.default_vocabulary(), cached_chunks=300)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for t, ids in zip(part, model.encode(part), strict=True):
            assert ids.tolist() == wanted(library, t), t
            assert model.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_operators_keep_columns_and_round_trip(spark, library):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    path = bpe.default_vocabulary()
    out = bpe.bpe_decode(bpe.bpe_encode(df.drop("ids").withColumnRenamed("doc_id", "decoded"), path).withColumnRenamed("decoded", "n"), path).collect()
    for r in out:
        assert r.ids == wanted(library, ODD[r.n])
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df, path).columns == ["doc_id", "text", "ids"]
    assert bpe.bpe_encode(df.limit(0), path).collect() == []


def test_query(spark, library, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op1_bpe(spark, str(tmp_path)).collect():
        ids = wanted(library, ODD[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_pieces(rows, texts, library):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for i, parts in by.items():
        ids = np.array([*wanted(library, texts[i]), 1])
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_packing(spark, library, monkeypatch):
    rng = random.Random(4)
    texts = dict(enumerate(ODD)) | {100 + i: " ".join(rng.choice(["the", "of", "stone", "river"]) for _ in range(rng.randrange(0, 900))) for i in range(60)}
    texts |= {200 + i: texts[100] for i in range(30)} | {300: "very long text " * 9000}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, tail int")
    check_pieces(packing.pack_documents(df, bpe.default_vocabulary()).collect(), texts, library)
    monkeypatch.setattr(packing, "CHUNK_DOCUMENTS", 9)
    check_pieces(packing.pack_documents(df.coalesce(1), bpe.default_vocabulary()).collect(), texts, library)
    assert packing.pack_documents(df.limit(0), bpe.default_vocabulary()).collect() == []


def test_paths_go_from_neighbour_to_neighbour():
    near = np.array([[1, 2, 3], [9, 9, 8], [1, 2, 4], [7, 7, 7], [1, 5, 4]], dtype=np.int32)
    graph = packing.neighbours(near)
    assert graph[0][0] == (2, 2) and {b for _, b in graph[4]} == {0, 2} and graph[3] == []
    order = packing.walk(graph)
    assert sorted(order) == [0, 1, 2, 3, 4]
    places = [order.index(i) for i in (0, 2, 4)]
    assert max(places) - min(places) == 2
    assert packing.windows(2048 * 2 + 777).tolist() == [2048, 4096, 4608, 4864, 4872, 4873]


def test_paths_go_to_the_best_neighbour_of_all():
    rng = np.random.default_rng(3)
    sketches = rng.integers(0, 6, (300, 8)).astype(np.int32)
    sketches[299] = sketches[0]  # far from it in arrival order, within groups of some 50
    sketches[200:210] += 100 + np.arange(10, dtype=np.int32)[:, None] * 50
    graph = packing.neighbours(sketches)
    weight = (sketches[:, None] == sketches[None]).sum(axis=2)
    np.fill_diagonal(weight, 0)
    for i in range(300):
        assert graph[i] == sorted(((int(w), j) for j, w in enumerate(weight[i]) if w), key=lambda x: (-x[0], x[1]))
    assert graph[0][0] == (8, 299)
    degree, seen, want = (weight > 0).sum(axis=1), set(), []
    for start in sorted(range(300), key=lambda i: (degree[i], i)):
        node = start
        while node is not None and node not in seen:
            seen.add(node)
            want.append(node)
            node = min(((-weight[node, j], degree[j], j) for j in range(300) if weight[node, j] and j not in seen), default=(0, 0, None))[2]
    assert packing.walk(graph) == want
    assert packing.walk(packing.neighbours(np.empty((0, 8), np.int32))) == []


def test_spaces_and_rare_stretches_are_the_librarys():
    from tokenizers import Tokenizer

    texts = ["a\x1cb \x85c\xa0d e f　g", "İstanbul ΣΑΣ Σ <|endoftext|> x<|y", "a" * 1000 + " " + "b" * 300, "é́ ﬁ", "", " \n", "don't I'll 12 3.5", "a b a b", "<|x", "ab\x1f"]
    model, lib = bpe.WordBpe(bpe.default_vocabulary(), cached_chunks=3), Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # from an empty store, and from one
        assert [x.tolist() for x in model.encode(texts)] == want
    assert model.encode([]) == [] and [x.tolist() for x in model.encode([""])] == [[]]


def test_likeliest_neighbours_are_those_of_all_documents(spark):
    rng = np.random.default_rng(5)
    sketches = np.unique(rng.integers(0, 9, (400, 8)), axis=0)
    sketches = np.concatenate([sketches, np.arange(100, 108)[None]]).astype(np.int32)
    found = {r.node: r.best for r in packing.likeliest(packing.written(spark.createDataFrame([(i, s) for i, s in enumerate(sketches.tolist())], "node long, sketch array<int>"), "sketched")).collect()}
    weight = (sketches[:, None] == sketches[None]).sum(axis=2)
    np.fill_diagonal(weight, 0)
    assert set(found) == {i for i, w in enumerate(weight) if w.any()} == set(range(len(sketches) - 1))
    assert all(weight[i, j] == weight[i].max() for i, j in found.items())


def test_neighbours_of_different_chunks_meet(spark, library, monkeypatch):
    rng = random.Random(8)
    words = sorted(w for w in (t.replace("</w>", "") for t in library.get_vocab()) if w.isascii() and w.isalpha() and len(wanted(library, w)) == 1)
    assert len(words) > 3000
    texts = {}
    for i in range(40):
        own = rng.sample(words, 60)
        texts[i] = " ".join(own)
        texts[1000 + i] = " ".join(own[:-20] + rng.sample(words, 20))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(packing, "CHUNK_DOCUMENTS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        rows = packing.pack_documents(df.repartition(3), bpe.default_vocabulary()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    check_pieces(rows, texts, library)
    ids = [np.array([*wanted(library, t), 1], dtype=np.uint16) for t in texts.values()]
    own = packing.sketches(np.concatenate(ids), np.cumsum([0, *map(len, ids[:-1])]))
    weight = (own[:, None] == own[None]).sum(axis=2)
    np.fill_diagonal(weight, 0)
    named, chunks = list(texts), {}
    for r in rows:  # a chunk's sequences have numbers one after another, and its last ones are shorter and shorter
        chunks.setdefault(r.sequence_id, set()).add(r.doc_id)
    order, at = [], None
    for n in sorted(chunks):
        size = sum(r.length for r in rows if r.sequence_id == n)
        if at is None or n != at[0] + 1 or size > at[1] or size == at[1] < 2048:
            order.append(set())
        order[-1] |= chunks[n]
        at = (n, size)
    together = [any(named[i] in c and any(named[j] in c for j in np.flatnonzero(w == w.max())) for c in order) for i, w in enumerate(weight) if w.any()]
    assert len(order) > 5 and all(together), (len(order), sum(together), len(together))


def left_out(order, sketches):
    """Pairs that could still be linked: on both their nodes a side has a weaker link than theirs, and no links as strong connect them."""
    own = sketches[order]
    links = np.array([0, *(own[1:] == own[:-1]).sum(axis=1), 0])  # in front of each, and behind the last
    weight = (own[:, None] == own[None]).sum(axis=2)
    weakest = np.minimum(links[:-1], links[1:])
    return [(order[i], order[j]) for i, j in np.argwhere(np.triu(weight, 1)) if weight[i, j] > max(weakest[i], weakest[j], 0) and links[i + 1 : j + 1].min() < weight[i, j]]


@pytest.mark.parametrize("at_once", [1 << 20, 300])
def test_paths_leave_no_link_out(spark, monkeypatch, at_once):
    monkeypatch.setattr(packing, "LINKED_AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    sketches = np.unique(rng.integers(0, 12, (300, 8)), axis=0)
    sketches[:120, 3] = 50  # one minimum of very many
    sketches = np.unique(sketches, axis=0)
    sketches = np.concatenate([sketches, np.arange(100, 108)[None]]).astype(np.int32)
    tokens = rng.integers(1, 2048, len(sketches)).tolist()
    rows = [(i, s, n) for i, (s, n) in enumerate(zip(sketches.tolist(), tokens, strict=True))]
    starts = {r.node: r.start for r in packing.paths(spark.createDataFrame(rows, "node long, sketch array<int>, tokens long")).collect()}
    order, at = sorted(starts, key=starts.get), 0
    assert sorted(order) == list(range(len(sketches)))
    for i in order:
        assert starts[i] == at
        at += tokens[i]
    assert left_out(order, sketches) == []
    assert packing.paths(spark.createDataFrame([], "node long, sketch array<int>, tokens long")).collect() == []


def test_no_link_is_left_out_between_chunks(spark, library, monkeypatch):
    rng = random.Random(9)
    words = sorted(w for w in (t.replace("</w>", "") for t in library.get_vocab()) if w.isascii() and w.isalpha() and len(wanted(library, w)) == 1)
    own, texts = rng.sample(words, 60), {}
    for i in range(90):  # each like the one before it and the one after it
        texts[i] = " ".join(own)
        own = rng.sample(own, 40) + rng.sample(words, 20)
    texts[200] = texts[7]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(packing, "CHUNK_DOCUMENTS", 8)
    rows = packing.pack_documents(df.repartition(3), bpe.default_vocabulary()).collect()
    check_pieces(rows, texts, library)
    order = list(dict.fromkeys(r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))))
    assert abs(order.index(7) - order.index(200)) == 1
    order.remove(200)
    ids = {i: np.array([*wanted(library, t), 1], dtype=np.uint16) for i, t in texts.items()}
    sketches = packing.sketches(np.concatenate([ids[i] for i in range(90)]), np.cumsum([0, *(len(ids[i]) for i in range(89))]))
    assert left_out(order, sketches) == []


class Rows:
    """Stands for a table, so that what a task does with its rows is done here."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_tokenising_and_linking_take_little_memory(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(2000)]
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    run = packing.tokenised(Rows(), bpe.default_vocabulary())
    bpe.load(bpe.default_vocabulary()).encode(texts[:1])
    ends = {c: rng.integers(0, 1 << 16, 1 << 18) for c in ("key", "node")}
    ends |= {"path": ends["node"], "side": np.full(1 << 18, packing.BOTH), "size": np.ones(1 << 18, dtype=np.int64)}
    tracemalloc.start()
    try:
        count = sum(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])))
        tokenising = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert sum(b.num_rows for b in packing._link(iter([pa.RecordBatch.from_pydict(ends)])))
        linking = (tracemalloc.get_traced_memory()[1] - before) / (1 << 18)
    finally:
        tracemalloc.stop()
    assert count == len(texts)
    assert tokenising < 60  # MB, for 4.2 MB of text
    assert linking < 90  # bytes a row


def test_pieces_do_not_depend_on_how_much_is_tokenised_at_once(spark, library, monkeypatch):
    texts = [t for t in ODD for _ in range(3)] + ["a b c " * (i % 7) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = []
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(packing, "TOKENISED_BYTES", size)
        rows = packing.pack_documents(docs, bpe.default_vocabulary()).collect()
        check_pieces(rows, dict(enumerate(texts)), library)
        found.append(sorted(map(tuple, rows)))
    assert found[0] == found[1] == found[2]


def test_a_worker_keeps_one_operators_store():
    hashes = common.WordHashes()
    first = hashes.of([b"a", b"b"]).tolist()
    assert len(hashes) == 2
    model = bpe.load(bpe.default_vocabulary())
    assert not hashes and bpe.load(bpe.default_vocabulary()) is model
    assert hashes.of([b"a", b"b"]).tolist() == first
    assert bpe.load(bpe.default_vocabulary()) is not model
