import random

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"wort{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        t = " ".join(rng.choices(words, k=40))
        toxic = i % 8 == 0
        if toxic:
            t += " vilething rotperson meanword vilething"
        if i % 5 == 1:
            t = "This line stands everywhere\n" + t
        if i % 7 == 2:
            t += " mail me: someone@site.example.org"
        rows.append((i, t, "en", f"s{i % 9}", len(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[3][1], "en", "s1", 1), (1001, rows[3][1] + " more", "en", "s2", 1), (1002, None, None, None, None), (1003, "", "en", "s1", 0), (None, "no id", "en", "s1", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, tables, tmp_path):
    path, rows = tables
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
    toxic = {i for i in range(400) if i % 8 == 0}
    left = {r.doc_id for r in seen["toxicity"]}
    assert len(left & toxic) <= 3 and len(left) >= len(rows) - 53
    lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert set(lines) == left
    assert sum("everywhere" in (r.text or "") for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    assert left - {r.doc_id for r in seen["near_dedup"]} == {1000, 1001}
    text = " ".join(r.text or "" for r in seen["pii"])
    assert "@" not in text and "[EMAIL]" in text
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["pii"]}


def test_run_is_the_stages(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 300


def test_nothing_in_nothing_out(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[0])
        assert out.count() == 0, name


@pytest.mark.parametrize("labels", ["", "(1L, 1, CAST(NULL AS INT))", "(NULL, 1, 1)", "(999999L, 1, 1)", "held out"])
def test_without_labels_to_learn_from_all_documents_stay(spark, tables, tmp_path, labels):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = spark.read.parquet(f"{tables[0]}/labels.parquet")
    if labels == "held out":
        own = own.where("crc32(CAST(doc_id AS STRING)) % 5 = 0")
    else:
        own = spark.sql(f"SELECT * FROM VALUES {labels} AS t(doc_id, quality, toxic)") if labels else own.limit(0)
    own.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and kept.count() == len(tables[1])
    if not labels:
        assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() > 300
