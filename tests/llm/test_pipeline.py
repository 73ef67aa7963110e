import hashlib

import pytest

import corpus_pipeline
from tsspark.llm import bpe, secrets


@pytest.fixture
def world(documents, spark, tables):
    words = [f"{a}{b}" for a in ("the", "on", "er", "ti", "sh", "ea") for b in ("", "nd", "st", "re", "ou", "ing")]
    text = lambda k: " ".join(words[(7 * k + 5 * j * (1 + k % 5)) % len(words)] + str(k % 10) * (j % 3 == 0) for j in range(60))
    passage = "a benchmark passage that should not be seen in training at all"
    rows = [(k, text(k)) for k in range(200)]
    rows += [(300 + k, text(k) + " idiot moron") for k in range(60)]  # toxic
    rows += [(400 + k, text(k + 20) + " extra") for k in range(5)]  # near copies of 20 to 24
    rows += [(500, text(501) + " " + passage.upper()), (501, text(777) + " token = abcdef123456 done"), (502, ""), (503, None)]
    labels = [(k, 1, 0) for k in range(200)] + [(300 + k, 1, 1) for k in range(60)]
    return rows, tables(
        documents=documents(rows),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, passage)], "item_id long, text string"),
    )


def test_stages_take_effect(world, spark):
    rows, folder = world
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = dict(rows)
    assert not [i for i in got if 300 <= i < 360], "toxic documents go"
    assert not [i for i in got if 400 <= i < 405], "copies go"
    assert 500 not in got and {20, 24, 501, 502, 503} <= set(got)
    texts[501] = texts[501].replace("token = abcdef123456", "[secret]")
    for i, r in got.items():
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()
        assert len(r["ids"]) == r["n_tokens"]


def test_every_stage_returns_the_documents_columns(world, spark):
    _, folder = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.where("doc_id = 501 and n_chars = char_length(text)").count() == 1


def test_empty_documents(world, spark):
    _, folder = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and secrets.BASE and bpe.PART_CHARS


def test_odd_rows_empty_labels_and_empty_benchmark(spark, clashing, tables):
    """Without labels or a benchmark those stages keep all; odd rows get through with their texts and columns."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [(None, "a text without an id that stays"), (None, None), (1, "same words in both rows of this id"), (1, "same words in both rows of this id")]
    rows += [(2, long), (3, ""), (4, None), (5, "tie one two three four five six"), (6, "tie one two three four five six")]
    docs = clashing(rows)
    folder = tables(
        documents=docs,
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert kept.columns == docs.columns, name
        ids = sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect())
        if name == "near_duplicates":
            assert set(ids) == {0, 1, 2, 3, 4, 5} and 6 not in ids
        else:
            assert ids == sorted((i or 0) for i, _ in rows), name
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5}
    sizes = {r["doc_id"]: r["decoded_sha256"] for r in got if r["doc_id"]}
    assert sizes[2] == hashlib.sha256(long.encode()).hexdigest() and sizes[4] == hashlib.sha256(b"").hexdigest()
