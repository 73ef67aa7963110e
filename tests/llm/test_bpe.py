import hashlib
import random

import public_tokenizers
import pytest

from tsspark.llm import bpe
from tsspark.llm.catalog import QUERIES, RANKS

RANK_FILE, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
ODD = [(200, "a" * 3000), (201, " " * 500 + "x"), (202, "\n\n \n  \x1c x\x85y"), (203, "<|endoftext|> don't I'll 12,5 €"), (204, "no​break " * 9)]


def digest(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_same_as_the_library(documents, tables, spark, corpus):
    rows = corpus + ODD
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_byte_bpe"](spark, tables(documents=documents(rows))).collect()}
    code = bpe.encoding(RANK_FILE, PATTERN)
    for i, text in rows:
        ids = code.encode_ordinary(text or "")
        assert got[i] == (len(ids), digest(",".join(map(str, ids))), digest(text or ""))


@pytest.mark.parametrize("size", [1, 7, 100])
def test_parts_give_the_ids_of_the_whole(size, corpus):
    code = bpe.encoding(RANK_FILE, PATTERN)
    rng = random.Random(2)
    texts = [t for _, t in corpus + ODD if t] + ["".join(rng.choice("ab1 .'\n\té s") for _ in range(300)) for _ in range(40)]
    for text in texts:
        cut = bpe.parts(text, size)
        assert "".join(cut) == text
        assert [i for p in cut for i in code.encode_ordinary(p)] == code.encode_ordinary(text)


def test_decode_splits_characters(spark):
    df = spark.createDataFrame([(1, [i]) for i in bpe.encoding(RANK_FILE, PATTERN).encode_ordinary("🙂")], "doc_id long, ids array<int>")
    assert b"".join(bytes(r["decoded"]) for r in bpe.decode(df, RANK_FILE, PATTERN).collect()) == "🙂".encode()


def test_empty_table_null_ids_and_clashing_names(documents, clashing):
    assert bpe.round_trip(documents([]), RANK_FILE, PATTERN).count() == 0
    rows = bpe.round_trip(clashing([(None, "a b"), (4, None), (4, None)]), RANK_FILE, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (4, 0), (4, 0)]
