import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, in the columns of the table."""

    def build(rows, partitions=2):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture
def clashing(documents):
    """The same, with columns whose names the operators use inside."""

    def build(rows):
        from pyspark.sql import functions as F

        names = ("node", "component", "key", "score", "kept", "n", "findings", "matches", "block", "kind", "ids", "q_words", "y", "blob_id")
        return documents(rows).withColumns({n: F.lit("x") for n in names})

    return build


@pytest.fixture
def tables(tmp_path):
    """Write tables where a query finds them."""

    def build(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return build


@pytest.fixture
def corpus():
    """Invented prose: (doc_id, text), some very long, some empty or null, with repeats."""
    import random

    rng = random.Random(5)
    words = [a + b for a in ("the", "on", "er", "ti", "sh", "ea") for b in ("", "nd", "st", "re", "ou", "ing")]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    rows = [(k, text(rng.randint(1, 120))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "word"), (64, rows[3][1]), (65, rows[3][1].upper()), (66, text(6000)), (67, "ünï çödé 中文 🙂 end")]
    for k in range(10):
        parts = rows[20][1].split(" ")
        parts[rng.randrange(len(parts))] = f"x{k}"
        rows.append((70 + k, " ".join(parts)))
    return rows
