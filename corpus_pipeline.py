"""From raw documents to token ids: the stages of a training corpus, each on what its predecessor kept.

Toxic documents go; of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays;
documents that hold a benchmark passage go; secrets inside the remaining texts are replaced by a mark; the texts
are encoded. Every stage writes Parquet that the next one reads, so a lost executor costs part of one stage.

An empty input, empty labels or an empty benchmark are fine: such a stage keeps what it gets. Columns beyond those of
``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsspark.llm import bpe, decontam, neardup, secrets, toxicity
from tsspark.llm.catalog import RANKS
from tsspark.llm.common import stored
from tsspark.session import scratch_path
from tsspark.sources.panels import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, neardup.Banding(width=5))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; ``n_chars`` follows the text where it changed."""
    clean = secrets.redact(docs.withColumn("__before", F.char_length("text")), scratch_path(spark, "pipeline-ledger"))
    changed = F.char_length("text") != F.col("__before")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with the digests that show the round trip."""
    rank_file, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    both = bpe.transcode(docs, rank_file, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", *bpe.digests())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenize),
]

#: None of the filters can be expressed in SQL as a whole; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
