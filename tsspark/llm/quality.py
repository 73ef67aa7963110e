"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects a document. On a sample of documents every rule is timed and its verdicts
are counted; the cascade then takes, step by step, the rule that rejects most of the rows still there per
second. The order decides the cost only: a document is kept if no rule rejects it, so the result is the same
for every order. In the plan the cascade is one CASE chain, which leaves a document at its first rejection.

Null texts have no words; a document without words has too few and is rejected. Lines end at line feeds.
Three-word windows are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

import functools
import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsspark.llm.common import BLANK_RUN, BLANKS, text_or_empty

SYMBOLS = "#*$%&|<>"
HAS_WORD = r"[^\x20\x09-\x0D]"

#: Rows of the sample that sets the order. It decides no verdict.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 10_000


class Rule(NamedTuple):
    name: str
    rejects: Column


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column, symbols: str = SYMBOLS) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, symbols, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(tokens: Column) -> Column:
    """Hashes of the three-word windows in order; empty with fewer words."""
    run = F.transform(F.sequence(F.lit(1), F.size(tokens) - 2), lambda i: F.xxhash64(F.get(tokens, i - 1), F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(F.size(tokens) >= 3, run).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Texts without such a window skip the sort."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(placed))


def _covered(placed: Column) -> Column:
    """From (hash, place) in order: how many words lie in windows whose hash has a neighbour."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    # the sorted array is bound once by wrapping it in a one-element array, so that the filter does not sort again
    twice = F.flatten(F.transform(F.array(placed), lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | ((k > 0) & same(x, F.get(s, F.greatest(k - 1, F.lit(0))))))))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with the word and line measures of each text; new columns begin with ``q_``."""
    whole = text_or_empty(text)
    return (
        df.withColumn("q_words", words(whole))
        .withColumn("q_windows", window_hashes(F.col("q_words")))
        .select(
            *df.columns,
            F.size("q_words").cast("long").alias("q_n_words"),
            word_chars(whole).alias("q_word_chars"),
            n_symbols(whole).alias("q_n_symbols"),
            n_dup_lines(worded_lines(whole)).alias("q_n_dup_lines"),
            n_repeat_words(F.col("q_windows")).alias("q_n_repeat_words"),
        )
    )


def production_rules(text: str = "text") -> list[Rule]:
    """The cascade of the registered query, over the columns of :func:`measured`. All bounds are per document."""
    whole, n = text_or_empty(text), F.col("q_n_words")
    lines = worded_lines(whole)
    capitals = F.char_length(whole) - F.char_length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouts = F.char_length(whole) - F.char_length(F.translate(whole, "!", ""))
    return [
        Rule("few_words", n < 50),
        Rule("repeated_words", 100 * F.col("q_n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("q_n_symbols") > n),
        Rule("repeated_lines", 100 * F.col("q_n_dup_lines") > 40 * F.size(lines)),
        Rule("exclamations", 10 * shouts > 3 * n),
        Rule("capitals", 100 * capitals > 35 * F.col("q_word_chars")),
        Rule("long_words", F.col("q_word_chars") > 20 * n),
    ]


def cascade_order(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Positions of the rules, the next one always that with most rejections among the rest per second.

    The sample is the head of the table, so that only its first partitions are read: at most ``sample_rows`` rows
    with texts up to ``SAMPLE_CHARS``. It is evaluated once per rule for the time and once for all verdicts
    together; at most ``2 ** len(rules)`` counts reach the driver.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    short = [F.coalesce(F.char_length(name), F.lit(0)) <= SAMPLE_CHARS for name in texts]
    head = df.where(functools.reduce(Column.__and__, short, F.lit(True))).take(sample_rows)
    sample = df.sparkSession.createDataFrame(head, df.schema).coalesce(1)
    cost = []
    for rule in rules:
        start = time.perf_counter()
        sample.agg(F.count_if(rule.rejects)).collect()
        cost.append(time.perf_counter() - start)
    verdicts = [F.coalesce(rule.rejects, F.lit(False)).alias(f"r{k}") for k, rule in enumerate(rules)]
    counts = [(row[:-1], row[-1]) for row in sample.select(*verdicts).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()]
    return greedy(counts, cost)


def greedy(counts: list[tuple[tuple, int]], cost: list[float]) -> list[int]:
    """``counts``: rows by the rules that reject them. Rules that reject nothing more come last, cheapest first."""
    left, order = set(range(len(cost))), []
    while left:
        gain = {k: sum(n for v, n in counts if v[k]) / max(cost[k], 1e-9) for k in left}
        best = min(left, key=lambda k: (-gain[k], cost[k], k))
        order.append(best)
        left.remove(best)
        counts = [(v, n) for v, n in counts if not v[best]]
    return order


def cascade(df: DataFrame, rules: list[Rule], order: list[int] | None = None) -> Column:
    """Name of the first rule that rejects a row, null if none does; evaluated no further than that rule."""
    chain = F
    for k in order if order is not None else cascade_order(df, rules):
        chain = chain.when(rules[k].rejects, F.lit(rules[k].name))
    return chain.otherwise(F.lit(None).cast("string")) if chain is not F else F.lit(None).cast("string")


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the measures, whether a base rule fails it, and the cascade's verdict."""
    base = measured(df.select(F.col(key).alias("q_key"), F.col(text).alias("q_text")), "q_text")
    rules = production_rules("q_text")
    failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return base.select(
        F.col("q_key").alias(key),
        *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        cascade(base, rules).isNull().alias("kept"),
    )
