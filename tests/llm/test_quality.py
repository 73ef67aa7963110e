import re
from collections import Counter

from pyspark.sql import functions as F

from tsspark.llm import quality
from tsspark.llm.catalog import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n, chars, symbols, dup, repeat = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    failed = n < 50 or 100 * repeat > 50 * n
    capitals, shouts = len(re.findall("[A-Z]", text)), text.count("!")
    kept = not (failed or 10 * symbols > n or 100 * dup > 40 * len(lines) or 10 * shouts > 3 * n or 100 * capitals > 35 * chars or chars > 20 * n)
    return (n, chars, symbols, dup, repeat, failed, kept)


ODD = [
    (300, "a b c a b c a"), (301, "a b c d a b"), (302, "a a a a"), (303, "x\nx\n\n \nx y\nx y"), (304, "# $ % | < > & *"),
    (305, "Über ÉCOLE 🙂 \x0b\x0c w" * 30), (306, "SHOUT!! LOUD!! " * 40), (307, "a b c " * 300), (308, "l1 w\n" * 60 + "other words here\n" * 2),
    (309, "a b c x a b c y b c x"), (310, "w# " * 60),
]


def test_same_as_brute_force(documents, tables, spark, corpus):
    rows = corpus + ODD + corpus[:2]
    got = QUERIES["op10_quality_rules"](spark, tables(documents=documents(rows))).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        assert tuple(r)[1:] == brute(want[r["doc_id"]]), (r, want[r["doc_id"]])


def test_order_does_not_change_the_verdict(documents, corpus):
    base = quality.measured(documents(corpus + ODD))
    rules = quality.production_rules()
    forward = quality.cascade(base, rules, list(range(len(rules))))
    backward = quality.cascade(base, rules, list(range(len(rules)))[::-1])
    assert base.where(forward.isNull() != backward.isNull()).count() == 0
    assert base.where(forward.isNotNull()).count() > 0


def test_greedy_takes_most_rejections_per_cost():
    counts = [((True, True, False), 6), ((True, False, False), 2), ((False, False, True), 3), ((False, False, False), 9)]
    assert quality.greedy(counts, [2.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.greedy([], [3.0, 1.0]) == [1, 0]


def test_order_is_learnt_from_a_sample(documents):
    df = documents([(k, "a" if k % 2 else "b") for k in range(20)])
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("half", F.col("text") == "a")]
    assert quality.cascade_order(df, rules)[0] == 1


def test_no_python_in_the_plan(documents, corpus, capsys):
    quality.judged(documents(corpus)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty_table_and_clashing_names(documents, clashing):
    assert quality.judged(documents([])).count() == 0
    rows = quality.judged(clashing([(None, None), (1, "a b"), (1, "a b")])).collect()
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in rows if r["doc_id"] is None] == [(0, True, False)]
    assert len(rows) == 3
