import random

from tsspark.llm import decontam
from tsspark.llm.catalog import QUERIES


def distance(item, text):
    """Least edit distance of the item to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def brute(docs, items):
    out = {}
    for i, text in docs:
        plain = decontam.plain(text or "")
        found = {}
        for item_id, item in items:
            item = decontam.plain(item or "")
            if len(item) >= decontam.LEAST_CHARS:
                d, _ = distance(item, plain)
                if d <= int(len(item) * decontam.RATE):
                    found[item_id] = d
        out[i] = found
    return out


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = rng.choice("abcxyz ")
        elif kind == 1:
            chars.insert(k, rng.choice("abcxyz"))
        else:
            chars.pop(k)
    return "".join(chars)


def world(corpus):
    rng = random.Random(11)
    words = [a + b for a in ("the", "on", "er", "ti", "sh") for b in ("", "nd", "st", "re", "ing")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "too short"), (53, items[2][1]), (None, items[3][1])]
    docs = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in corpus]
    for k in range(24):
        item = items[k % 12][1]
        budget = int(len(item) * decontam.RATE)
        leak = edited(item, [0, budget // 2, budget, budget + 6][k % 4], rng)
        before, after = corpus[k][1] or "", corpus[k + 1][1] or ""
        docs.append((500 + k, [before + "\n" + leak.upper() + " " + after, leak, leak + after, before + leak][k % 4]))
    return docs, items


def test_same_as_the_full_table(documents, tables, spark, corpus):
    docs, items = world(corpus)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in QUERIES["op4_decontaminate"](spark, tables(documents=documents(docs), benchmark=benchmark)).collect()}
    want = brute(docs, [x for x in items if x[0] is not None])
    assert len(got) == len(docs)
    for i, found in want.items():
        assert list(got[i]["item_ids"]) == sorted(found), i
        assert got[i]["contaminated"] == bool(found) and got[i]["least_distance"] == (min(found.values()) if found else None)
    assert sum(bool(f) for f in want.values()) >= 18


def test_items_in_several_parts(documents, spark, corpus, monkeypatch):
    docs, items = world(corpus)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {r["doc_id"]: r["item_ids"] for r in decontam.judged(documents(docs), benchmark).collect()}
    monkeypatch.setattr(decontam, "PART_CHARS", 300)
    assert len(decontam.item_parts(benchmark)) > 3
    assert {r["doc_id"]: r["item_ids"] for r in decontam.judged(documents(docs), benchmark).collect()} == want


def test_short_items_are_matched_exactly(documents, spark):
    items = [(1, "Who wrote  Hamlet?"), (2, "cat"), (3, "東京はどこですか"), (4, None), (5, " \n"), (None, "cat"), (6, "7+5")]
    docs = [
        (1, "q: who wrote\nhamlet? a: ..."), (2, "who wrot hamlet?"), (3, "a category, concat"), (4, "category (Cat)"), (5, "質問:東京はどこですかと聞いた"),
        (6, "東京はどこで"), (7, "=7+5"), (8, "17+5"), (9, "cat"), (10, "cat\u0301 1cat"), (11, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: list(r["item_ids"]) for r in decontam.judged(documents(docs), benchmark).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [2], 5: [3], 6: [], 7: [6], 8: [], 9: [2], 10: [], 11: []}
    assert {r["doc_id"] for r in decontam.drop_contaminated(documents(docs), benchmark).collect()} == {2, 3, 6, 8, 10, 11}
    assert sorted((r["item_id"] or 0) for r in decontam.left_out(benchmark).collect()) == [0, 4, 5]


def test_myers_same_as_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        window = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontam.edit_distance_within(item, window) == distance(item, window)


def test_pieces_cover_the_item():
    for n in range(1, 40):
        for budget in range(n):
            cut = decontam.pieces("x" * n, budget)
            assert len(cut) == budget + 1 and cut[0][0] == 0 and cut[-1][1] == n
            assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(cut, cut[1:], strict=False))


def test_stage_empty_tables_and_clashing_names(clashing, documents, spark):
    benchmark = spark.createDataFrame([(1, "a passage that is long enough to count here")], "item_id long, text string")
    docs = clashing([(1, "x A passage that is long enough to count here y"), (2, "clean"), (None, None), (2, "clean")])
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 2]
    assert decontam.drop_contaminated(docs, benchmark.limit(0)).count() == 4
    assert decontam.judged(documents([]), benchmark).count() == 0
