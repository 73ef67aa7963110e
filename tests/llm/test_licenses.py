import random
import re

from tsspark.llm import licenses
from tsspark.llm.catalog import QUERIES


def words(text):
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        plain = m.group().lower().strip(licenses._EDGES)
        if plain:
            out.append(plain)
    return out


def shingles(tokens):
    return [tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4)]


def brute(text):
    """Templates of which some run of their length (a little longer, as edits add words) holds enough shingles."""
    own = shingles(words(text))
    found = set()
    for name, template in licenses.TEMPLATES.items():
        wanted = set(shingles(words(template)))
        size = len(wanted)
        for k in range(max(1, len(own) - size + 1)):
            if 100 * len(wanted & set(own[k : k + size])) >= licenses.PERCENT * size:
                found.add(name)
                break
    return found


def test_same_as_brute_force(documents, tables, spark, corpus):
    rng = random.Random(6)
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in corpus]
    names = sorted(licenses.TEMPLATES)
    for k in range(40):
        name = names[k % len(names)]
        body = licenses.TEMPLATES[name].split(" ")
        if k >= 14 and len(body) > 30:
            for _ in range(1 if k < 28 else 6):
                body[rng.randrange(len(body))] = "changed"
        text = " ".join(body)
        rows.append((700 + k, f"{corpus[k][1] or ''}\n{text.upper() if k % 3 else text} {corpus[k + 1][1] or ''}"))
    got = {r["doc_id"]: r for r in QUERIES["op5_license_scan"](spark, tables(documents=documents(rows))).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        names_found = set(filter(None, got[i]["names"].split(",")))
        assert names_found >= brute(text), i
        for f in got[i]["finds"]:
            inside = set(shingles(words(text[f["start"] : f["stop"]])))
            wanted = set(shingles(words(licenses.TEMPLATES[f["license"]])))
            assert f["percent"] >= licenses.PERCENT and 100 * len(wanted & inside) >= licenses.PERCENT * len(wanted)
    assert all(got[700 + k]["n_found"] >= 1 for k in range(14))
    assert not any(got[i]["n_found"] for i, _ in corpus)


def test_spans_are_the_licence(documents):
    text = "é🙂 before, -- Released under the MIT License. after"
    row = licenses.judged(documents([(1, text)])).first()
    f = row["finds"][0]
    assert text[f["start"] : f["stop"]] == "Released under the MIT License." and f["percent"] == 100


def test_repeats_and_windows():
    finder = licenses.Finder(licenses.TEMPLATES)
    body = licenses.TEMPLATES["MIT-text"]
    for shift in range(0, 200, 7):
        filler = " ".join(f"w{k}" for k in range(shift))
        found = finder.find(licenses.pa.array([f"{filler} {body} {filler} {body}"], licenses.pa.large_string()))[0]
        own = [f for f in found if f["license"] == "MIT-text"]
        assert 1 <= len(own) <= 2 and all(f["percent"] == 100 for f in own)
        assert own[-1]["stop"] == 2 * len(filler) + 2 * len(body) + 3
        if shift > 130:  # nearer copies share a window and are one find
            assert len(own) == 2


def test_short_notices_word_for_word(documents):
    lines = {
        "see the MIT License, please": ("MIT License", "MIT name"), "// SPDX-License-Identifier: LGPL-2.1-or-later": ("SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX LGPL-2.1-or-later"),
        "Licensed under CC BY-SA 3.0.": ("CC BY-SA 3.0", "CC-BY-SA-3.0 name"), "é🙂 (CC0 1.0 Universal)": ("CC0 1.0 Universal", "CC0-1.0 name"),
        "at https://creativecommons.org/licenses/by/4.0/ now": ("https://creativecommons.org/licenses/by/4.0", "CC-BY-4.0 https"),
    }
    rows = list(enumerate([*lines, "the MIT of the License", "MIT", "License", "Released under the MIT License.", "New BSD License"]))
    got = {r["doc_id"]: r["finds"] + r["notices"] for r in licenses.judged(documents(rows)).collect()}
    for i, (text, (span, name)) in enumerate(lines.items()):
        assert [f["license"] for f in got[i]] == [name] and text[got[i][0]["start"] : got[i][0]["stop"]].strip("(),./") == span, text
    assert not any(got[k] for k in range(5, 8)) and [f["license"] for f in got[8]] == ["MIT"]
    assert [f["license"] for f in got[9]] == ["BSD-3-Clause new"]


def test_all_notices_of_the_table_are_found():
    finder = licenses.Finder(licenses.TEMPLATES | licenses.SHORT)
    names = [*licenses.TEMPLATES, *licenses.SHORT]
    texts = [f"some words before {(licenses.TEMPLATES | licenses.SHORT)[n]} and after" for n in names]
    found = finder.find(licenses.pa.array(texts, licenses.pa.large_string()))
    assert all(n in [f["license"] for f in x] for n, x in zip(names, found, strict=True))
    assert {"AGPL-3.0-notice", "LGPL-2.1-notice", "EPL-2.0-notice", "CC0-1.0-notice", "BSD-third-clause"} <= set(names)


def test_empty_table_null_ids_and_clashing_names(documents, clashing):
    assert licenses.judged(documents([])).count() == 0
    rows = licenses.judged(clashing([(None, licenses.TEMPLATES["MIT"]), (1, None), (1, None), (2, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_found"]) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 0)]
