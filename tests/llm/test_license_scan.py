import math
import re

from gapcast.llm import license_scan as ls

TERM = re.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z\x80-\U0010ffff]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passages(text):
    """Lines, blocks, sentences, runs of two to five sentences, and the text."""
    sentences = re.split(r"(?<=[.!?;])\s+", text)
    runs = {" ".join(sentences[i : i + n]) for n in range(1, ls.RUN + 1) for i in range(len(sentences) - n + 1)}
    return {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), *runs, text}


def allowed(passage, words):
    if tag := re.search(ls.SPDX, passage):
        name = re.sub(r"(-only|-or-later|\+)$", "", tag[1].lower())
        return [n for n in ls.LICENSES if n.lower() == name]
    return [n for n, (groups, lacking) in ls.LICENSES.items() if all(words & {*g} for g in groups) and not words & {*lacking}]


def plain_own(rows, least=0.6):
    """The closest template over all passages of each text, with frequencies of all terms over all files."""
    cut = lambda t: TERM.findall(t.translate(FOLD))
    texts = [t or "" for _, t in rows]
    held = [set(cut(t)) for t in texts]
    known = {}

    def idf(w):
        if w not in known:
            known[w] = math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1
        return known[w]

    def vector(t):
        words = cut(t)
        return {w: words.count(w) * idf(w) for w in set(words)}

    def cosine(a, b):
        dot = sum(a[w] * b.get(w, 0) for w in a)
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return dot / size if size else 0.0

    templates = [(name, vector(t)) for name, t in ls.TEMPLATES]
    out = []
    for text in texts:
        scored = []
        for p in passages(text):
            own, names = vector(p), allowed(p, set(cut(p)))
            scored += [(-round(cosine(own, v), 9), name) for name, v in templates if name in names]
        best = min(scored, default=(0, None))
        out.append((best[1], -best[0]) if -best[0] >= least else (None, None))
    return out


FILES = [
    ("a/LICENSE", "MIT License\n\n" + ls.NOTICES[1][1]),
    ("a/b/code.py", "import os\nprint(1)"),
    ("a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\ncode = 1"),
    ("a/b/c/COPYING.txt", "Lots of other words before it\n" * 5 + ls.NOTICES[6][1]),
    ("a/b/c/d/deep.py", "x = 1"),
    ("ab/near.py", "no licence here of any kind that one could tell"),
    ("top.py", "y = 2"),
    ("e/wrapped.c", "/*\n * Licensed under the Apache\n * License, Version 2.0.\n */\n\nint x;"),
    ("e/long.txt", "Prose words all over. " * 3000 + "\nReleased under the MIT License.\n" + "And more prose. " * 3000),
    ("f/null.txt", None),
    ("f/empty.txt", ""),
    (None, "Released under the MIT License."),
    (None, "nothing"),
    ("a/b/code.py", "import os\nprint(1)"),
]


def test_scan(spark):
    df = spark.createDataFrame(FILES, "path string, text string").selectExpr("*", "'mine' AS file", "'mine' AS license", "1 AS above")
    found = ls.scan_licenses(df).collect()
    assert len(found) == len(FILES)
    expected = plain_own(FILES)
    got = {(r["path"], r["origin"]): r for r in found}
    for (path, _), (name, score) in zip(FILES, expected):
        if name is not None:
            row = got[(path, "own")]
            assert row["license"] == name and abs(row["score"] - score) < 1e-6
        else:
            assert (path, "own") not in got or path is None
    assert {e[0] for e in expected} >= {"MIT", "Apache-2.0", "GPL-3.0"}
    inherited = {r["path"]: (r["license"], r["from_path"]) for r in found if r["origin"] == "inherited"}
    assert inherited == {"a/b/code.py": ("MIT", "a/LICENSE"), "a/b/c/d/deep.py": ("GPL-3.0", "a/b/c/COPYING.txt")}
    assert {r["path"] for r in found if r["origin"] == "none"} == {"ab/near.py", "top.py", "f/null.txt", "f/empty.txt", None}


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def true_scores(text, texts):
    """Cosines of one passage with all templates, with the frequencies of all terms over all files."""
    cut = lambda t: TERM.findall(t.translate(FOLD))
    held = [set(cut(t)) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1
    vectors = [{w: t.count(w) * idf(w) for w in t} for t in map(cut, (text, *(t for _, t in ls.TEMPLATES)))]
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    first, *others = vectors
    return max(sum(first[w] * v.get(w, 0) for w in first) / size(first) / size(v) for v in others)


def test_common_words_beside_a_notice_weigh_little(spark):
    notice = "Released under the MIT License with love everywhere always"
    rows = [("z/own.txt", notice)] + [(f"z/{i}.txt", f"love everywhere always w{i} with") for i in range(300)]
    expected = true_scores(notice, [t for _, t in rows])
    found = [r for r in ls.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect() if r["origin"] == "own"]
    assert [(r["path"], r["license"]) for r in found] == [("z/own.txt", "MIT")] and abs(found[0]["score"] - expected) < 1e-6


def test_notices_without_a_cue_and_inside_a_long_line(spark):
    notices = ["Creative Commons Attribution 4.0 International", "GNU Affero General Public, version 3", "CC0 1.0 Universal", "CC BY 4.0"]
    prose = "Some prose about other things altogether. " * 40
    rows = [(f"y{i}/about.txt", t) for i, t in enumerate(notices)] + [("y/line.txt", f"{prose}Released under the MIT License. {prose}")]
    rows += [(f"x/{i}.txt", f"prose about the other version of things by w{i}") for i in range(200)]
    found = {r["path"]: r for r in ls.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    texts = [t for _, t in rows]
    for i, notice in enumerate(notices):
        expected = true_scores(notice, texts)
        row = found[f"y{i}/about.txt"]
        assert (row["origin"] == "own") == (expected >= 0.6) and abs((row["score"] or expected) - expected) < 1e-6
    assert sum(r["origin"] == "own" for r in found.values()) >= 4
    assert found["y/line.txt"]["license"] == "MIT" and found["y/line.txt"]["score"] > 0.999


def scan_each(spark, texts):
    """The licence of each text in a directory of its own, beside prose."""
    rows = [(f"d{i}/x.c", t) for i, t in enumerate(texts)]
    rows += [(f"p{i}/y.txt", f"The program may be used under other terms of the file {i}, or distributed by any of you.") for i in range(60)]
    found = {r["path"]: r["license"] for r in ls.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    return [found[f"d{i}/x.c"] for i in range(len(texts))]


def test_no_template_is_taken_for_another_licence(spark):
    """Notices, SPDX tags and headers in comments of all licences come out as themselves."""
    named = ls.TEMPLATES + [(n, f"/*\n * {t}\n */\nint x;") for n, t in ls.NOTICES]
    named += [("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later")]
    named += [("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1+"), (None, "SPDX-License-Identifier: EUPL-1.2"), ("EPL-2.0", "Eclipse Public License, Version 2.0")]
    got = scan_each(spark, [t for _, t in named])
    assert [(n, t, g) for (n, t), g in zip(named, got) if n != g] == []


def test_a_notice_of_several_sentences_inside_a_long_line(spark):
    prose = "Some prose about other things altogether. " * 30
    texts = [f"{prose}{t} {prose}" for _, t in ls.NOTICES]
    assert scan_each(spark, texts) == [n for n, _ in ls.NOTICES]
