import random
import re

from gapcast.llm.winnowing import clean_documents, contamination, words_hit


def cut(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))


def plain(docs, items, n=10):
    needles = {}
    for item, text in items:
        w = cut(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            needles.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(k) for k in needles}
    out = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if (names := needles.get(tuple(w[p : p + size]))) is not None:
                    hit |= set(range(p, p + size))
                    found |= names
        out.append((i, len(w), len(hit), ",".join(sorted(map(str, found - {None})))))
    return sorted(out, key=repr)


def found(docs, items):
    rows = contamination(docs, items).select("doc_id", "n_words", words_hit().alias("n_hit"), "items").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in rows), key=repr)


def test_random_documents(spark, make_docs):
    rng = random.Random(8)
    vocabulary = [*"abcdefg", "Élan", "été", "x1", "3"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, "..."), items[7], (52, items[7][1]), (None, items[8][1])]
    docs = []
    for i in range(50):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        if i % 2:
            text += " - " + rng.choice(items[:12])[1].upper() + "! " + text[:20]
        docs.append((i, text))
    docs += [(60, None), (61, ""), (62, items[6][1]), docs[1], (1, "other text of that id"), (None, items[9][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(make_docs(docs), table) == plain(docs, items)
    clean = clean_documents(make_docs(docs), table)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(
        (d for d, p in zip(docs, [plain([d], items)[0] for d in docs]) if p[2] == 0), key=repr
    )
    assert clean.columns == make_docs([]).columns


def test_long_shared_spans_are_whole(spark, make_docs):
    rng = random.Random(1)
    passage = [f"w{rng.randrange(40)}" for _ in range(300)]
    docs = [(1, " ".join(["before"] * 5 + passage[20:260] + ["after"] * 5)), (2, " ".join(passage[:9])), (3, "w1 " * 5000)]
    items = [(7, " ".join(passage))]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(make_docs(docs), table) == plain(docs, items)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(make_docs([(1, "a b"), (2, None)]), none) == [(1, 2, 0, ""), (2, 0, 0, "")]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(make_docs([]), some) == []
