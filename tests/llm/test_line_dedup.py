import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from gapcast.llm.line_dedup import LineRuns, dedup_lines


def plain(rows):
    """The rule, line by line."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(fold)

    holders = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def cleaned(docs, **rules):
    rows = dedup_lines(docs, **rules).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_random_documents(make_docs):
    rng = random.Random(4)
    pool = [f"line number {i} of the pool" for i in range(25)] + ["short", "", "  ÉLAN vital de la ligne  ", "élan vital de la ligne"]
    pool += [x.upper() + "\t" for x in pool[:5]]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0]), (None, None), rows[3], (7, pool[1] + "\n" + pool[2])]
    assert cleaned(make_docs(rows)) == plain(rows)
    assert cleaned(make_docs(rows), batches=7, fanout=2) == plain(rows)


def test_long_text_with_most_lines_dropped(make_docs):
    long = "\n".join(f"shared line {i} that is long" if i % 3 else f"own line number {i} of it" for i in range(20_000))
    rows = [(i, long if i < 3 else "x") for i in range(4)]
    assert cleaned(make_docs(rows)) == plain(rows)


def test_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "a")])
    out = dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"} and out.first()["rest"] == "mine"
    assert dedup_lines(make_docs([])).count() == 0


def test_runs_are_disjoint_and_compacted(spark):
    runs, seen = LineRuns(spark, 4, fanout=2), set()
    for batch in range(5):
        keys = {(k, k * 7) for k in range(batch * 3, batch * 3 + 6)}
        df = spark.createDataFrame([(a, b, batch) for a, b in keys], "h1 long, h2 long, keeper int")
        fresh = {(r["h1"], r["h2"]) for r in runs.fresh(df).collect()} if runs.runs() else keys
        assert fresh == keys - seen
        runs.add(df)
        seen |= keys
    assert runs.compactions >= 2 and len(runs.runs()) <= 3
    table = runs.table()
    assert table.count() == len(seen) == table.select("h1", "h2").distinct().count()
    assert table.where("h1 = 3").first()["keeper"] == 0  # the batch that brought it
    runs.drop()


def test_digest_of_the_query(spark, make_docs):
    row = dedup_lines(make_docs([(1, "é\n")])).select(F.sha2("text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("é\n".encode()).hexdigest()


def test_text_ids(make_docs):
    """Ids that are texts, in their own order, give what the same documents numbered in that order give."""
    rng = random.Random(7)
    lines = [f"a line that is long enough number {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)) + [f"own {i}"])) for i in range(60)] + [(None, lines[0])]
    named = [(f"d{i:03d}é" if i is not None else None, t) for i, t in rows]
    by_number = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(rows)).collect()}
    found = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(named, "doc_id string, text string")).collect()}
    assert found == {(f"d{i:03d}é" if i is not None else None): t for i, t in by_number.items()}
    assert dedup_lines(make_docs([], "doc_id string, text string")).count() == 0
