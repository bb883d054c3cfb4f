import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gapcast.llm.graph import connected_components
from gapcast.llm.simhash import ball, fingerprint, near_duplicates, one_of_each_group, words


def plain_print(text, size=3):
    tokens = (text or "").encode().lower().split()
    runs = [b" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_match_the_definition():
    for text in (None, "", " \t\n", "One", "one two", "A b C d\x0be", "naïve Été ÉTÉ été x y z", "ab " * 300):
        assert int(fingerprint(words(text), 3, 42)[0]) & (2**64 - 1) == plain_print(text)


def test_ball_sizes():
    assert [len(ball(r)) for r in range(3)] == [1, 65, 2081]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_components_equal_brute_force(make_docs, radius):
    rng = random.Random(radius)
    base = [" ".join(rng.choices("abcdefghij", k=400)) for _ in range(6)]
    rows = []
    for i in range(40):
        tokens = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            tokens[rng.randrange(len(tokens))] = "new"
        rows.append((i, " ".join(tokens)))
    rows += [(50, None), (51, ""), (52, "two words"), rows[0], (60, rows[0][1])]
    prints = {i: plain_print(t) for i, t in rows}
    expected = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    found = near_duplicates(make_docs([*rows, (None, "two words"), (None, "alone with no id")]), radius=radius)
    got = [(r["doc_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in found.collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted((i, prints[i], expected[i]) for i, _ in rows)
    assert {g[2] for g in got if g[0] is None} == {52, None}
    assert near_duplicates(make_docs([])).count() == 0


def test_one_of_each_group_chooses_rows_not_ids(make_docs):
    """An id that two rows share, and null ids: the unique text of each stays, its copies go."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(4)]
    first, other, third, own = texts
    near = f"{first} more"
    assert (plain_print(first) ^ plain_print(near)).bit_count() <= 2
    rows = [(1, first), (2, near), (2, other), (None, near), (None, own), (3, third), (3, third), (4, third.upper()), (5, None), (6, "")]
    found = one_of_each_group(make_docs(rows))
    got = {(r["doc_id"], r["text"]) for r in found.collect()}
    assert got == {(1, first), (2, other), (None, own), (3, third), (5, None)} and found.count() == 5
    assert found.columns == make_docs(rows).columns
    assert one_of_each_group(make_docs([])).count() == 0


def test_one_of_each_group_keeps_the_smallest_id_of_brute_force_groups(make_docs):
    rng = random.Random(12)
    base = [" ".join(rng.choices("abcdefghij", k=400)) for _ in range(5)]
    rows = []
    for i in range(60):
        tokens = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            tokens[rng.randrange(len(tokens))] = "new"
        rows.append((i, " ".join(tokens)))
    prints = {i: plain_print(t) for i, t in rows}
    groups = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = [r["doc_id"] for r in one_of_each_group(make_docs(rows)).collect()]
    assert sorted(kept) == sorted(set(groups.values()))


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5, 5), (None, 3), edges[0]]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    pairs = set(edges)
    expected = components(sorted(nodes), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    got = connected_components(df).collect()
    assert {r["node"]: r["component"] for r in got} == expected and len(got) == len(nodes)
    assert connected_components(df.where(F.lit(False))).count() == 0
