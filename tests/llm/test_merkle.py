import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gapcast.llm.merkle import OpenSubtrees, fold, height, leaf_hash, merkle_manifest, placed, proof


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """(root, per node the siblings by level): whole levels, the definition."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // arity * arity : (p // arity + 1) * arity]
            paths[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], paths


def plain(rows, arity):
    """rows: (id, group, text)."""
    leaves = sorted((g is not None, g or "", i is not None, i or 0, plain_leaf((i, g, t))) for i, g, t in rows)
    groups = {}
    for row in leaves:
        groups.setdefault(row[:2], []).append(row)
    subroots, paths = {}, {}
    for g, own in groups.items():
        subroots[g], paths[g] = plain_tree([r[4] for r in own], arity)
    root, over = plain_tree(list(subroots.values()), arity)
    out = []
    for (g, own), above in zip(groups.items(), over):
        for r, path in zip(own, paths[g]):
            out.append((r[3] if r[2] else None, g[1] if g[0] else None, r[4], subroots[g], root, digest("".join(a + b for a, b in path + above))))
    return sorted(out, key=str)


def result(found):
    found = found.withColumn("p", F.sha2(proof(F.col("witness")), 256)).withColumn("folded", fold(F.col("leaf"), F.col("witness")))
    rows = found.collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return sorted(((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], r["p"]) for r in rows), key=str)


def make(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    return df.withColumns({c: F.lit("mine") for c in ("id", "branch", "node", "place", "total", "block", "witness", "group", "dealt", "serial")})


@pytest.mark.parametrize("arity, levels", [(2, 1), (3, 2), (8, 1), (8, 4)])
def test_equals_whole_trees(spark, arity, levels):
    rng = random.Random(arity)
    rows = [(i, rng.choice(["de", "en", "en", "en", "ü"]), f"Text {i}") for i in range(150)]
    rows += [(500, None, "x"), (501, None, None), (None, "en", "no id"), (None, None, None), (600, "alone", ""), (601, "", "Z" * 100_000)]
    rows += [rows[3], rows[3], (7, "en", "another of one id"), (7, "de", "and another")]
    found = merkle_manifest(make(spark, rows).repartition(4), "doc_id", ["doc_id", "lang", "text"], "lang", arity=arity, levels=levels)
    assert result(found) == plain(rows, arity)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_one_group_of_any_size(spark, n):
    rows = [(i, "en", str(i)) for i in range(n)]
    found = merkle_manifest(make(spark, rows), "doc_id", ["doc_id", "lang", "text"], "lang", levels=1)
    assert result(found) == (plain(rows, 8) if n else [])


def test_many_groups(spark):
    rows = [(i, f"g{i % 90:03d}", str(i)) for i in range(200)]
    found = merkle_manifest(make(spark, rows), "doc_id", ["doc_id", "lang", "text"], "lang", levels=1)
    assert result(found) == plain(rows, 8)


def test_a_change_is_found(spark):
    rows = [(i, "en", f"Text {i}") for i in range(30)]
    docs = make(spark, rows)
    changed = F.unhex(leaf_hash([F.col("doc_id"), F.col("lang"), F.lower("text")]))
    found = merkle_manifest(docs, "doc_id", ["doc_id", "lang", "text"], "lang", {"changed": changed})
    other = found.select(fold(F.lower(F.hex("changed")), F.col("witness")).alias("folded"), "root").collect()
    assert all(r["folded"] != r["root"] for r in other)


def test_appends_extend_witnesses_step_by_step():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(21)]
    tree = OpenSubtrees(4, height(21, 4))
    seen = []
    for leaf in leaves:
        tree.append(leaf)
        seen.append(len(tree.witnesses[0]))
    assert seen == [0] * 3 + [1] * 12 + [2] * 6 and tree.root is None
    tree.close()
    root, paths = plain_tree([x.hex() for x in leaves], 4)
    assert tree.root.hex() == root and [[(a.hex(), b.hex()) for a, b in w] for w in tree.witnesses] == paths


def test_places_without_one_big_task(spark):
    rows = [(i % 40, "hot" if i % 3 else None, "t") for i in range(500)]
    found = placed(make(spark, rows).select("doc_id", "lang"), "lang", ["doc_id"]).collect()
    for g in ("hot", None):
        own = sorted((r for r in found if r["lang"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and {r["total"] for r in own} == {len(own)}
        assert [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
