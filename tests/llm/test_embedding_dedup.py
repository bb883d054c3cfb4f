import random

import numpy as np
import pytest

from gapcast.llm import embedding_dedup as ed


def plain(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    width = max((len(v) for _, v in good), default=1)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good]).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mask = x @ x.T >= cosine
    np.fill_diagonal(mask, False)
    root = list(range(len(good)))
    while True:
        new = [min([root[k], *(root[j] for j in np.flatnonzero(mask[k]))]) for k in range(len(good))]
        if new == root:
            break
        root = new
    out = [(i, 0, i) for i, v in rows if not any(v is g or (g_id == i and v == g.tolist()) for g_id, g in good)]
    for k, (i, _) in enumerate(good):
        ids = [good[j][0] for j in range(len(good)) if root[j] == root[k] and good[j][0] is not None]
        out.append((i, int(mask[k].sum()), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, leaf", [(4096, 512), (16, 4)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block, leaf):
    rng, generator = random.Random(5), np.random.default_rng(5)
    centres = generator.normal(size=(6, 12))
    rows = []
    for i in range(260):
        v = centres[i % 6] * generator.uniform(0.5, 3) + generator.normal(size=12) * rng.choice([0.05, 0.3, 0.6])
        rows.append((i, v.astype(np.float32).astype(float).tolist()))
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(0, rows[0][1]), (None, rows[1][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [None, *[1.0] * 11]), (405, [float("inf"), *[1.0] * 11])]
    rows += [(406, rows[2][1][:7]), (407, [-0.0, *rows[3][1][1:]]), (408, [0.0, *rows[3][1][1:]]), (409, [1e-30] * 12), (410, [1e30] * 12)]
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "LEAF", leaf)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'mine' AS first", "1 AS n_links", "2 AS vector")
    found = ed.near_duplicate_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == plain(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_empty_and_unusable_tables(spark):
    assert ed.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = ed.near_duplicate_vectors(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_distant_leaves_are_skipped(monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 8)
    x = np.concatenate([np.eye(4)[[0]].repeat(8, 0), np.eye(4)[[1]].repeat(8, 0)]) + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    visited = [(s, t) for s, t, _ in ed.join_blocks(x, None, np.eye(4)[:, :2], 0.9)]
    assert visited == [(0, 0), (8, 8)]


def spread_vectors(n, dims, seed):
    """Vectors in all directions, every tenth of them close to another."""
    generator = np.random.default_rng(seed)
    x = generator.normal(size=(n, dims))
    near = np.arange(0, n - 10, 10)
    x[near] = x[near + 9] + generator.normal(size=(len(near), dims)) * generator.choice([0.1, 0.4, 0.5], size=(len(near), 1))
    return x.astype(np.float32)


def disk_used(spark, folder, work):
    """(bytes in tables written to ``folder``, bytes shuffled) by ``work``."""
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    work()
    return sum(f.stat().st_size for f in folder.rglob("part-*") if f.is_file()), shuffled() - before


def test_disk_grows_with_the_vectors_not_with_pairs_of_blocks(spark, monkeypatch, tmp_path):
    """No direction tells the vectors apart, so that all blocks meet: they are not written or sent for each pair."""
    monkeypatch.setattr(ed, "BLOCK", 64)
    monkeypatch.setattr("gapcast.llm.tables.shared_dir", lambda spark, name: f"{tmp_path}/{name}-{random.getrandbits(64)}")
    x = spread_vectors(3000, 64, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = []
    written, sent = disk_used(spark, tmp_path, lambda: found.extend(ed.near_duplicate_vectors(df).collect()))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == plain(rows, 0.9)
    assert written < 3.5 * x.nbytes and sent < 3 * x.nbytes


def test_links_across_bands_equal_brute_force(spark, monkeypatch):
    """Several bands, tiles and levels; copies of a vector in many batches are one class."""
    for name, value in {"BLOCK": 8, "TILE": 2, "FANOUT": 4, "PART": 1 << 13, "BAND": 1 << 13}.items():
        monkeypatch.setattr(ed, name, value)
    met = []
    monkeypatch.setattr(ed, "_meeting_bands", lambda *a, real=ed._meeting_bands: met.append(real(*a)) or met[-1])
    generator = np.random.default_rng(9)
    x = spread_vectors(240, 12, 9) * np.array([4, *[1] * 11], np.float32)
    x = np.concatenate([x, x[:60] + generator.normal(size=(60, 12)).astype(np.float32) * 0.3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    with ed.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=5):
        found = ed.near_duplicate_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == plain(rows, 0.9)
    bands = met[0]
    assert len(bands) > 3 and any(len(others) > 1 for others in bands.values())
    last = max(bands)
    assert any(others != list(range(band, last + 1)) for band, others in bands.items())  # some are too far apart to meet


@pytest.mark.parametrize("wide", [None, 8, 20])
@pytest.mark.parametrize("noise", [0.02, 0.3])
def test_blocks_joined_by_bounds_equal_all_products(wide, noise):
    """Few links and many; products on the threshold are told in double precision."""
    generator = np.random.default_rng(11)
    centres = generator.normal(size=(12, 32))
    x, y = (ed._units(centres[generator.integers(12, size=n)] + generator.normal(size=(n, 32)) * noise) for n in (700, 1100))
    axes = np.linalg.qr(generator.normal(size=(32, 32)))[0]
    for cosine in (0.9, float(x[3] @ y[5])):
        for a, b in ((x, y), (x, None)):
            found = np.zeros((len(a), len(x if b is None else b)), bool)
            for s, t, (r, c) in ed.join_blocks(a, b, axes[:, :4], cosine, axes[:, :wide] if wide else None):
                assert not found[s + r, t + c].any()
                found[s + r, t + c] = True
            products = np.einsum("id,jd->ijd", a, x if b is None else b).sum(axis=2)
            expected = products >= cosine if b is not None else np.triu(products >= cosine, 1)
            unsure = np.abs(products - cosine) < 1e-13
            assert (found == expected)[~unsure].all() and expected.sum() > 500


def test_edges_thinned_out_connect_the_same():
    generator = np.random.default_rng(12)
    a, b = generator.integers(3000, size=(2, 2500)) * 1000
    thin = ed._forest(a, b)

    def groups(a, b):
        least = {n: n for n in (*a, *b)}
        while True:
            before = dict(least)
            for u, v in zip(a, b):
                least[u] = least[v] = min(least[u], least[v])
            if least == before:
                return {n: g for n, g in least.items() if n != g}

    assert groups(*thin) == groups(a, b) and len(thin[0]) == len(set(thin[0])) < 2500
