import hashlib

import pytest
from pyspark.sql import functions as F

from gapcast.operators import split
from gapcast.operators.split import hash_split, key_fraction, kfold, random_split, sample_fraction


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))


def test_parts_are_disjoint_and_whole(keys):
    for train, test in (hash_split(keys, "k", 0.7, seed=3), random_split(keys, 0.7, seed=3)):
        assert train.intersect(test).count() == 0
        assert train.unionAll(test).distinct().count() == 20_000
        assert abs(train.count() / 20_000 - 0.7) < 0.02


def test_split_does_not_depend_on_partitions(keys):
    a, _ = hash_split(keys, "k", seed=3)
    b, _ = hash_split(keys.repartition(13), "k", seed=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_seed_changes_the_split(keys):
    a, _ = hash_split(keys, "k", seed=3)
    b, _ = hash_split(keys, "k", seed=4)
    assert abs(a.intersect(b).count() / 20_000 - 0.49) < 0.03


def test_split_needs_no_shuffle(keys):
    train, _ = hash_split(keys, "k")
    assert "Exchange" not in train._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_go_somewhere(spark):
    df = spark.createDataFrame([(None,), (1,)], "k long")
    train, test = hash_split(df, "k")
    assert train.count() + test.count() == 2


def test_negative_and_huge_keys(spark):
    df = spark.createDataFrame([(-1,), (-(2**63),), (2**63 - 1,)], "k long")
    values = [r[0] for r in df.select(key_fraction(df, "k", 5)).collect()]
    assert all(0 <= v < 1 for v in values)


def test_equal_rows_stay_together_without_a_key(spark):
    df = spark.createDataFrame([(i % 50, "x") for i in range(1000)], "a long, b string")
    train, test = hash_split(df)
    assert train.intersect(test).count() == 0


def test_folds_are_even_also_within_a_split(keys):
    train, _ = hash_split(keys, "k", seed=0)
    for df, n in ((keys, 20_000), (train, train.count())):
        counts = {r["fold"]: r["count"] for r in kfold(df, 5, "k", seed=1).groupBy("fold").count().collect()}
        assert sorted(counts) == list(range(5))
        assert all(abs(c - n / 5) < 0.06 * n / 5 for c in counts.values())


def test_sample(keys):
    sample = sample_fraction(keys, 0.8, seed=1)
    assert abs(sample.count() / 20_000 - 0.8) < 0.02
    assert sample.exceptAll(keys).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_bottom_k_is_exact_and_independent_of_partitions(spark, monkeypatch, digits):
    monkeypatch.setattr(split, "DIGITS", digits)
    monkeypatch.setattr(split, "SORTED_ROWS", 20)
    df = spark.range(3000).selectExpr("id", "id % 7 AS v")
    marks = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), i) for i in range(3000))
    for k in (0, 1, 17, 1500, 2999, 3000, 4000):
        expected = {i for _, i in marks[:k]}
        for parts in (1, 7):
            taken, rest = split.bottom_k(df.repartition(parts), k, "id", seed=5)
            assert {r["id"] for r in taken.collect()} == expected and {r["id"] for r in rest.collect()} == set(range(3000)) - expected
            assert taken.columns == rest.columns == df.columns


def test_bottom_k_with_repeated_keys_rows_and_nulls(spark):
    rows = [(1, i) for i in range(50)] + [(2, 0)] * 30 + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, v long")
    for k in (1, 10, 49, 50, 60, 99):
        taken, rest = split.bottom_k(df, k, "key")
        assert taken.count() == k and sorted(map(str, taken.union(rest).collect())) == sorted(map(str, df.collect()))
        again, _ = split.bottom_k(df.repartition(5), k, "key")
        assert sorted(map(str, again.collect())) == sorted(map(str, taken.collect()))
    assert split.sample_exact(df, 0.255).count() == 26 and split.sample_exact(df.limit(0)).count() == 0
    train, test = split.split_exact(df, 0.7, "key")
    assert (train.count(), test.count()) == (70, 30)
