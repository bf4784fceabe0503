"""Helpers: bounded samples, joins with heavy keys, staged tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelark.llm import _spark


@pytest.mark.parametrize(("rows", "bound"), [(0, 5), (4, 5), (5000, 10), (30_000, 100)])
def test_sample_holds_the_smallest_hashes(spark, rows, bound):
    df = spark.range(rows).withColumnRenamed("id", "key")
    want = [r.key for r in df.orderBy(F.xxhash64("key"), "key").limit(bound).collect()]
    assert [r.key for r in _spark.hash_sample(df, ["key"], bound).collect()] == want


def test_heavy_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HEAVY_LEAST", 20)
    keys = [0] * 500 + [1] * 30 + list(range(2, 40)) + [None] * 3
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    got = Counter((r.k, r.i, r.n) for r in _spark.join_unique(left, sizes, ["k"], "n", len(keys)).collect())
    n = Counter(keys)
    assert got == Counter((k, i, n[k]) for i, k in enumerate(keys) if k is not None)


def test_rows_of_an_explode_are_not_broadcast(spark):
    left = spark.range(300).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(35))).alias("k"))
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    out = _spark.join_unique(left, sizes, ["k"], "n", 300 * 36)
    assert len(out.collect()) == 300 * 36
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") <= 2 and "SortMergeJoin" in plan  # by broadcast only with the heavy keys


def test_staged_tables_go_with_their_block(spark):
    def make():
        a = _spark.staged(spark.range(5))
        seen.append(a._staged_at)
        return a.where("id > 2")

    seen: list[str] = []
    out = _spark.kept(make)
    path = lambda p: p.removeprefix("file:")
    assert not os.path.exists(path(seen[0])) and out.count() == 2
    with _spark.scratch():
        inner = _spark.staged(out)
        assert inner.count() == 2 and os.path.exists(path(inner._staged_at))
    assert not os.path.exists(path(inner._staged_at)) and out.count() == 2
    _spark.forget(out)
    assert not os.path.exists(path(out._staged_at))
