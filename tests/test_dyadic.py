"""Interval joins and counts through dyadic blocks against all pairs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dyadic


def spans(seed, n, far, long):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        start = rnd.randrange(-far, far)
        rows.append((rnd.choice("ab"), k, start, start + rnd.choice([0, 1, rnd.randrange(1, 9), rnd.randrange(1, long)])))
    return rows


@pytest.mark.parametrize("far, long, cell", [(60, 30, 1), (60, 30, 64), (100_000, 50_000, 64)])
def test_overlaps_against_all_pairs(spark, far, long, cell):
    left, right = spans(1, 150, far, long), spans(2, 150, far, long)
    l = spark.createDataFrame(left, "key string, i long, a long, b long")
    r = spark.createDataFrame(right, "key string, j long, c long, d long")
    got = collections.Counter((x.i, x.j) for x in dyadic.overlap_pairs(l, r, ["key"], ("a", "b"), ("c", "d"), cell).collect())
    want = collections.Counter((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and a < b and c < d and a < d and c < b)
    assert got == want and len(want) > 20
    totals = {(x.key, x.a, x.b): x.n for x in dyadic.overlap_totals(l, r, ["key"], ("a", "b"), ("c", "d"), "n").collect()}
    assert totals == {(k, a, b): sum(m == k and a < b and c < d and a < d and c < b for m, _, c, d in right) for k, _, a, b in left}


def test_a_long_interval_stands_under_few_blocks(spark):
    rows = spark.createDataFrame([(5, 1_000_005), (0, 1 << 20), (7, 7), (-13, 41)], "a long, b long")
    got = [r.b for r in rows.select(dyadic.blocks("a", "b").alias("b")).collect()]
    assert len(got[0]) < 45 and [tuple(x)[:2] for x in got[1]] == [(20, 0)] and got[2] is None
    assert sorted(p for x in got[3] for p in range(x.node << x.level, (x.node + 1) << x.level)) == list(range(-13, 41))


def test_overlaps_shuffle_each_side_once(spark):
    left, right = spans(5, 40, 4000, 300), [*spans(6, 40, 4000, 40), ("a", 99, -4000, 4000)]
    l = spark.createDataFrame(left, "key string, i long, a long, b long")
    r = spark.createDataFrame(right, "key string, j long, c long, d long")
    found = dyadic.overlap_pairs(l, r, ["key"], ("a", "b"), ("c", "d"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((x.i, x.j) for x in found.collect()) == sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and a < b and c < d and a < d and c < b)


def test_nothing_to_meet(spark):
    some, none = spark.createDataFrame([("a", 1, 1, 5)], "key string, i long, a long, b long"), spark.createDataFrame([], "key string, j long, c long, d long")
    assert dyadic.overlap_pairs(some, none, ["key"], ("a", "b"), ("c", "d")).count() == 0
    assert [r.n for r in dyadic.overlap_totals(some, none, ["key"], ("a", "b"), ("c", "d"), "n").collect()] == [0]
    assert dyadic.overlap_totals(none.select("key", F.col("c").alias("a"), F.col("d").alias("b")), some.select("key", F.col("a").alias("c"), F.col("b").alias("d")), ["key"], ("a", "b"), ("c", "d"), "n").count() == 0


def test_counts_of_several_sources_move_two_rows_each(spark):
    left, right = spans(3, 200, 200_000, 90_000), spans(4, 200, 200_000, 90_000)
    l = spark.createDataFrame([*left, ("a", 1, None, 9), (None, 2, 1, 9)], "key string, i long, a long, b long")
    r = spark.createDataFrame([*right, *right[:50], (None, 1, 2, 5)], "key string, j long, c long, d long")
    got = {(x.key, x.a, x.b): (x.all, x.few) for x in dyadic.overlap_counts(l, {"all": r, "few": r.where("j % 3 = 0")}, ["key"], ("a", "b"), ("c", "d")).collect()}

    def meets(k, a, b, few):
        return sum(m == k and a < b and c < d and a < d and c < b and (not few or j % 3 == 0) for m, j, c, d in [*right, *right[:50]])

    assert got == {(k, a, b): (meets(k, a, b, False), meets(k, a, b, True)) for k, _, a, b in left} | {("a", None, 9): (0, 0), (None, 1, 9): (0, 0)}
    assert max(x for x, _ in got.values()) > 20
