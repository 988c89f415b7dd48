"""Chains that come after one of too few anchors."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import chains


def test_lone_anchor_hides_no_chain(spark):
    rows = [("B", "A", "+", 900_000, 10, 100), ("B", "A", "+", 100, 100, 5), ("B", "A", "+", 200, 200, 5), ("B", "A", "+", 500_000, 5_000, 50), ("B", "A", "+", 300_000, 300_000, 2), ("B", "A", "+", 300_050, 300_050, 2)]
    pairs = spark.createDataFrame(rows, "q string, t string, strand string, qs long, ts long, score long")
    got = sorted((r.chain_no, r.anchors, r.raw_score, r.ref_start, r.ref_end) for r in chains.chains(pairs).collect())
    assert got == [(0, 2, 10.0, 100, 200), (1, 2, 4.0, 300_000, 300_050)]
    assert [r.chain_no for r in chains.chains(pairs, chains.Params(min_score=5.0)).collect()] == [0]


def test_stretches_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(5)
    for relative in (False, True):
        p = chains.Params(predecessors=12, max_gap=90, max_ratio=4.0, gap_unit=8.0, gap_weight=0.3, relative=relative)
        bounds, plus, rows = [0], [], []
        for g in range(40):
            plus.append(bool(g % 3))
            # Some stretches are too dense for the window, some have one row.
            places = {(int(a), int(b)) for a, b in rng.integers(0, (1500, 300)[g % 2], (int(rng.integers(0, 60)), 2))} | {(7 * k, (7 * k + k % 3) * (1 if plus[-1] else -1)) for k in range(1 + g % 25)}
            rows += sorted(places, key=lambda x: (x[0], x[1] if plus[-1] else -x[1]))
            bounds.append(len(rows))
        ref, query = np.array(rows).T
        score = rng.integers(1, 12, len(rows)).astype(float)
        found = chains.extract_all(np.array(bounds), ref, query, score, np.array(plus), p)
        for g, got in enumerate(found):
            own = slice(bounds[g], bounds[g + 1])
            assert [(x.tolist(), total) for x, total in got] == [(x.tolist(), total) for x, total in chains.extract(ref[own], query[own], score[own], plus[g], p)]


def test_stretches_go_to_many_tasks(spark):
    rows = [(f"B{k % 300}", "A", "+", 100 * (k // 300), 100 * (k // 300), 5) for k in range(900)]
    found = chains.chains_with_rows(spark.createDataFrame(rows, "q string, t string, strand string, qs long, ts long, score long"))
    stretches = chains._stretches(spark.createDataFrame(rows, "q string, t string, strand string, qs long, ts long, score long"), chains.Params())
    tasks = stretches.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) > 4 and found.count() == sum(r["count"] for r in tasks) == 300
