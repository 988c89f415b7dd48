"""Candidates by edit distance against all pairs, for many tokens and every relation of alphas and lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assignment, tokens


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_candidates_equal_all_pairs(spark):
    rng, anchors, alphas = np.random.default_rng(17), [], []
    base = [[f"t{x}" for x in rng.integers(0, 9, n)] for n in (1, 2, 4, 7, 7)]
    for k in range(150):
        toks = list(base[rng.integers(0, 5)])
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(toks) + 1))
            toks[at : at + int(rng.integers(0, 2))] = [f"t{rng.integers(0, 9)}"] * int(rng.integers(0, 2))
        toks = toks[::-1] if rng.random() < 0.3 else toks
        anchors.append((k, f"s{k % 3}", f"g{k % 2}", f"c{k}", toks or ["t0"]))
        alphas += [(k, f"s{x}", int(rng.integers(1, 8))) for x in range(3) if x != k % 3 and rng.random() < 0.8]
    found = spark.createDataFrame(anchors, "anchor_id long, sample string, group_id string, context_key string, tokens array<string>")
    alpha = spark.createDataFrame(alphas, "anchor_id long, of_sample string, alpha long")
    level = {(k, x): v for k, x, v in alphas}
    for least in (2, 6):
        p = assignment.Params(min_score=least)
        got = {(r.query_anchor_id, r.target_anchor_id): (r.edit_distance, r.strand, r.score) for r in assignment.scored_candidates(assignment.queries(found, alpha, found), found, alpha, p).collect()}
        want = {}
        for i, si, gi, _, a in anchors:
            for j, sj, gj, _, b in anchors:
                q, r = level.get((i, sj), 0), level.get((j, si), 0)
                if gi == gj and si != sj and q and r:
                    plus, minus = distance(a, b), distance(a[::-1], b)
                    if q + r - min(plus, minus) > least:
                        want[i, j] = (min(plus, minus), "-" if minus < plus else "+", q + r - min(plus, minus))
        assert got == want and len(want) > 50


def test_many_different_tokens(spark):
    a, b = [f"x{k}" for k in range(200)], [f"x{k}" for k in range(190)] + [f"y{k}" for k in range(10)]
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert row.select(assignment.token_distance(F.col("a"), F.col("b"))).first()[0] == 10
    with pytest.raises(Exception, match="different tokens"):
        row.select(assignment.token_distance(F.col("a"), F.col("b"), 100)).collect()


def test_rows_of_anchors_times_samples_are_narrow_and_contexts_need_no_join(spark):
    rows = spark.createDataFrame([(k, k % 3, f"s{k % 3}", 40 * k, f"v:{k % 2}", k != 4) for k in range(9)], "anchor_id long, sequence_id long, sample string, center long, group_id string, groupable boolean")
    contexts = tokens.anchor_contexts(tokens.structural_tokens(rows, keep=("center", "group_id")), keep=("center", "group_id"))
    plain = tokens.anchor_contexts(tokens.structural_tokens(rows)).join(rows.select("anchor_id", "center", "group_id"), "anchor_id")
    assert sorted(contexts.select(plain.columns).collect()) == sorted(plain.collect()) and contexts.count() == 8
    alpha = spark.createDataFrame([(0, "s1", 7)], "anchor_id long, of_sample string, alpha long")
    asked = assignment.queries(contexts, alpha, contexts)
    assert set(asked.columns) == {"query_anchor_id", "query_sample", "target_sample", "q_alpha"}
    assert asked.count() == 16 and asked.where("q_alpha = 7").count() == 1
