"""Extensions of bundles and patch quality against base-by-base versions and fixtures."""

import re

import numpy as np
import pytest

from tessera.operators import chains, extension, patching

BUNDLES = "q string, t string, strand string, chain_no long, ref_start long, ref_end long, query_start long, query_end long, score double"
PAIRS = "q string, t string, strand string, qs long, ts long, score double, both boolean"


def run(spark, bundles, pairs, e):
    made = spark.createDataFrame([("q", "t", *b) for b in bundles], BUNDLES)
    attempts = extension.extension_attempts(made, spark.createDataFrame([("q", "t", *p) for p in pairs], PAIRS), e)
    return made, attempts, {(r.strand, r.left_no): r for r in attempts.collect()}


def test_outcomes(spark):
    e = extension.Extension(chains.Params(max_gap=2000, max_ratio=1.5, gap_unit=10.0, gap_weight=0.0), min_anchors=2, min_score=5.0, half=10, cell=128)
    bundles = [("+", 0, 0, 100, 0, 100, 9.0), ("+", 1, 500, 600, 500, 600, 9.0), ("+", 2, 600, 700, 900, 950, 9.0), ("+", 3, 5000, 5100, 5000, 5100, 9.0), ("+", 4, 5400, 5500, 5100, 5200, 9.0), ("+", 5, 5600, 5700, 5300, 5400, 9.0), ("+", 6, 5750, 5800, 5450, 5500, 9.0), ("+", 7, 5900, 6000, 5300, 5350, 1.0)]
    bundles += [("-", 0, 0, 100, 900, 1000, 9.0), ("-", 1, 500, 600, 500, 600, 9.0)]
    pairs = [("+", 100 + x, 100 + x, 4.0, False) for x in (60, 120, 180)] + [("+", 750, 20, 4.0, True), ("+", 300, 200, 50.0, False), ("+", 5250, 5550, 4.0, False), ("+", 5260, 5560, 4.0, False), ("+", 5425, 5725, 4.0, False)]
    pairs += [("-", 900 - x, 100 + x, 4.0, False) for x in (60, 150, 295, 350)] + [("-", 395, 495, 4.0, False)]
    made, attempts, got = run(spark, bundles, pairs, e)
    said = {k: (r.classification, r.stop_reason, r.candidates, r.anchors) for k, r in got.items()}
    assert said[("+", 0)] == ("partial_extension", "best_partial_path", 4, 3)
    assert (got[("+", 0)].remaining_ref_gap, got[("+", 0)].remaining_query_gap, got[("+", 0)].new_ref_end) == (210, 210, 290)
    assert said[("+", 1)] == ("query_dup_branch", "copy_support", 0, 0) and got[("+", 1)].copy_support == 1
    assert said[("+", 2)] == ("unresolved_gap", "gap_too_large", 0, 0)
    assert said[("+", 3)] == ("query_deletion", "single_axis_reached", 0, 0)
    assert said[("+", 4)] == ("partial_extension", "best_partial_path", 2, 2)
    assert said[("+", 5)] == ("unresolved_gap", "below_threshold", 1, 1) and ("+", 6) not in said  # the last two cross on the query axis
    assert said[("-", 0)] == ("partial_extension", "best_partial_path_overlap_clipped", 3, 2)
    after = {(r.strand, r.chain_no): r for r in extension.extended(made, attempts).collect()}
    assert len(after) == len(bundles) and after["+", 0].extended and after["+", 0].ref_end == 290 and after["+", 0].score > 9 and not after["+", 1].extended
    assert after["-", 0].query_start < 900 and after["-", 0].query_end == 1000
    assert run(spark, bundles[:1], pairs, e)[2] == {}


def attempt_by_hand(gap, rows, e):
    """The best path by all predecessors in loops: (score, anchors) before any clipping."""
    plus, p = gap["strand"] == "+", e.steps
    nodes = [(gap["l_ref_end"], gap["l_query_end"] if plus else gap["l_query_start"], 0.0)] + sorted(rows, key=lambda x: (x[0], x[1] if plus else -x[1]))
    total, size = [0.0] + [None] * len(rows), [0] * len(nodes)
    for i in range(1, len(nodes)):
        for j in range(i - 1, max(0, i - p.predecessors) - 1, -1):
            dr, dq = nodes[i][0] - nodes[j][0], (nodes[i][1] - nodes[j][1]) * (1 if plus else -1)
            if total[j] is None or min(dr, dq) <= 0 or max(dr, dq) > p.max_gap or max(dr, dq) > p.max_ratio * min(dr, dq):
                continue
            x = abs(dr - dq) / p.gap_unit
            value = total[j] + nodes[i][2] - p.gap_weight * x - np.log2(1 + x)
            if total[i] is None or value > total[i]:
                total[i], size[i] = value, size[j] + 1
    reached = [(t, n) for t, n in zip(total[1:], size[1:]) if t is not None]
    return max(reached, key=lambda x: x[0]) if reached else None


def test_paths_against_loops():
    rng, found = np.random.default_rng(1), 0
    e = extension.Extension(chains.Params(predecessors=5, max_gap=300, max_ratio=2.5, gap_unit=10.0, gap_weight=0.1), min_anchors=1, min_score=-1e9, half=0)
    for plus in (True, False):
        for _ in range(40):
            ts, qs = rng.integers(101, 499, 25), rng.integers(101, 499, 25)
            l_q, r_q = ((0, 100), (500, 600)) if plus else ((500, 600), (0, 100))
            gap = {"strand": "+" if plus else "-", "l_ref_start": 0, "l_ref_end": 100, "l_query_start": l_q[0], "l_query_end": l_q[1], "r_ref_start": 500, "r_ref_end": 600, "r_query_start": r_q[0], "r_query_end": r_q[1]}
            rows = sorted({(int(a), int(b)): float(s) for a, b, s in zip(ts, qs, rng.integers(1, 9, 25))}.items())
            rows = [(a, b, s) for (a, b), s in rows]
            got = extension.attempt(gap, *(np.array(x) for x in zip(*rows)), e)
            want = attempt_by_hand(gap, rows, e)
            if want is None:
                assert got["stop_reason"] == "no_reachable_candidate"
                continue
            found += 1
            assert (got["extension_score"], got["anchors"]) == (pytest.approx(want[0]), want[1])
    assert found > 40


def quality_by_hand(cigar, p):
    """Base by base, as a list of (kind, long) columns."""
    runs = [(int(n), op) for n, op in re.findall("([0-9]+)([=XID])", cigar)]
    segments, flat = [[]], []
    for n, op in runs:
        if op in "ID" and n >= p.long_indel:
            segments.append([])
        else:
            segments[-1] += [op != "="] * n
            flat += [op != "="] * n
    worst = 0.0
    for s in segments:
        w = min(p.window, len(s))
        worst = max([worst] + [sum(s[k : k + w]) / w for k in range(len(s) - w + 1) if w])
    ends = [1 - sum(x) / len(x) if x else 0.0 for x in (flat[: p.window], flat[-p.window :])]
    return worst, ends[0], ends[1]


def test_patch_quality(spark):
    rng, p = np.random.default_rng(3), patching.Quality(window=20, long_indel=15, flank=10)
    cigars = ["", "5=", "3X", "40I", "400=150I400=", "300=120I300=130I250=", "300=120I300=130D250=", "300=3X120D300="]
    for _ in range(200):
        cigars.append("".join(f"{rng.integers(1, 30)}{'=XID'[rng.integers(0, 4)]}" for _ in range(rng.integers(1, 12))))
    for c in cigars:
        got = patching.patch_quality_of(c, p)
        assert (got["error_density"], got["left_identity"], got["right_identity"]) == pytest.approx(quality_by_hand(c, p))
    rows = {r.cigar: r for r in patching.patch_quality(spark.createDataFrame([(c,) for c in [*cigars, None, "5="]], "cigar string")).collect()}
    assert len(rows) == len(set(cigars)) and rows["5="].identity == 1.0 and rows[""].identity == 1.0
    assert [rows[c].rescue for c in cigars[4:8]] == ["long_indel", "multi_event", "none", "long_indel"]
    assert rows["40I"].low_quality and not rows["400=150I400="].low_quality
