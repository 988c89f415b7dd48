"""Refined chains, trimming into parts and the context test against slow versions and fixtures."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chains, refinement, trimming

KINDS = "q string, t string, strand string, qs long, ts long, score double, both boolean"


def planted(rng, n):
    """Anchor pairs of one sequence pair on both strands: segments on a few diagonals, and noise."""
    out = {}
    for k in range(n):
        strand = "+" if rng.random() < 0.6 else "-"
        ts, diagonal = int(rng.integers(0, 900)), int(rng.choice([0, 90, 200]))
        qs = ts + diagonal + int(rng.integers(0, 4)) if strand == "+" else 1200 - ts + diagonal
        if rng.random() < 0.2:
            qs = int(rng.integers(0, 1200))
        out[strand, qs, ts] = (float(rng.integers(1, 9)), bool(rng.random() < 0.4))
    # Some pairs stand on both strands, so that one strand's chain takes them from the other.
    for (strand, qs, ts), x in list(out.items())[:10]:
        out["-" if strand == "+" else "+", qs, ts] = x
    return [("B", "A", strand, qs, ts, *x) for (strand, qs, ts), x in out.items()]


def refined_by_hand(primary, left, p, r):
    """(strand, kind, parent, left, right, [(ts, qs)]) by scanning all leftovers for each box."""
    used = {(x["qs"], x["ts"]) for c in primary for x in c["rows"]}
    out = []

    def attempt(strand, box, *kind):
        own = [x for x in left if x[2] == strand and (x[3], x[4]) not in used and box[0] <= x[4] <= box[1] and box[2] <= x[3] <= box[3]]
        own.sort(key=lambda x: (x[4], x[3] if strand == "+" else -x[3]))
        if len(own) < r.min_anchors:
            return
        rows, total = chains.best_chain(np.array([x[4] for x in own]), np.array([x[3] for x in own]), np.array([x[5] for x in own]), strand == "+", p)
        if len(rows) >= r.min_anchors and total >= p.min_score and sum(own[k][6] for k in rows) >= p.min_both:
            used.update((own[k][3], own[k][4]) for k in rows)
            out.append((strand, *kind, [(own[k][4], own[k][3]) for k in rows]))

    for strand in "+-":
        for c in sorted((c for c in primary if c["strand"] == strand), key=lambda c: c["chain_no"]):
            attempt(strand, (c["ref_start"] - r.window, c["ref_end"] + r.window, c["query_start"] - r.window, c["query_end"] + r.window), "around", c["chain_no"], None, None)
    for strand in "+-":
        order = sorted((c for c in primary if c["strand"] == strand), key=lambda c: (c["ref_start"], c["chain_no"]))
        for a, b in zip(order, order[1:]):
            low, high = (a["query_end"], b["query_start"]) if strand == "+" else (b["query_end"], a["query_start"])
            if a["ref_end"] <= b["ref_start"] and low <= high:
                attempt(strand, (a["ref_end"], b["ref_start"], low, high), "between", None, a["chain_no"], b["chain_no"])
    return out


def test_refined_chains_against_scans(spark):
    rng, kinds = np.random.default_rng(8), set()
    for window in (0, 60):
        p, r = chains.Params(predecessors=6, max_gap=120, max_ratio=2.5, gap_unit=8.0, min_anchors=5), refinement.Refinement(window, 3)
        rows = planted(rng, 260) + [("C", "A", "+", 5, 5, 1.0, True)]
        pairs = spark.createDataFrame(rows, KINDS)
        primary = chains.chains_with_rows(pairs, p)
        rest = chains.leftovers(pairs, primary).unionByName(spark.createDataFrame(planted(rng, 260), KINDS))
        rest = spark.createDataFrame(rest.groupBy("q", "t", "strand", "qs", "ts").agg(F.max("score").alias("score"), F.max("both").alias("both")).collect(), KINDS)
        got = refinement.refined_chains(primary, rest, p, r).collect()
        own = [c.asDict(recursive=True) for c in primary.where("q = 'B'").collect()]
        want = refined_by_hand(own, [tuple(x) for x in rest.where("q = 'B'").select("q", "t", "strand", "qs", "ts", "score", "both").collect()], p, r)
        assert sorted(((g.strand, g.refinement, g.parent_no, g.left_no, g.right_no, [(x.ts, x.qs) for x in g.rows]) for g in got), key=str) == sorted(want, key=str)
        for g in got:
            assert g.anchors == len(g.rows) and g.both == sum(x.both for x in g.rows) and g.chain_score == pytest.approx(g.raw_score * (0.2 + 0.8 * g.both_rate))
        taken = [(c["strand"], c["chain_no"]) for c in own] + [(g.strand, g.chain_no) for g in got]
        assert len(set(taken)) == len(taken)
        kinds |= {g.refinement for g in got}
        assert refinement.refined_chains(primary.limit(0), rest, p, r).count() == 0 == refinement.refined_chains(primary, rest.limit(0), p, r).count()
    assert kinds == {"around", "between"}


def trimmed_by_hand(parts, f, p):
    """The fold with every accepted chain, anchor by anchor: [(source, [(ts, qs)], total)]."""

    def made(source, rows):
        raw = rows[0][2]
        for a, b in zip(rows, rows[1:]):
            x = abs((b[0] - a[0]) - abs(b[1] - a[1])) / f.gap_unit
            raw += b[2] - f.gap_weight * x - math.log2(1 + x)
        both = sum(r[3] for r in rows)
        q = [r[1] for r in rows]
        return source, rows, raw * (0.2 + 0.8 * both / len(rows)), both, (rows[0][0], rows[-1][0], min(q), max(q))

    def ratio(a0, a1, b0, b1):
        shared = 0 if a1 <= b0 or b1 <= a0 else min(a1, b1) - max(a0, b0)
        return shared / min(a1 - a0 or 1, b1 - b0 or 1)

    accepted = []
    for low in sorted((made(*x) for x in parts), key=lambda x: (-x[2], -x[3] / len(x[1]), -x[3], -len(x[1]), *x[4], x[0])):
        pieces = [low]
        for high in accepted:
            rest = []
            for piece in pieces:
                a, b = ratio(*piece[4][:2], *high[4][:2]), ratio(*piece[4][2:], *high[4][2:])
                if (a >= p.multimap_overlap and b < p.trim_overlap) or (b >= p.multimap_overlap and a < p.trim_overlap):
                    continue
                if a < p.trim_overlap or b < p.trim_overlap:
                    rest.append(piece)
                    continue
                run, h = [], high[4]
                for x in piece[1]:
                    if h[0] <= x[0] <= h[1] and h[2] <= x[1] <= h[3] and not x[3]:
                        rest += [made(piece[0], run)] if run else []
                        run = []
                    else:
                        run.append(x)
                rest += [made(piece[0], run)] if run else []
            pieces = rest
        accepted += [x for x in pieces if len(x[1]) >= f.min_anchors and x[3] >= f.min_both and x[2] >= f.min_score]
    return accepted


def test_trimming_against_the_whole_fold(spark):
    rng, f = np.random.default_rng(12), chains.Params(gap_unit=20.0, gap_weight=0.05, min_anchors=2)
    split = dropped = 0
    for trim, multimap in ((0.01, 0.5), (0.3, 0.6), (0.2, 0.9)):
        p, rows, given = trimming.Params(trim, multimap), [], []
        for no in range(120):
            n = int(rng.integers(2, 25))
            ts = int(rng.integers(0, 3000)) + np.cumsum(rng.integers(5, 40, n))
            qs = ts + int(rng.choice([0, 30, 900])) + rng.integers(-2, 3, n)
            own = [(int(a), int(b), float(s), bool(x)) for a, b, s, x in zip(ts, np.maximum.accumulate(qs) + np.arange(n), rng.integers(1, 9, n), rng.random(n) < 0.5)]
            part = trimming.Part(no, 0, *(np.array(x) for x in zip(*own)), 0.0, 0.0).cut(np.arange(n), 0, f)
            given.append((no, own))
            rows.append(("B", "A", "+", no, part.raw, part.total, [dict(zip(("ts", "qs", "score", "both"), x)) for x in own]))
        frame = spark.createDataFrame(rows, "q string, t string, strand string, chain_no long, raw_score double, chain_score double, rows array<struct<ts: bigint, qs: bigint, score: double, both: boolean>>")
        got = trimming.trim_chains(frame, f, p).collect()
        want = trimmed_by_hand(given, f, p)
        key = lambda source, own, total: (source, [tuple(x)[:2] for x in own], round(total, 6))
        assert sorted(key(g.source_no, g.rows, g.chain_score) for g in got) == sorted(key(*x[:3]) for x in want)
        assert sorted(g.chain_no for g in got) == list(range(len(got))) and all(g.anchors == len(g.rows) for g in got)
        split += len(got) - len({g.source_no for g in got})
        dropped += len(given) - len({g.source_no for g in got})
    assert split and dropped
    assert trimming.trim_chains(frame, f, trimming.Params(0.0)).count() == 120


def context(spark, rows, strand="+"):
    frame = spark.createDataFrame([("q", "t", strand, k, *map(int, box), float(s), "x") for k, *box, s in rows], "q string, t string, strand string, chain_no long, ref_start long, ref_end long, query_start long, query_end long, chain_score double, violation string")
    return {r.chain_no: r for r in trimming.chain_context(frame).collect()}


def test_context_fixtures(spark):
    left, right = (10, 0, 100, 0, 100, 100), (11, 200, 300, 1000, 1100, 100)
    got = context(spark, [left, right, (12, 1000, 1100, 110, 200, 10)])
    assert {k: r.classification for k, r in got.items()} == {10: "syntenic_skeleton", 11: "syntenic_skeleton", 12: "orphan_gap_cross_copy_rejected"}
    assert (got[12].left_no, got[12].right_no, got[12].bracket_axis, got[12].violation) == (10, 11, "query", 900)
    got = context(spark, [left, right, (13, 1200, 1300, 110, 990, 10)])
    assert got[13].classification == "off_skeleton_structural_candidate" and got[13].boundary_supported and (got[13].left_gap, got[13].right_gap) == (10, 10)
    got = context(spark, [(20, 0, 100, 34000, 34100, 100), (21, 14000, 15000, 35400, 36400, 100), (22, 24000, 25000, 56000, 57000, 100)])
    assert got[21].classification == "off_skeleton_excursion" and got[21].local_gain < 0 and got[21].excursion >= 2000
    assert got[20].classification == got[22].classification == "syntenic_skeleton"
    got = context(spark, [(30, 0, 100, 0, 100, 100), (31, 9000, 10000, 1000, 2000, 100), (32, 11000, 12000, 3000, 4000, 100)])
    assert {r.classification for r in got.values()} == {"syntenic_skeleton"}


def classes_by_hand(rows, plus):
    """The context test with all pairs and scans; rows (no, ref_start, ref_end, query_start, query_end, score) in order."""
    box = [(r[1], r[2], *((r[3], r[4]) if plus else (-r[4], -r[3]))) for r in rows]
    span = [min(max(b[1] - b[0], 1), max(b[3] - b[2], 1)) for b in box]
    weight = [max(0.0, r[5]) + s for r, s in zip(rows, span)]
    diagonal = [b[2] + (b[3] - b[2]) // 2 - b[0] - (b[1] - b[0]) // 2 for b in box]
    step = lambda a, b: 1600.0 * math.log1p(abs((box[b][0] - box[a][1]) - (box[b][2] - box[a][3])) / 1000.0)

    def bones(away):
        order = sorted((k for k in range(len(box)) if k not in away), key=lambda k: (box[k][0], box[k][2], box[k][1]))
        total, back = {}, {}
        for i, k in enumerate(order):
            total[k], back[k] = weight[k], None
            for j in order[:i]:
                if box[j][1] <= box[k][0] and box[j][3] <= box[k][2] and total[j] + weight[k] > total[k]:
                    total[k], back[k] = total[j] + weight[k], j
        k, path = max(order, key=lambda k: (total[k], -order.index(k))), []
        while k is not None:
            path.append(k)
            k = back[k]
        return path[::-1]

    out, away = {}, set()
    while True:
        path, worst = bones(away), None
        for a, k, b in zip(path, path[1:], path[2:]):
            x, y = diagonal[k] - diagonal[a], diagonal[b] - diagonal[k]
            net, less = abs(x + y), min(abs(x), abs(y))
            gain = weight[k] - step(a, k) - step(k, b) + step(a, b)
            if x * y < 0 and less - net >= 2000 and (less - net) / span[k] >= 0.5 and net / less <= 0.25 and gain < 0 and (worst is None or gain < worst[0]):
                worst = gain, k
        if worst is None:
            break
        away.add(worst[1])
        out[worst[1]] = "off_skeleton_excursion"
    for k in range(len(box)):
        if k in out:
            continue
        out[k] = "syntenic_skeleton" if k in path else None
        if out[k]:
            continue
        found = []
        for a in (2, 0):
            b = 2 - a
            left = [j for j in path if box[j][a + 1] <= box[k][a]]
            right = [j for j in path if box[j][a] >= box[k][a + 1]]
            if left and right:
                low, high = max(left, key=lambda j: (box[j][a + 1], -j)), min(right, key=lambda j: (box[j][a], j))
                v = max(0, box[low][b + 1] - box[k][b], box[k][b + 1] - box[high][b])
                size = max(1, box[k][1] - box[k][0], box[k][3] - box[k][2])
                if v:
                    found.append((v / size, max(box[k][a] - box[low][a + 1], box[high][a] - box[k][a + 1]) <= max(500, size // 10)))
        best = max(found, key=lambda x: x[0]) if found else None
        out[k] = "off_skeleton_retained" if best is None else "off_skeleton_structural_candidate" if best[1] else "orphan_gap_cross_copy_rejected" if best[0] >= 0.5 else "off_skeleton_retained"
    return out


def test_context_against_scans(spark):
    rng, seen = np.random.default_rng(9), set()
    for plus in (True, False):
        for spread in (4000, 40_000):
            r0 = rng.integers(0, 60_000, 60)
            q0 = r0 + rng.choice([0, 0, 0, spread, -spread // 2], 60) + rng.integers(0, 300, 60) + 50_000
            q0 = q0 if plus else 160_000 - q0
            rows = sorted({(int(a), int(a + x), int(b), int(b + y), int(s)) for a, b, x, y, s in zip(r0, q0, rng.integers(0, 1500, 60), rng.integers(0, 1500, 60), rng.integers(1, 400, 60))})
            rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
            got = context(spark, [(k, *r) for k, r in enumerate(rows)], "+" if plus else "-")
            want = classes_by_hand([(k, *r) for k, r in enumerate(rows)], plus)
            assert {k: r.classification for k, r in got.items()} == want
            seen |= set(want.values())
    assert {"syntenic_skeleton", "off_skeleton_excursion", "orphan_gap_cross_copy_rejected"} <= seen


def test_chains_with_noise_equal_chaining_the_rest_again():
    from tests.test_operators import greedy_by_hand

    rng = np.random.default_rng(31)
    for plus in (True, False):
        rows = sorted({(x[4], x[3] if plus else -x[3]): x[5] for x in planted(rng, 500)}.items(), key=lambda x: (x[0][0], x[0][1] if plus else -x[0][1]))
        rows = [(a, b, s) for (a, b), s in rows]
        p = chains.Params(predecessors=7, max_gap=120, max_ratio=2.5, gap_unit=8.0, gap_weight=0.3)
        ref, query, score = map(np.array, zip(*rows))
        got = [(round(total, 6), [rows[k][:2] for k in own.tolist()]) for own, total in chains.extract(ref, query, score, plus, p)]
        assert got == greedy_by_hand(rows, plus, p) and max(len(x[1]) for x in got) > 8


def test_a_pair_is_refined_from_boxes_and_free_anchors_alone():
    # No anchors of primary chains are held; what one strand's chain uses is gone for the other.
    boxes = pd.DataFrame({"strand": ["+", "-"], "chain_no": [0, 0], "ref_start": [0, 0], "ref_end": [50, 50], "query_start": [0, 0], "query_end": [50, 50]})
    free = pa.table({"strand": ["+"] * 3 + ["-"] * 3, "ts": [10, 20, 30] * 2, "qs": [10, 20, 30, 30, 20, 10], "score": [5.0] * 6, "both": [True] * 6})
    p, r = chains.Params(max_gap=100, gap_weight=0.0), refinement.Refinement(0, 2)
    found = [(strand, kind, rows[0].tolist(), rows[1].tolist()) for strand, kind, _, _, _, rows, _ in refinement.refine_pair(boxes, free, p, r)]
    assert found == [("+", "around", [10, 20, 30], [10, 20, 30]), ("-", "around", [10, 30], [30, 10])]
