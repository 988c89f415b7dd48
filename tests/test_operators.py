"""Order-dependent operators against brute force, and the published fixtures of scalar functions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import sequence as fx
from tessera.operators import anchors, chains, tokens
from tessera.sources.paf import parse_lines, to_lines


def test_reverse_complement_and_orientation(spark):
    rows = spark.createDataFrame([("ARYN",), ("ACGTAC",), ("GTACGT",), ("ACGT",), ("",)], "s string")
    rc = fx.reverse_complement(F.col("s"))
    got = {r.s: (r.rc, r.o) for r in rows.select("s", rc.alias("rc"), fx.orientation(F.col("s"), rc).alias("o")).collect()}
    assert got == {"ARYN": ("NRYT", "+"), "ACGTAC": ("GTACGT", "+"), "GTACGT": ("ACGTAC", "-"), "ACGT": ("ACGT", "."), "": ("", ".")}


def test_plateaus_against_a_loop():
    rng = np.random.default_rng(5)
    start = np.unique(rng.integers(0, 900, 400))
    score = rng.integers(0, 3, len(start))
    runs = [[0]]
    for k in range(1, len(start)):
        if score[k] != score[k - 1] or start[k] - start[k - 1] > 20:
            runs.append([])
        runs[-1].append(k)
    number, dist2 = anchors.plateaus(start, score, 20)
    for no, run in enumerate(runs, 1):
        for k in run:
            assert number[k] == no and dist2[k] == abs(2 * start[k] - start[run[0]] - start[run[-1]])


def test_long_kmers_are_counted_like_short_ones(spark):
    rows = spark.createDataFrame([("ACGTACGTACGTNACGTACGTACGT",), ("ACGTACGTACGT",), ("ACG",), (None,)], "seq string")
    got = {r.kmer: r.freq for r in anchors.kmer_frequency(rows, 12).collect()}
    assert got == {"ACGTACGTACGT": 3}
    short = {r.kmer: r.freq for r in anchors.kmer_frequency(rows, 3).collect()}
    assert short == {r.kmer: r.freq for r in anchors._counted_as_text(rows, 3).collect()}


def test_suppression_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(a), int(a) + 50, int(rng.integers(0, 5)), int(rng.integers(0, 9))) for s in range(4) for a in np.unique(rng.integers(0, 1500, 120))]
    frame = spark.createDataFrame(rows, "sequence_id long, start long, end long, score_q long, dist2_from_center long")
    want = set()
    for s in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[4], r[1])):
            if all(abs(r[1] - k) > 60 for k in kept):
                kept.append(r[1])
        want |= {(s, k) for k in kept}
    for rounds in (12, 1, 0):
        got = []
        for s in range(4):
            own = sorted(r for r in rows if r[0] == s)
            start, score, dist2 = (np.array([r[c] for r in own]) for c in (1, 3, 4))
            got += [own[k] for k in np.flatnonzero(anchors.suppressed(start, score, dist2, 60, rounds))]
        assert {(r[0], r[1]) for r in got} == want
    kept = spark.createDataFrame(got, frame.schema)
    chosen = anchors.select_anchors(kept, 10_000, 1000.0).collect()
    assert sorted(r.anchor_id for r in chosen) == [f"anchor_{k:08d}" for k in range(10)]
    assert [(r.sequence_id, r.start) for r in sorted(chosen, key=lambda r: r.anchor_id)] == sorted((r.sequence_id, r.start) for r in chosen)


def chain_by_hand(rows, plus, p):
    best, back = [], []
    for i, (r, q, s) in enumerate(rows):
        value, at = 0.0, -1
        for j in range(i - 1, max(-1, i - 1 - p.predecessors), -1):
            dr, dq = r - rows[j][0], (q - rows[j][1]) * (1 if plus else -1)
            if 0 < dr <= p.max_gap and 0 < dq <= p.max_gap and max(dr, dq) <= p.max_ratio * min(dr, dq):
                x = abs(dr - dq) / (max(1, min(dr, dq)) if p.relative else p.gap_unit)
                v = best[j] - (p.gap_weight * x + (np.sqrt(1 + x) - 1 if p.relative else np.log2(1 + x)))
                if v > value:
                    value, at = v, j
        best.append(s + value)
        back.append(at)
    k, out = int(np.argmax(best)), []
    total = best[k]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1], total


def test_chain_programme_against_loops():
    rng = np.random.default_rng(4)
    p = chains.Params(predecessors=10, max_gap=400)
    for plus in (True, False):
        for _ in range(20):
            rows = sorted({(int(a), int(b)): int(s) for a, b, s in rng.integers(0, 600, (40, 3))}.items(), key=lambda x: (x[0][0], x[0][1] if plus else -x[0][1]))
            rows = [(a, b, s) for (a, b), s in rows]
            ref, query, score = map(np.array, zip(*rows))
            got, total = chains.best_chain(ref, query, score, plus, p)
            want, best = chain_by_hand(rows, plus, p)
            assert got == want and abs(total - best) < 1e-9


def test_chains_fixture(spark):
    rows = [("B", "A", "+", 0, 0, 5), ("B", "A", "+", 200, 200, 12), ("B", "A", "-", 100, 100, 10), ("B", "A", "+", 200, 200, 12)]
    pairs = spark.createDataFrame(rows, "q string, t string, strand string, qs long, ts long, score long")
    got = chains.chains(pairs, chains.Params(min_anchors=1)).collect()
    assert {(r.strand, r.anchors, r.raw_score) for r in got} == {("+", 2, 17.0), ("-", 1, 10.0)}
    rows = [(*r, k == 0) for k, r in enumerate(rows[:2])]
    scored = chains.chains(spark.createDataFrame(rows, "q string, t string, strand string, qs long, ts long, score long, both boolean")).first()
    assert (scored.both, scored.both_rate) == (1, 0.5) and abs(scored.chain_score - 10.2) < 1e-9
    assert chains.chains(pairs, chains.Params(min_both=1)).count() == 0


def greedy_by_hand(rows, plus, p):
    """All chains of a track, best first, each time chaining all that is left: (score, rows)."""
    left, out = list(rows), []
    while left:
        got, total = chain_by_hand(left, plus, p)
        if total < p.min_score:
            break
        out.append((round(float(total), 6), [left[k][:2] for k in got]))
        left = [r for k, r in enumerate(left) if k not in got]
    return out


def test_chains_of_stretches_equal_chaining_the_rest_again():
    rng = np.random.default_rng(7)
    for plus in (True, False):
        for relative in (True, False):
            p = chains.Params(predecessors=8, max_gap=60, max_ratio=4.0, relative=relative)
            rows = sorted({(int(a), int(b)): int(s) for a, b, s in rng.integers(0, 400, (60, 3))}.items(), key=lambda x: (x[0][0], x[0][1] if plus else -x[0][1]))
            rows = [(a, b, s) for (a, b), s in rows]
            ref, query, score = map(np.array, zip(*rows))
            got = [(round(total, 6), [rows[k][:2] for k in own.tolist()]) for own, total in chains.extract(ref, query, score, plus, p)]
            assert got == greedy_by_hand(rows, plus, p)


def test_alignment_lines_round_trip(spark):
    kinds = "qname string, qlen long, qs long, qe long, strand string, tname string, tlen long, ts long, te long, matches long, block long, mapq long, tags map<string,string>"
    rows = spark.createDataFrame([("q1", 20, 1, 9, "+", "t1", 30, 3, 11, 7, 8, 60, {"tp:A": "P", "cg:Z": "8="}), ("q2", 4, 0, 4, "-", "t2", 9, 5, 9, 4, 4, 0, {}), ("q3", None, 0, 4, "-", "t2", 9, 5, 9, 4, 4, 0, {})], kinds)
    lines = to_lines(rows).unionByName(spark.createDataFrame([("# comment",), ("",)], "value string"))
    got = sorted(parse_lines(lines).collect(), key=lambda r: r.qname)
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(rows.collect(), key=lambda r: r.qname)]


def test_fingerprints_of_fixed_width(spark):
    grams = [["A:x", "D:1"], ["D:1", "A:x"], ["A:x,D:1"], ["A:x"], ["A:" + "y" * 300, "D:2", "A:z"]]
    rows = spark.createDataFrame([(g,) for g in grams], "gram array<string>")
    got = [r[0] for r in rows.select(tokens.fingerprint("gram")).collect()]
    want = [hashlib.sha256(b"".join(len(x.encode()).to_bytes(4, "little") + x.encode() for x in min(g, g[::-1]))).hexdigest()[:32] + f":{len(g)}" for g in grams]
    assert got == want and got[0] == got[1] and len(set(got)) == 4
