"""Alignment, trimming, components and formats against brute force and fixtures."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import alignment, assignment, components, records, trimming
from tessera.sources import formats


def align_by_hand(a, b):
    s = [[-(i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i][j - 1] - 1, s[i - 1][j] - 1)
    return s[-1][-1]


def test_global_alignment():
    import re

    assert alignment.global_alignment("ACGTAC", "ACGTAC") == ("6=", 6, 6)
    assert alignment.global_alignment("", "AC") == ("2I", -2, 0) and alignment.global_alignment("AC", "") == ("2D", -2, 0) and alignment.global_alignment("", "") == ("", 0, 0)
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = ("".join(rng.choice(list("ACGT"), rng.integers(0, 20))) for _ in range(2))
        cigar, score, matches = alignment.global_alignment(a, b)
        assert score == align_by_hand(a, b)
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([=XID])", cigar)]
        assert sum(n for n, o in ops if o in "=XD") == len(a) and sum(n for n, o in ops if o in "=XI") == len(b)
        assert sum(n for n, o in ops if o == "=") == matches and score == matches - sum(n for n, o in ops if o != "=")


def test_bounded_distance_fixtures():
    cases = [([1, 2, 3], [1, 2, 3], 3, 0), ([1, 2, 3], [1, 9, 3], 3, 1), ([1, 2, 3], [1, 2, 8, 3], 3, 1), ([1, 2, 8, 3], [1, 2, 3], 3, 1), ([1, 2, 3, 4], [1, 9, 3, 8, 4], 5, 2), ([], [1, 2], 2, 2), ([1, 2], [], 2, 2), ([1, 2, 3], [1], 1, 2), ([1, 2, 3], [9, 8, 7], 2, 3), ([1, 2, 3], [9, 8, 3], 2, 2)]
    for left, right, limit, want in cases:
        assert alignment.bounded_distance(left, right, limit) == want


def test_edit_steps():
    rng = np.random.default_rng(7)
    for _ in range(40):
        a, b = (rng.choice(list("abc"), rng.integers(0, 12)).tolist() for _ in range(2))
        steps = alignment.edit_steps(a, b)
        assert sum(op != "match" for op, _ in steps) == alignment.bounded_distance(a, b, 30)
        assert [i for op, i in steps if op != "insertion"] == list(range(len(a)))
        assert sum(op != "deletion" for op, _ in steps) == len(b)


def test_pairs_in_spark(spark):
    rows = spark.createDataFrame([(1, "ACGT", "AGT"), (2, "A" * 30, "A" * 30)], "pair_id long, ref string, query string")
    got = {r.pair_id: (r.cigar, r.score) for r in alignment.align_pairs(rows, most_cells=100).collect()}
    assert got == {1: ("1=1D2=", 2), 2: ("30=", 30)}
    tokens = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "b", "a"])], "pair_id long, left array<string>, right array<string>")
    assert tuple(alignment.token_distances(tokens).first()) == (1, 2, 0)


def test_skeleton_of_what_is_left_needs_no_new_search():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        r0, q0 = rng.integers(0, 80, n), rng.integers(0, 80, n)
        r1, q1, w = r0 + rng.integers(0, 15, n), q0 + rng.integers(0, 15, n), rng.integers(1, 6, n).astype(np.float64)
        made, left = trimming.Skeleton(r0, r1, q0, q1, w), np.arange(n)
        while len(left):
            path = made.heaviest()
            assert path == left[trimming.skeleton(r0[left], r1[left], q0[left], q1[left], w[left])].tolist()
            gone = int(rng.choice(path))
            made.leave(gone)
            first, searched = int(made.place[gone]), list(made.total)
            made.heaviest()
            assert made.total[: first + 1] == searched[: first + 1]
            left = left[left != gone]
        assert made.heaviest() == []


def test_skeleton_against_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(20):
        r0, q0 = rng.integers(0, 60, (2, 8))
        r1, q1, w = r0 + rng.integers(1, 12, 8), q0 + rng.integers(1, 12, 8), rng.integers(1, 9, 8)
        best = 0
        for code in range(256):
            own = sorted((k for k in range(8) if code >> k & 1), key=lambda k: r0[k])
            if all(r1[a] <= r0[b] and q1[a] <= q0[b] for a, b in zip(own, own[1:])):
                best = max(best, sum(w[k] for k in own))
        assert sum(w[k] for k in trimming.skeleton(r0, r1, q0, q1, w)) == best


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 60), (60, 70), (9, 9), (99, 99)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(31)} | {50: 50, 60: 50, 70: 50, 99: 99}


def test_formats(spark, tmp_path):
    path = tmp_path / "one.fa"
    path.write_text(">chr1 words\nACGT\nacgn\n>empty\n>bad\nAC-T\n")
    got = {r.sequence_id: (r.sample, r.seq, r.valid) for r in formats.read_fasta(spark, str(path)).collect()}
    assert got == {"chr1": ("one", "ACGTACGN", True), "empty": ("one", "", False), "bad": ("one", "AC-T", False)}
    vcf = spark.createDataFrame([("#CHROM",), ("c1\t5\tx\tA\tATT\t.\tPASS\t.",), ("c1\t9\ty\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-40;END=49;FLAG;A=1;A=2",)], "value string")
    rows = {r.id: r for r in formats.parse_vcf(vcf).collect()}
    assert (rows["x"].kind, rows["x"].size, rows["x"].end) == ("INS", 2, 5)
    assert (rows["y"].kind, rows["y"].size, rows["y"].end, rows["y"].info["FLAG"], rows["y"].info["A"]) == ("DEL", 40, 49, "true", "2")
    frame = spark.createDataFrame([(1, None), (2, "b")], "a long, b string")
    assert [tuple(r) for r in formats.undotted(formats.dotted(frame), {"a": "long"}).orderBy("a").collect()] == [(1, None), (2, "b")]
    segments = spark.createDataFrame([("s1", "AC"), ("s2", "G")], "segment string, seq string")
    steps = spark.createDataFrame([("p", 0, "s1", "+"), ("p", 1, "s2", "-"), ("r", 0, "s1", "+"), ("r", 1, "s2", "-")], "path string, step_no long, segment string, orient string")
    lines = sorted(r.value for r in formats.graph_lines(segments, steps).collect())
    assert lines == sorted(["H\tVN:Z:1.0", "S\ts1\tAC", "S\ts2\tG", "L\ts1\t+\ts2\t-\t0M", "P\tp\ts1+,s2-\t*", "P\tr\ts1+,s2-\t*"])
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(2, "c", 9)], "k long, x string, y long")
    assert sorted((r.k, r.x, r.y) for r in formats.upsert(base, new, ["k"]).collect() if r.y or True) == [(1, "a", None), (2, "c", 9)]


def matched_by_hand(edges):
    """Size of a largest matching, by augmenting each left end in turn."""
    around = {}
    for u, v in edges:
        around.setdefault(u, set()).add(v)
    taken = {}

    def augment(u, seen):
        for v in around[u] - seen:
            seen.add(v)
            if v not in taken or augment(taken[v], seen):
                taken[v] = u
                return True
        return False

    return sum(augment(u, set()) for u in sorted(around))


def test_maximum_matching_against_augmenting_by_hand(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 150), rng.integers(0, 45, 150))] + [(100, 200), (100, 200), (101, 200), (101, 201)]
    got = [tuple(r) for r in records.maximum_matching(spark.createDataFrame(edges, "left_id long, right_id long")).collect()]
    assert len(got) == matched_by_hand(edges) and set(got) <= set(edges)
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    assert records.maximum_matching(spark.createDataFrame([], "left_id long, right_id long")).count() == 0


def test_cigar_runs_and_fetch(spark):
    rows = spark.createDataFrame([("3=2=1X0I4D1D2=",), ("5=",), ("",), ("2I3=",)], "c string")
    c = F.col("c")
    got = {r.c: (r.m, r.a, r.b, r.t) for r in rows.select("c", records.merged_runs(c).alias("m"), records.exact_flanks(c)[0].alias("a"), records.exact_flanks(c)[1].alias("b"), records.without_leading_match(c, 2).alias("t")).collect()}
    assert got == {"3=2=1X0I4D1D2=": ("5=1X5D2=", 3, 2, "1=2=1X0I4D1D2="), "5=": ("5=", 5, 5, "3="), "": ("", 0, 0, ""), "2I3=": ("2I3=", 0, 3, "2I3=")}
    seqs = spark.createDataFrame([(1, "acgtn" * 9), (2, "AC"), (3, "")], "sequence_id long, seq string")
    wanted = spark.createDataFrame([(1, 3, 40, "+"), (1, 3, 40, "-"), (2, 0, 9, "+"), (2, 1, 1, "+"), (9, 0, 1, "+")], "sequence_id long, start long, end long, strand string")
    found = {(r.sequence_id, r.strand): r.bases for r in records.fetch(records.chunked(seqs, 7), wanted, 7).collect()}
    text = ("ACGTN" * 9)[3:40]
    assert found == {(1, "+"): text, (1, "-"): text[::-1].translate(str.maketrans("ACGT", "TGCA")), (2, "+"): "AC"}


def test_token_distance_and_strands(spark):
    rng = np.random.default_rng(1)
    rows = [([str(x) for x in rng.integers(0, 5, rng.integers(0, 7))], [str(x) for x in rng.integers(0, 5, rng.integers(0, 7))]) for _ in range(80)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = frame.select("a", "b", assignment.token_distance(F.col("a"), F.col("b")).alias("d"), assignment.pair_strand(F.col("a"), F.col("b"), F.reverse("b")).alias("s")).collect()
    for r in got:
        assert r.d == distance(r.a, r.b)
        assert r.s == ("." if (r.a == r.b) == (r.a == r.b[::-1]) else "+" if r.a == r.b else "-")
