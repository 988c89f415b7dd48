"""Wavefronts, stitched alignments, strand votes and truth builders against tables, loops and fixtures."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import stitching, truth, wavefront
from tessera.operators.alignment import global_alignment


def consumed(cigar, ref, query):
    """Walks a CIGAR over both texts: (score, matches); fails where it claims what the texts don't have."""
    i = j = matches = total = 0
    runs = re.findall("([0-9]+)([=XID])", cigar)
    assert "".join(n + op for n, op in runs) == cigar and all(a[1] != b[1] for a, b in zip(runs, runs[1:]))
    for n, op in runs:
        n = int(n)
        total += n
        if op in "=X":
            assert all((a == b) == (op == "=") for a, b in zip(ref[i : i + n], query[j : j + n]))
            matches += n * (op == "=")
        i, j = i + n * (op != "I"), j + n * (op != "D")
    assert (i, j) == (len(ref), len(query))
    return 2 * matches - total, matches


def altered(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = int(rng.integers(0, len(out) + 1)), rng.integers(0, 3)
        if kind == 0 and k < len(out):
            out[k] = "ACGT"[rng.integers(0, 4)]
        elif kind == 1:
            out.insert(k, "ACGT"[rng.integers(0, 4)] * int(rng.integers(1, 4)))
        elif k < len(out):
            del out[k : k + int(rng.integers(1, 4))]
    return "".join(out)


def test_wavefronts_score_like_the_whole_table(monkeypatch):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join("ACGT"[k] for k in rng.integers(0, 4, n))
    cases = [("", ""), ("", "ACG"), ("A", ""), ("A", "C"), ("ACGT" * 9, "ACGT" * 9)]
    cases += [(letters(int(a)), letters(int(b))) for a, b in rng.integers(0, 90, (60, 2))]
    for n in (40, 200, 900):
        for edits in (0, 1, 8, 60):
            text = letters(n)
            cases.append((text, altered(rng, text, edits)))
    for kept in (1500, 12, 40):
        monkeypatch.setattr(wavefront, "COST_KEPT", kept)  # beyond it, wavefronts from both ends meet
        for ref, query in cases:
            cigar, score, matches = wavefront.wave_alignment(ref, query)
            assert consumed(cigar, ref, query) == (score, matches)
            assert score == global_alignment(ref, query)[1], (ref, query, kept)


def test_long_texts_are_aligned():
    rng = np.random.default_rng(4)
    text = "".join("ACGT"[k] for k in rng.integers(0, 4, 60_000))
    other = altered(rng, text, 900)
    cigar, score, matches = wavefront.wave_alignment(text, other)
    assert consumed(cigar, text, other) == (score, matches) and matches > 57_000


PAIRS = "pair_id long, ref string, query string, strand string, anchors array<struct<ref_start: bigint, ref_end: bigint, query_start: bigint, query_end: bigint>>"
TURN = str.maketrans("ACGT", "TGCA")


def test_stitched_alignments(spark):
    rng, rows, sides = np.random.default_rng(6), [], {}
    for k in range(24):
        ref = "".join("ACGT"[x] for x in rng.integers(0, 4, int(rng.integers(500, 1500))))
        copy = altered(rng, ref, int(rng.integers(0, 12)))
        turned = k % 3 == 0
        query = copy.translate(TURN)[::-1] if turned else copy
        anchors = []
        for p in range(0, len(ref) - 20, 90):
            at = copy.find(ref[p : p + 20])
            if at >= 0:
                a = len(copy) - at - 20 if turned else at
                anchors.append((p, p + 20, a, a + 20))
        anchors += [(5, 5, 5, 5), (10, 30, len(query) + 5, len(query) + 25)] + [(0, 5, 7, 12), (40, 60, 10, 30)] * (not turned)
        rows.append((k, ref.lower() if k == 7 else ref, query, "+", anchors))
        sides[k] = ref, copy
    rows += [(90, "ACGT", "ACGT", "-", []), (91, "ACGTACGT", "TTTTTTTT", "-", [(0, 4, 0, 4)]), (92, "AACC", "AACC", "+", None), (93, "", "", "+", [])]
    got = {r.pair_id: r for r in stitching.anchor_guided(spark.createDataFrame(rows, PAIRS)).collect()}
    assert len(got) == len(rows)
    for k, (ref, copy) in sides.items():
        if k == 7:
            continue
        r = got[k]
        assert r.strand == ("-" if k % 3 == 0 else "+") and r.guides >= 1
        assert consumed(r.cigar, ref, copy) == (r.score, r.matches) and r.block_length == 2 * r.matches - r.score
        assert global_alignment(ref, copy)[1] - 40 <= r.score <= global_alignment(ref, copy)[1]
    assert all((got[k].cigar, got[k].score, got[k].guides) == (None, None, 0) for k in (90, 91, 92, 93))
    votes = {r.pair_id: (r.forward, r.reverse, r.incompatible, r.effective) for r in stitching.strand_votes(spark.createDataFrame([(1, "AACC", "AACC", "-", [(0, 4, 0, 4)]), (2, "AACC", "GGTT", "+", [(0, 4, 0, 4), (0, 2, 0, 2)]), (3, "AACC", "GGTT", "-", [(0, 2, 0, 3)]), (4, "AC", "AC", ".", None)], PAIRS)).collect()}
    assert votes == {1: (1, 0, 0, "+"), 2: (0, 1, 1, "-"), 3: (0, 0, 1, "-"), 4: (0, 0, 0, ".")}
    assert stitching.segment_alignment("", "") == ("", 0, 0) and stitching.segment_alignment("", "AC") == ("2I", -2, 0) and stitching.segment_alignment("ACG", "") == ("3D", -3, 0)


EVENTS = "chrom string, event_id long, kind string, ref_start long, ref_end long, query_delta long, source_chrom string, source_start long, source_end long"


def blocks_by_hand(events, length):
    """Blocks of one chromosome's events by walking both cursors."""
    out, r, q = [], 0, 0

    def put(event, kind, strand, n, target, start, at):
        if n > 0:
            out.append((event, kind, strand, at, at + n, target, start, start + n))

    for chrom, no, kind, start, end, delta, source, s0, s1 in sorted(events, key=lambda e: (e[3], e[4], e[1])):
        flank = max(0, max(start, r) - r)
        put(no, "flank", "+", flank, chrom, r, q)
        q, r = q + flank, r + flank
        n = max(0, end - start) or max(0, delta)
        if kind == "DEL":
            r = max(r, end)
        elif kind == "INV":
            put(no, "INV", "-", n, chrom, start, q)
            q, r = q + n, max(r, start + n)
        elif kind == "DUP":
            put(no, "DUP_original", "+", n, chrom, start, q)
            put(no, "DUP_extra_copy", "+", n, chrom, start, q + n)
            q, r = q + 2 * n, max(r, start + n)
        else:
            if source and delta > 0:
                put(no, kind + "_source", "+", min(delta, s1 - s0) if s1 > s0 else delta, source, s0, q)
            q += max(0, delta)
            if kind == "BND" and end > start:
                r = max(r, end)
    put(None, "flank", "+", length - r, events[0][0], r, q)
    return out


def random_events(rng, n, spread):
    rows = []
    for k in range(n):
        kind = ("DEL", "INS", "INV", "DUP", "BND")[rng.integers(0, 5)]
        start, size = int(rng.integers(0, spread)), int(rng.integers(0, 60))
        end = start + (0 if kind == "INS" or rng.random() < 0.2 else size)
        rows.append(("c1", k, kind, start, end, int(rng.integers(-3, 50)), *(("c2", 5, 5 + int(rng.integers(0, 40))) if rng.random() < 0.5 else (None, None, None))))
    return rows


def test_truth_blocks_against_a_loop(spark):
    rng = np.random.default_rng(2)
    for spread in (300, 4000):
        rows = random_events(rng, 60, spread)
        frame, lengths = spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("c1", 5000), ("c9", 10)], "chrom string, length long")
        got = [tuple(r)[1:9] for r in truth.truth_blocks(frame, lengths).collect()]
        assert sorted(got, key=str) == sorted(blocks_by_hand(rows, 5000), key=str)


def test_graph_paths_spell_the_changed_sequence(spark):
    rng = np.random.default_rng(5)
    reference = "".join("ACGT"[k] for k in rng.integers(0, 4, 4200))
    rows = [r for r in random_events(rng, 70, 4000) if r[2] != "BND" and not (r[2] in ("DUP", "INV", "DEL") and r[4] == r[3])]
    frame, lengths = spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("c1", 4200), ("c9", 10)], "chrom string, length long")
    away = {r.event_id for r in truth.conflicts(frame).collect()}
    kept = [r for r in sorted(rows, key=lambda e: (e[3], e[4], e[1])) if r[1] not in away]
    assert away and len(kept) > 10
    kept_frame = spark.createDataFrame(kept, EVENTS)
    bases = {r.segment: reference[r.start : r.end] for r in truth.graph_segments(kept_frame, lengths).where("chrom = 'c1'").collect()}
    bases = {str(k): v for k, v in bases.items()} | {f"i{r[1]}": "x" * max(0, r[5]) for r in kept}
    steps = truth.graph_steps(frame, lengths)
    spell = lambda path: "".join(bases[r.segment] if r.orient == "+" else bases[r.segment].translate(TURN)[::-1] for r in steps.where(f"chrom = 'c1' and path = '{path}'").orderBy("step").collect())
    want, cursor = "", 0
    for _, no, kind, start, end, delta, *_ in kept:
        want += reference[cursor:start]
        piece = reference[start:end]
        want += {"DEL": "", "INS": "x" * max(0, delta), "DUP": piece * 2, "INV": piece.translate(TURN)[::-1]}[kind]
        cursor = end
    assert spell("reference") == reference and spell("changed") == want + reference[cursor:]
    links = truth.graph_links(steps).collect()
    assert sum(r.n for r in links) == steps.count() - 4 and len({tuple(r)[:5] for r in links}) == len(links)
    assert steps.where("chrom = 'c9'").count() == 2
    assert truth.truth_blocks(frame.limit(0), lengths).count() == 0


@pytest.mark.parametrize("text,want", [("", ""), ("3=4=", "7="), ("0X3=0I2X1X", "3=3X")])
def test_merged_runs(text, want):
    assert stitching.merged(text) == want


def test_expanded_matches(spark):
    assert stitching.expanded("4M", "ACGT", "aCcT") == "2=1X1=" and stitching.expanded("2M1D1M2I1=", "ACGTA", "ATTGGA") == "1=1X1D1=2I1="
    assert stitching.expanded("", "", "") == "" and stitching.expanded("0M2=", "AC", "AC") == "2="
    for cigar in ("3M", "5M", "4", "4M1S"):
        with pytest.raises(ValueError):
            stitching.expanded(cigar, "ACGT", "ACGT")
    rows = spark.createDataFrame([(7, "ACGT", "ACCT", "4M")], "pair_id long, ref string, query string, cigar string")
    assert [tuple(r) for r in stitching.expand_matches(rows).collect()] == [(7, "2=1X1=", 3)]


def test_texts_are_expanded_in_slices_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(stitching, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"target": ["ACGT", "ACGTACGTACGT", "", "AC"], "query": ["ACGA", "ACGTACGTACGT", "", "AC"], "cigar": ["4M", "12M", "", "2M"]})
    parts = list(stitching._slices(batch, ["target", "query"]))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == 4
    assert [x for p in parts for x in zip(*stitching._expanded_columns(p, "target", "query"))] == [("3=1X", 3, 4), ("12=", 12, 12), ("", 0, 0), ("2=", 2, 2)]
