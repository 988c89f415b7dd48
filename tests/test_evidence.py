"""Evidence of duplications and decisions about gaps on small cases with known answers."""

import random

from pyspark.sql import functions as F

from tessera.operators import evidence

T = "truth_id long, q string, t string, ref_start long, ref_end long, query_start long, query_end long, pct_sequence double, pct_size double"
A, R = "q string, t string, ts long, te long, qs long, qe long", "q string, t string, ts long, te long, qs long, qe long, cigar string"


def test_insertions_with_places():
    assert evidence.insertions_of("10=5I3D2X4M7I", 100, 50) == [{"t": 110, "q": 60, "size": 5}, {"t": 119, "q": 71, "size": 7}]
    assert evidence.insertions_of(None, 0, 0) == evidence.insertions_of("9D", 0, 0) == []


def test_alleles_and_likeness():
    assert [evidence.inserted_bases(*x) for x in [("A", "AGG"), ("ACT", "AGGCT"), ("aa", "AAA"), ("A", "<DUP>"), ("ACGT", "A")]] == ["GG", "GG", "A", "", ""]
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("AC") for _ in range(rnd.randrange(0, 12))) for _ in range(2))
        best = max((sum(a[i + s] == b[i] for i in range(len(b)) if 0 <= i + s < len(a)) for s in range(-3, 4)), default=0)
        assert evidence.shifted_likeness(a, b, 3) == (best / max(len(a), len(b)) if a and b else 0.0)


def test_genotypes(spark):
    rows = spark.createDataFrame([(g,) for g in ("0/0:9", "0|0", ".", "./.", "0", "0/1", "1", "1|1:3")], "g string")
    assert [r.g for r in rows.where(evidence.non_reference(F.col("g"))).collect()] == ["0/1", "1", "1|1:3"]


def test_each_stage_that_loses_a_duplication(spark):
    """Truths of 100 bases with copies at 1,000 and 1,100 of a query of their own, and evidence up to one stage more each."""
    first, second = (0, 40, 1010, 1050), (10, 50, 1120, 1160)
    cases = {
        "assignment_missing": ([], [], []), "one_copy_assignment_missing": ([first], [], []), "chaining_missing": ([first, second], [], []), "one_copy_final_chain_missing": ([first, second], [second], []),
        "base_alignment_missing": ([first, second], [first, second], [(100, 300, 0, 9, "9=")]), "paf_duplication_signal_missing": ([first, second], [first, second], [(0, 100, 1000, 1100, "100=")]),
        "graph_vcf_call_missing": ([first, second], [first, second], [(0, 100, 1000, 1180, "50=80I50=")]),
    }
    truths, assigned, chained, records, calls = [], [], [], [], []
    for k, (a, c, r) in enumerate(cases.values()):
        q = f"q{k}"
        truths.append((k, q, "t", 0, 100, 1000, 1200, None, None))
        assigned += [(q, "t", *x) for x in a]
        chained += [(q, "t", *x) for x in c]
        records += [(q, "t", *x) for x in r]
    more = {"benchmark_matching_failure": (400, 90, None, None), "graph_vcf_breakpoint_mismatch": (560, 90, None, None), "graph_vcf_size_mismatch": (0, 9, None, None), "graph_allele_sequence_mismatch": (0, 90, 0.1, 0.9), "benchmark_dup_resolution_mismatch": (0, 90, 0.1, 0.9)}
    for k, (pos, size, sequence, of_size) in enumerate(more.values(), len(cases)):
        truths.append((k, f"q{k}", "t", 0, 100, 1000, 1200, sequence, of_size))
        calls.append((f"q{k}", "t", k, pos, size))
    frame = spark.createDataFrame
    got = evidence.failure_stages(frame(truths, T), frame(assigned, A), frame(chained, A), frame(records, R), frame(calls, "q string, t string, call_id long, pos long, call_size long"), frame([(len(truths) - 1, 0.99)], "truth_id long, identity double"))
    rows = {r.truth_id: r for r in got.collect()}
    assert [rows[k].stage for k in range(len(truths))] == [*cases, *more]
    assert (rows[6].inserted, rows[6].records_1, rows[6].records_2, rows[5].records_1, rows[5].records_2) == ("80", 1, 1, 1, 0)


def test_decisions_about_gaps(spark):
    """Chain 2 is merged into 1; 3's decision is that of (2, 3), 9's is that of another chain at its place."""
    g = "sample string, left_no long, right_no long, ref_gap long, query_gap long, right_ref long, right_query long"
    gaps = [("s", 1, 3, 10, 10, 100, 100), ("s", 4, 5, 7, 7, 900, 900), ("s", 6, 9, 1, 1, 20_000, 20_000), ("s", 7, 8, 1, 1, 90_000, 1)]
    extensions = [("s", 2, 3, 50, 50, 100, 100, "best_partial_path"), ("s", 4, 5, 7, 7, 900, 900, "gap_too_large"), ("s", 6, 10, 3, 3, 24_000, 16_000, "below_threshold"), ("s", 7, 11, 3, 3, 96_000, 1, "far"), ("r", 7, 11, 3, 3, 90_000, 1, "other")]
    patches = [(1, 2, 5, 5, "patched", True), (2, 3, 50, 50, "patch_zdrop_reject", False), (6, 10, 3, 3, "patched", False)]
    got = evidence.gap_decisions(spark.createDataFrame(gaps, g), spark.createDataFrame(extensions, g + ", stop_reason string"), spark.createDataFrame(patches, "left_no long, right_no long, ref_gap long, query_gap long, status string, merge boolean"))
    rows = {r.left_no: (r.match, r.extension_left, r.extension_right, r.patch_left, r.patch_right, r.cause) for r in got.collect()}
    assert rows == {
        1: ("merged_component", 2, 3, 2, 3, "patch_zdrop_reject"), 4: ("exact", 4, 5, None, None, "not_patch_eligible_gap_too_large"),
        6: ("competing_chain_coordinate_proxy", 6, 10, 6, 10, "patched"), 7: (".", None, None, None, None, "merged_lineage_or_nonadjacent_chain"),
    }
