"""Overlapping records and bundles settled by plain loops; realigned records read both sides in full."""

import random
import re

import pytest

from tessera.operators import normalising as nm
from tessera.operators import records

P = nm.Normalising(anchor=4, flank=3, junction=5, max_gap=60)
FIELDS = "q string, qlen long, qs long, qe long, strand string, t string, ts long, te long, chain_no long, cigar string, matches long, block long, score long, source string, mode string, patches long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def random_records(seed, n):
    rnd, rows, ts, o = random.Random(seed), [], 0, 5
    for k in range(n):
        strand = "+" if k < n // 2 else "-"
        if k == n // 2:
            ts, o = 0, 5
        a, b, i = rnd.randrange(1, 40), rnd.randrange(1, 40), rnd.choice([0, 0, 3])
        cigar = f"{a}=2X" + (f"{i}{rnd.choice('ID')}" if i else "") + f"{b}="
        ref = a + b + 2 + (i if "D" in cigar else 0)
        query = a + b + 2 + (i if "I" in cigar else 0)
        qs, qe = (o, o + query) if strand == "+" else (10_000 - o - query, 10_000 - o)
        rows.append(("q", 10_000, qs, qe, strand, "t", ts, ts + ref, k, cigar, a + b, a + b + 2 + i, a + b - 2 - i, "raw", "direct", 0))
        ts += max(1, ref - rnd.choice([0, 4, 4, 7, 12, 30, -5]))
        o += max(1, query - rnd.choice([0, 0, 4, -2, -6, -6, 9]))
    rows.append(("q", 10_000, 7, 7, "+", "t", 20, 20, 999, "", 0, 0, 0, "raw", "direct", 0))  # an empty one
    return rows


def flank(cigar, first):
    found = re.findall(r"([0-9]+)(.)", cigar)
    n, op = (found[0] if first else found[-1]) if found else (0, "")
    return int(n) if op == "=" else 0


def settled(rows):
    """(records, events): one pass over each track, from the left, changing records in place."""
    out, events, tracks = [], [], {}
    for r in rows:
        tracks.setdefault((r[5], r[0], r[4]), []).append(dict(zip(NAMES, r), realign=False))
    whole = lambda x: x["te"] > x["ts"] and x["qe"] > x["qs"]
    turned = lambda x: (x["qs"], x["qe"]) if x["strand"] == "+" else (x["qlen"] - x["qe"], x["qlen"] - x["qs"])
    for own in tracks.values():
        own.sort(key=lambda x: (x["ts"], x["qs"], x["te"], x["chain_no"]))
        for l, r in zip(own, own[1:]):
            if not whole(l) or not whole(r):
                continue
            lo, ro = turned(l), turned(r)
            ref, query, gap = max(l["te"] - r["ts"], 0), max(lo[1] - ro[0], 0), max(ro[0] - lo[1], 0)
            if not ref and not query:
                continue
            dup = l["strand"] == "+" and ref >= P.anchor and not query and gap <= 2 * P.flank and ref + gap <= P.max_gap and l["qe"] - l["qs"] > ref + P.flank
            dup = dup and flank(l["cigar"], False) >= ref + P.flank and flank(r["cigar"], True) >= max(P.junction, P.flank, ref)
            one = (ref == P.anchor and not query) or (query == P.anchor and not ref)
            action = "stitch_overlap_duplication" if dup else "clip_left" if one else "report_only"
            events.append((action, l["strand"], l["chain_no"], r["chain_no"], l["te"], l["qe"], ref, query))
            if dup:
                n = flank(r["cigar"], True)
                rest = (f"{n - ref}=" if n > ref else "") + re.sub("^[0-9]+=", "", r["cigar"])
                l.update(te=r["te"], qe=r["qe"], cigar=f"{l['cigar']}{ref + gap}I{rest}", matches=l["matches"] + r["matches"] - ref, block=l["block"] + r["block"] - ref + ref + gap, score=l["score"] + r["score"], source="overlap_chain_duplication", mode="cigar_stitch", patches=l["patches"] + r["patches"] + 1)
                r.update(ts=0, te=0, qs=0, qe=0)
            elif one:
                new = dict(l)
                if ref:
                    new["te"] = r["ts"]
                if query:
                    new["qe" if l["strand"] == "+" else "qs"] = r["qs" if l["strand"] == "+" else "qe"]
                if whole(new):
                    l.update(new, realign=True)
        out += [tuple(x[c] for c in [*NAMES, "realign"]) for x in own if whole(x)]
    return out, events


@pytest.mark.parametrize("seed", [1, 2])
def test_records_settled_by_a_plain_loop(spark, seed):
    rows = random_records(seed, 400)
    frame = spark.createDataFrame(rows, FIELDS)
    want, events = settled(rows)
    assert sorted(map(tuple, nm.normalised(frame, P).collect())) == sorted(want)
    got = nm.overlap_events(frame, P).select("action", "strand", "left_chain", "right_chain", "left_ref_end", "left_query_end", "ref_overlap", "query_overlap")
    assert sorted(map(tuple, got.collect())) == sorted(events)
    assert {"stitch_overlap_duplication", "clip_left", "report_only"} == {e[0] for e in events}
    assert nm.normalised(frame.limit(0), P).count() == 0


def test_clipped_records_are_aligned_again(spark):
    rnd = random.Random(3)
    ref = "".join(rnd.choice("ACGT") for _ in range(900))
    copy = ref[:300] + ref[310:]
    turned = copy[::-1].translate(str.maketrans("ACGT", "TGCA"))
    row = lambda k, strand, ts, te, qs, qe, again: (f"q{strand}", 890, qs, qe, strand, "t", ts, te, k, "1=", 1, 1, 1, "raw", "direct", 0, again)
    rows = [row(1, "+", 0, 500, 0, 490, True), row(2, "-", 0, 500, 400, 890, True), row(3, "+", 600, 700, 1, 2, False)]
    chunks = lambda x: records.chunked(spark.createDataFrame(x, "sequence_id string, seq string"), 128)
    got = {r.chain_no: r for r in nm.realigned(spark.createDataFrame(rows, FIELDS + ", realign boolean"), chunks([("t", ref)]), chunks([("q+", copy), ("q-", turned)]), 128).collect()}
    assert len(got) == 3 and got[3].cigar == "1=" and not any(r.realign for r in got.values())
    for k in (1, 2):
        assert (got[k].matches, got[k].block, got[k].score) == (490, 500, 480)
        a = b = 0
        for n, op in re.findall("([0-9]+)(.)", got[k].cigar):
            n = int(n)
            assert op == "D" or (op == "=" and ref[a : a + n] == copy[b : b + n])
            a, b = a + n, b + n * (op == "=")
        assert (a, b) == (500, 490)


def test_flank_that_stays_of_a_rejected_record(spark):
    rows = [("q", 1000, 100, 430, s, "t", 50, 360, k, c, 0, 0, 0, "x", "y", 2) for k, (s, c) in enumerate([("+", "90=20I220="), ("-", "90=20I220="), ("+", "300=10I20="), ("+", "100=230I"), ("+", "")])]
    got = {r.chain_no: (r.ts, r.te, r.qs, r.qe, r.cigar, r.source) for r in nm.terminal_exact_flank(spark.createDataFrame(rows, FIELDS), 200).collect()}
    assert got == {0: (140, 360, 210, 430, "220=", "inversion_boundary_flank"), 1: (140, 360, 100, 320, "220=", "inversion_boundary_flank")}


def trimmed_by_scans(rows, overlap, least):
    """Every bundle against all parts taken before it, in order."""
    taken, out = [], []
    share = lambda a, b, i: max(0, min(a[i + 1], b[i + 1]) - max(a[i], b[i])) / max(1, min(a[i + 1] - a[i], b[i + 1] - b[i]))
    for q, t, strand, no, *box, score in sorted(rows, key=lambda r: (-r[8], -(r[5] - r[4] + r[7] - r[6]), r[4], r[6], r[3])):
        parts = [tuple(box)]
        for track, b in taken:
            if track == (q, t, strand):
                new = []
                for a in parts:
                    if share(a, b, 0) >= overlap and share(a, b, 2) >= overlap:
                        low, high = (a[2], min(a[3], b[2])), (max(a[2], b[3]), a[3])
                        first, last = (low, high) if strand == "+" else (high, low)
                        for s in ((a[0], min(a[1], b[0]), *first), (max(a[0], b[1]), a[1], *last)):
                            if s[1] - s[0] >= least and s[3] - s[2] >= least:
                                new.append(s)
                    else:
                        new.append(a)
                parts = new
        taken += [((q, t, strand), p) for p in parts]
        out += [(q, t, strand, no, *p, score, k, p != tuple(box)) for k, p in enumerate(parts)]
    return out


@pytest.mark.parametrize("overlap", [0.2, 0.7])
def test_final_trim_against_scans(spark, overlap):
    rnd, rows = random.Random(7), []
    for k in range(300):
        a, n, strand = rnd.randrange(0, 6000), rnd.choice([30, 90, 400, 1500]), rnd.choice("+-")
        b = max(0, (a if strand == "+" else 8000 - a - n) + rnd.randrange(-60, 60))
        rows.append(("q", rnd.choice("ab"), strand, k, a, a + n, b, b + n + rnd.randrange(0, 20), float(rnd.randrange(20))))
    frame = spark.createDataFrame(rows, "q string, t string, strand string, chain_no long, ref_start long, ref_end long, query_start long, query_end long, score double")
    got = sorted(map(tuple, nm.final_trimmed(frame, overlap, 40).collect()))
    assert got == sorted(trimmed_by_scans(rows, overlap, 40)) and any(r[-1] for r in got)
    with pytest.raises(ValueError, match="above 0"):
        nm.final_trimmed(frame, 0.0)
