"""Final bundles and alignment records that no longer overlap their neighbours: trimming, stitching, clipping and aligning anew.

Records are (q, qlen, qs, qe, strand, t, ts, te, chain_no, cigar, matches, block, score, source, mode, patches), with a CIGAR
that runs along the target.  The query runs along it too once it is turned (``o_start``, ``o_end`` below).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import cigar_ops, consumed
from tessera.operators import records as rec
from tessera.operators.chains import TRACK
from tessera.operators.stitching import merged, segment_alignments


@dataclass(frozen=True)
class Normalising:
    """Lengths that decide about an overlap of neighbours: that of an anchor, flanks of a patch and of a duplication's junction, and the longest patched gap."""

    anchor: int = 40
    flank: int = 100
    junction: int = 200
    max_gap: int = 70_000


_RECORD = ["q", "qlen", "qs", "qe", "strand", "t", "ts", "te", "chain_no", "cigar", "matches", "block", "score", "source", "mode", "patches"]


def oriented(rows: DataFrame) -> DataFrame:
    """``rows`` with ``o_start`` and ``o_end``, the query interval on the record's strand."""
    plus = F.col("strand") == "+"
    return rows.withColumns({"o_start": F.when(plus, F.col("qs")).otherwise(F.col("qlen") - F.col("qe")), "o_end": F.when(plus, F.col("qe")).otherwise(F.col("qlen") - F.col("qs"))})


def _decided(records: DataFrame, p: Normalising) -> DataFrame:
    """Records with their left neighbour ``l``, both overlaps with it, and the ``action`` that this makes on it.

    Neighbours follow each other by (ts, qs, te, chain_no, qe, cigar) on a track; what a record's action changes is only its left
    neighbour or itself, so each is decided from the records as they came, but for one whose left neighbour was stitched
    away: of records that could all be stitched to the one before, every second is.
    """
    lead, tail = rec.exact_flanks(F.col("cigar"))
    rows = oriented(records).withColumns({"lead": lead, "tail": tail, "whole": (F.col("te") > F.col("ts")) & (F.col("qe") > F.col("qs"))})
    over = Window.partitionBy("t", "q", "strand").orderBy("ts", "qs", "te", "chain_no", "qe", "cigar")
    left = F.lag(F.struct(*(c for c in rows.columns if c not in ("t", "q", "strand")))).over(over)
    rows = rows.withColumn("l", left).withColumn("place", F.row_number().over(over))
    above = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    rows = rows.withColumns({"ref_overlap": above("l.te", "ts"), "query_overlap": above("l.o_end", "o_start"), "query_gap": above("o_start", "l.o_end")})
    ref, query = F.col("ref_overlap"), F.col("query_overlap")
    meets = F.coalesce(F.col("whole") & F.col("l.whole") & ((ref > 0) | (query > 0)), F.lit(False))
    can = (
        meets & (F.col("strand") == "+") & (ref >= p.anchor) & (query == 0) & (F.col("query_gap") <= 2 * p.flank) & (ref + F.col("query_gap") <= p.max_gap)
        & (F.col("l.qe") - F.col("l.qs") > ref + p.flank) & (F.col("l.tail") >= ref + p.flank) & (F.col("lead") >= F.greatest(F.lit(max(p.junction, p.flank)), ref))
    )
    rows = rows.withColumns({"meets": meets, "can": can})
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(F.when(~F.col("can"), F.col("place"))).over(upto), F.lit(0))
    rows = rows.withColumn("stitched", F.col("can") & ((F.col("place") - last) % 2 == 1))
    gone = F.coalesce(F.lag("stitched").over(over), F.lit(False))
    one_anchor = ((ref == p.anchor) & (query == 0)) | ((query == p.anchor) & (ref == 0))
    action = F.when(~F.col("meets") | gone, F.lit(None)).when(F.col("stitched"), "stitch_overlap_duplication").when(one_anchor, "clip_left").otherwise("report_only")
    return rows.withColumn("action", action)


def overlap_events(records: DataFrame, p: Normalising = Normalising()) -> DataFrame:
    """Neighbours on a track that overlap: (action, reason, t, q, strand, both chains and boxes, ref_overlap, query_overlap)."""
    reason = F.when(F.col("action") == "clip_left", "anchor_length_overlap").when(F.col("action") == "report_only", "non_normalized_overlap").otherwise("overlap_chain_duplication")
    sides = [(f"l.{a}", f"left_{b}", a, f"right_{b}") for a, b in (("chain_no", "chain"), ("ts", "ref_start"), ("te", "ref_end"), ("qs", "query_start"), ("qe", "query_end"))]
    both = [F.col(x).alias(y) for k in range(2) for s in sides for x, y in [s[2 * k : 2 * k + 2]]]
    return _decided(records, p).where("action is not null").select("action", reason.alias("reason"), "t", "q", "strand", *both, "ref_overlap", "query_overlap")


def normalised(records: DataFrame, p: Normalising = Normalising()) -> DataFrame:
    """Records after their overlaps with neighbours are settled, with ``realign``: whether the CIGAR is that of the longer record it was clipped from.

    A record that repeats the end of the one before is stitched to it as an insertion of what both axes have twice; an
    overlap of one anchor on one axis is cut from the left record, if something of it stays; others stay (see
    overlap_events).  Empty records are left out.
    """
    rows = _decided(records, p)
    over = Window.partitionBy("t", "q", "strand").orderBy("place")
    nxt = F.lead(F.struct("action", "ts", "te", "qs", "qe", "cigar", "matches", "block", "score", "patches", "ref_overlap", "query_overlap", "query_gap")).over(over)
    rows = rows.withColumn("n", nxt).where(F.col("whole") & ~F.col("stitched"))
    stitch, plus = F.coalesce(F.col("n.action") == "stitch_overlap_duplication", F.lit(False)), F.col("strand") == "+"
    cut_ref, cut_query = F.col("n.ref_overlap") > 0, F.col("n.query_overlap") > 0
    te = F.when(cut_ref, F.col("n.ts")).otherwise(F.col("te"))
    qe = F.when(cut_query & plus, F.col("n.qs")).otherwise(F.col("qe"))
    qs = F.when(cut_query & ~plus, F.col("n.qe")).otherwise(F.col("qs"))
    clip = F.coalesce((F.col("n.action") == "clip_left") & (te > F.col("ts")) & (qe > qs), F.lit(False))
    span = F.col("n.ref_overlap") + F.col("n.query_gap")
    rest = F.struct(F.col("n.cigar").alias("cigar"), F.col("n.ref_overlap").alias("by"))
    pick = lambda stitched, clipped, plain: F.when(stitch, stitched).when(clip, clipped).otherwise(plain)
    own = {c: F.col(c) for c in _RECORD}
    add = lambda c: F.col(c) + F.col(f"n.{c}")
    own |= {
        "te": pick(F.col("n.te"), te, F.col("te")), "qe": pick(F.col("n.qe"), qe, F.col("qe")), "qs": pick(F.col("qs"), qs, F.col("qs")),
        "cigar": F.when(stitch, F.concat("cigar", span.cast("string"), F.lit("I"), _without_front(rest))).otherwise(F.col("cigar")),
        "matches": F.when(stitch, add("matches") - F.col("n.ref_overlap")).otherwise(F.col("matches")),
        "block": F.when(stitch, add("block") - F.col("n.ref_overlap") + span).otherwise(F.col("block")),
        "score": F.when(stitch, add("score")).otherwise(F.col("score")),
        "source": F.when(stitch, "overlap_chain_duplication").otherwise(F.col("source")), "mode": F.when(stitch, "cigar_stitch").otherwise(F.col("mode")),
        "patches": F.when(stitch, add("patches") + 1).otherwise(F.col("patches")),
    }
    return rows.select(*(x.alias(c) for c, x in own.items()), clip.alias("realign"))


def _without_front(rest: Column) -> Column:
    """A CIGAR without ``by`` bases of the exact match at its front, which is as long at least."""
    left = F.regexp_extract(rest["cigar"], "^([0-9]+)=", 1).cast("bigint") - rest["by"]
    return F.concat(F.when(left > 0, F.concat(left.cast("string"), F.lit("="))).otherwise(F.lit("")), F.regexp_replace(rest["cigar"], "^[0-9]+=", ""))


def realigned(rows: DataFrame, targets: DataFrame, queries: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``normalised`` rows with new CIGARs, matches, block lengths and scores for those that ask for it, from the bases of their clipped intervals.

    ``targets`` and ``queries`` are chunks (records.chunked) of ``size`` bases; only intervals that are aligned anew are fetched.
    """
    asked = rows.where("realign")
    wanted = lambda name, a, b, strand: asked.select(F.col(name).alias("sequence_id"), F.col(a).alias("start"), F.col(b).alias("end"), strand.alias("strand")).distinct()
    named = lambda found, name, a, b, bases: found.select(F.col("sequence_id").alias(name), F.col("start").alias(a), F.col("end").alias(b), F.col("strand").alias(f"{bases}_strand"), F.col("bases").alias(bases))
    ref = named(rec.fetch(targets, wanted("t", "ts", "te", F.lit("+")), size), "t", "ts", "te", "ref").drop("ref_strand")
    query = named(rec.fetch(queries, wanted("q", "qs", "qe", F.col("strand")), size), "q", "qs", "qe", "bases").withColumnRenamed("bases_strand", "strand")
    both = asked.join(ref, ["t", "ts", "te"]).join(query, ["q", "qs", "qe", "strand"]).select(*rows.columns, "ref", "bases")
    fields, columns = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes), rows.columns

    def run(batches):
        for batch in batches:
            done = segment_alignments(batch["ref"].tolist(), batch["bases"].tolist())
            batch["cigar"], batch["score"], batch["matches"] = [merged(c) for c, _, _ in done], [s for _, s, _ in done], [m for _, _, m in done]
            yield batch[columns]

    new = both.repartition(*TRACK, "ts").mapInPandas(run, fields)
    ops = cigar_ops(F.col("cigar"))
    return rows.where("not realign").unionByName(new.withColumns({"block": consumed(ops, "=XID"), "realign": F.lit(False)}))


def terminal_exact_flank(records: DataFrame, least: int = 200) -> DataFrame:
    """The exact match that a rejected record ends with, as a record of its own, where it has ``least`` bases or more; on the minus strand it lies at the query's start."""
    n = rec.exact_flanks(F.col("cigar"))[1]
    plus = F.col("strand") == "+"
    rows = records.withColumn("n", n).where((F.col("n") >= least) & F.col("cigar").rlike("^([0-9]+[=XMID])+$"))
    new = {
        "ts": F.col("te") - F.col("n"), "qs": F.when(plus, F.col("qe") - F.col("n")).otherwise(F.col("qs")), "qe": F.when(plus, F.col("qe")).otherwise(F.col("qs") + F.col("n")), "cigar": F.concat(F.col("n").cast("string"), F.lit("=")),
        "matches": F.col("n"), "block": F.col("n"), "score": F.col("n"), "source": F.lit("inversion_boundary_flank"), "mode": F.lit("terminal_exact_recovery"),
    }
    return rows.withColumns(new).select(*_RECORD)


_BOX = ["ref_start", "ref_end", "query_start", "query_end"]


def _share(a0: int, a1: int, b0: int, b1: int) -> float:
    least = min(a1 - a0, b1 - b0)
    return max(0, min(a1, b1) - max(a0, b0)) / least if least > 0 else 0.0


def trimmed_boxes(boxes: list[tuple[int, int, int, int]], plus: bool, overlap: float, least: int, cell: int = 1024) -> list[list[tuple[int, int, int, int]]]:
    """What stays of each box (ref_start, ref_end, query_start, query_end), best first, after all before it were taken.

    A box that a taken part overlaps by a share of ``overlap`` of the smaller on both axes is cut into what lies before
    and behind it; parts of under ``least`` on an axis go.  Taken parts are looked up by cells of the reference.
    """
    taken: list[tuple[int, int, int, int]] = []
    cells: dict[int, list[int]] = {}
    out = []
    for box in boxes:
        parts = [box]
        for k in sorted({k for c in range(box[0] // cell, (max(box[1], box[0] + 1) - 1) // cell + 1) for k in cells.get(c, ())}):
            b, cut = taken[k], []
            for a in parts:
                if _share(*a[:2], *b[:2]) < overlap or _share(*a[2:], *b[2:]) < overlap:
                    cut.append(a)
                    continue
                before, behind = (min(a[3], b[2]), max(a[2], b[3])) if plus else (max(a[2], b[3]), min(a[3], b[2]))
                sides = ((a[0], min(a[1], b[0]), a[2], before), (max(a[0], b[1]), a[1], behind, a[3])) if plus else ((a[0], min(a[1], b[0]), before, a[3]), (max(a[0], b[1]), a[1], a[2], behind))
                cut += [s for s in sides if s[1] - s[0] >= max(least, 0) and s[3] - s[2] >= max(least, 0)]
            parts = cut
            if not parts:
                break
        for a in parts:
            for c in range(a[0] // cell, (max(a[1], a[0] + 1) - 1) // cell + 1):
                cells.setdefault(c, []).append(len(taken))
            taken.append(a)
        out.append(parts)
    return out


def final_trimmed(bundles: DataFrame, overlap: float = 0.5, least: int = 40) -> DataFrame:
    """(TRACK, chain_no, box, score, part, cut): bundles (TRACK, chain_no, box, score) after better ones of their track took their place.

    The higher score is better, then the larger sum of both spans, then the smaller place and number.  Bundles that no
    chain of overlaps on the reference joins can't cut each other, so each such island is settled on its own.
    """
    if overlap <= 0:
        raise ValueError("overlap must be above 0")
    over = Window.partitionBy(*TRACK).orderBy("ref_start", "ref_end", "query_start", "chain_no")
    reach = F.max("ref_end").over(over.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("ref_start") >= reach)).cast("bigint")
    rows = bundles.select(*TRACK, "chain_no", *_BOX, F.col("score").cast("double").alias("score")).withColumn("new", new).withColumn("island", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    kinds, columns = dict(rows.dtypes), [*TRACK, "chain_no", *_BOX, "score"]
    fields = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "part bigint", "cut boolean"])
    span = F.expr("ref_end - ref_start + query_end - query_start")
    best_first = rows.repartition(*TRACK, "island").sortWithinPartitions(*TRACK, "island", F.desc("score"), span.desc(), "ref_start", "query_start", "chain_no").select("island", *columns)

    def run(batches):
        made = []
        every = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for (_, *track), group in groupby(every, key=itemgetter(0, 1, 2, 3)):
            group = list(group)
            for row, parts in zip(group, trimmed_boxes([tuple(map(int, r[5:9])) for r in group], track[2] == "+", overlap, least)):
                made += [(*row[1:5], *part, row[9], k, part != tuple(row[5:9])) for k, part in enumerate(parts)]
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=[*columns, "part", "cut"])
                made = []
        if made:
            yield pd.DataFrame(made, columns=[*columns, "part", "cut"])

    return best_first.mapInPandas(run, fields)
