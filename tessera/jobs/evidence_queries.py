"""Registered queries of the evidence around variants and of the decisions about gaps, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.jobs.queries import ALPHA, alpha_prime, query
from tessera.operators import evidence, normalising, records
from tessera.operators.lineage import checkpoint_folder, checkpointed
from tessera.sources import staged
from tessera.sources import tables as src

#: Bases around a variant in which evidence is counted.
WINDOW = 1000

LIKENESS = src.DUPLICATIONS + """,
near as (select d.truth_id, d.source, c.call_id, c.inserted from dup_truths d join dup_calls c on c.q = d.q and c.t = d.t and c.pos between d.ref_start - greatest(500, size // 2) and d.ref_end + greatest(500, size // 2)),
distinct_pairs as (select distinct source, inserted from near where inserted <> ''),
shifted as (select source, inserted, s, greatest(s, 0) as a, greatest(-s, 0) as b from distinct_pairs, range(-20, 21) r(s)),
laid as (select source, inserted, (select count(*) from range(0, greatest(least(length(inserted) - a, length(source) - b), 0)) x(i) where inserted[a + i + 1] = source[b + i + 1]) as same from shifted),
likeness as (select source, inserted, max(same)::double / greatest(length(source), length(inserted)) as identity from laid group by source, inserted),
best as (select truth_id, max(coalesce(identity, 0)) as identity, arg_max(call_id, (coalesce(identity, 0), -call_id)) as call_id from near left join likeness using (source, inserted) group by truth_id)"""

STAGES = LIKENESS + """,
copies as (select *, query_start + size as middle from dup_truths),
anchored as (select truth_id, count(*) filter (where qs < middle and qs + 40 > query_start) as assigned_1, count(*) filter (where qs < query_end and qs + 40 > middle) as assigned_2,
  count(*) filter (where p.both and qs < middle and qs + 40 > query_start) as chained_1, count(*) filter (where p.both and qs < query_end and qs + 40 > middle) as chained_2
  from copies c join planted p on p.q = c.q and p.t = c.t and p.ts < ref_end and p.ts + 40 > ref_start group by truth_id),
over_truth as (select *, least(te, ref_end) - greatest(ts, ref_start) >= greatest(1, size // 2) as wide, qs + 2 * half + grown as qe, greatest(1, size // 2) as need from copies c join dup_records r on r.q = c.q and r.t = c.t and r.ts < ref_end and r.te > ref_start),
supported as (select truth_id, count(*) as near_records, count(*) filter (where wide and least(qe, middle) - greatest(qs, query_start) >= need) as records_1, count(*) filter (where wide and least(qe, query_end) - greatest(qs, middle) >= need) as records_2,
  list(grown order by grown) filter (where grown > 0 and ts + half between ref_start - 500 and ref_end + 500 and ((qs + half < query_end and qs + half + grown > query_start) or qs + half between query_start - 500 and query_end + 500)) as inserted from over_truth group by truth_id),
called as (select truth_id, count(*) filter (where pos between ref_start - greatest(500, size // 2) and ref_end + greatest(500, size // 2)) as near_calls, count(*) as wide_calls,
  min(abs(pos - ref_start)) filter (where least(call_size, size) >= 0.7 * greatest(call_size, size)) as closest from copies c join dup_calls k on k.q = c.q and k.t = c.t and k.pos between ref_start - greatest(500, size) and ref_end + greatest(500, size) group by truth_id),
known as (select c.truth_id, size, pct_sequence, pct_size, coalesce(assigned_1, 0) as assigned_1, coalesce(assigned_2, 0) as assigned_2, coalesce(chained_1, 0) as chained_1, coalesce(chained_2, 0) as chained_2, coalesce(near_records, 0) as near_records,
  coalesce(records_1, 0) as records_1, coalesce(records_2, 0) as records_2, coalesce(near_calls, 0) as near_calls, coalesce(wide_calls, 0) as wide_calls, closest, coalesce(inserted, []) as inserted, coalesce(identity, 0) as identity
  from copies c left join anchored using (truth_id) left join supported using (truth_id) left join called using (truth_id) left join best using (truth_id))"""


def _identities(spark, d):
    calls, truths = src.dup_calls(spark, d).where(evidence.non_reference(F.col("genotype"))), src.dup_truths(spark, d)
    near = evidence.near_calls(truths, calls).where("reported").select("truth_id", "call_id")
    return evidence.best_identities(near.join(truths.select("truth_id", "source"), "truth_id").join(calls.select("call_id", "ref", "alt"), "call_id"))


@query("select truth_id, round(identity, 9) as identity, call_id from best", LIKENESS)
def dup_allele_identity(spark, d):
    """The near call of another genotype whose inserted bases are most like each duplication's, laid with a shift of 20 at most."""
    return _identities(spark, d).select("truth_id", F.round("identity", 9).alias("identity"), "call_id")


@query("""select truth_id, size, assigned_1, assigned_2, chained_1, chained_2, near_records, records_1, records_2, near_calls, array_to_string(inserted, ',') as inserted, round(identity, 9) as identity,
  case when pct_sequence < 0.7 then case when identity >= 0.95 then 'benchmark_dup_resolution_mismatch' when pct_size >= 0.7 then 'graph_allele_sequence_mismatch' else 'graph_vcf_size_mismatch' end
    when closest is not null then case when closest > 500 then 'graph_vcf_breakpoint_mismatch' else 'benchmark_matching_failure' end when wide_calls > 0 then 'graph_vcf_size_mismatch'
    when assigned_1 + assigned_2 = 0 then 'assignment_missing' when least(assigned_1, assigned_2) = 0 then 'one_copy_assignment_missing' when chained_1 + chained_2 = 0 then 'chaining_missing'
    when least(chained_1, chained_2) = 0 then 'one_copy_final_chain_missing' when near_records = 0 then 'base_alignment_missing'
    when len([x for x in inserted if x >= 0.7 * size and x <= 1.3 * size]) > 0 or (records_1 > 0 and records_2 > 0) then 'graph_vcf_call_missing' else 'paf_duplication_signal_missing' end as stage from known""", STAGES)
def dup_failure_stages(spark, d):
    """The stage that lost each missed duplication, with anchors, records and calls that speak for it."""
    pairs = src.planted_pairs(spark, d).select("q", "t", "ts", (F.col("ts") + 40).alias("te"), "qs", (F.col("qs") + 40).alias("qe"), "both")
    calls = src.dup_calls(spark, d).where(evidence.non_reference(F.col("genotype")))
    found = evidence.failure_stages(src.dup_truths(spark, d), pairs, pairs.where("both"), src.dup_records(spark, d), calls, _identities(spark, d))
    return found.withColumn("identity", F.round("identity", 9))


@query(f"""select truth_id as event_id, q, t, greatest(ref_start - {WINDOW}, 0) as low, ref_end + {WINDOW} as high,
  (select count(*) from planted p where p.q = d.q and p.t = d.t and p.ts between greatest(ref_start - {WINDOW}, 0) and ref_end + {WINDOW}) as assigned,
  (select count(*) from planted p where p.q = d.q and p.t = d.t and p.both and p.ts between greatest(ref_start - {WINDOW}, 0) and ref_end + {WINDOW}) as chained,
  (select count(*) from dup_records r where r.q = d.q and r.t = d.t and r.ts < ref_end + {WINDOW} and r.te > greatest(ref_start - {WINDOW}, 0)) as records,
  (select count(*) from dup_calls c where c.q = d.q and c.t = d.t and c.pos < ref_end + {WINDOW} and c.pos + 1 > greatest(ref_start - {WINDOW}, 0)) as calls from dup_truths d""", src.DUPLICATIONS)
def local_evidence(spark, d):
    """Anchors, chained anchors, records and calls around every missed duplication."""
    pairs = src.planted_pairs(spark, d).select("q", "t", (F.col("ts") - 1).alias("start"), (F.col("ts") + 1).alias("end"), "both")
    calls = src.dup_calls(spark, d).where(evidence.non_reference(F.col("genotype"))).select("q", "t", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    records = src.dup_records(spark, d).select("q", "t", F.col("ts").alias("start"), F.col("te").alias("end"))
    variants = src.dup_truths(spark, d).select(F.col("truth_id").alias("event_id"), "q", "t", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    return evidence.local_evidence(variants, {"assigned": pairs, "chained": pairs.where("both"), "records": records, "calls": calls}, WINDOW)


@query("""select sample, left_no, right_no, ref_gap, query_gap, match, el as extension_left, er as extension_right, coalesce(pl, p2l, p3l) as patch_left, coalesce(pr, p2r, p3r) as patch_right,
  case when st in ('patch_interval_low_identity', 'patch_zdrop_reject') then st when mg then 'accepted_patch_boundary_remains' when st is not null then st
    when stop = 'gap_too_large' then 'not_patch_eligible_gap_too_large' when el is not null then 'no_patch_record_after_extension' else 'merged_lineage_or_nonadjacent_chain' end as cause from (
  select *, coalesce(ps, p2s, p3s) as st, coalesce(pm, p2m, p3m) as mg from (
  select f.*, p2.left_no as p2l, p2.right_no as p2r, p2.status as p2s, p2.merge as p2m, p3.left_no as p3l, p3.right_no as p3r, p3.status as p3s, p3.merge as p3m from found f
  left join patches p2 on p2.left_no = f.el and p2.right_no = f.er left join lateral (select * from pat x where x.lm = f.lm and x.rm = f.rm and x.lm <> x.rm order by abs(x.ref_gap - f.ref_gap) + abs(x.query_gap - f.query_gap), x.left_no, x.right_no limit 1) p3 on true))""", src.DECIDED_GAPS + """,
ext as (select e.*, l.m as lm, r.m as rm from extensions e join root l on l.no = left_no join root r on r.no = right_no),
pat as (select e.*, l.m as lm, r.m as rm from patches e join root l on l.no = left_no join root r on r.no = right_no),
found as (select g.sample, g.left_no, g.right_no, g.ref_gap, g.query_gap, l.m as lm, r.m as rm, p.left_no as pl, p.right_no as pr, p.status as ps, p.merge as pm, coalesce(e1.left_no, e2.left_no, e3.left_no) as el, coalesce(e1.right_no, e2.right_no, e3.right_no) as er,
  coalesce(e1.stop_reason, e2.stop_reason, e3.stop_reason) as stop, case when e1.left_no is not null then 'exact' when e2.left_no is not null then 'merged_component' when e3.left_no is not null then 'competing_chain_coordinate_proxy' when p.left_no is not null then 'exact' else '.' end as match
  from gaps g join root l on l.no = g.left_no join root r on r.no = g.right_no left join patches p on p.left_no = g.left_no and p.right_no = g.right_no left join ext e1 on e1.left_no = g.left_no and e1.right_no = g.right_no
  left join lateral (select * from ext x where x.lm = l.m and x.rm = r.m and x.lm <> x.rm order by abs(x.ref_gap - g.ref_gap) + abs(x.query_gap - g.query_gap), x.left_no, x.right_no limit 1) e2 on true
  left join lateral (select * from ext x where x.sample = g.sample and x.lm = l.m and abs(x.right_ref - g.right_ref) <= 5000 and abs(x.right_query - g.right_query) <= 5000 order by abs(x.right_ref - g.right_ref) + abs(x.right_query - g.right_query), x.left_no, x.right_no limit 1) e3 on true)""")
def gap_decisions(spark, d):
    """The extension and patch that decided about every gap between final records, and the gap's cause."""
    return evidence.gap_decisions(*src.decided_gaps(spark, d))


# Records and bundles that no longer overlap their neighbours ---------------------------------------

NORMALISING = normalising.Normalising(anchor=40, flank=50, junction=200)
SETTLED = src.TRACK_RECORDS + """,
neighbours as (select r.*, l.chain_no as l_chain, l.ts as l_ts, l.te as l_te, l.o_start as l_o_start, l.o_end as l_o_end, l.arm as l_arm, greatest(l.te - r.ts, 0) as ref_overlap, greatest(l.o_end - r.o_start, 0) as query_overlap,
  greatest(r.o_start - l.o_end, 0) as query_gap from placed r left join placed l on l.t = r.t and l.q = r.q and l.strand = r.strand and l.place = r.place - 1),
able as (select *, coalesce(strand = '+' and ref_overlap >= 40 and query_overlap = 0 and query_gap <= 100 and ref_overlap + query_gap <= 70000 and l_o_end - l_o_start > ref_overlap + 50 and l_arm >= ref_overlap + 50 and arm >= greatest(200, ref_overlap), false) as can from neighbours),
taken as (select *, can and (place - coalesce(max(place) filter (where not can) over (partition by t, q, strand order by place), 0)) % 2 = 1 as stitched from able),
acted as (select *, case when coalesce(lag(stitched) over w, false) or not coalesce(ref_overlap > 0 or query_overlap > 0, false) then null when stitched then 'stitch_overlap_duplication'
  when (ref_overlap = 40 and query_overlap = 0) or (query_overlap = 40 and ref_overlap = 0) then 'clip_left' else 'report_only' end as action from taken window w as (partition by t, q, strand order by place))"""
_ON_QUERY = "case when strand = '+' then {0} else 1000000000 - {1} end"


@query(f"""select action, case action when 'clip_left' then 'anchor_length_overlap' when 'report_only' then 'non_normalized_overlap' else 'overlap_chain_duplication' end as reason, t, q, strand, l_chain as left_chain, chain_no as right_chain, l_ts as left_ref_start,
  l_te as left_ref_end, ts as right_ref_start, te as right_ref_end, {_ON_QUERY.format("l_o_start", "l_o_end")} as left_query_start, {_ON_QUERY.format("l_o_end", "l_o_start")} as left_query_end, {_ON_QUERY.format("o_start", "o_end")} as right_query_start,
  {_ON_QUERY.format("o_end", "o_start")} as right_query_end, ref_overlap, query_overlap from acted where action is not null""", SETTLED)
def record_overlap_events(spark, d):
    """Neighbouring alignment records that overlap, and what is done about it."""
    return normalising.overlap_events(src.track_records(spark, d), NORMALISING)


@query(f"""select a.q, 1000000000::bigint as qlen, {_ON_QUERY.format("a.o_start", "x.o_end").replace("strand", "a.strand")} as qs, {_ON_QUERY.format("x.o_end", "a.o_start").replace("strand", "a.strand")} as qe, a.strand, a.t, a.ts, x.te, a.chain_no,
  a.arm || '=' || a.rest || case when b.stitched then (b.ref_overlap + b.query_gap) || 'I' || case when b.arm > b.ref_overlap then (b.arm - b.ref_overlap) || '=' else '' end || b.rest else '' end as cigar,
  2 * a.arm + case when b.stitched then 2 * b.arm - b.ref_overlap else 0 end as matches, 2 * a.arm + 10 + a.grown + case when b.stitched then 2 * b.arm + 10 + b.grown + b.query_gap else 0 end as block,
  2 * a.arm - 10 - a.grown + case when b.stitched then 2 * b.arm - 10 - b.grown else 0 end as score, case when b.stitched then 'overlap_chain_duplication' else 'raw' end as source, case when b.stitched then 'cigar_stitch' else 'direct' end as mode,
  case when b.stitched then 1 else 0 end::bigint as patches, coalesce(b.action = 'clip_left', false) and x.kept as realign
  from acted a left join acted b on b.t = a.t and b.q = a.q and b.strand = a.strand and b.place = a.place + 1 join lateral (select case when b.stitched then b.te when c.kept and b.ref_overlap > 0 then b.ts else a.te end as te,
    case when b.stitched then b.o_end when c.kept and b.query_overlap > 0 then b.o_start else a.o_end end as o_end, c.kept from (select coalesce(b.action = 'clip_left' and (b.ref_overlap = 0 or b.ts > a.ts) and (b.query_overlap = 0 or b.o_start > a.o_start), false) as kept) c) x on true
  where not a.stitched""", SETTLED)
def records_normalised(spark, d):
    """Alignment records after stitching and clipping, and which of them are to be aligned again."""
    return normalising.normalised(src.track_records(spark, d), NORMALISING)


def _anchor_records(spark, d):
    """Records from each anchor of a sequence and its altered copy to the end of the next one, as far as both sides are about as long; chunks of both.

    On the reference each overlaps the next by one anchor, on the query it ends where that begins.
    """
    pairs = checkpointed(src.guided_pairs(spark, d))
    steps = F.arrays_zip(F.col("anchors").alias("a"), F.expr("slice(anchors, 2, greatest(size(anchors) - 1, 0))").alias("b"))
    rows = pairs.select("pair_id", F.length("query").cast("bigint").alias("n"), (F.col("pair_id") % 3 == 0).alias("turned"), F.posexplode(steps).alias("k", "x")).where("x.b is not null")
    rows = rows.select("*", F.expr("if(turned, x.b.query_end, x.a.query_start)").alias("qs"), F.expr("if(turned, x.a.query_end, x.b.query_start)").alias("qe"), F.col("x.a.ref_start").alias("ts"), F.col("x.b.ref_end").alias("te"))
    zero = F.lit(0).cast("bigint")
    rows = rows.where("qe > qs and abs(qe - qs - (te - ts)) <= 300").select(
        F.col("pair_id").alias("q"), F.col("n").alias("qlen"), "qs", "qe", F.when(F.col("turned"), "-").otherwise("+").alias("strand"), F.col("pair_id").alias("t"), "ts", "te", (F.col("pair_id") * 1_000_000 + F.col("k")).alias("chain_no"),
        F.concat((F.col("te") - F.col("ts")).cast("string"), F.lit("D"), (F.col("qe") - F.col("qs")).cast("string"), F.lit("I")).alias("cigar"), zero.alias("matches"), zero.alias("block"), zero.alias("score"),
        F.lit("raw").alias("source"), F.lit("direct").alias("mode"), zero.alias("patches"),
    )
    chunks = lambda c: records.chunked(pairs.select(F.col("pair_id").alias("sequence_id"), F.col(c).alias("seq")), 4096)
    return rows, chunks("ref"), chunks("query")


@query()
def records_realigned(spark, d):
    """Records between neighbouring anchors, clipped where they overlap by one, and aligned again from the bases that stay."""
    rows, targets, queries = _anchor_records(spark, d)
    return normalising.realigned(normalising.normalised(rows, NORMALISING), targets, queries, 4096).drop("realign")


@query("select q, 1000000000::bigint as qlen, case when strand = '+' then o_end - arm else 1000000000 - o_end end as qs, case when strand = '+' then o_end else 1000000000 - o_end + arm end as qe, strand, t, te - arm as ts, te, chain_no, arm || '=' as cigar, arm as matches, arm as block, arm as score, 'inversion_boundary_flank' as source, 'terminal_exact_recovery' as mode, 0::bigint as patches from sized where arm >= 500", src.TRACK_RECORDS)
def terminal_flanks(spark, d):
    """Exact matches of 500 bases or more that alignment records end with."""
    return normalising.terminal_exact_flank(src.track_records(spark, d), 500)


@query()
def final_bundles(spark, d):
    """Bundles after better ones of their track took their place."""
    rows = src.track_records(spark, d).select("q", "t", "strand", "chain_no", F.col("ts").alias("ref_start"), F.col("te").alias("ref_end"), F.col("qs").alias("query_start"), F.col("qe").alias("query_end"), "score")
    return normalising.final_trimmed(rows, 0.3, 40)


# Tables between stages ------------------------------------------------------------------------------

#: The sample columns that a stage table of anchors has.
SAMPLES = [f"s{k}" for k in range(4)]
STAGED = ALPHA + """,
staged as (select e.anchor_id, e.sequence_id, e.center, e.group_id, e.groupable, e.anchor_id % 97 = 0 as odd, e.anchor_id % 89 = 0 as unlike from event_anchors e)"""


def _stage_table(spark, d):
    """Anchors with their counts by sample written as a stage's table and read back; some lines have a signed start or a flag in capitals."""
    counts = alpha_prime(spark, d).groupBy("anchor_id").pivot("of_sample", SAMPLES).agg(F.first("alpha"))
    rows = src.event_anchors(spark, d).join(counts, "anchor_id", "left").na.fill(0, SAMPLES)
    start = F.when(F.col("anchor_id") % 97 == 0, F.concat(F.lit("+"), F.col("center").cast("string"))).otherwise(F.col("center").cast("string"))
    flag = F.when(F.col("anchor_id") % 89 == 0, F.upper(F.col("groupable").cast("string"))).otherwise(F.col("groupable").cast("string"))
    table = rows.select(F.col("group_id").alias("anchor_group_id"), start.alias("start"), (F.col("center") + 50).alias("end"), F.col("anchor_id").cast("string").alias("anchor_id"), F.col("sequence_id").cast("string").alias("sequence_id"), flag.alias("groupable"), *(F.col(s).alias(f"{s}_alpha_prime") for s in SAMPLES))
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    staged.write_stage(table, path)
    return staged.read_stage(spark, path, staged.GROUPED_ANCHORS, block=("alpha", "_alpha_prime"))


@query("""select s.anchor_id::varchar as anchor_id, s.sequence_id::varchar as sequence_id, center as start, center + 50 as "end", group_id as anchor_group_id, groupable, 's' || k as of_sample, coalesce(alpha, 0)::bigint as alpha
  from staged s cross join range(4) r(k) left join alpha a on a.anchor_id = s.anchor_id and a.of_sample = 's' || k where not odd and not unlike""", STAGED)
def stage_table_rows(spark, d):
    """The rows of a stage's table of anchors, a row a sample."""
    return _stage_table(spark, d)[0].select("anchor_id", "sequence_id", "start", "end", "anchor_group_id", "groupable", F.explode("alpha").alias("of_sample", "alpha"))


@query("""select case when odd then 'invalid integer in start: +' || center else 'invalid flag in groupable: ' || upper(groupable::varchar) end as reason, count(*) as n from staged where odd or unlike group by 1""", STAGED)
def stage_table_rejects(spark, d):
    """Why lines of a stage's table of anchors are left out."""
    return _stage_table(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
