"""Registered queries of catalogs, interval fetch, records and callset summaries, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sequence as fx
from tessera.jobs.queries import GAPS, TOKENS, _tokens, query, sv_band_match_edges, truth_boundary_best
from tessera.operators import band_matching, intervals, records, stitching, truth
from tessera.operators.evaluation import failure_modes
from tessera.sources import formats, paf
from tessera.sources import tables as src

EDGES = src.SV_EVENTS + """,
edges as (select a.event_id as left_id, b.event_id as right_id from sv_events a join sv_events b on a.setno = 0 and b.setno = 1 and a.chrom = b.chrom and a.kind = b.kind and abs(a.pos - b.pos) <= 25 and least(a.size, b.size) >= 0.7 * greatest(a.size, b.size)),
hits as (select left_id as event_id from edges union select right_id from edges),
counts as (select chrom as sample, count(*) filter (where setno = 0 and h.event_id is not null) as tp, count(*) filter (where setno = 1 and h.event_id is null) as fp, count(*) filter (where setno = 0 and h.event_id is null) as fn
  from sv_events e left join hits h using (event_id) where setno < 2 group by chrom)"""
TRUTHS = src.INTERVALS + """,
best as (select a.strand, a.qs, a.qe, x.cs, x.ce from (select distinct q, strand, qs, qe from intervals where t = 't0' and qe > qs) a
  join lateral (select c.qs as cs, c.qe as ce from intervals c where c.t <> 't0' and c.q = a.q and c.strand = a.strand and c.qs < a.qe and c.qe > a.qs order by least(a.qe, c.qe) - greatest(a.qs, c.qs) desc, c.qs, c.qe desc limit 1) x on true),
far as (select strand, greatest(abs(cs - qs), abs(ce - qe)) as far from best)"""
FETCHED = src.SEQUENCES + """,
wanted as (select distinct sequence_id, s as start, e as "end", case when sequence_id % 2 = 0 then '+' else '-' end as strand from (select sequence_id, unnest([0, length(seq) // 4, length(seq) - 60]) as s, unnest([50, 3 * (length(seq) // 4), length(seq)]) as e from sequences where length(seq) >= 60) where e > s)"""


@query("""select q as qname, 10000::bigint as qlen, qs, qe, strand, t as tname, 200000::bigint as tlen, ts, te, score as matches, greatest(qe - qs, te - ts) as block, 60::bigint as mapq, 'P' as tp from intervals""", src.INTERVALS)
def paf_roundtrip(spark, d):
    """Intervals written as alignment lines of twelve columns and a tag, and read back."""
    rows = src.intervals(spark, d).select(
        F.col("q").alias("qname"), F.lit(10000).cast("bigint").alias("qlen"), "qs", "qe", "strand", F.col("t").alias("tname"), F.lit(200000).cast("bigint").alias("tlen"), "ts", "te", F.col("score").alias("matches"),
        F.greatest(F.col("qe") - F.col("qs"), F.col("te") - F.col("ts")).alias("block"), F.lit(60).cast("bigint").alias("mapq"), F.create_map(F.lit("tp:A"), F.lit("P")).alias("tags"),
    )
    return paf.parse_lines(paf.to_lines(rows)).select(*paf.COLUMNS, F.col("tags")["tp:A"].alias("tp"))


@query("select sample, sum(n)::bigint as sequences, sum(bases)::bigint as bases, max(longest)::bigint as longest, count(*) filter (where n > 1) as repeated from (select sample, sequence_id, count(*) as n, sum(length(seq)) as bases, max(length(seq)) as longest from sequences group by 1, 2) group by sample", src.SEQUENCES)
def sequence_catalog(spark, d):
    """Sequences, bases and repeated ids of every sample."""
    return records.catalog(src.sequences(spark, d))


@query("select sample, sequence_id::varchar as sequence_id, length(seq)::bigint as bases, 2::bigint as copies from sequences where sequence_id % 3 = 0 union all select sample, sequence_id::varchar, length(seq), case when sequence_id % 3 = 0 then 2 else 1 end from sequences", src.SEQUENCES)
def fasta_combined(spark, d):
    """Two FASTA inputs combined, with how often each sample's sequence id stands in them."""
    rows = src.sequences(spark, d)
    read = lambda part: formats.parse_fasta(formats.fasta_records(part.select(F.concat_ws("#", F.coalesce("sample", F.lit("")), F.col("sequence_id").cast("string")).alias("sequence_id"), "seq")))
    named = lambda part: read(part).select(F.substring_index("sequence_id", "#", 1).alias("sample"), F.substring_index("sequence_id", "#", -1).alias("sequence_id"), "seq")
    both = records.combined([named(rows), named(rows.where("sequence_id % 3 = 0"))])
    return both.select("sample", "sequence_id", F.length("seq").cast("bigint").alias("bases"), "copies")


@query("""select sequence_id, start::bigint as start, "end"::bigint as "end", strand, sha256(case when strand = '-' then reverse(translate(x, 'ACGT', 'TGCA')) else x end) as digest from (select w.*, substr(seq, (start + 1)::bigint, ("end" - start)::bigint) as x from wanted w join sequences using (sequence_id))""", FETCHED)
def interval_fetch(spark, d):
    """Three intervals of every sequence fetched from chunks, on the strand of the sequence."""
    rows = src.sequences(spark, d)
    n = F.length("seq").cast("bigint")
    quarter = F.expr("cast(length(seq) as bigint) div 4")
    spans = F.array(*(F.struct(a.alias("start"), b.alias("end")) for a, b in ((F.lit(0).cast("bigint"), F.lit(50).cast("bigint")), (quarter, 3 * quarter), (n - 60, n))))
    wanted = rows.where("length(seq) >= 60").select("sequence_id", F.explode(spans).alias("x")).select("sequence_id", "x.start", "x.end", F.when(F.col("sequence_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    size = 1024
    return records.fetch(records.chunked(rows, size), wanted, size).select("sequence_id", "start", "end", "strand", F.sha2("bases", 256).alias("digest"))


@query("""select sequence_id::varchar as sequence_id, center as start, center + 50 as "end", 'anchor_' || lpad(anchor_id::varchar, greatest(8, length(anchor_id::varchar))::int, '0') as anchor_id, (anchor_id % 97)::double as score from event_anchors""", src.EVENT_ANCHORS)
def bed_roundtrip(spark, d):
    """Anchors written as BED lines and read back."""
    rows = src.event_anchors(spark, d).select("sequence_id", F.col("center").alias("start"), (F.col("center") + 50).alias("end"), F.col("anchor_id").cast("bigint").alias("anchor_id"), (F.col("anchor_id") % 97).cast("double").alias("score"))
    return records.parse_bed(records.bed_lines(rows))


@query("""select case when a then t else q end as q, case when a then ts else qs end as qs, case when a then te else qe end as qe, strand, case when a then q else t end as t, case when a then qs else ts end as ts, case when a then qe else te end as te, score
  from (select *, q in ('q1', 'q2', 'q3') as a, t = 't0' as b from intervals) where a <> b""", src.INTERVALS)
def reference_oriented(spark, d):
    """Intervals between a reference and another sequence, turned so that the reference is the target."""
    return records.towards_reference(src.intervals(spark, d), F.col("q").isin("q1", "q2", "q3"), F.col("t") == "t0")


@query(f"""select pair_id, forward, reverse, incompatible, case when reverse > forward then '-' else '+' end as effective from (select pair_id, count(*) filter (where a = b) as forward, count(*) filter (where a <> b and a = reverse(translate(b, 'ACGT', 'TGCA'))) as reverse,
  count(*) filter (where a <> b and a <> reverse(translate(b, 'ACGT', 'TGCA'))) as incompatible from (select g.pair_id, substr(p.ref, p + 1, {src.ANCHOR}) as a, substr(p.query, s + 1, {src.ANCHOR}) as b from guided g left join places p using (pair_id)) group by pair_id)""", src.SEQUENCES + ",\n" + src.GUIDED)
def strand_vote(spark, d):
    """Votes of every pair's anchors by their bases, and the strand of the majority."""
    return stitching.strand_votes(src.guided_pairs(spark, d)).select("pair_id", "forward", "reverse", "incompatible", "effective")


@query()
def anchor_guided_align(spark, d):
    """Sequences and their altered copies aligned between equal anchors and put together."""
    return stitching.anchor_guided(src.guided_pairs(spark, d))


@query("""select q, t, strand, case when strand = '+' then qs + head else qs + tail end as qs, case when strand = '+' then qe - tail else qe - head end as qe, a as ts, b as te from (select *, ((a - ts) * (qe - qs)) // (te - ts) as head, ((te - b) * (qe - qs)) // (te - ts) as tail
  from (select *, greatest(ts, 300) as a, least(te, 9000) as b from intervals where te > 300 and ts < 9000 and te > ts))""", src.INTERVALS)
def interval_clip(spark, d):
    """Intervals cut to a window of the target, the query in proportion."""
    return records.clipped(src.intervals(spark, d), 300, 9000)


@query("""select t || '/' || q as name, replace(t || '/' || q, '/', '_') as safe, ts as start, te as "end", count(*) as n from intervals group by all""", src.INTERVALS)
def locus_names(spark, d):
    """Loci written as names with spans and parsed again, with their safe file names."""
    text = F.concat(F.concat_ws("/", "t", "q"), F.lit(":"), F.col("ts").cast("string"), F.lit("-"), F.col("te").cast("string"))
    name, start, end = records.locus(F.col("locus"))
    rows = src.intervals(spark, d).select(text.alias("locus")).select(name.alias("name"), start.alias("start"), end.alias("end"))
    return rows.groupBy("name", records.safe_name(F.col("name")).alias("safe"), "start", "end").agg(F.count("*").alias("n"))


@query("""select pair_id, sum(case when a = b then 1 else 0 end)::bigint as matches, count(*)::bigint as columns, sum(case when (a = b) is distinct from before then 1 else 0 end)::bigint as runs from (select *, lag(a = b) over (partition by pair_id order by i) as before from (
  select pair_id, i, substr(ref, i, 1) as a, substr(copy, i, 1) as b from (select *, unnest(generate_series(1, least(length(ref), length(copy)))) as i from guided))) group by pair_id""", src.SEQUENCES + ",\n" + src.GUIDED)
def matches_expanded(spark, d):
    """The columns that sequences and their altered copies both have as one M operation, told apart by letters."""
    rows = src.guided_pairs(spark, d)
    query = F.when(F.col("pair_id") % 3 == 0, fx.reverse_complement(F.col("query"))).otherwise(F.col("query"))
    n = F.least(F.length("ref"), F.length(query))
    pairs = rows.select("pair_id", F.substring("ref", F.lit(1), n).alias("ref"), F.substring(query, F.lit(1), n).alias("query"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"))
    done = stitching.expand_matches(pairs)
    ops = fx.cigar_ops(F.col("cigar"))
    return done.select("pair_id", "matches", fx.consumed(ops, "=X").alias("columns"), F.size(ops).cast("bigint").alias("runs"))


CIGAR_TEXTS = src.SEQUENCES + ",\n" + src.GUIDED + """,
letters as (select pair_id, i, if(substr(ref, i, 1) = substr(copy, i, 1), '=', 'X') as op from (select *, unnest(generate_series(1, least(length(ref), length(copy)))) as i from guided)),
runs as (select pair_id, op, min(i) as i, count(*) as n from (select *, i - row_number() over (partition by pair_id, op order by i) as island from letters) group by pair_id, op, island),
texts as (select pair_id, string_agg(n || op, '' order by i) as cg, sum(n) filter (where op = '=') as matches from runs group by pair_id),
sides as (select pair_id, length(ref)::bigint as tlen, length(copy)::bigint as qlen from guided)"""


@query("""select 'q' || pair_id as qname, qlen, 0::bigint as qs, qlen as qe, '+' as strand, 't' || pair_id as tname, tlen, 0::bigint as ts, tlen as te, coalesce(matches, 0)::bigint as matches, greatest(tlen, qlen) as block, 255::bigint as mapq,
  coalesce(cg, '') || case when tlen > qlen then (tlen - qlen) || 'D' when qlen > tlen then (qlen - tlen) || 'I' else '' end as cg from sides left join texts using (pair_id)""", CIGAR_TEXTS)
def cigar_file_records(spark, d):
    """Records of whole sequences, their altered copies and a CIGAR of one M and the rest, written as lines and read back."""
    rows = src.guided_pairs(spark, d)
    query = F.when(F.col("pair_id") % 3 == 0, fx.reverse_complement(F.col("query"))).otherwise(F.col("query"))
    pairs = rows.select(F.concat(F.lit("q"), "pair_id").alias("qname"), query.alias("query"), F.concat(F.lit("t"), "pair_id").alias("tname"), F.col("ref").alias("target"))
    n, m = F.length("query"), F.length("target")
    rest = F.when(m > n, F.concat((m - n).cast("string"), F.lit("D"))).when(n > m, F.concat((n - m).cast("string"), F.lit("I"))).otherwise("")
    found = stitching.cigar_records(pairs.withColumn("cigar", F.concat(F.least(m, n).cast("string"), F.lit("M"), rest)))
    return paf.parse_lines(paf.to_lines(found)).select(*paf.COLUMNS, F.col("tags")["cg:Z"].alias("cg"))


TRUTH_RULE = "recursive " + src.TRUTH_EVENTS + """,
sized as (select *, greatest(ref_end - ref_start, 0) as span, case when ref_end > ref_start then ref_end - ref_start else query_delta end as len from truth_events),
reach as (select *, case when kind in ('INV', 'DUP') then ref_start + len when kind = 'DEL' or (kind = 'BND' and span > 0) then ref_end else ref_start end as stop from sized),
ranked as (select *, row_number() over (partition by chrom order by ref_start, ref_end, event_id) as k from reach),
walk as (select distinct chrom, 0::bigint as k, 0::bigint as cursor, 0::bigint as q from truth_events
  union all select w.chrom, e.k, greatest(w.cursor, e.stop), w.q + greatest(e.ref_start - w.cursor, 0) + case e.kind when 'DEL' then 0 when 'INV' then e.len when 'DUP' then 2 * e.len else e.query_delta end from walk w join ranked e on e.chrom = w.chrom and e.k = w.k + 1),
placed as (select e.*, w.cursor, w.q, greatest(e.ref_start - w.cursor, 0) as flank from ranked e join walk w on w.chrom = e.chrom and w.k = e.k - 1),
ends as (select chrom, max(cursor) as cursor, max(q) as q, (select max(ref_end) + 10000 from truth_events e where e.chrom = walk.chrom) as tlen from walk group by chrom),
blocks as (
  select chrom, event_id, 'flank' as block, '+' as strand, q as query_start, q + flank as query_end, chrom as target, cursor as ref_start, cursor + flank as ref_end from placed
  union all select chrom, event_id, 'INV', '-', q + flank, q + flank + len, chrom, ref_start, ref_start + len from placed where kind = 'INV'
  union all select chrom, event_id, 'DUP_original', '+', q + flank, q + flank + len, chrom, ref_start, ref_start + len from placed where kind = 'DUP'
  union all select chrom, event_id, 'DUP_extra_copy', '+', q + flank + len, q + flank + 2 * len, chrom, ref_start, ref_start + len from placed where kind = 'DUP'
  union all select chrom, event_id, kind || '_source', '+', q + flank, q + flank + n, source_chrom, source_start, source_start + n from (select *, case when source_end > source_start then least(query_delta, source_end - source_start) else query_delta end as n from placed where kind in ('INS', 'BND') and source_chrom is not null)
  union all select chrom, null, 'flank', '+', q, q + tlen - cursor, chrom, cursor, tlen from ends)"""


def _truth(spark, d):
    events = src.truth_events(spark, d)
    return events, events.groupBy("chrom").agg((F.max("ref_end") + 10_000).alias("length"))


@query("select *, least(query_end - query_start, ref_end - ref_start) as matches, greatest(query_end - query_start, ref_end - ref_start) as bases from blocks where query_end > query_start and ref_end > ref_start", TRUTH_RULE)
def truth_blocks(spark, d):
    """Alignment blocks of the changed sequences that the truth's variants make, with those of inversions, duplications and sources."""
    return truth.truth_blocks(*_truth(spark, d))


@query()
def truth_graph_steps(spark, d):
    """Paths of the reference and of the changed sequences through the segments between the truth's breakpoints."""
    return truth.graph_steps(*_truth(spark, d))


@query()
def truth_graph_links(spark, d):
    """How often each pair of neighbouring segments follows one another in the paths."""
    return truth.graph_links(truth.graph_steps(*_truth(spark, d)))


@query("""select c.event_id, count(t.event_id) as near, min(abs(t.pos - c.pos)) as nearest, coalesce(string_agg(t.event_id::varchar, ',' order by t.event_id), '') as ids from sv_events c left join sv_events t on t.setno = 0 and t.chrom = c.chrom and abs(t.pos - c.pos) <= 40 where c.setno = 2 group by c.event_id""", src.SV_EVENTS)
def fp_near_truths(spark, d):
    """For every event of the third set the truth events near it, with their ids."""
    rows = src.sv_events(spark, d)
    return records.nearby(rows.where("setno = 2"), rows.where("setno = 0"), 40)


@query("select event_id, exists (select 1 from sv_events r where r.setno = 1 and r.chrom = c.chrom and r.pos = c.pos and r.kind = c.kind) as in_raw from sv_events c where setno = 2", src.SV_EVENTS)
def fp_in_raw(spark, d):
    """Whether each event of the third set stands in the second one too."""
    rows = src.sv_events(spark, d)
    return records.flagged(rows.where("setno = 2"), rows.where("setno = 1"), ["chrom", "pos", "kind"]).select("event_id", "in_raw")


@query("select sample, tp, fp, fn from counts", EDGES)
def sample_match_counts(spark, d):
    """Matched truths, unmatched calls and unmatched truths by chromosome."""
    return records.match_counts(src.sv_events(spark, d), sv_band_match_edges(spark, d))


@query("select tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 9) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 9) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 9) else 0 end as f1 from (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from counts)", EDGES)
def micro_prf(spark, d):
    """Precision, recall and F1 over all samples' counts."""
    return records.micro_scores(sample_match_counts(spark, d))


@query()
def sv_maximum_matching(spark, d):
    """A largest one-to-one matching of the truth set with the call set."""
    return band_matching.largest_matching_in_band(src.sv_events(spark, d))


@query("select chrom, n as ac, count(*) as alleles from (select chrom, pos, kind, size, count(*) as n from sv_events group by all) group by 1, 2", src.SV_EVENTS)
def allele_count_distribution(spark, d):
    """Alleles of every chromosome by the number of records that have them."""
    return records.allele_counts(src.sv_events(spark, d))


@query("""select strand, count(*) as n, count(*) filter (where far <= 10) as within_10, count(*) filter (where far <= 50) as within_50, count(*) filter (where far <= 100) as within_100, count(*) filter (where far <= 500) as within_500, count(*) filter (where far <= 1000) as within_1000,
  list_sort(list(far))[floor(0.5 * (count(*) - 1))::int + 1] as p50, list_sort(list(far))[floor(0.95 * (count(*) - 1))::int + 1] as p95 from far group by strand""", TRUTHS)
def boundary_deltas(spark, d):
    """How far the ends of the best call lie from each truth's, by strand."""
    return records.delta_summary(truth_boundary_best(spark, d))


@query("""select mode, coalesce(sum(n) filter (where chrom = 'chr0'), 0)::bigint as chr0, coalesce(sum(n) filter (where chrom = 'chr1'), 0)::bigint as chr1, coalesce(sum(n) filter (where chrom = 'chr2'), 0)::bigint as chr2, coalesce(sum(n) filter (where chrom = 'chr3'), 0)::bigint as chr3, coalesce(sum(n) filter (where chrom = 'chr4'), 0)::bigint as chr4 from (
  select chrom, case max_level when 3 then 'same_place' when 2 then 'same_kind_near' when 1 then 'other_kind_near' else 'isolated' end as mode, count(*) as n from (
  select c.event_id, c.chrom, c.kind, max(case when t.pos is null then 0 when t.pos = c.pos and t.kind = c.kind then 3 when t.kind = c.kind then 2 else 1 end) as max_level
  from sv_events c left join sv_events t on t.setno = 0 and t.chrom = c.chrom and abs(t.pos - c.pos) <= 50 where c.setno = 2 group by 1, 2, 3) group by 1, 2) group by mode""", src.SV_EVENTS)
def fp_mode_pivot(spark, d):
    """Third-set events by what is near them, a column a chromosome."""
    names = [f"chr{k}" for k in range(5)]
    return failure_modes(src.sv_events(spark, d)).groupBy("mode").pivot("chrom", names).agg(F.sum("n")).na.fill(0, names)


@query("select sample, token, n from (select sample, token, count(*) as n, row_number() over (partition by sample order by count(*) desc, token) as place from tokens group by 1, 2) where place <= 5", TOKENS)
def most_common_tokens(spark, d):
    """The five most common tokens of every sample."""
    from pyspark.sql import Window

    counts = _tokens(spark, d).groupBy("sample", "token").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("n"), "token"))).where("place <= 5").drop("place")


@query("""select cigar, regexp_extract(cigar, '^([0-9]+)=', 1)::bigint as leading, regexp_extract(cigar, '([0-9]+)=$', 1)::bigint as trailing,
  regexp_replace(cigar, '[0-9]+=$', '') || (regexp_extract(cigar, '([0-9]+)=$', 1)::bigint + regexp_extract(cigar, '^([0-9]+)=', 1)::bigint)::varchar || '=' || regexp_replace(cigar, '^[0-9]+=', '') as joined,
  case when regexp_extract(cigar, '^([0-9]+)=', 1)::bigint > 10 then (regexp_extract(cigar, '^([0-9]+)=', 1)::bigint - 10)::varchar || '=' else '' end || regexp_replace(cigar, '^[0-9]+=', '') as trimmed, count(*) as n from cigars group by all""", src.CIGARS)
def cigar_runs(spark, d):
    """CIGARs joined to themselves with runs merged, their exact flanks, and the front flank trimmed by ten bases."""
    c = F.col("cigar")
    lead, tail = records.exact_flanks(c)
    rows = src.cigars(spark, d).groupBy("cigar").agg(F.count("*").alias("n"))
    return rows.select("cigar", lead.alias("leading"), tail.alias("trailing"), records.merged_runs(F.concat(c, c)).alias("joined"), records.without_leading_match(c, 10).alias("trimmed"), "n")


@query("""select i.q, covered, coalesce(n, 0) as gaps, coalesce(open_gaps, 0) as open_gaps from (select q, sum("end" - start)::bigint as covered from (select q, island, min(start) as start, max("end") as "end" from (
    select *, sum(new) over (partition by q order by start rows between unbounded preceding and current row) as island from (
    select *, case when start > max("end") over (partition by q order by start rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from (select q, qs as start, max(qe) as "end" from intervals group by q, qs))) group by q, island) group by q) i
  left join (select q, count(*) as n, count(*) filter (where cause = 'open_gap') as open_gaps from gaps group by q) g on g.q = i.q""", GAPS)
def coverage_and_gaps(spark, d):
    """Covered bases of every query beside the number of its gaps."""
    rows = src.intervals(spark, d)
    gaps = intervals.adjacent_gaps(rows).groupBy("q").agg(F.count("*").alias("gaps"), F.count_if(F.col("cause") == "open_gap").alias("open_gaps"))
    return intervals.union_coverage(rows, ["q"], "qs", "qe").select("q", "covered").join(gaps, "q", "left").na.fill(0, ["gaps", "open_gaps"])
