"""The given Parquet tables and what is derived from them to feed the sequence operators.

Each derivation is a DataFrame function and the same thing as DuckDB SQL (a list of named CTEs), so
that queries and their SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import reverse_complement

#: Milliseconds in a distance bin of the event token streams.
TOKEN_BIN = 21_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, sample, seq): whole documents as nucleotide-like strings; the sample is the language."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    seq = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence_id"), F.col("lang").alias("sample"), seq.alias("seq"))


SEQUENCES = """sequences as (select doc_id as sequence_id, lang as sample,
  translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents)"""


def event_anchors(spark: SparkSession, sf_dir: str, width: float = 50) -> DataFrame:
    """(anchor_id, sequence_id, sample, center, group_id, groupable): events as anchors on their user's time line, grouped by kind and value in steps of ``width``."""
    center = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 1000")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("anchor_id"), F.col("user_id").alias("sequence_id"), F.expr("concat('s', user_id % 4)").alias("sample"), center.alias("center"),
        F.expr(f"concat(event_type, ':', cast(floor(value / {width}) as int))").alias("group_id"), F.expr("cast(floor(value) as int) % 17 <> 0").alias("groupable"),
    )


EVENT_ANCHORS = """event_anchors as (select event_id as anchor_id, user_id as sequence_id, 's' || (user_id % 4) as sample,
  (epoch_us(ts) - 1704067200000000) // 1000 as center, event_type || ':' || floor(value / 50)::int as group_id, floor(value)::int % 17 <> 0 as groupable from events)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, t, strand, qs, qe, ts, te, score): line items as pairs of half-open intervals on two axes."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q', l_suppkey) as q", "concat('t', l_partkey % 5) as t", "if(l_returnflag = 'R', '-', '+') as strand", "l_orderkey % 5000 as qs", "l_orderkey % 5000 + cast(l_quantity as bigint) as qe",
        "l_partkey * 7 + l_linenumber * 3 as ts", "l_partkey * 7 + l_linenumber * 3 + cast(l_quantity as bigint) as te", "cast(round(l_extendedprice) as bigint) as score",
    )


INTERVALS = """intervals as (select 'q' || l_suppkey as q, 't' || (l_partkey % 5) as t, case when l_returnflag = 'R' then '-' else '+' end as strand,
  l_orderkey % 5000 as qs, l_orderkey % 5000 + l_quantity::bigint as qe, l_partkey * 7 + l_linenumber * 3 as ts, l_partkey * 7 + l_linenumber * 3 + l_quantity::bigint as te,
  round(l_extendedprice)::bigint as score from lineitem)"""


def planted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, t, strand, qs, ts, score, both, ambiguous): line items as anchor pairs of sequence pairs with rearrangements.

    The reference place is the order's key.  Blocks of 4,000 are shifted against each other, every fifth is turned
    round, some lie a block ahead; of seven line numbers two are noise, and one, ambiguous, lies 700 beside its block.
    """
    block, at, turned = "(l_orderkey div 4000)", "(l_orderkey % 4000)", "(l_orderkey div 4000) % 5 = 3"
    shift = f"({block} * 7919 % 13 - 6) * 400 + if({block} % 11 = 7, 9000, 0) + if(l_linenumber = 5, 700, 0)"
    true = f"40000 + {block} * 4000 + if({turned}, 4000 - {at}, {at}) + {shift} + cast(l_quantity as bigint) % 3"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q', l_partkey % 7) as q", "concat('t', l_suppkey % 5) as t", f"if({turned}, '-', '+') as strand", f"if(l_linenumber >= 6, 40000 + l_partkey * 7919 % 60000, {true}) as qs", "l_orderkey as ts",
        "1 + cast(l_quantity as bigint) % 20 as score", "l_linestatus = 'O' and l_linenumber < 5 as both", "l_linenumber = 5 as ambiguous",
    )


#: Bases of a planted anchor, and between two of them.
ANCHOR, ANCHOR_STEP = 40, 300


def guided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, ref, query, strand, anchors): sequences and altered copies, every third turned round, with where pieces of the first stand in the other.

    Copies lack 30 bases and have substitutions, deletions and insertions at certain words; a piece's place is the
    first where the copy has it, so some anchors are wrong.  The strand that is claimed is always +.
    """
    altered = F.concat(F.expr("substr(seq, 1, length(seq) div 3)"), F.expr("substr(seq, length(seq) div 3 + 31)"))
    for word, other in (("ACGTA", "ACTTA"), ("GGATC", "GGTC"), ("TTGCA", "TTGGGCA")):
        altered = F.regexp_replace(altered, word, other)
    rows = sequences(spark, sf_dir).where("length(seq) >= 400").select(F.col("sequence_id").alias("pair_id"), F.col("seq").alias("ref"), altered.alias("copy"))
    turned = F.col("pair_id") % 3 == 0
    at = f"transform(sequence(0, length(ref) - {ANCHOR}, {ANCHOR_STEP}), p -> named_struct('p', cast(p as bigint), 'c', cast(locate(substr(ref, p + 1, {ANCHOR}), copy) - 1 as bigint)))"
    start = f"if(pair_id % 3 = 0, length(copy) - x.c - {ANCHOR}, x.c)"
    places = f"transform(filter({at}, x -> x.c >= 0), x -> named_struct('ref_start', x.p, 'ref_end', x.p + {ANCHOR}, 'query_start', cast({start} as bigint), 'query_end', cast({start} + {ANCHOR} as bigint)))"
    return rows.select("pair_id", "ref", F.when(turned, reverse_complement(F.col("copy"))).otherwise(F.col("copy")).alias("query"), F.lit("+").alias("strand"), F.expr(places).alias("anchors"))


GUIDED = f"""guided as (select pair_id, ref, case when pair_id % 3 = 0 then reverse(translate(copy, 'ACGT', 'TGCA')) else copy end as query, copy from (
  select sequence_id as pair_id, seq as ref, regexp_replace(regexp_replace(regexp_replace(substr(seq, 1, length(seq) // 3) || substr(seq, length(seq) // 3 + 31), 'ACGTA', 'ACTTA', 'g'), 'GGATC', 'GGTC', 'g'), 'TTGCA', 'TTGGGCA', 'g') as copy from sequences where length(seq) >= 400)),
places as (select pair_id, p, case when pair_id % 3 = 0 then length(copy) - c - {ANCHOR} else c end as s, ref, query from (select *, instr(copy, substr(ref, p + 1, {ANCHOR})) - 1 as c from (select *, unnest(generate_series(0, length(ref) - {ANCHOR}, {ANCHOR_STEP}))::bigint as p from guided)) where c >= 0)"""


def truth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, event_id, kind, ref_start, ref_end, query_delta, source_chrom, source_start, source_end): orders as variants of five kinds along five chromosomes."""
    kind = "element_at(array('DEL', 'INS', 'INV', 'DUP', 'BND'), cast(o_orderkey % 5 + 1 as int))"
    size = "50 + cast(floor(o_totalprice) as bigint) % 2000"
    span = f"case o_orderkey % 5 when 1 then 0 when 4 then if(o_custkey % 4 = 0, 30, 0) when 3 then if(o_custkey % 7 = 0, 0, {size}) else {size} end"
    from_ = "o_orderkey % 5 in (1, 4) and o_custkey % 2 = 0"
    rows = table(spark, sf_dir, "orders").selectExpr("concat('chr', o_custkey % 5) as chrom", "o_orderkey as event_id", f"{kind} as kind", "o_orderkey * 97 as ref_start", f"o_orderkey * 97 + {span} as ref_end", f"{size} as query_delta",
        f"if({from_}, concat('chr', o_custkey % 3), null) as source_chrom", f"if({from_}, o_custkey * 31, null) as source_start", f"if({from_}, o_custkey * 31 + o_custkey % 1500, null) as source_end")
    return rows


TRUTH_EVENTS = """truth_events as (select chrom, event_id, kind, ref_start, ref_start + case event_id % 5 when 1 then 0 when 4 then case when cust % 4 = 0 then 30 else 0 end when 3 then case when cust % 7 = 0 then 0 else size end else size end as ref_end, size as query_delta,
  case when src then 'chr' || (cust % 3) end as source_chrom, case when src then cust * 31 end as source_start, case when src then cust * 31 + cust % 1500 end as source_end from (
  select 'chr' || (o_custkey % 5) as chrom, o_orderkey as event_id, ['DEL', 'INS', 'INV', 'DUP', 'BND'][o_orderkey % 5 + 1] as kind, o_orderkey * 97 as ref_start, 50 + floor(o_totalprice)::bigint % 2000 as size, o_custkey as cust, o_orderkey % 5 in (1, 4) and o_custkey % 2 = 0 as src from orders))"""


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, strand, ts, cigar): an alignment of each line item's two intervals."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q', l_suppkey) as q", "if(l_returnflag = 'R', '-', '+') as strand", "l_partkey * 7 + l_linenumber * 3 as ts",
        "concat(cast(l_quantity as int), '=', l_linenumber, 'X', case when l_discount >= 0.05 then concat(cast(round(l_discount * 1000) as int), case when l_returnflag = 'A' then 'I' else 'D' end) else '' end, cast(l_quantity as int), '=') as cigar",
    )


CIGARS = """cigars as (select 'q' || l_suppkey as q, case when l_returnflag = 'R' then '-' else '+' end as strand, l_partkey * 7 + l_linenumber * 3 as ts,
  l_quantity::int || '=' || l_linenumber || 'X' || case when l_discount >= 0.05 then round(l_discount * 1000)::int || case when l_returnflag = 'A' then 'I' else 'D' end else '' end || l_quantity::int || '=' as cigar from lineitem)"""


def sv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, setno, chrom, pos, kind, size): orders as structural variants of three callsets."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as event_id", "o_orderkey % 3 as setno", "concat('chr', o_custkey % 5) as chrom", "(o_custkey * 13) % 100000 as pos", "if(o_orderstatus = 'F', 'DEL', 'INS') as kind",
        "50 + cast(floor(o_totalprice) as bigint) % 2000 as size",
    )


SV_EVENTS = """sv_events as (select o_orderkey as event_id, o_orderkey % 3 as setno, 'chr' || (o_custkey % 5) as chrom, (o_custkey * 13) % 100000 as pos,
  case when o_orderstatus = 'F' then 'DEL' else 'INS' end as kind, 50 + floor(o_totalprice)::bigint % 2000 as size from orders)"""


#: The copy of planted duplications that a place of the reference has on the query axis.
_MIRROR = "{0} + 40000 + (({0} {1} 4000) * 7919 % 13 - 6) * 400"
#: Hexadecimal digits and the bases that stand for them.
_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def dup_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth_id, q, t, ref_start, ref_end, query_start, query_end, pct_sequence, pct_size, source): orders as duplications that were missed, with the bases of one copy."""
    size = "20 + cast(floor(o_totalprice) as bigint) % 300"
    start = _MIRROR.format("o_orderkey", "div")
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 = 3").selectExpr(
        "o_orderkey as truth_id", "concat('q', (o_orderkey div 5) % 7) as q", "concat('t', (o_orderkey div 5) % 5) as t", "o_orderkey as ref_start", f"o_orderkey + {size} as ref_end", f"{start} as query_start",
        f"{start} + 2 * ({size}) + o_custkey % 2 as query_end", "if(o_custkey % 3 <> 1, null, cast(o_custkey % 10 as double) / 10) as pct_sequence", "if(o_custkey % 3 <> 1, null, cast(o_custkey % 7 as double) / 7) as pct_size",
        f"translate(md5(cast(o_orderkey as string)), '{_HEX}', '{_BASES}') as source",
    )


def dup_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, q, t, pos, call_size, genotype, ref, alt): orders as insertion calls; some hold most of a neighbouring duplication's bases."""
    alt = f"concat('A', substr(translate(md5(cast(o_orderkey - o_orderkey % 5 + 3 as string)), '{_HEX}', '{_BASES}'), cast(1 + o_custkey % 9 as int)))"
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 in (1, 2) and o_custkey % 7 = 0").selectExpr(
        "o_orderkey as call_id", "concat('q', (o_orderkey div 5) % 7) as q", "concat('t', (o_orderkey div 5) % 5) as t", "o_orderkey + o_custkey % 1200 - 600 as pos", "10 + cast(floor(o_totalprice) as bigint) % 600 as call_size",
        "if(o_orderstatus = 'F', '0/1:9', '0/0:3') as genotype", "'A' as ref", f"if(o_custkey % 4 = 0, '<DUP>', {alt}) as alt",
    )


def dup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, t, ts, te, qs, qe, cigar): line items as alignment records along the planted copies, some with an insertion in the middle."""
    half, grown = "cast(l_quantity as bigint) * 4", "if(l_linenumber % 3 = 0, cast(l_quantity as bigint) * 5, 0)"
    at = _MIRROR.format("l_orderkey", "div")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q', l_partkey % 7) as q", "concat('t', l_suppkey % 5) as t", "l_orderkey as ts", f"l_orderkey + 2 * {half} as te", f"{at} as qs", f"{at} + 2 * {half} + {grown} as qe",
        f"concat({half}, '=', if({grown} > 0, concat({grown}, 'I'), ''), {half}, '=') as cigar",
    )


DUPLICATIONS = f"""planted as (select 'q' || (l_partkey % 7) as q, 't' || (l_suppkey % 5) as t, l_orderkey as ts, case when l_linenumber >= 6 then 40000 + l_partkey * 7919 % 60000 else 40000 + l_orderkey // 4000 * 4000
  + case when l_orderkey // 4000 % 5 = 3 then 4000 - l_orderkey % 4000 else l_orderkey % 4000 end + (l_orderkey // 4000 * 7919 % 13 - 6) * 400 + case when l_orderkey // 4000 % 11 = 7 then 9000 else 0 end + case when l_linenumber = 5 then 700 else 0 end
  + l_quantity::bigint % 3 end as qs, l_linestatus = 'O' and l_linenumber < 5 as both from lineitem),
dup_truths as (select o_orderkey as truth_id, 'q' || (o_orderkey // 5 % 7) as q, 't' || (o_orderkey // 5 % 5) as t, o_orderkey as ref_start, o_orderkey + 20 + floor(o_totalprice)::bigint % 300 as ref_end, {_MIRROR.format("o_orderkey", "//")} as query_start,
  {_MIRROR.format("o_orderkey", "//")} + 2 * (20 + floor(o_totalprice)::bigint % 300) + o_custkey % 2 as query_end, 20 + floor(o_totalprice)::bigint % 300 as size, case when o_custkey % 3 = 1 then (o_custkey % 10)::double / 10 end as pct_sequence,
  case when o_custkey % 3 = 1 then (o_custkey % 7)::double / 7 end as pct_size, translate(md5(o_orderkey::varchar), '{_HEX}', '{_BASES}') as source from orders where o_orderkey % 5 = 3),
dup_calls as (select o_orderkey as call_id, 'q' || (o_orderkey // 5 % 7) as q, 't' || (o_orderkey // 5 % 5) as t, o_orderkey + o_custkey % 1200 - 600 as pos, 10 + floor(o_totalprice)::bigint % 600 as call_size,
  case when o_custkey % 4 > 0 then substr(translate(md5((o_orderkey - o_orderkey % 5 + 3)::varchar), '{_HEX}', '{_BASES}'), 1 + o_custkey % 9) else '' end as inserted from orders where o_orderkey % 5 in (1, 2) and o_custkey % 7 = 0 and o_orderstatus = 'F'),
dup_records as (select 'q' || (l_partkey % 7) as q, 't' || (l_suppkey % 5) as t, l_orderkey as ts, l_orderkey + 8 * l_quantity::bigint as te, {_MIRROR.format("l_orderkey", "//")} as qs, l_quantity::bigint * 4 as half,
  case when l_linenumber % 3 = 0 then l_quantity::bigint * 5 else 0 end as grown from lineitem)"""


def decided_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gaps, extensions, patches) of orders as chains along four samples: every third chain is lost in the end, half of those by merging into the one before."""
    rows = table(spark, sf_dir, "orders").selectExpr("concat('s', o_custkey % 4) as sample", "o_orderkey as no", "o_orderkey * 50 as ref_start", "30 + cast(floor(o_totalprice) as bigint) % 100 as size")

    def neighbours(chains: DataFrame) -> DataFrame:
        over = Window.partitionBy("sample").orderBy("no")
        pairs = chains.withColumns({"right_no": F.lead("no").over(over), "right_ref": F.lead("ref_start").over(over)}).where("right_no is not null")
        return pairs.selectExpr("sample", "no as left_no", "right_no", "right_ref - ref_start - size as ref_gap", "right_ref - ref_start - size + right_no % 7 as query_gap", "right_ref", "right_ref + 17 as right_query")

    every = neighbours(rows)
    extensions = every.where("left_no % 4 <> 1").withColumn("stop_reason", F.expr("if(right_no % 6 = 0, 'gap_too_large', 'best_partial_path')"))
    status = "element_at(array('patched', 'patch_interval_low_identity', 'patch_zdrop_reject', 'patch_too_short'), cast(right_no % 4 as int) + 1)"
    patches = every.where("right_no % 5 < 3").withColumns({"status": F.expr(status), "merge": F.expr("right_no % 6 = 0")})
    return neighbours(rows.where("no % 3 <> 0")), extensions, patches


def _neighbours(rows: str) -> str:
    return f"""select sample, left_no, right_no, ref_gap, ref_gap + right_no % 7 as query_gap, right_ref, right_ref + 17 as right_query from (
  select sample, no as left_no, lead(no) over w as right_no, lead(ref_start) over w - ref_start - size as ref_gap, lead(ref_start) over w as right_ref from {rows} window w as (partition by sample order by no)) where right_no is not null"""


DECIDED_GAPS = f"""recursive chain as (select 's' || (o_custkey % 4) as sample, o_orderkey as no, o_orderkey * 50 as ref_start, 30 + floor(o_totalprice)::bigint % 100 as size from orders),
every as ({_neighbours("chain")}), gaps as ({_neighbours("(select * from chain where no % 3 <> 0)")}),
extensions as (select *, case when right_no % 6 = 0 then 'gap_too_large' else 'best_partial_path' end as stop_reason from every where left_no % 4 <> 1),
patches as (select *, ['patched', 'patch_interval_low_identity', 'patch_zdrop_reject', 'patch_too_short'][right_no % 4 + 1] as status, right_no % 6 = 0 as merge from every where right_no % 5 < 3),
root as (select no, no as m from chain where no not in (select right_no from patches where merge) union all select p.right_no, r.m from root r join patches p on p.left_no = r.no and p.merge)"""


def track_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignment records along tracks of both strands; many overlap their neighbour on one axis or both."""
    arm, grown = "(300 + cast(l_quantity as bigint) * 10)", "if(l_discount >= 0.05, cast(round(l_discount * 1000) as bigint), 0)"
    inserted = "l_returnflag = 'A'"
    query_bases = f"(2 * {arm} + 10 + if({inserted}, {grown}, 0))"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('q', l_partkey % 7) as q", "1000000000L as qlen", f"if(l_returnflag = 'R', 1000000000 - l_orderkey * 80 - 500 - {query_bases}, l_orderkey * 80 + 500) as qs", f"{query_bases} as n", "if(l_returnflag = 'R', '-', '+') as strand",
        "concat('t', l_suppkey % 5) as t", "l_orderkey * 70 as ts", f"l_orderkey * 70 + 2 * {arm} + 10 + if({inserted}, 0, {grown}) as te", "l_orderkey * 10 + l_linenumber as chain_no",
        f"concat({arm}, '=10X', if({grown} > 0, concat({grown}, if({inserted}, 'I', 'D')), ''), {arm}, '=') as cigar", f"2 * {arm} as matches", f"2 * {arm} + 10 + {grown} as block", f"2 * {arm} - 10 - {grown} as score",
    )
    return rows.selectExpr("q", "qlen", "qs", "qs + n as qe", "strand", "t", "ts", "te", "chain_no", "cigar", "matches", "block", "score", "'raw' as source", "'direct' as mode", "0L as patches")


TRACK_RECORDS = """parts as (select 'q' || (l_partkey % 7) as q, 't' || (l_suppkey % 5) as t, case when l_returnflag = 'R' then '-' else '+' end as strand, l_orderkey as k, l_orderkey * 10 + l_linenumber as chain_no, 300 + l_quantity::bigint * 10 as arm,
  case when l_discount >= 0.05 then round(l_discount * 1000)::bigint else 0 end as grown, l_returnflag = 'A' as ins from lineitem),
sized as (select *, k * 80 + 500 as o_start, k * 80 + 510 + 2 * arm + case when ins then grown else 0 end as o_end, k * 70 as ts, k * 70 + 2 * arm + 10 + case when ins then 0 else grown end as te,
  '10X' || case when grown > 0 then grown || case when ins then 'I' else 'D' end else '' end || arm || '=' as rest from parts),
placed as (select *, row_number() over (partition by t, q, strand order by ts, case when strand = '+' then o_start else 1000000000 - o_end end, te, chain_no, case when strand = '+' then o_end else 1000000000 - o_start end, arm || '=' || rest) as place from sized)"""
