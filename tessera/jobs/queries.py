"""The registered queries over the given tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequence as fx
from tessera.operators import alignment, anchors, assignment, chains, components, evaluation, extension, intervals, matching, patching, refinement, tokens, trimming
from tessera.operators.lineage import checkpointed
from tessera.sources import formats
from tessera.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    """Register a query by its function's name, with its SQL where SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"with {ctes} " if ctes else "") + sql
        return f

    return register


# Sequences, k-mers and windows ------------------------------------------------------------------

KMERS = src.SEQUENCES + f""",
kmers as (select sequence_id, pos, substr(seq, pos + 1, {anchors.K}) as kmer from (select sequence_id, seq, unnest(range(0, length(seq) - {anchors.K} + 1)) as pos from sequences where length(seq) >= {anchors.K})),
counts as (select kmer, count(*) as freq from kmers group by kmer)"""
FRAME = anchors.LENGTH - anchors.K + 1
WINDOWS = KMERS + f""",
framed as (select sequence_id, pos, sum(q) over w as score_q, count(*) over w as n from (select k.*, round(ln(1 + least(freq, 65535)::double) * 1e9)::bigint as q from kmers k join counts using (kmer))
  window w as (partition by sequence_id order by pos rows between {FRAME - 1} preceding and current row)),
windows as (select sequence_id, pos - {FRAME - 1} as start, pos + {anchors.K} as "end", score_q::bigint as score_q from framed where n = {FRAME})"""
PLATEAUS = WINDOWS + """,
marked as (select *, case when score_q = lag(score_q) over w and start - lag(start) over w <= 20 then 0 else 1 end as new from windows window w as (partition by sequence_id order by start)),
numbered as (select *, (sum(new) over (partition by sequence_id order by start rows between unbounded preceding and current row))::bigint as plateau_id from marked)"""


@query("""select sequence_id, sample, length(seq)::bigint as bases, sha256(seq) as seq_sha256, sha256(rc) as rc_sha256, sha256(least(seq, rc)) as canonical_sha256,
  case when seq = rc then '.' when seq < rc then '+' else '-' end as orientation from (select *, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from sequences)""", src.SEQUENCES)
def seq_revcomp_canonical(spark, d):
    """Reverse complement, canonical form and orientation of every document's sequence."""
    rows = src.sequences(spark, d).withColumn("rc", fx.reverse_complement(F.col("seq")))
    return rows.select("sequence_id", "sample", F.length("seq").cast("bigint").alias("bases"), F.sha2("seq", 256).alias("seq_sha256"), F.sha2("rc", 256).alias("rc_sha256"), F.sha2(F.least("seq", "rc"), 256).alias("canonical_sha256"), fx.orientation(F.col("seq"), F.col("rc")).alias("orientation"))


@query("select kmer, freq from counts", KMERS)
def kmer_frequency(spark, d):
    """Counts of all k-mers over all sequences."""
    return anchors.kmer_frequency(src.sequences(spark, d))


@query(f"""select near as kmer, sum(freq)::bigint as freq from (select distinct kmer, freq, substr(kmer, 1, i - 1) || b || substr(kmer, i + 1) as near from counts, (select unnest(range(1, {anchors.K + 1})) as i), (select unnest(['A', 'C', 'G', 'T']) as b))
  where near in (select kmer from counts) group by near""", KMERS)
def kmer_frequency_hamming(spark, d):
    """Counts of all k-mers with up to one mismatch."""
    return anchors.kmer_frequency_hamming(src.sequences(spark, d))


@query("""select sequence_id, start, "end", score_q from windows""", WINDOWS)
def window_scores(spark, d):
    """Scores of all windows of all sequences."""
    return anchors.scanned_windows(src.sequences(spark, d)).select("sequence_id", "start", "end", "score_q")


@query("""select sequence_id, start, score_q, plateau_id, abs(2 * start - min(start) over p - max(start) over p)::bigint as dist2_from_center from numbered window p as (partition by sequence_id, plateau_id)""", PLATEAUS)
def score_plateaus(spark, d):
    """Plateaus of equal scores and each window's distance from its plateau's centre."""
    return anchors.scanned_windows(src.sequences(spark, d)).select("sequence_id", "start", "score_q", "plateau_id", "dist2_from_center")


@query()
def anchor_nms(spark, d):
    """Windows that greedy non-maximum suppression keeps in each sequence."""
    return anchors.scanned_windows(src.sequences(spark, d), suppress_within=60).select("sequence_id", "start", "end", "score_q", "dist2_from_center")


@query()
def anchor_select_topk(spark, d):
    """The lowest-copy kept windows, as many as the density of the input's bases allows, with dense ids."""
    sequences = src.sequences(spark, d)
    total = sequences.agg(F.sum(F.length("seq"))).first()[0] or 0
    return anchors.select_anchors(anchor_nms(spark, d), int(total))


# Token streams, contexts and substrings ---------------------------------------------------------

@query("""select sha256(group_id) as group_key, group_id, count(*) as n, count(distinct sample) as samples from event_anchors where groupable group by group_id""", src.EVENT_ANCHORS)
def anchor_groups(spark, d):
    """Anchors by group, with the number of samples that have it."""
    return anchors.anchor_groups(src.event_anchors(spark, d))


TOKENS = src.EVENT_ANCHORS + f""",
placed as (select *, row_number() over w - 1 as r, center - lag(center) over w as dist from event_anchors where groupable window w as (partition by sequence_id order by center, anchor_id)),
tokens as (select sample, sequence_id, (2 * r)::bigint as token_index, 'A' as token_type, 'A:' || group_id as token, anchor_id, null::bigint as raw_distance, null::bigint as distance_bin from placed
  union all select sample, sequence_id, 2 * r - 1, 'D', 'D:' || (dist // {src.TOKEN_BIN}), null, dist, dist // {src.TOKEN_BIN} from placed where r > 0)"""
CONTEXTS = TOKENS + f""",
framed as (select *, list(token) over (partition by sequence_id order by token_index rows between {tokens.RADIUS} preceding and {tokens.RADIUS} following) as ctx, max(token_index) over (partition by sequence_id) as last from tokens),
contexts as (select anchor_id, sequence_id, sample, token_index as center_token_index, greatest(0, token_index - {tokens.RADIUS}) as context_start, least(last, token_index + {tokens.RADIUS}) as context_end,
  sha256(from_hex(array_to_string(list_transform(case when ctx <= list_reverse(ctx) then ctx else list_reverse(ctx) end, lambda x: printf('%02x%02x%02x%02x', strlen(x) % 256, strlen(x) // 256 % 256, strlen(x) // 65536 % 256, strlen(x) // 16777216) || hex(encode(x))), ''))) as context_key, array_to_string(ctx, '|') as forward_tokens from framed where token_type = 'A')"""
GRAMS = TOKENS + f""",
ahead as (select sample, sequence_id, token_index as start, list(token) over (partition by sequence_id order by token_index rows between current row and {tokens.MOST - 1} following) as a from tokens),
grams0 as (select sample, sequence_id, start, length, a[1:length] as gram from (select *, unnest(range(1, len(a) + 1)) as length from ahead)),
grams as (select *, array_to_string(case when gram <= list_reverse(gram) then gram else list_reverse(gram) end, ',') as gram_key from grams0 where len(list_filter(gram, lambda x: starts_with(x, 'A:'))) > 0),
uniq as (select sample, gram_key, min(sequence_id) as sequence_id, min(start) as start, min(length) as length, any_value(gram) as gram from grams group by sample, gram_key having count(*) = 1),
trimmed as (select *, gram[1:length - 1] as l, gram[2:length] as r from uniq),
keyed as (select *, array_to_string(case when l <= list_reverse(l) then l else list_reverse(l) end, ',') as lk, array_to_string(case when r <= list_reverse(r) then r else list_reverse(r) end, ',') as rk from trimmed),
minimal as (select sample, gram_key, length, sequence_id, start from keyed k where not exists (select 1 from uniq u where u.sample = k.sample and u.gram_key = k.lk) and not exists (select 1 from uniq u where u.sample = k.sample and u.gram_key = k.rk))"""
HITS = GRAMS + """,
hits as (select g.sequence_id, g.start, g.start + g.length - 1 as last, m.sample as of_sample, m.gram_key from grams g join minimal m using (gram_key))"""
ALPHA = HITS + f""",
alpha as (select t.anchor_id, h.of_sample, count(*) as alpha from tokens t join hits h on t.sequence_id = h.sequence_id and t.token_index between greatest(0, h.last - {tokens.RADIUS}) and h.start + {tokens.RADIUS} where t.token_type = 'A' group by 1, 2)"""


def _tokens(spark, d):
    return tokens.structural_tokens(src.event_anchors(spark, d))


def _minimal(spark, d):
    grams = tokens.token_ngrams(_tokens(spark, d))
    return grams, tokens.minimal_unique(grams)


def _hits(spark, d):
    return tokens.substring_hits(*_minimal(spark, d))


@query("select * from tokens", TOKENS)
def structural_tokens(spark, d):
    """Alternating anchor and distance tokens of every sequence."""
    return _tokens(spark, d)


@query("select * from contexts", CONTEXTS)
def anchor_contexts(spark, d):
    """Each anchor's context of neighbouring tokens, and its strand-free key."""
    return tokens.anchor_contexts(_tokens(spark, d))


@query("select context_key, count(*) as anchors from contexts group by context_key", CONTEXTS)
def context_groups(spark, d):
    """Anchors by context."""
    return anchor_contexts(spark, d).groupBy("context_key").agg(F.count("*").alias("anchors"))


@query("select sample, gram_key, count(*) as n from grams group by sample, gram_key", GRAMS)
def token_ngrams(spark, d):
    """Counts of strand-free token n-grams with an anchor, by sample."""
    return tokens.token_ngrams(_tokens(spark, d)).groupBy("sample", tokens.key("gram").alias("gram_key")).agg(F.count("*").alias("n"))


@query("""select sha256(from_hex(array_to_string(list_transform(case when gram <= list_reverse(gram) then gram else list_reverse(gram) end, lambda x: printf('%02x%02x%02x%02x', strlen(x) % 256, strlen(x) // 256 % 256, strlen(x) // 65536 % 256, strlen(x) // 16777216) || hex(encode(x))), '')))[1:32] || ':' || len(gram) as fingerprint,
  count(*) as n, count(distinct sample) as samples from grams group by 1""", GRAMS)
def gram_fingerprints(spark, d):
    """Token n-grams with an anchor by their fingerprint of fixed width: how often they stand, and in how many samples."""
    by_sample = tokens.token_ngrams(_tokens(spark, d)).groupBy("sample", tokens.fingerprint("gram").alias("fingerprint")).agg(F.count("*").alias("n"))
    return by_sample.groupBy("fingerprint").agg(F.sum("n").alias("n"), F.count("*").alias("samples"))


@query("select sample, gram_key, length::bigint as length, sequence_id, start from minimal", GRAMS)
def tmus(spark, d):
    """Minimal unique token substrings of every sample."""
    return _minimal(spark, d)[1].withColumn("length", F.col("length").cast("bigint"))


@query("select sample, count(*) as n from minimal group by sample", GRAMS)
def tmus_per_sample(spark, d):
    """Number of minimal unique token substrings by sample."""
    return _minimal(spark, d)[1].groupBy("sample").agg(F.count("*").alias("n"))


@query("select anchor_id, of_sample, alpha from alpha", ALPHA)
def alpha_prime(spark, d):
    """How many minimal unique substrings of each sample touch each anchor's window."""
    return tokens.alpha_prime(_tokens(spark, d), _hits(spark, d))


@query("""select of_sample, (select count(*) from tokens where token_type = 'A') - count(*) as zero, count(*) filter (where alpha between 1 and 9) as low,
  count(*) filter (where alpha between 10 and 49) as middle, count(*) filter (where alpha >= 50) as high from alpha group by of_sample""", ALPHA)
def alpha_prime_hist(spark, d):
    """Anchors by how many substrings of each sample touch them."""
    return tokens.alpha_histogram(_tokens(spark, d), alpha_prime(spark, d))


# Matching between samples -----------------------------------------------------------------------

PAIRS = src.EVENT_ANCHORS + """,
s as (select distinct sample from event_anchors)"""
EXACT = CONTEXTS + """,
single as (select sample, context_key, min(anchor_id) as target_anchor_id from contexts group by sample, context_key having count(*) = 1),
exact as (select c.anchor_id as query_anchor_id, c.sample as query_sample, s.target_anchor_id, s.sample as target_sample from contexts c join single s using (context_key) where c.sample <> s.sample)"""
MERGED = EXACT + """,
f as (select target_sample as sample_a, target_anchor_id as anchor_a, query_sample as sample_b, query_anchor_id as anchor_b from exact where target_sample < query_sample),
r as (select query_sample as sample_a, query_anchor_id as anchor_a, target_sample as sample_b, target_anchor_id as anchor_b from exact where target_sample > query_sample),
merged as (select sample_a, anchor_a, sample_b, anchor_b, case when inf and inr then 'both' when inf then case when exists (select 1 from r where r.sample_a = m.sample_a and r.anchor_a = m.anchor_a and r.sample_b = m.sample_b) then 'discordant' else 'forward_only' end
    else case when exists (select 1 from f where f.sample_b = m.sample_b and f.anchor_b = m.anchor_b and f.sample_a = m.sample_a) then 'discordant' else 'reverse_only' end end as support_direction
  from (select sample_a, anchor_a, sample_b, anchor_b, bool_or(f) as inf, bool_or(not f) as inr from (select *, true as f from f union all select *, false from r) group by all) m)"""
SHARED = HITS + f""",
owned as (select distinct t.anchor_id, h.gram_key from hits h join tokens t on t.sequence_id = h.sequence_id and t.token_type = 'A' and t.token_index between greatest(0, h.last - {tokens.RADIUS}) and h.start + {tokens.RADIUS}),
own as (select o.*, a.sample, a.group_id from owned o join event_anchors a using (anchor_id)),
shared as (select q.anchor_id as query_anchor_id, t.sample as target_sample, t.anchor_id as target_anchor_id, count(*) as shared from own q join own t using (gram_key, group_id) where q.sample <> t.sample group by 1, 2, 3)"""


@query("select row_number() over (order by t.sample, q.sample) - 1 as pair_id, t.sample as target_sample, q.sample as query_sample from s t join s q on t.sample <> q.sample", PAIRS)
def sample_pairs(spark, d):
    """All ordered pairs of different samples."""
    return matching.sample_pairs(src.event_anchors(spark, d)).withColumn("pair_id", F.col("pair_id").cast("bigint"))


@query("select * from exact", EXACT)
def assign_exact_context(spark, d):
    """Anchors matched to the one anchor of another sample with the same context."""
    return matching.match_exact_context(tokens.anchor_contexts(_tokens(spark, d)))


@query("""select query_anchor_id, target_sample, min(target_anchor_id) as target_anchor_id, any_value(shared) as shared from (select *, max(shared) over (partition by query_anchor_id, target_sample) as most from shared) where shared = most
  group by query_anchor_id, target_sample having count(*) = 1""", SHARED)
def assign_shared_tmus(spark, d):
    """Anchors matched to the one anchor of another sample, in their group, with the most shared unique substrings."""
    t, (grams, minimal) = _tokens(spark, d), _minimal(spark, d)
    owned = matching.anchor_substrings(t, tokens.substring_hits(grams, minimal), tokens.RADIUS)
    return matching.match_shared_substrings(src.event_anchors(spark, d), owned)


@query("""select target_sample, count(*) as primary_n, count(distinct query_anchor_id) as queries from exact group by target_sample""", EXACT)
def assign_status_counts(spark, d):
    """Exact matches by target sample."""
    return assign_exact_context(spark, d).groupBy("target_sample").agg(F.count("*").alias("primary_n"), F.countDistinct("query_anchor_id").alias("queries"))


@query("select * from merged", MERGED)
def correspondences(spark, d):
    """Both directions' exact matches merged, with their support."""
    return matching.correspondences(assign_exact_context(spark, d))


@query("select * from merged where support_direction = 'both'", MERGED)
def correspondences_reciprocal(spark, d):
    """Merged matches that both directions found."""
    return matching.correspondences(assign_exact_context(spark, d), "reciprocal")


@query("select support_direction, count(*) as n from merged group by support_direction", MERGED)
def support_counts(spark, d):
    """Merged matches by support."""
    return correspondences(spark, d).groupBy("support_direction").agg(F.count("*").alias("n"))


# Assignments and what chains step on ---------------------------------------------------------------

#: Width of the value classes that group anchors for assignments, and thresholds that fit the events' few shared substrings.
FINE, EVENT_MATCHES = 20, assignment.Params(min_shared=3, min_score=2, margin=5)
ASSIGNED = (SHARED + CONTEXTS[len(TOKENS) :] + ALPHA[len(HITS) :]).replace("floor(value / 50)", f"floor(value / {FINE})") + f""",
anc as (select c.anchor_id, c.sample, e.group_id, c.context_key, string_split(c.forward_tokens, '|') as toks from contexts c join event_anchors e using (anchor_id)),
asked as (select a.anchor_id as query_anchor_id, a.sample as query_sample, s.sample as target_sample, a.group_id, a.context_key, a.toks, coalesce(l.alpha, 0) as q_alpha
  from anc a join (select distinct sample from anc) s on s.sample <> a.sample left join alpha l on l.anchor_id = a.anchor_id and l.of_sample = s.sample),
one as (select sample, context_key, min(anchor_id) as target_anchor_id from anc group by all having count(*) = 1),
ex as (select q.*, o.target_anchor_id, coalesce(l.alpha, 0) as r_alpha from asked q join one o on o.sample = q.target_sample and o.context_key = q.context_key
  left join alpha l on l.anchor_id = o.target_anchor_id and l.of_sample = q.query_sample where q.q_alpha + coalesce(l.alpha, 0) > 0),
left1 as (select * from asked anti join ex using (query_anchor_id, target_sample)),
sh0 as (select q.query_anchor_id, q.query_sample, q.target_sample, q.q_alpha, s.target_anchor_id, s.shared, l.alpha as r_alpha from left1 q join shared s using (query_anchor_id, target_sample)
  join alpha l on l.anchor_id = s.target_anchor_id and l.of_sample = q.query_sample where q.q_alpha > 0 and s.shared >= 3),
sh as (select query_anchor_id, query_sample, target_sample, min(target_anchor_id) as target_anchor_id, min(q_alpha) as q_alpha, min(r_alpha) as r_alpha
  from (select *, max(shared) over (partition by query_anchor_id, target_sample) as most from sh0) where shared = most group by 1, 2, 3 having count(*) = 1),
left2 as (select * from left1 anti join sh using (query_anchor_id, target_sample)),
ed0 as (select q.*, t.anchor_id as target_anchor_id, l.alpha as r_alpha, t.toks as far, list_distinct(q.toks || t.toks) as v from left2 q join anc t on t.group_id = q.group_id and t.sample = q.target_sample
  join alpha l on l.anchor_id = t.anchor_id and l.of_sample = q.query_sample where q.q_alpha > 0),
ed1 as (select *, array_to_string(list_transform(toks, lambda x: chr(96 + list_position(v, x)::int)), '') as a, array_to_string(list_transform(far, lambda x: chr(96 + list_position(v, x)::int)), '') as b from ed0),
ed2 as (select *, levenshtein(a, b) as plus, levenshtein(reverse(a), b) as minus from ed1),
ed3 as (select *, least(plus, minus) as d, q_alpha + r_alpha - least(plus, minus) as score from ed2 where q_alpha + r_alpha - least(plus, minus) > 2),
ed4 as (select *, row_number() over w as rank, count(*) over (partition by query_anchor_id, target_sample) as candidates, first_value(score) over w as top, nth_value(score, 2) over (partition by query_anchor_id, target_sample order by score desc, d, target_anchor_id rows between unbounded preceding and unbounded following) as second
  from ed3 window w as (partition by query_anchor_id, target_sample order by score desc, d, target_anchor_id)),
ed as (select *, top - coalesce(second, top) as margin, candidates = 1 or top - second >= 5 as sure from ed4),
assigned as (select query_anchor_id, query_sample, target_sample, target_anchor_id, 'primary' as status, 'exact_context' as method, q_alpha + r_alpha as score, 0::bigint as edit_distance, '.' as strand, q_alpha, r_alpha, 0::bigint as margin, 1::bigint as candidates from ex
  union all select query_anchor_id, query_sample, target_sample, target_anchor_id, 'primary', 'shared_tmus', q_alpha + r_alpha, 0, '.', q_alpha, r_alpha, 0, 1 from sh
  union all select query_anchor_id, query_sample, target_sample, target_anchor_id, case when sure then 'primary' else 'ambiguous' end, 'edit_distance', score, d, case when minus < plus then '-' else '+' end, q_alpha, r_alpha, margin, candidates from ed
    where (sure and rank = 1) or (not sure and top - score <= 5)
  union all select query_anchor_id, query_sample, target_sample, null, 'unmatched', null, null, null, null, q_alpha, null, null, null from left2 anti join ed using (query_anchor_id, target_sample)),
fw as (select target_sample as sample_a, target_anchor_id as anchor_a, query_sample as sample_b, query_anchor_id as anchor_b, score, strand from assigned where status = 'primary' and target_sample < query_sample),
bw as (select query_sample as sample_a, query_anchor_id as anchor_a, target_sample as sample_b, target_anchor_id as anchor_b, score, strand from assigned where status = 'primary' and target_sample > query_sample),
corr as (select sample_a, anchor_a, sample_b, anchor_b, case when f.score is not null and r.score is not null then 'both'
    when r.score is null then case when exists (select 1 from bw where bw.sample_a = f.sample_a and bw.anchor_a = f.anchor_a and bw.sample_b = f.sample_b) then 'discordant' else 'forward_only' end
    else case when exists (select 1 from fw where fw.sample_b = r.sample_b and fw.anchor_b = r.anchor_b and fw.sample_a = r.sample_a) then 'discordant' else 'reverse_only' end end as support,
  f.score as forward_score, r.score as reverse_score, f.strand as forward_strand, r.strand as reverse_strand from fw f full join bw r using (sample_a, anchor_a, sample_b, anchor_b)),
cand0 as (select sample_a, anchor_a, sample_b, anchor_b, case when forward_score is null or (reverse_score is not null and reverse_score > forward_score) then reverse_score else forward_score end as score,
    case when forward_score is null or (reverse_score is not null and reverse_score > forward_score) then reverse_strand else forward_strand end as reported, support = 'both' as "both", 0 as source from corr
  union all select case when target_sample > query_sample then query_sample else target_sample end, case when target_sample > query_sample then query_anchor_id else target_anchor_id end,
    case when target_sample > query_sample then target_sample else query_sample end, case when target_sample > query_sample then target_anchor_id else query_anchor_id end, score, strand, false, 1 from assigned where status = 'ambiguous'),
cand1 as (select * from (select *, row_number() over (partition by sample_a, anchor_a, sample_b, anchor_b order by source, score desc, reported) as place from cand0) where place = 1),
cands as (select * from (select c.sample_a, c.sample_b, c.sample_b || ':' || b.sequence_id as q, c.sample_a || ':' || a.sequence_id as t,
    case when reported in ('+', '-') then reported when (x.toks = y.toks) = (x.toks = list_reverse(y.toks)) then '.' when x.toks = y.toks then '+' else '-' end as strand,
    b.center as qs, a.center as ts, c.score, c."both", c.anchor_a, c.anchor_b from cand1 c join event_anchors a on a.anchor_id = c.anchor_a join event_anchors b on b.anchor_id = c.anchor_b join anc x on x.anchor_id = c.anchor_a join anc y on y.anchor_id = c.anchor_b) where strand <> '.')"""


def _fine(spark, d):
    """(anchors with their contexts, alpha, shared counts) of finely grouped events, each computed once."""
    rows = src.event_anchors(spark, d, FINE)
    # What anchors have goes along with their tokens, so that contexts need no join by anchor.
    stream = checkpointed(tokens.structural_tokens(rows, keep=("center", "group_id")))
    grams = tokens.token_ngrams(stream)
    hits = checkpointed(tokens.substring_hits(grams, tokens.minimal_unique(grams)))
    contexts = tokens.anchor_contexts(stream, keep=("center", "group_id"))
    found = checkpointed(contexts.select("anchor_id", "sample", "context_key", F.split("forward_tokens", r"\|").alias("tokens"), "sequence_id", "center", "group_id"))
    shared = matching.shared_counts(rows, matching.anchor_substrings(stream, hits, tokens.RADIUS))
    return found, checkpointed(tokens.alpha_prime(stream, hits)), checkpointed(shared)


def _assigned(spark, d):
    found, alpha, shared = _fine(spark, d)
    return found, checkpointed(assignment.assignments(found, alpha, shared, EVENT_MATCHES))


@query("select * from assigned", ASSIGNED)
def assignments(spark, d):
    """Each anchor's assignment to every other sample, by the first of three methods that succeeds."""
    return _assigned(spark, d)[1]


@query("select query_anchor_id, query_sample, target_sample, target_anchor_id, status, score, edit_distance, strand, margin, candidates from assigned where method = 'edit_distance'", ASSIGNED)
def assign_edit_distance(spark, d):
    """Assignments by edit distance of contexts inside anchor groups."""
    return _assigned(spark, d)[1].where("method = 'edit_distance'").select("query_anchor_id", "query_sample", "target_sample", "target_anchor_id", "status", "score", "edit_distance", "strand", "margin", "candidates")


@query("select target_sample, status, coalesce(method, '.') as method, count(*) as n, count(distinct query_anchor_id) as queries from assigned group by all", ASSIGNED)
def assignment_counters(spark, d):
    """Assignment rows and queries by target sample, status and method."""
    rows = _assigned(spark, d)[1]
    return rows.groupBy("target_sample", "status", F.coalesce("method", F.lit(".")).alias("method")).agg(F.count("*").alias("n"), F.countDistinct("query_anchor_id").alias("queries"))


@query("select group_id, count(*) as queries, round(avg(best), 9) as mean_best from (select group_id, query_anchor_id, target_sample, min(d) as best from ed3 group by 1, 2, 3) group by group_id", ASSIGNED)
def group_best_distance(spark, d):
    """Mean over queries of the smallest distance to a candidate of their anchor group."""
    found, alpha, shared = _fine(spark, d)
    asked = assignment.queries(found, alpha, found)
    done = assignment.by_exact_context(asked, found, alpha).select("query_anchor_id", "target_sample")
    left = asked.join(done, ["query_anchor_id", "target_sample"], "left_anti")
    done = assignment.by_shared_substrings(left, shared, alpha, EVENT_MATCHES).select("query_anchor_id", "target_sample")
    left = left.join(done, ["query_anchor_id", "target_sample"], "left_anti")
    best = assignment.scored_candidates(left, found, alpha, EVENT_MATCHES).groupBy("group_id", "query_anchor_id", "target_sample").agg(F.min("edit_distance").alias("best"))
    return best.groupBy("group_id").agg(F.count("*").alias("queries"), F.round(F.avg("best"), 9).alias("mean_best"))


@query("select * from corr", ASSIGNED)
def assignment_correspondences(spark, d):
    """Primaries of all methods merged over both directions, with scores and strands."""
    return assignment.correspondence_rows(_assigned(spark, d)[1])


@query("select * from cands", ASSIGNED)
def chain_candidates(spark, d):
    """Anchor pairs that chains may step on: correspondences, then ambiguous assignments, with positions and strand."""
    return _candidates(spark, d)


def _candidates(spark, d):
    found, rows = _assigned(spark, d)
    return assignment.chain_candidates(assignment.correspondence_rows(rows), rows, found)


#: Steps over at most two weeks of a user's time line, costed by the hour.
EVENT_CHAINS = chains.Params(max_gap=14 * 86_400_000, max_ratio=20.0, gap_unit=3_600_000.0, min_both=0)


def _event_chains(spark, d):
    return checkpointed(chains.chains_with_rows(_candidates(spark, d), EVENT_CHAINS))


@query()
def event_chains(spark, d):
    """Collinear chains of anchor pairs between samples, with the share of anchors that both directions support."""
    return _event_chains(spark, d).drop("rows")


@query()
def event_chain_anchors(spark, d):
    """The anchors of every event chain, in order."""
    return chains.chain_anchors(_event_chains(spark, d))


@query()
def event_chain_leftovers(spark, d):
    """Anchor pairs that no event chain has."""
    pairs = checkpointed(_candidates(spark, d))
    return chains.leftovers(pairs, checkpointed(chains.chains_with_rows(pairs, EVENT_CHAINS))).select("q", "t", "strand", "qs", "ts", "score", "both")


# Chains and intervals ---------------------------------------------------------------------------

@query()
def chains_by_track(spark, d):
    """Collinear chains of every track of line item intervals."""
    return chains.chains(src.intervals(spark, d))


@query()
def chain_summary_rescore(spark, d):
    """Event chains by query sequence: number, anchors, longest, and the best score after the share of two-way support."""
    return event_chains(spark, d).groupBy("q").agg(F.count("*").alias("chains"), F.sum("anchors").alias("anchors"), F.sum("both").alias("both"), F.max("anchors").alias("longest"), F.max("chain_score").alias("best_score"))


ISLANDS = src.INTERVALS + """,
e as (select q, qs as start, max(qe) as "end" from intervals group by q, qs),
m as (select *, case when start > max("end") over (partition by q order by start rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from e),
n as (select *, sum(new) over (partition by q order by start rows between unbounded preceding and current row) as island from m),
i as (select q, island, min(start) as start, max("end") as "end" from n group by q, island),
g as (select *, lead(start) over (partition by q order by start) - "end" as gap from i)"""
GAPS = src.INTERVALS + """,
nxt as (select *, lead(qs) over w as nqs, lead(ts) over w as nts, lead(te) over w as nte from intervals window w as (partition by q, t, strand order by qs, qe, ts, te, score)),
gaps0 as (select q, t, strand, qe, nqs as next_qs, nqs - qe as q_gap, case when strand = '+' then nts - te else ts - nte end as t_gap from nxt where nqs is not null),
gaps as (select *, case when q_gap < 0 and t_gap < 0 then 'overlap_both' when q_gap < 0 then 'overlap_query' when t_gap < 0 then 'order_break' when t_gap > 100000 then 'gap_too_large' else 'open_gap' end as cause from gaps0)"""


@query("""select q, sum("end" - start)::bigint as covered, count(*) as islands, count(gap) as gaps, count(*) filter (where gap >= 100) as gaps_100, coalesce(max(gap), 0)::bigint as largest_gap from g group by q""", ISLANDS)
def interval_union_coverage(spark, d):
    """Covered bases, islands and gaps of every query's intervals."""
    return intervals.union_coverage(src.intervals(spark, d), ["q"], "qs", "qe")


@query("""select q, t, qs, qe, (select count(*) from intervals b where b.q = a.q and b.t = a.t and b.qs < a.qe and b.qe > a.qs) - 1 as overlapping from intervals a where a.qe > a.qs""", src.INTERVALS)
def interval_overlap_counts(spark, d):
    """How many other intervals of its query and target each interval overlaps."""
    return intervals.overlap_counts(src.intervals(spark, d).where("qe > qs").select("q", "t", "qs", "qe"), ["q", "t"], "qs", "qe")


@query("""select q, qs as at, (select max(b.qe) from intervals b where b.q = a.q and b.strand = '-' and b.qe <= a.qs) as before from (select distinct q, qs from intervals where strand = '+') a""", src.INTERVALS)
def nearest_bracket_asof(spark, d):
    """For every plus-strand start the nearest minus-strand end at or before it."""
    rows = src.intervals(spark, d)
    return intervals.nearest_bracket(rows.where("strand = '+'"), rows.where("strand = '-'"), ["q"], "qs", "qe")


@query("""select a.q, a.strand, a.qs, a.qe, coalesce(x.overlap, 0)::bigint as best_overlap, x.cs as best_qs, x.ce as best_qe from (select distinct q, strand, qs, qe from intervals where t = 't0' and qe > qs) a
  left join lateral (select least(a.qe, c.qe) - greatest(a.qs, c.qs) as overlap, c.qs as cs, c.qe as ce from intervals c where c.t <> 't0' and c.q = a.q and c.strand = a.strand and c.qs < a.qe and c.qe > a.qs
  order by least(a.qe, c.qe) - greatest(a.qs, c.qs) desc, c.qs, c.qe desc limit 1) x on true""", src.INTERVALS)
def truth_boundary_best(spark, d):
    """Every interval of target t0 with the call of another target that overlaps it most on the query."""
    rows = src.intervals(spark, d)
    return intervals.best_overlap(rows.where("t = 't0'"), rows.where("t <> 't0'")).select("q", "strand", "qs", "qe", "best_overlap", "best_qs", "best_qe")


@query("select t, cause, count(*) as n, count(*) filter (where q_gap >= 1000 or t_gap >= 1000) as n_1000, max(q_gap) as most_query, max(t_gap) as most_target from gaps group by t, cause", GAPS)
def gap_causes(spark, d):
    """Gaps between adjacent intervals by target and cause."""
    return intervals.gap_causes(intervals.adjacent_gaps(src.intervals(spark, d)))


@query("""select q, rank, t, strand, qe, next_qs, q_gap, t_gap from (select *, row_number() over (partition by q order by t_gap desc, q_gap desc, t, strand, qe, next_qs) as rank from gaps) where rank <= 3""", GAPS)
def gap_top_n(spark, d):
    """The three largest target gaps of every query."""
    return intervals.top_gaps(intervals.adjacent_gaps(src.intervals(spark, d)))


@query("""select x.threshold::int as threshold, count(*) filter (where q_gap between 0 and x.threshold and t_gap between 0 and x.threshold) as recoverable,
  round(count(*) filter (where q_gap between 0 and x.threshold and t_gap between 0 and x.threshold) / count(*), 9) as share from gaps, (select unnest([100, 1000, 10000, 100000]) as threshold) x group by x.threshold""", GAPS)
def threshold_sweep(spark, d):
    """Gaps that each of four limits would bridge."""
    return evaluation.threshold_sweep(intervals.adjacent_gaps(src.intervals(spark, d)), [100, 1000, 10000, 100000])


@query("""select case when f = '' then 'none' else f end as flags, count(*) as n from (select concat_ws('+', case when q_gap < 0 then 'query_overlap' end, case when t_gap < 0 then 'target_overlap' end, case when abs(q_gap - t_gap) > 1000 then 'length_difference' end) as f from gaps) group by 1""", GAPS)
def failure_combos(spark, d):
    """Gaps by the combination of what is wrong with them."""
    return evaluation.failure_combinations(intervals.adjacent_gaps(src.intervals(spark, d)))


# CIGARs and records -----------------------------------------------------------------------------

OPS = src.CIGARS + """,
x as (select q, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)=', 1), lambda v: v::bigint)) as m, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)X', 1), lambda v: v::bigint)) as mm,
  coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)I', 1), lambda v: v::bigint)), 0) as i, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)D', 1), lambda v: v::bigint)), 0) as dd from cigars)"""


@query("""select q, count(*) as records, sum(m)::bigint as matches, sum(mm)::bigint as mismatches, sum(i)::bigint as inserted, sum(dd)::bigint as deleted, sum(m + mm + i + dd)::bigint as block, round(sum(m) / sum(m + mm + i + dd), 9) as identity from x group by q""", OPS)
def cigar_stats(spark, d):
    """Matches, mismatches, indels and identity of every query's CIGARs."""
    return evaluation.cigar_statistics(src.cigars(spark, d))


@query("select translate(cigar, 'ID', 'DI') as swapped, count(*) as n from cigars group by 1", src.CIGARS)
def cigar_swap(spark, d):
    """CIGARs with query and target exchanged, counted."""
    return src.cigars(spark, d).groupBy(fx.swap_indels(F.col("cigar")).alias("swapped")).agg(F.count("*").alias("n"))


@query("""select q, strand, ts, cigar, part, a as target_start, b as target_end, n as query_bases from (
  select q, strand, ts, cigar, 0 as part, ts as a, ts + case when big and op = 'I' then lead_len when big then lead_len else all_t end as b, case when big then lead_len else all_q end as n from y
  union all select q, strand, ts, cigar, 1, ts + lead_len + case when op = 'D' then len else 0 end, ts + lead_len + case when op = 'D' then len else 0 end + tail_len, tail_len from y where big)""",
  src.CIGARS + """,
p as (select *, regexp_extract(cigar, '^([0-9]+)=', 1)::bigint as m1, regexp_extract(cigar, '=([0-9]+)X', 1)::bigint as mm, regexp_extract(cigar, '([0-9]+)=$', 1)::bigint as m2, coalesce(nullif(regexp_extract(cigar, '([0-9]+)[ID]', 1), '')::bigint, 0) as len, regexp_extract(cigar, '([ID])', 1) as op from cigars),
y as (select *, len >= 60 as big, m1 + mm as lead_len, m2 as tail_len, m1 + mm + m2 + case when op = 'D' then len else 0 end as all_t, m1 + mm + m2 + case when op = 'I' then len else 0 end as all_q from p)""")
def cigar_split_long_indels(spark, d):
    """Every CIGAR's parts between indels of 60 bases or more."""
    return evaluation.split_at_long_indels(src.cigars(spark, d), 60)


# Callsets ---------------------------------------------------------------------------------------

@query("""select a.event_id as left_id, b.event_id as right_id from sv_events a join sv_events b on a.setno = 0 and b.setno = 1 and a.chrom = b.chrom and a.kind = b.kind and abs(a.pos - b.pos) <= 25 and least(a.size, b.size) >= 0.7 * greatest(a.size, b.size)""", src.SV_EVENTS)
def sv_band_match_edges(spark, d):
    """Events of two callsets that match in place, kind and size."""
    return evaluation.band_matches(src.sv_events(spark, d))


@query("""select region, count(*) as alleles from (select max((setno = 0)::int) || '' || max((setno = 1)::int) || '' || max((setno = 2)::int) as region from sv_events group by chrom, pos, kind) group by region""", src.SV_EVENTS)
def sv_exact_venn(spark, d):
    """Distinct alleles by the callsets that have them."""
    return evaluation.venn(src.sv_events(spark, d))


@query("""select chrom, bin, dels, inss, round((dels + inss) / sum(dels + inss) over (partition by chrom), 9) as fraction from (select chrom, pos // 5000 as bin, count(*) filter (where kind = 'DEL') as dels, count(*) filter (where kind = 'INS') as inss from sv_events group by 1, 2)""", src.SV_EVENTS)
def sv_histogram(spark, d):
    """Events by position bin and kind, with shares."""
    return evaluation.position_histogram(src.sv_events(spark, d))


@query("""select chrom, count(*) as records, count(distinct (pos, kind, size)) as alleles, count(*) - count(distinct (pos, kind, size)) as duplicates, count(*) filter (where kind = 'DEL') as dels, count(*) filter (where kind = 'INS') as inss, round(sum(size) / count(*), 6) as mean_size, max(size) as most_size from sv_events group by chrom""", src.SV_EVENTS)
def sv_ac_summary(spark, d):
    """Records, alleles and sizes by chromosome."""
    return evaluation.allele_summary(src.sv_events(spark, d))


@query("""select chrom, kind, case max_level when 3 then 'same_place' when 2 then 'same_kind_near' when 1 then 'other_kind_near' else 'isolated' end as mode, count(*) as n from (
  select c.event_id, c.chrom, c.kind, max(case when t.pos is null then 0 when t.pos = c.pos and t.kind = c.kind then 3 when t.kind = c.kind then 2 else 1 end) as max_level
  from sv_events c left join sv_events t on t.setno = 0 and t.chrom = c.chrom and abs(t.pos - c.pos) <= 50 where c.setno = 2 group by 1, 2, 3) group by 1, 2, 3""", src.SV_EVENTS)
def fp_failure_modes(spark, d):
    """Third-set events by what the first set has near them."""
    return evaluation.failure_modes(src.sv_events(spark, d))


# Formats, logs and the order-dependent stages -----------------------------------------------------

@query("""select chrom, pos, event_id::varchar as id, kind, size, pos + case when kind = 'DEL' then size else 0 end as "end", 'true' as imprecise from sv_events""", src.SV_EVENTS)
def vcf_info_map(spark, d):
    """Events written as variant lines and parsed again, with their INFO fields."""
    parsed = formats.parse_vcf(formats.write_vcf_lines(src.sv_events(spark, d)))
    return parsed.select("chrom", "pos", "id", "kind", "size", "end", F.col("info")["IMPRECISE"].alias("imprecise"))


@query("select sequence_id::varchar as sequence_id, sha256(seq) as digest, length(seq)::bigint as bases, length(seq) > 0 as valid from sequences", src.SEQUENCES)
def fasta_roundtrip(spark, d):
    """Sequences written as FASTA records of 80 columns and parsed again."""
    back = formats.parse_fasta(formats.fasta_records(src.sequences(spark, d)))
    return back.select("sequence_id", F.sha2("seq", 256).alias("digest"), F.length("seq").cast("bigint").alias("bases"), "valid")


@query("""select trial, coalesce(u.total, b.total) as total, u.total is not null as updated from (select o_custkey as trial, sum(round(o_totalprice))::bigint as total from orders where o_orderkey % 3 <> 1 group by 1) b
  full join (select o_custkey as trial, sum(round(o_totalprice))::bigint as total from orders where o_orderkey % 3 = 1 group by 1) u using (trial)""")
def trial_log_upsert(spark, d):
    """A log of totals by key, with new rows in place of old ones of the same key."""
    rows = src.table(spark, d, "orders").select(F.col("o_custkey").alias("trial"), F.round("o_totalprice").cast("bigint").alias("total"), (F.expr("o_orderkey % 3") == 1).alias("updated"))
    logged = rows.groupBy("trial", "updated").agg(F.sum("total").alias("total")).select("trial", "total", "updated")
    return formats.upsert(logged.where("not updated"), logged.where("updated"), ["trial"])


@query("""select cause, case when t_gap < 0 then 'negative' when t_gap < 1000 then 'under_1k' when t_gap < 10000 then '1k_10k' else 'over_10k' end as bin, count(*) as n, min(t_gap) as least, max(t_gap) as most from gaps group by 1, 2""", GAPS)
def gap_bins(spark, d):
    """Gaps by cause and length class."""
    size = F.when(F.col("t_gap") < 0, "negative").when(F.col("t_gap") < 1000, "under_1k").when(F.col("t_gap") < 10000, "1k_10k").otherwise("over_10k")
    return intervals.adjacent_gaps(src.intervals(spark, d)).groupBy("cause", size.alias("bin")).agg(F.count("*").alias("n"), F.min("t_gap").alias("least"), F.max("t_gap").alias("most"))


@query("""select strand, count(*) as truths, count(*) filter (where o > 0) as found, count(*) filter (where o = qe - qs) as covered, count(*) filter (where o * 20 >= (qe - qs) * 19) as covered_95 from (select a.strand, a.qs, a.qe, coalesce((select max(least(a.qe, c.qe) - greatest(a.qs, c.qs))
  from intervals c where c.t <> 't0' and c.q = a.q and c.strand = a.strand and c.qs < a.qe and c.qe > a.qs), 0) as o from (select distinct q, strand, qs, qe from intervals where t = 't0' and qe > qs) a) group by strand""", src.INTERVALS)
def boundary_summary(spark, d):
    """How many truth intervals a call overlaps, covers, or covers to 95 %, by strand."""
    o, n = F.col("best_overlap"), F.col("qe") - F.col("qs")
    return truth_boundary_best(spark, d).groupBy("strand").agg(F.count("*").alias("truths"), F.count_if(o > 0).alias("found"), F.count_if(o == n).alias("covered"), F.count_if(o * 20 >= n * 19).alias("covered_95"))


#: Steps over planted pairs; a refined chain has four anchors at least.
PLANTED, REFINED = chains.Params(max_gap=600, max_ratio=3.0, gap_unit=10.0, gap_weight=0.1, min_anchors=6, min_both=1), refinement.Refinement(2000, 4)


def _planted(spark, d):
    """Primary chains of planted pairs, and what refinement may use: leftovers and ambiguous pairs."""
    pairs = src.planted_pairs(spark, d)
    sure = pairs.where("not ambiguous").drop("ambiguous")
    primary = checkpointed(chains.chains_with_rows(sure, PLANTED))
    return primary, chains.leftovers(sure, primary).unionByName(pairs.where("ambiguous").drop("ambiguous"))


@query()
def planted_chains(spark, d):
    """Primary chains of line items as anchor pairs of rearranged sequences."""
    return chains.chains(src.planted_pairs(spark, d).where("not ambiguous"), PLANTED)


@query()
def refined_chains(spark, d):
    """Chains from what primary ones left over and from ambiguous pairs, around primaries and between neighbours."""
    return refinement.refined_chains(*_planted(spark, d), dataclasses.replace(PLANTED, min_both=0), REFINED).drop("rows")


def _trimmed(spark, d):
    primary, rest = _planted(spark, d)
    more = refinement.refined_chains(primary, rest, dataclasses.replace(PLANTED, min_both=0), REFINED)
    columns = [*chains.TRACK, "chain_no", "raw_score", "chain_score", "rows"]
    return trimming.trim_chains(primary.select(columns).unionByName(more.select(columns)), dataclasses.replace(PLANTED, min_both=0, min_anchors=4))


@query()
def trimmed_chains(spark, d):
    """Primary and refined chains cut by better ones of their track."""
    return _trimmed(spark, d).drop("rows")


@query()
def chain_context(spark, d):
    """Trimmed chains by their place against their track's skeleton."""
    return trimming.chain_context(trimmed_chains(spark, d))


#: Extensions over planted pairs.
EXTENSION = extension.Extension(dataclasses.replace(PLANTED, max_gap=20_000), min_anchors=3, min_score=20.0)


def _extension(spark, d):
    bundles = checkpointed(_trimmed(spark, d).where("anchors >= 12").select(*chains.TRACK, "chain_no", "ref_start", "ref_end", "query_start", "query_end", F.col("chain_score").alias("score")))
    return bundles, extension.extension_attempts(bundles, src.planted_pairs(spark, d), EXTENSION)


@query()
def extension_attempts(spark, d):
    """Gaps between neighbouring bundles: whether the left one extends into them, what they are, and why they stay open."""
    return _extension(spark, d)[1]


@query()
def extended_bundles(spark, d):
    """Bundles with their bounds and scores after extension."""
    return extension.extended(*_extension(spark, d))


@query()
def chains_in_context(spark, d):
    """Trimmed chains that stand on their track's skeleton or may be structural: counts and anchors by track and class, and what was rejected."""
    found = chain_context(spark, d)
    gone = F.col("classification").isin(trimming.REJECTED)
    return found.groupBy(*chains.TRACK).agg(*(F.count(F.when(F.col("classification") == c, 1)).alias(c) for c in ("syntenic_skeleton", "off_skeleton_retained", "off_skeleton_structural_candidate", *trimming.REJECTED)), F.sum(F.when(~gone, F.col("anchors"))).alias("kept_anchors"))


def _turn_pairs(spark, d):
    from pyspark.sql import Window

    over = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = src.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("after", F.lead("text").over(over)).where("after is not null")
    return rows.withColumn("pair_id", F.xxhash64("conv_id", "turn"))


#: Thresholds that the line items' short alignments are on both sides of.
PATCHES = patching.Quality(window=25, long_indel=60, flank=20, extra_indel=10, error_density=0.2, endpoint_identity=0.9)
PATCHED = src.CIGARS + """,
ops as (select cigar, k, regexp_extract_all(cigar, '([0-9]+)([=XID])', 1)[k]::bigint as n, regexp_extract_all(cigar, '([0-9]+)([=XID])', 2)[k] as op from (select cigar, unnest(generate_series(1, len(regexp_extract_all(cigar, '[=XID]')))) as k from (select distinct cigar from cigars))),
parts as (select *, op in ('I', 'D') and n >= 60 as far, sum(case when op in ('I', 'D') and n >= 60 then 1 else 0 end) over (partition by cigar order by k) as seg from ops),
bases as (select cigar, seg, (op <> '=')::int as wrong, row_number() over (partition by cigar order by k, i) as ahead, row_number() over (partition by cigar order by k desc, i desc) as back, count(*) over (partition by cigar, seg) as size,
  row_number() over (partition by cigar, seg order by k, i) as own from (select *, unnest(generate_series(1, n)) as i from parts where not far)),
dens as (select cigar, max(w) as density from (select cigar, own, size, sum(wrong) over (partition by cigar, seg order by own rows between 24 preceding and current row) / least(size, 25) as w from bases) where own >= least(size, 25) group by cigar),
edge as (select cigar, 1 - sum(wrong) filter (where ahead <= 25) / count(*) filter (where ahead <= 25) as l, 1 - sum(wrong) filter (where back <= 25) / count(*) filter (where back <= 25) as r from bases group by cigar),
seg as (select cigar, seg, sum(n) filter (where op in ('=', 'X') and not far) as a, sum(n) filter (where op = '=') as e from parts group by 1, 2),
segs as (select cigar, bool_and(coalesce(a, 0) >= 20 and coalesce(e, 0) / a >= 0.95) as flanks, bool_and(coalesce(a, 0) >= 20 and coalesce(e, 0) / a >= 0.99) as very from seg group by cigar),
sums as (select cigar, sum(n) filter (where op = '=') / sum(n) as identity, count(*) filter (where far) as long_indels, coalesce(sum(n) filter (where op in ('I', 'D') and not far), 0) as extra, count(distinct op) filter (where far) as kinds from parts group by cigar)"""


@query("""select cigar, identity, l as left_identity, r as right_identity, density as error_density, long_indels, l < 0.9 or r < 0.9 or density > 0.2 as low_quality, case when long_indels > 0 then extra else 0 end::bigint as extra_indel,
  case when long_indels = 1 and flanks and extra <= 10 then 'long_indel' when long_indels > 1 and kinds = 1 and very and extra <= 100 and density <= 0.15 and l >= 0.9 and r >= 0.9 then 'multi_event' else 'none' end as rescue
  from sums join dens using (cigar) join edge using (cigar) join segs using (cigar)""", PATCHED)
def patch_quality(spark, d):
    """Quality of the line items' alignments as patches of gaps."""
    return patching.patch_quality(src.cigars(spark, d), PATCHES)


@query()
def fallback_align(spark, d):
    """Unit-cost global alignments of each conversation turn's letters with the next turn's."""
    letters = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    return alignment.align_pairs(_turn_pairs(spark, d).select("pair_id", letters(F.col("text")).alias("ref"), letters(F.col("after")).alias("query")))


@query()
def token_edit_distance(spark, d):
    """Bounded edit distances of each turn's words to the next turn's, forwards and reversed."""
    return alignment.token_distances(_turn_pairs(spark, d).select("pair_id", F.split("text", r"\s+").alias("left"), F.split("after", r"\s+").alias("right")))


@query("""select node, min(reach) as component from walk group by node""", """recursive e as (select distinct o_custkey * 2 as u, o_orderkey * 2 + 1 as v from orders union select distinct o_custkey * 2, -1 - o_custkey // 4 from orders),
both_ways as (select u as a, v as b from e union select v, u from e),
walk as (select a as node, a as reach from both_ways union select w.node, b.b from walk w join both_ways b on b.a = w.reach)""")
def component_labels(spark, d):
    """Connected components of the graph of customers, their orders and their groups of four."""
    rows = src.table(spark, d, "orders")
    edges = rows.select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") * 2 + 1).alias("v")).unionByName(rows.select((F.col("o_custkey") * 2).alias("u"), F.expr("-1 - o_custkey div 4").alias("v")))
    return components.connected_components(edges)


@query("""select t, f as share, list_sort(v)[round_even((len(v) - 1) * f, 0)::int + 1] as value from (select t, list(t_gap) as v from gaps group by t), (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as f)""", GAPS)
def gap_quantiles(spark, d):
    """Nearest-rank quantiles of every target's gaps."""
    return evaluation.nearest_rank_quantiles(intervals.adjacent_gaps(src.intervals(spark, d)), "t", "t_gap")


@query()
def edit_op_histogram(spark, d):
    """Edit operations by word index over the alignments of each turn's words with the next turn's."""
    return alignment.operation_histogram(_turn_pairs(spark, d).select(F.split("text", r"\s+").alias("left"), F.split("after", r"\s+").alias("right")))
