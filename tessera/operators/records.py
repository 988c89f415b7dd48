"""Records of alignments, sequences and variants: catalogs, interval fetch, cursors, votes, matches and their summaries."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import cigar_ops, reverse_complement
from tessera.operators.components import connected_components


def combined(parts: Iterable[DataFrame]) -> DataFrame:
    """All sequences of several inputs (sample, sequence_id, seq) with ``copies``, how many rows have the same sample and id; more than one is an error of the inputs."""
    first, *rest = parts
    for more in rest:
        first = first.unionByName(more)
    return first.withColumn("copies", F.count("*").over(Window.partitionBy("sample", "sequence_id")))


def catalog(sequences: DataFrame) -> DataFrame:
    """(sample, sequences, bases, longest, repeated): number and lengths of each sample's sequences, and how many ids stand more than once."""
    ids = sequences.groupBy("sample", "sequence_id").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.max(F.length("seq")).alias("longest"))
    return ids.groupBy("sample").agg(F.sum("n").alias("sequences"), F.sum("bases").alias("bases"), F.max("longest").cast("bigint").alias("longest"), F.count_if(F.col("n") > 1).alias("repeated"))


def chunked(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(sequence_id, chunk, bases): sequences in pieces of ``size`` bases, so that no later row holds a whole one."""
    places = F.sequence(F.lit(0), F.expr(f"greatest(length(seq) - 1, 0) div {size}"))
    return sequences.select("sequence_id", "seq", F.explode(places).alias("chunk")).select("sequence_id", "chunk", F.upper(F.substring("seq", F.col("chunk") * size + 1, F.lit(size))).alias("bases"))


def fetch(chunks: DataFrame, wanted: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``wanted`` (sequence_id, start, end, strand) with ``bases``: upper-cased, half-open from 0, turned round on the minus strand.

    Intervals look up the chunks they touch and put them together again; parts beyond a sequence are
    missing, and intervals of unknown sequences are left out.
    """
    cells = wanted.where("end > start").distinct().withColumn("chunk", F.explode(F.expr(f"sequence(start div {size}, (end - 1) div {size})")))
    lo, hi = F.greatest(F.lit(0), F.col("start") - F.col("chunk") * size), F.least(F.lit(size), F.col("end") - F.col("chunk") * size)
    own = cells.join(chunks.withColumn("chunk", F.col("chunk").cast("bigint")), ["sequence_id", "chunk"]).withColumn("part", F.substring("bases", lo.cast("int") + 1, (hi - lo).cast("int")))
    whole = own.groupBy("sequence_id", "start", "end", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x.part), "").alias("bases"))
    return whole.withColumn("bases", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")))


def bed_lines(anchors: DataFrame) -> DataFrame:
    """(value) BED lines of (sequence_id, start, end, anchor_id, score)."""
    return anchors.select(F.concat_ws("\t", F.col("sequence_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("anchor_%08d", "anchor_id"), F.col("score").cast("string")).alias("value"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """(sequence_id, start, end, anchor_id, score) of BED lines, split at white space; comments and blank lines are left out, a line of under four columns is an error."""
    c = F.split(F.trim("value"), r"\s+")
    kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    name = F.when(F.size(c) >= 4, c[0]).otherwise(F.raise_error(F.concat(F.lit("BED line of under four columns: "), "value")).cast("string"))
    return kept.select(name.alias("sequence_id"), F.get(c, F.lit(1)).cast("bigint").alias("start"), F.get(c, F.lit(2)).cast("bigint").alias("end"), F.get(c, F.lit(3)).alias("anchor_id"), F.get(c, F.lit(4)).cast("double").alias("score"))


def towards_reference(rows: DataFrame, query_reference: Column, target_reference: Column) -> DataFrame:
    """Intervals of which exactly one side is the reference, exchanged where needed so that the reference is the target."""
    kept = rows.withColumn("__q", query_reference).withColumn("__t", target_reference).where("__q <> __t")
    pick = lambda x, y: F.when(F.col("__q"), F.col(y)).otherwise(F.col(x))
    return kept.select(pick("q", "t").alias("q"), pick("qs", "ts").alias("qs"), pick("qe", "te").alias("qe"), "strand", pick("t", "q").alias("t"), pick("ts", "qs").alias("ts"), pick("te", "qe").alias("te"), "score")


def clipped(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Intervals cut to [low, high) of the target; the query side is cut in proportion, from the other end on the minus strand."""
    a, b = F.greatest("ts", F.lit(low)), F.least("te", F.lit(high))
    inside = rows.where((F.col("te") > low) & (F.col("ts") < high) & (F.col("te") > F.col("ts"))).withColumn("a", a).withColumn("b", b)
    head, tail = F.expr("((a - ts) * (qe - qs)) div (te - ts)"), F.expr("((te - b) * (qe - qs)) div (te - ts)")
    plus = F.col("strand") == "+"
    return inside.select("q", "t", "strand", F.when(plus, F.col("qs") + head).otherwise(F.col("qs") + tail).alias("qs"), F.when(plus, F.col("qe") - tail).otherwise(F.col("qe") - head).alias("qe"), F.col("a").alias("ts"), F.col("b").alias("te"))


def locus(text: Column) -> tuple[Column, Column, Column]:
    """(name, start, end) of ``name:start-end``; nulls where the text is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", k), F.lit(""))
    return part(1), part(2).cast("bigint"), part(3).cast("bigint")


def safe_name(text: Column) -> Column:
    """A name with all but letters, digits, dots, dashes and underscores as underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def near_places(places: DataFrame, truth: DataFrame, distance: int) -> DataFrame:
    """(chrom, pos, near, nearest, ids): for every different place the rows of ``truth`` on its chromosome within ``distance``.

    Both sides are dealt by cells of the distance, so a place meets three cells; the ids at one place of ``truth`` move as one
    list, so what moves grows with places times lists, not with pairs of rows.
    """
    cell = F.expr(f"pos div {distance + 1}")
    left = places.select("chrom", "pos").distinct().select("chrom", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = truth.groupBy("chrom", "pos").agg(F.collect_list("event_id").alias("others")).select("chrom", F.col("pos").alias("at"), cell.alias("cell"), "others")
    met = left.join(right, ["chrom", "cell"]).withColumn("far", F.abs(F.col("pos") - F.col("at"))).where(F.col("far") <= distance)
    ids = F.array_join(F.array_sort(F.flatten(F.collect_list("others"))), ",")
    return met.groupBy("chrom", "pos").agg(F.sum(F.size("others")).alias("near"), F.min("far").alias("nearest"), ids.alias("ids"))


def nearby(calls: DataFrame, truth: DataFrame, distance: int) -> DataFrame:
    """(event_id, near, nearest, ids): for every call the places of ``truth`` on its chromosome within ``distance``: their number, the smallest distance, and their ids in order.

    Calls at one place have the same answer, which is made once and then joined to them.
    """
    found = near_places(calls, truth, distance)
    return calls.select("event_id", "chrom", "pos").join(found, ["chrom", "pos"], "left").select("event_id", F.coalesce("near", F.lit(0)).alias("near"), "nearest", F.coalesce("ids", F.lit("")).alias("ids"))


def flagged(calls: DataFrame, raw: DataFrame, keys: list[str], name: str = "in_raw") -> DataFrame:
    """``calls`` with a flag: whether ``raw`` has a row of the same keys."""
    return calls.join(raw.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def maximum_matching(edges: DataFrame) -> DataFrame:
    """(left_id, right_id): a largest set of edges (left_id, right_id) without a common end.

    Components are matched one by one by augmenting paths, ends of few edges first; the number of pairs
    is the only thing that all largest matchings share.  A task goes through its components in turn and holds
    the edges of one.
    """
    ends = edges.select((F.col("left_id") * 2).alias("u"), (F.col("right_id") * 2 + 1).alias("v")).distinct()
    named = ends.join(connected_components(ends), F.col("u") == F.col("node")).select("component", "u", "v")

    def run(batches):
        made = []
        every = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for _, group in groupby(every, key=itemgetter(0)):
            made += largest_matching([(u, v) for _, u, v in group])
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=["u", "v"])
                made = []
        if made:
            yield pd.DataFrame(made, columns=["u", "v"])

    ordered = named.repartition("component").sortWithinPartitions("component", "u", "v")
    return ordered.mapInPandas(run, "u long, v long").select(F.expr("u div 2").alias("left_id"), F.expr("(v - 1) div 2").alias("right_id"))


def largest_matching(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A largest set of the edges (u, v) of one component without a common end."""
    around: dict[int, list[int]] = {}
    for u, v in edges:
        around.setdefault(u, []).append(v)
    of_u: dict[int, int] = {}
    of_v: dict[int, int] = {}
    for root in sorted(around, key=lambda u: (len(around[u]), u)):
        came, queue, free = {}, [root], None  # breadth first: v -> the u it was reached from
        while queue and free is None:
            grown = []
            for u in queue:
                for v in around[u]:
                    if v not in came:
                        came[v] = u
                        if v not in of_v:
                            free = v
                            break
                        grown.append(of_v[v])
                if free is not None:
                    break
            queue = grown
        while free is not None:
            u = came[free]
            before = of_u.get(u)
            of_u[u], of_v[free], free = free, u, before
    return sorted(of_u.items())


def micro_scores(counts: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) summed over samples' rows (tp, fp, fn); 0 where nothing is to be divided by."""
    s = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 9)).otherwise(0.0)
    t = F.col("tp")
    return s.select("tp", "fp", "fn", ratio(t, t + F.col("fp")).alias("precision"), ratio(t, t + F.col("fn")).alias("recall"), ratio(2 * t, 2 * t + F.col("fp") + F.col("fn")).alias("f1"))


def match_counts(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample, tp, fp, fn) of sets 0 (truth) and 1 (calls) by chromosome: truths with a match, calls without one, truths without one."""
    hit = edges.select(F.col("left_id").alias("event_id")).unionByName(edges.select(F.col("right_id").alias("event_id"))).distinct().withColumn("hit", F.lit(1))
    rows = events.where("setno < 2").join(hit, "event_id", "left").withColumn("hit", F.col("hit").isNotNull())
    return rows.groupBy(F.col("chrom").alias("sample")).agg(F.count_if(F.expr("setno = 0 and hit")).alias("tp"), F.count_if(F.expr("setno = 1 and not hit")).alias("fp"), F.count_if(F.expr("setno = 0 and not hit")).alias("fn"))


def merged_runs(cigar: Column) -> Column:
    """The CIGAR with neighbouring operations of one kind put together and empty ones left out."""
    step = lambda done, x: F.when(x.len == 0, done).when(F.get(done, F.size(done) - 1)["op"] == x.op, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct((F.get(done, F.size(done) - 1)["len"] + x.len).alias("len"), x.op.alias("op"))))).otherwise(F.concat(done, F.array(x)))
    runs = F.aggregate(cigar_ops(cigar), F.expr("cast(array() as array<struct<len: bigint, op: string>>)"), step)
    return F.array_join(F.transform(runs, lambda x: F.concat(x.len.cast("string"), x.op)), "")


def exact_flanks(cigar: Column) -> tuple[Column, Column]:
    """Bases of the exact matches that a CIGAR begins and ends with."""
    flank = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    return flank("^([0-9]+)="), flank("([0-9]+)=$")


def without_leading_match(cigar: Column, bases: int) -> Column:
    """The CIGAR without ``bases`` bases of the exact match at its front, or all of that if it is shorter."""
    lead = exact_flanks(cigar)[0]
    rest = F.regexp_replace(cigar, "^[0-9]+=", "")
    return F.when(lead == 0, cigar).when(lead > bases, F.concat((lead - bases).cast("string"), F.lit("="), rest)).otherwise(rest)


def allele_counts(events: DataFrame) -> DataFrame:
    """(chrom, ac, alleles): distinct alleles by how many records have them."""
    per = events.groupBy("chrom", "pos", "kind", "size").agg(F.count("*").alias("n"))
    return per.groupBy("chrom", F.col("n").alias("ac")).agg(F.count("*").alias("alleles"))


def delta_summary(rows: DataFrame, limits: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> DataFrame:
    """By strand, of the larger distance of a call's two ends from the truth's: how many are within each limit, and the values at floor(share * (n - 1)) for 50 and 95 %."""
    far = rows.where("best_qs is not null").select("strand", F.greatest(F.abs(F.col("best_qs") - F.col("qs")), F.abs(F.col("best_qe") - F.col("qe"))).alias("far"))
    counts = far.groupBy("strand").agg(F.count("*").alias("n"), *(F.count_if(F.col("far") <= x).alias(f"within_{x}") for x in limits))
    over = Window.partitionBy("strand").orderBy("far")
    running = far.groupBy("strand", "far").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(over)).join(counts.select("strand", "n"), "strand")
    place = lambda share: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * share), F.col("far")))
    return counts.join(running.groupBy("strand").agg(place(0.5).alias("p50"), place(0.95).alias("p95")), "strand")
