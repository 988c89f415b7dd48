"""What a set of variants makes of a reference: alignment blocks of the changed sequence, and a variation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["ref_start", "ref_end", "event_id"]


def _placed(events: DataFrame) -> DataFrame:
    """Events with ``cursor`` and ``q``, the places up to which the reference and the changed sequence are done before them, and their ``flank``.

    Every event counts.  The cursor is the furthest end of any earlier event, so one that begins before it
    has no flank; insertions and sources don't move it.  The changed sequence grows by flanks and by what events put in.
    """
    span, put = F.greatest(F.col("ref_end") - F.col("ref_start"), F.lit(0)), F.greatest("query_delta", F.lit(0))
    sized = events.withColumn("put", put).withColumn("len", F.when(span > 0, span).otherwise(put))
    stop = F.when(F.col("kind").isin("INV", "DUP"), F.col("ref_start") + F.col("len")).when((F.col("kind") == "DEL") | ((F.col("kind") == "BND") & (span > 0)), F.greatest("ref_end", "ref_start")).otherwise(F.col("ref_start"))
    before = Window.partitionBy("chrom").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("stop", stop).withColumn("cursor", F.coalesce(F.max("stop").over(before), F.lit(0)))
    flank = F.greatest(F.col("ref_start") - F.col("cursor"), F.lit(0))
    gain = F.when(F.col("kind") == "DEL", 0).when(F.col("kind") == "INV", F.col("len")).when(F.col("kind") == "DUP", 2 * F.col("len")).otherwise(F.col("put"))
    moved = at.withColumn("flank", flank).withColumn("gain", F.col("flank") + gain)
    return moved.withColumn("q", F.coalesce(F.sum("gain").over(before), F.lit(0)))


def _block(kind: Column, strand: str, q: Column, n: Column, target: Column, start: Column) -> Column:
    return F.struct(kind.alias("block"), F.lit(strand).alias("strand"), q.alias("query_start"), (q + n).alias("query_end"), target.alias("target"), start.alias("ref_start"), (start + n).alias("ref_end"))


def truth_blocks(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chrom, event_id, block, strand, query_start, query_end, target, ref_start, ref_end, matches, bases) of events (chrom, event_id, kind, ref_start, ref_end, query_delta, source_chrom, source_start, source_end).

    Before each event stands its flank; inversions have a block on the minus strand, duplications two blocks on
    the same stretch, other events that name a source one on it.  Behind the last event of a chromosome the rest up to its
    ``length`` is a flank without an event.  Empty blocks are left out; chromosomes without events have none.
    """
    placed = _placed(events)
    c, name = F.col, F.lit
    at = c("q") + c("flank")
    source_bases = c("source_end") - c("source_start")
    from_source = F.when(source_bases > 0, F.least("put", source_bases)).otherwise(c("put"))
    made = F.array(
        _block(name("flank"), "+", c("q"), c("flank"), c("chrom"), c("cursor")),
        F.when(c("kind") == "INV", _block(name("INV"), "-", at, c("len"), c("chrom"), c("ref_start"))),
        F.when(c("kind") == "DUP", _block(name("DUP_original"), "+", at, c("len"), c("chrom"), c("ref_start"))),
        F.when(c("kind") == "DUP", _block(name("DUP_extra_copy"), "+", at + c("len"), c("len"), c("chrom"), c("ref_start"))),
        F.when(~c("kind").isin("DEL", "INV", "DUP") & c("source_chrom").isNotNull(), _block(F.concat("kind", F.lit("_source")), "+", at, from_source, c("source_chrom"), c("source_start"))),
    )
    own = placed.select("chrom", "event_id", F.explode(made).alias("x")).where("x is not null")
    ends = placed.groupBy("chrom").agg(F.max("stop").alias("cursor"), F.sum("gain").alias("q")).join(lengths, "chrom")
    last = ends.select("chrom", F.lit(None).cast("bigint").alias("event_id"), _block(name("flank"), "+", c("q"), c("length") - c("cursor"), c("chrom"), c("cursor")).alias("x"))
    rows = own.unionByName(last).select("chrom", "event_id", "x.*").where("query_end > query_start and ref_end > ref_start")
    sides = c("query_end") - c("query_start"), c("ref_end") - c("ref_start")
    return rows.withColumn("matches", F.least(*sides)).withColumn("bases", F.greatest(*sides))


def conflicts(events: DataFrame) -> DataFrame:
    """Events that begin before the end of an earlier one, which a graph's path can't have."""
    return _placed(events).where("ref_start < cursor").select(*events.columns)


def graph_segments(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chrom, segment, start, end): the stretches between all ends of events, numbered along their chromosome from 0."""
    ends = F.array(F.lit(0).cast("bigint"), F.col("length"))
    points = events.select("chrom", F.explode(F.array("ref_start", "ref_end")).alias("start")).unionByName(lengths.select("chrom", F.explode(ends).alias("start"))).distinct()
    over = Window.partitionBy("chrom").orderBy("start")
    cut = points.withColumn("end", F.lead("start").over(over)).where("end is not null")
    return cut.select("chrom", (F.row_number().over(over) - 1).cast("bigint").alias("segment"), "start", "end")


def graph_steps(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chrom, path, step, segment, orient): how the reference and the changed sequence go through the segments.

    Segments are numbers along the reference, or ``i`` and an event's id for what it inserts.  Conflicting events
    are left out (see conflicts()); of the others, DEL, INS, DUP and INV change the path.
    """
    placed = _placed(events).where("ref_start >= cursor")
    kept = placed.select(*events.columns)
    segments = graph_segments(kept, lengths)
    placed = _placed(kept)
    c = F.col
    piece = lambda no, start, end, orient, what=F.lit(None).cast("string"): F.struct(F.lit(no).alias("no"), start.alias("a"), end.alias("b"), F.lit(orient).alias("orient"), what.alias("what"))
    event = lambda no, orient="+": piece(no, c("ref_start"), c("ref_end"), orient)
    cut = c("kind").isin("DUP", "INV") & (c("ref_end") > c("ref_start"))
    pieces = F.array(
        F.when(c("flank") > 0, piece(0, c("cursor"), c("ref_start"), "+")),
        F.when((c("kind") == "INS") & (c("put") > 0), piece(1, c("ref_start"), c("ref_start"), "+", F.concat(F.lit("i"), c("event_id").cast("string")))),
        F.when(cut & (c("kind") == "DUP"), event(1)), F.when(cut & (c("kind") == "DUP"), event(2)), F.when(cut & (c("kind") == "INV"), event(1, "-")),
    )
    own = placed.select("chrom", F.lit("changed").alias("path"), c("ref_start").alias("k0"), c("ref_end").alias("k1"), c("event_id").alias("k2"), F.explode(pieces).alias("x")).where("x is not null")
    far = F.lit((1 << 63) - 1)
    done = placed.groupBy("chrom").agg(F.max("stop").alias("cursor"))
    rest = lengths.join(done, "chrom", "left").select("chrom", F.lit("changed").alias("path"), far.alias("k0"), far.alias("k1"), far.alias("k2"), piece(0, F.coalesce("cursor", F.lit(0)), c("length"), "+").alias("x")).where("x.b > x.a")
    whole = lengths.select("chrom", F.lit("reference").alias("path"), far.alias("k0"), far.alias("k1"), far.alias("k2"), piece(0, F.lit(0).cast("bigint"), c("length"), "+").alias("x")).where("x.b > x.a")
    rows = own.unionByName(rest).unionByName(whole).select("chrom", "path", "k0", "k1", "k2", "x.*")
    first = segments.select("chrom", c("start").alias("a"), c("segment").alias("from"))
    last = segments.select("chrom", c("end").alias("b"), c("segment").alias("to"))
    spans = rows.where("what is null").join(first, ["chrom", "a"]).join(last, ["chrom", "b"])
    through = F.when(c("orient") == "+", F.sequence("from", "to")).otherwise(F.sequence("to", "from"))
    keys = ["chrom", "path", "k0", "k1", "k2", "no"]
    steps = spans.select(*keys, "orient", F.posexplode(through).alias("at", "n")).select(*keys, "at", c("n").cast("string").alias("segment"), "orient")
    put = rows.where("what is not null").select(*keys, F.lit(0).alias("at"), c("what").alias("segment"), "orient")
    over = Window.partitionBy("chrom", "path").orderBy(*keys[2:], "at")
    return steps.unionByName(put).select("chrom", "path", (F.row_number().over(over) - 1).cast("bigint").alias("step"), "segment", "orient")


def graph_links(steps: DataFrame) -> DataFrame:
    """(chrom, segment, orient, to_segment, to_orient, n): neighbours in paths, and how often they are."""
    over = Window.partitionBy("chrom", "path").orderBy("step")
    next_ = steps.withColumn("to_segment", F.lead("segment").over(over)).withColumn("to_orient", F.lead("orient").over(over)).where("to_segment is not null")
    return next_.groupBy("chrom", "segment", "orient", "to_segment", "to_orient").agg(F.count(F.lit(1)).alias("n"))
