"""Interval analytics: unions and gaps, overlap joins, nearest brackets, and best overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dyadic import overlap_pairs


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end) of merged overlapping or touching intervals.

    Equal starts are pre-aggregated to their furthest end, so repeated rows cost one.
    """
    slim = rows.groupBy(*keys, F.col(start).alias("start")).agg(F.max(end).alias("end"))
    over = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(over.rowsBetween(Window.unboundedPreceding, -1))
    numbered = slim.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union_coverage(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, covered, islands, gaps, gaps_100, largest_gap) of each key's interval union, gaps between islands."""
    merged = islands(rows, keys, start, end)
    gap = F.lead("start").over(Window.partitionBy(*keys).orderBy("start")) - F.col("end")
    return merged.withColumn("gap", gap).groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("islands"), F.count("gap").alias("gaps"), F.count_if(F.col("gap") >= 100).alias("gaps_100"), F.coalesce(F.max("gap"), F.lit(0).cast("bigint")).alias("largest_gap")
    )


def overlap_counts(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Each interval with ``overlapping``: how many others of its key it overlaps, without making the pairs.

    Others that start before its end, less others that end at or before its start: two running counts
    over the sorted ends of all intervals.
    """
    own = rows.withColumn("__n", F.lit(1))
    points = own.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("p"))
    steps = points.groupBy(*keys, F.col("p.at").alias("at")).agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e"))
    over = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.select(*keys, "at", (F.sum("s").over(over) - F.col("s")).alias("started"), F.sum("e").over(over).alias("ended"))
    by_end = totals.select(*keys, F.col("at").alias(end), "started")
    by_start = totals.select(*keys, F.col("at").alias(start), "ended")
    return rows.join(by_end, [*keys, end]).join(by_start, [*keys, start]).withColumn("overlapping", F.col("started") - F.col("ended") - 1).drop("started", "ended")


def nearest_bracket(left: DataFrame, right: DataFrame, keys: list[str], at: str, end: str) -> DataFrame:
    """(keys, at, before): for each distinct ``left`` position the largest ``right`` end at or before it (an as-of join by one sort)."""
    a = left.select(*keys, F.col(at).alias("at")).distinct().withColumn("is_left", F.lit(1)).withColumn("value", F.lit(None).cast("bigint"))
    b = right.select(*keys, F.col(end).alias("at")).distinct().withColumn("is_left", F.lit(0)).withColumn("value", F.col("at").cast("bigint"))
    over = Window.partitionBy(*keys).orderBy("at", "is_left").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("before", F.last("value", ignorenulls=True).over(over)).where("is_left = 1").select(*keys, "at", "before")


def adjacent_gaps(rows: DataFrame) -> DataFrame:
    """(q, t, strand, qe, next_qs, q_gap, t_gap, cause) of intervals that follow each other on the query axis of one track."""
    over = Window.partitionBy("q", "t", "strand").orderBy("qs", "qe", "ts", "te", "score")
    nxt = rows.select("q", "t", "strand", "qe", "te", "ts", F.lead("qs").over(over).alias("next_qs"), F.lead("ts").over(over).alias("next_ts"), F.lead("te").over(over).alias("next_te")).where("next_qs is not null")
    t_gap = F.when(F.col("strand") == "+", F.col("next_ts") - F.col("te")).otherwise(F.col("ts") - F.col("next_te"))
    gaps = nxt.select("q", "t", "strand", "qe", "next_qs", (F.col("next_qs") - F.col("qe")).alias("q_gap"), t_gap.alias("t_gap"))
    cause = F.when((F.col("q_gap") < 0) & (F.col("t_gap") < 0), "overlap_both").when(F.col("q_gap") < 0, "overlap_query").when(F.col("t_gap") < 0, "order_break").when(F.col("t_gap") > 100_000, "gap_too_large").otherwise("open_gap")
    return gaps.withColumn("cause", cause)


def gap_causes(gaps: DataFrame) -> DataFrame:
    """(t, cause, n, n_1000, most_query, most_target)."""
    return gaps.groupBy("t", "cause").agg(F.count("*").alias("n"), F.count_if((F.col("q_gap") >= 1000) | (F.col("t_gap") >= 1000)).alias("n_1000"), F.max("q_gap").alias("most_query"), F.max("t_gap").alias("most_target"))


def top_gaps(gaps: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest target gaps of each query, ranked (a top-k report); Spark keeps ``n`` rows a task and query before the shuffle."""
    over = Window.partitionBy("q").orderBy(F.desc("t_gap"), F.desc("q_gap"), "t", "strand", "qe", "next_qs")
    return gaps.withColumn("rank", F.row_number().over(over).cast("bigint")).where(F.col("rank") <= n).select("q", "rank", "t", "strand", "qe", "next_qs", "q_gap", "t_gap")


def best_overlap(truth: DataFrame, calls: DataFrame, width: int = 64) -> DataFrame:
    """(q, strand, qs, qe, best_overlap, best_qs, best_qe) of each distinct truth interval: its call of the largest query overlap on its query and strand.

    Calls are met through blocks of cells of ``width`` positions; per call start only the furthest end stays, which is the
    best of those for any truth interval.
    """
    t = truth.select("q", "strand", "qs", "qe").where("qe > qs").distinct()
    c = calls.where("qe > qs").groupBy("q", "strand", F.col("qs").alias("cs")).agg(F.max("qe").alias("ce")).select("q", "strand", "cs", "ce")
    met = overlap_pairs(t, c, ["q", "strand"], ("qs", "qe"), ("cs", "ce"), width).withColumn("overlap", F.least("qe", "ce") - F.greatest("qs", "cs"))
    best = met.groupBy("q", "strand", "qs", "qe").agg(F.max(F.struct("overlap", (-F.col("cs")).alias("a"), (-F.col("ce")).alias("b"))).alias("x"))
    return t.join(best, ["q", "strand", "qs", "qe"], "left").select("q", "strand", "qs", "qe", F.coalesce("x.overlap", F.lit(0).cast("bigint")).alias("best_overlap"), (-F.col("x.a")).alias("best_qs"), (-F.col("x.b")).alias("best_qe"))
