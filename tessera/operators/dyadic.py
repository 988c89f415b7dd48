"""Interval joins through a dyadic index: an interval stands under the few aligned blocks that tile it, a point under every block that holds it.

A block of level k has 2**k cells.  An interval of n cells is tiled by at most 2 * log2(n) blocks, and exactly one of them
holds any given point of it, so every pair of a point and an interval is met once, whatever the interval's length.
Hot keys are spread over their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(low: str, high: str) -> Column:
    """The (level, node) blocks that tile the cells [low, high), two SQL expressions; none if that is empty."""
    sides = f"""transform(sequence(0, cast(floor(log2({high} - {low})) as int) + 1),
        k -> named_struct('level', k, 'l', shiftright({low} + shiftleft(1L, k) - 1, k), 'r', shiftright({high}, k)))"""
    ends = "array(named_struct('level', x.level, 'node', x.l, 'odd', x.l & 1L), named_struct('level', x.level, 'node', x.r - 1, 'odd', x.r & 1L))"
    return F.expr(f"case when {high} > {low} then filter(flatten(transform(filter({sides}, x -> x.l < x.r), x -> {ends})), y -> y.odd = 1) end")


def _under(rows: DataFrame, places: Column) -> DataFrame:
    return rows.withColumn("__b", F.explode(places)).withColumns({"__level": F.col("__b.level"), "__node": F.col("__b.node")}).drop("__b")


def _tiled(rows: DataFrame, low: str, high: str) -> DataFrame:
    return _under(rows, blocks(low, high))


def _held(rows: DataFrame, at: str, tiled: DataFrame, cells: Column) -> DataFrame:
    """``rows`` under every block that holds ``at``, up to the level that the longest interval of ``tiled`` (``cells`` long) can have."""
    top = tiled.agg(F.floor(F.log2(F.max(cells))).cast("int")).scalar()
    deep = rows.withColumn("__top", top).where("__top is not null")
    return _under(deep, F.expr(f"transform(sequence(0, __top + 1), k -> named_struct('level', k, 'node', shiftright({at}, k)))")).drop("__top")


def containing(points: DataFrame, rows: DataFrame, keys: list[str], at: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Every pair of a point and a half-open interval of equal ``keys`` that holds it, once, with the columns of both.

    Names other than the keys must differ.  Blocks are made of cells of ``cell`` positions; borders are compared exactly.
    A null place or an empty interval meets nothing.
    """
    whole = rows.where(F.col(end) > F.col(start))
    low, high = f"floor(`{start}` / {cell})", f"floor((`{end}` - 1) / {cell}) + 1"
    tiled = _tiled(whole, f"cast({low} as bigint)", f"cast({high} as bigint)")
    held = _held(points.where(F.col(at).isNotNull()), f"cast(floor(`{at}` / {cell}) as bigint)", whole, F.expr(f"{high} - {low}"))
    met = held.join(tiled, [*keys, "__level", "__node"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return met.drop("__level", "__node")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], cell: int = 512) -> DataFrame:
    """Every pair of half-open intervals of equal ``keys`` that overlap, once, with the columns of both.

    An interval's level is the least k for which ``cell`` * 2**k is not under its length.  Two that overlap begin in equal or
    neighbouring cells of the larger of their levels, and meet there only: a row stands at its own level for those of the other
    side up to it, and at the larger levels that the other side has for those that are of them.  One of ``left`` stands in three
    cells each time, so give the side with fewer rows as ``left``.
    """
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]

    def own(x: DataFrame, ends: tuple[str, str]) -> DataFrame:
        a, b = ends
        return x.where(F.col(b) > F.col(a)).withColumn("__own", F.expr(f"cast(ceil(log2(greatest(ceil((`{b}` - `{a}`) / {cell}), 1))) as int)"))

    def placed(x: DataFrame, levels: str, start: str, beside: str) -> DataFrame:
        """Rows under (level, whether the right side's level is the larger one, cell)."""
        rows = x.withColumn("__b", F.explode(F.expr(levels))).withColumns({"__level": F.col("__b.level"), "__far": F.col("__b.far")})
        at = f"shiftright(cast(floor(`{start}` / {cell}) as bigint), __level)"
        return rows.withColumn("__cell", F.explode(F.expr(f"transform({beside}, k -> {at} + k)"))).drop("__b", "__own", "__other")

    l, r = own(left, left_ends), own(right, right_ends)
    l_levels, r_levels = (x.agg(F.collect_set("__own")).scalar() for x in (l, r))
    of_left = "concat(array(named_struct('level', __own, 'far', false)), transform(filter(__other, k -> k > __own), k -> named_struct('level', k, 'far', true)))"
    of_right = """concat(transform(filter(__other, k -> k >= __own), k -> named_struct('level', k, 'far', false)),
        if(exists(__other, k -> k < __own), array(named_struct('level', __own, 'far', true)), array()))"""
    asks = placed(l.withColumn("__other", r_levels), of_left, left_ends[0], "array(-1L, 0L, 1L)")
    met = asks.join(placed(r.withColumn("__other", l_levels), of_right, right_ends[0], "array(0L)"), [*keys, "__level", "__far", "__cell"])
    return met.where((F.col(left_ends[0]) < F.col(right_ends[1])) & (F.col(right_ends[0]) < F.col(left_ends[1]))).select(columns)


#: Positions of a cell within which running counts are made.
RUN = 1 << 16


def overlap_counts(windows: DataFrame, sources: dict[str, DataFrame], keys: list[str], ends: tuple[str, str], row_ends: tuple[str, str]) -> DataFrame:
    """Distinct (keys, ends) of ``windows`` with a column for each source: how many of its rows overlap each, without making the pairs.

    Rows that begin before a window's end, without those that end at its start or before it: two running counts, whatever the
    lengths.  They run within cells of RUN positions, on top of what the cells before hold; rows of one place are added up first.
    """
    (a, b), (c, d) = ends, row_ends
    own, place = [*keys, a, b], [*keys, "__cell", "__at"]
    cell = F.floor(F.col("__at") / RUN).alias("__cell")
    both = [f"__{x}{k}" for k in range(len(sources)) for x in ("begun", "ended")]
    steps = None
    for k, rows in enumerate(sources.values()):
        at = F.explode(F.array(F.struct(F.col(c).cast("bigint").alias("at"), F.lit(2 * k).alias("what")), F.struct(F.col(d).cast("bigint").alias("at"), F.lit(2 * k + 1).alias("what"))))
        part = rows.where(F.col(d) > F.col(c)).dropna(subset=keys).select(*keys, at.alias("__x")).select(*keys, F.col("__x.at").alias("__at"), F.col("__x.what").alias("__what"))
        steps = part if steps is None else steps.unionByName(part)
    counted = steps.select(*keys, cell, "__at", "__what").groupBy(*place).agg(*(F.count_if(F.col("__what") == k).alias(n) for k, n in enumerate(both)))
    until = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counted.groupBy(*keys, "__cell").agg(*(F.sum(n).alias(n) for n in both))
    # What a cell holds counts from the next cell on: a row of its own, before all places of the next cell that is asked or has rows.
    asked = windows.select(*own).distinct()
    asks = asked.withColumn("__at", F.explode(F.array(F.col(b).cast("bigint") - 1, F.col(a).cast("bigint")))).select(*own, cell, "__at")
    nothing = [F.lit(0).cast("bigint").alias(n) for n in both]
    every = cells.unionByName(asks.select(*keys, "__cell").distinct().select(*keys, "__cell", *nothing)).groupBy(*keys, "__cell").agg(*(F.sum(n).alias(n) for n in both))
    before = every.select(*keys, "__cell", *((F.sum(n).over(until) - F.col(n)).alias(n) for n in both)).withColumn("__at", F.lit(None).cast("bigint"))
    marks = [F.lit(None).cast(windows.schema[x].dataType).alias(x) for x in (a, b)]
    rows = before.select(*place, *both, *marks, F.lit(False).alias("__asks")).unionByName(counted.select(*place, *both, *marks, F.lit(False).alias("__asks")))
    rows = rows.unionByName(asks.select(*place, *nothing, a, b, F.lit(True).alias("__asks")))
    within = Window.partitionBy(*keys, "__cell").orderBy(F.col("__at").asc_nulls_first())
    found = rows.select(*own, "__at", "__asks", *(F.sum(n).over(within).alias(n) for n in both)).where("__asks")
    last, first = F.col("__at") == F.col(b).cast("bigint") - 1, F.col("__at") == F.col(a).cast("bigint")
    totals = (F.coalesce(F.max(F.when(last, F.col(f"__begun{k}"))) - F.max(F.when(first, F.col(f"__ended{k}"))), F.lit(0).cast("bigint")).alias(n) for k, n in enumerate(sources))
    out = found.groupBy(*own).agg(*totals)
    is_open = (F.col(b) > F.col(a)) & ~F.array_contains(F.array(*(F.col(x).isNull() for x in keys)), True)
    return out.select(*own, *(F.when(is_open, F.col(n)).otherwise(0).alias(n) for n in sources))


def overlap_totals(windows: DataFrame, rows: DataFrame, keys: list[str], ends: tuple[str, str], row_ends: tuple[str, str], name: str) -> DataFrame:
    """``overlap_counts`` of one source."""
    return overlap_counts(windows, {name: rows}, keys, ends, row_ends)
