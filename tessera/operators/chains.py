"""Chaining of anchor pairs into collinear chains: a dynamic programme per stretch of a track, extracted best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Bounds of a step, its cost, and what makes a chain.

    ``relative``: the cost of a step grows with the gaps' difference over the smaller gap, else over
    ``gap_unit``.  ``max_ratio`` bounds the larger gap over the smaller one, ``min_both`` a chain's
    anchors that both directions support, whose share scores ``both_weight`` of the raw score.
    """

    predecessors: int = 50
    max_gap: int = 50_000
    max_ratio: float = float("inf")
    gap_unit: float = 50.0
    gap_weight: float = 1.0
    relative: bool = False
    min_anchors: int = 2
    min_both: int = 0
    min_score: float = 0.0
    both_weight: float = 0.8


#: Rows whose steps are costed at once.
BLOCK = 4096
TRACK = ["q", "t", "strand"]


def step_gains(ref: np.ndarray, query: np.ndarray, begin: int, end: int, plus: bool, p: Params) -> np.ndarray:
    """(rows, predecessors): minus the cost of the step to each row from its 1st, 2nd, ... predecessor, -inf where none is allowed."""
    at = np.arange(begin, end)[:, None] - np.arange(1, p.predecessors + 1)[None, :]
    from_ = np.maximum(at, 0)
    dr = ref[begin:end, None] - ref[from_]
    dq = (query[begin:end, None] - query[from_]) * (1 if plus else -1)
    low, high = np.minimum(dr, dq), np.maximum(dr, dq)
    ok = (at >= 0) & (low > 0) & (high <= p.max_gap)
    if np.isfinite(p.max_ratio):
        ok &= high <= p.max_ratio * low
    if p.relative:
        x = (high - low) / np.maximum(low, 1)
        cost = p.gap_weight * x + np.sqrt(1 + np.where(ok, x, 0)) - 1
    else:
        x = (high - low) / p.gap_unit
        cost = p.gap_weight * x + np.log2(1 + x)
    return np.where(ok, -cost, -np.inf)


def best_chain(ref: np.ndarray, query: np.ndarray, score: np.ndarray, plus: bool, p: Params) -> tuple[list[int], float]:
    """(rows of the best chain, its score) of rows sorted by ref, then query (descending on the minus strand).

    A step goes to a strictly larger ref and a query strictly further along the strand, with neither
    gap over max_gap; the nearest predecessor wins ties, and the first best end.
    """
    n = len(ref)
    total, back = score.astype(np.float64).copy(), np.full(n, -1)
    for block in range(0, n, BLOCK):
        gains = step_gains(ref, query, block, min(n, block + BLOCK), plus, p)
        for i in np.flatnonzero((gains > -np.inf).any(axis=1)).tolist():
            i += block
            value = total[max(0, i - p.predecessors) : i][::-1]
            value = value + gains[i - block, : len(value)]
            at = int(value.argmax())
            if value[at] > 0:
                total[i] += value[at]
                back[i] = i - 1 - at
    end = int(np.argmax(total))
    rows, k = [], end
    while k >= 0:
        rows.append(k)
        k = int(back[k])
    return rows[::-1], float(total[end])


def path_value(ref: np.ndarray, query: np.ndarray, score: np.ndarray, p: Params) -> float:
    """The scores of anchors in a chain's order less the costs of its steps."""
    dr, dq = np.diff(ref).astype(np.float64), np.abs(np.diff(query)).astype(np.float64)
    far = np.abs(dr - dq)
    if p.relative:
        x = far / np.maximum(1, np.minimum(dr, dq))
        return float(score.sum() - (p.gap_weight * x + np.sqrt(1 + x) - 1).sum())
    x = far / p.gap_unit
    return float(score.sum() - (p.gap_weight * x + np.log2(1 + x)).sum())


class _Rest:
    """What is left of sorted rows while chains are taken out: each row's best total and step, kept up to date.

    Taking rows out changes the totals behind them only: where a step led to one of them, or where the window of
    ``predecessors`` rows now reaches further back.  Rows are settled again from the first one that is missing until, beyond
    the last, as many rows as a window has come out as they were; then all later ones would too.
    """

    STEP = 64

    def __init__(self, ref: np.ndarray, query: np.ndarray, score: np.ndarray, plus: bool, p: Params):
        self.ref, self.query, self.score, self.plus, self.p = ref, query, score.astype(np.float64), plus, p
        n = len(ref)
        self.row = np.arange(n)
        self.total, self.back, self.gone = np.full(n, np.nan), np.full(n, -1), np.zeros(n, dtype=bool)
        self.heap: list[tuple[float, int]] = []
        self._settle(0, n, BLOCK)

    def _settle(self, begin: int, sure: int, size: int) -> None:
        """Totals of the rows at places from ``begin`` on, as far as they can have changed; those before ``sure`` have to be looked at."""
        alike, k, most = 0, begin, self.p.predecessors
        while k < len(self.row):
            end = min(len(self.row), k + size)
            first = max(0, k - most)
            rows = self.row[first:end]
            gains = step_gains(self.ref[rows], self.query[rows], k - first, end - first, self.plus, self.p)
            steps = (gains > -np.inf).any(axis=1)
            for i in range(k, end):
                row = self.row[i]
                total, back = self.score[row], -1
                if steps[i - k]:
                    before = self.row[max(0, i - most) : i][::-1]
                    value = self.total[before] + gains[i - k, : len(before)]
                    at = int(value.argmax())
                    if value[at] > 0:
                        total, back = total + value[at], before[at]
                if total == self.total[row] and back == self.back[row]:
                    alike = alike + 1 if i >= sure else 0
                    if alike >= most:
                        return
                else:
                    alike = 0
                    self.total[row], self.back[row] = total, back
                    heapq.heappush(self.heap, (-total, int(row)))
            k = end

    def best(self) -> tuple[np.ndarray, float] | None:
        """The rows of the best chain (that which ends first of equal ones) and its score."""
        while self.heap and (self.gone[self.heap[0][1]] or -self.heap[0][0] != self.total[self.heap[0][1]]):
            heapq.heappop(self.heap)
        if not self.heap:
            return None
        total, k = self.heap[0]
        rows = []
        while k >= 0:
            rows.append(k)
            k = int(self.back[k])
        return np.array(rows[::-1]), -total

    def take(self, rows: np.ndarray) -> None:
        """Take rows out."""
        at = np.searchsorted(self.row, rows)
        self.gone[rows] = True
        self.row = np.delete(self.row, at)
        self._settle(int(at[0]), int(at[-1]) - len(rows) + 1, self.STEP)


def extract(ref: np.ndarray, query: np.ndarray, score: np.ndarray, plus: bool, p: Params) -> list[tuple[np.ndarray, float]]:
    """(rows, score) of the chains of a track's sorted rows, best first, down to ``min_score``; short ones too.

    The chains are those of taking out the best one and chaining all the rest again.
    """
    out, rest = [], _Rest(ref, query, score, plus, p)
    while (found := rest.best()) and found[1] >= p.min_score:
        out.append(found)
        rest.take(found[0])
    return out


#: Stretches of up to LARGE rows are chained side by side, as many as have CELLS rows together.
LARGE, CELLS = 8192, 1 << 15


def _side_by_side(ref: np.ndarray, query: np.ndarray, score: np.ndarray, p: Params, width: int) -> list[list[tuple[np.ndarray, float]]]:
    """``extract`` of many stretches at once, rows of matrices (padded with scores of -inf; query places grow along the strand).

    No row has more than ``width`` rows within ``max_gap`` before it.  When rows go, others are looked at again, wave by
    wave, for all stretches together: where a step led to a row that went or fell, where a row in the window rose, and where
    a row that came into the window (which are ``predecessors`` of those left) would be a better step.
    """
    n, most = ref.shape
    bound = width > p.predecessors
    wide = most + width
    gains = np.full((n, wide, width), -np.inf)
    for k in range(1, min(width, most - 1) + 1):
        dr, dq = ref[:, k:] - ref[:, :-k], query[:, k:] - query[:, :-k]
        low, high = np.minimum(dr, dq), np.maximum(dr, dq)
        ok = (low > 0) & (high <= p.max_gap)
        if np.isfinite(p.max_ratio):
            ok &= high <= p.max_ratio * low
        at = np.nonzero(ok)
        low, high = low[at], high[at]
        if p.relative:
            x = (high - low) / np.maximum(low, 1)
            cost = p.gap_weight * x + np.sqrt(1 + x) - 1
        else:
            x = (high - low) / p.gap_unit
            cost = p.gap_weight * x + np.log2(1 + x)
        gains[at[0], at[1] + width + k, k - 1] = -cost
    gains = gains.reshape(n * wide, width)
    # A stretch's rows follow ``width`` empty places, which are those behind the stretch before, too.
    own = np.full((n + 1, wide), -np.inf)
    own[:n, width:] = score
    own = own.ravel()
    total, back, gain = own.copy(), np.full(len(own), -1), np.zeros(len(own))
    steps = np.arange(1, width + 1)
    window = np.full(len(own), min(width, p.predecessors))  # places before a row that it may step from

    def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and steps of rows anew; the rows that fell and those that rose."""
        if not width:
            return rows[:0], rows[:0]
        value = total[rows[:, None] - steps] + gains[rows]
        if bound:
            value[steps > window[rows][:, None]] = -np.inf
        at = value.argmax(axis=1)
        best = value[np.arange(len(rows)), at]
        gain[rows] = np.maximum(best, 0)
        new = np.where(best > 0, own[rows] + best, own[rows])
        back[rows] = np.where(best > 0, rows - 1 - at, -1)
        old, total[rows] = total[rows], new
        return rows[new < old], rows[new > old]

    def widened(lines: np.ndarray) -> np.ndarray:
        """Rows of stretches for which one that came into their window is a better step."""
        rows = np.flatnonzero((total[: n * wide].reshape(n, wide)[lines] > -np.inf).ravel())
        rows += (begins[lines] - np.arange(len(lines)) * wide)[rows // wide]
        line = rows // wide
        first = np.searchsorted(line, line)
        new = np.minimum(rows - rows[np.maximum(np.arange(len(rows)) - p.predecessors, first)], width)
        full = np.arange(len(rows)) - first >= p.predecessors
        new = np.where(full, new, width)
        more = new > window[rows]
        rows, new, old = rows[more], new[more], window[rows[more]]
        window[rows] = new
        better = np.zeros(len(rows), dtype=bool)
        for e in range(1, int((new - old).max(initial=0)) + 1):
            some = np.flatnonzero(new - old >= e)
            at = old[some] + e
            better[some] |= total[rows[some] - at] + gains[rows[some], at - 1] > gain[rows[some]]
        return rows[better]

    begins = np.arange(n) * wide
    for k in range(most):
        rows = begins + width + k
        settle(rows[own[rows] > -np.inf])
    out: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n)]
    none = np.empty(0, dtype=np.int64)
    fallen, risen, others, active = none, none, none, np.arange(n)
    while len(active) or len(fallen) or len(risen):
        if len(fallen) or len(risen) or len(others):
            after = fallen[:, None] + steps
            again = [after[back[after] == fallen[:, None]], others]
            if len(risen):
                after = (risen[:, None] + steps).ravel()
                again.append(after[total[after] > -np.inf])
            fallen, risen = settle(np.unique(np.concatenate(again)) if len(risen) or len(others) else again[0])
            others = none
        ready = np.setdiff1d(active, np.concatenate([fallen, risen]) // wide) if len(fallen) or len(risen) else active
        if not len(ready):
            continue
        lines = total[: n * wide].reshape(n, wide)[ready]
        end = lines.argmax(axis=1)
        best = lines[np.arange(len(ready)), end]
        good = (best >= p.min_score) & (best > -np.inf)
        if not good.all():
            active = np.setdiff1d(active, ready[~good])
        taken, at, who = [], begins[ready[good]] + end[good], ready[good]
        chain: dict[int, list[int]] = {g: [] for g in who.tolist()}
        for g, value in zip(who.tolist(), best[good].tolist()):
            out[g].append((chain[g], value))
        while len(at):
            for g, k in zip(who.tolist(), (at - begins[who] - width).tolist()):
                chain[g].append(k)
            taken.append(at)
            at = back[at]
            on = at >= 0
            at, who = at[on], who[on]
        if taken:
            gone = np.concatenate(taken)
            total[gone], back[gone] = -np.inf, -2
            fallen = np.concatenate([fallen, gone])
            others = widened(ready[good]) if bound else none
    return [[(np.array(rows[::-1]), value) for rows, value in found] for found in out]


def extract_all(bounds: np.ndarray, ref: np.ndarray, query: np.ndarray, score: np.ndarray, plus: np.ndarray, p: Params) -> list[list[tuple[np.ndarray, float]]]:
    """``extract`` of each of the stretches that begin and end at ``bounds``; ``plus`` has a flag a stretch.

    Those of about equal size go side by side.  Large ones, and those where more than three times as many rows as
    ``predecessors`` stand within ``max_gap`` of another, go one by one.
    """
    size, begins = np.diff(bounds), bounds[:-1]
    along = np.where(np.repeat(plus, size), query, -query)
    out: list[list[tuple[np.ndarray, float]]] = [[] for _ in size]
    reach = np.zeros(len(size), dtype=np.int64)
    for g in np.flatnonzero(size > 1).tolist():
        own = ref[bounds[g] : bounds[g + 1]]
        reach[g] = (np.arange(len(own)) - np.searchsorted(own, own - p.max_gap)).max()
    alone = (size > LARGE) | (reach > 3 * p.predecessors)
    for g in np.flatnonzero(alone).tolist():
        own = slice(bounds[g], bounds[g + 1])
        out[g] = extract(ref[own], query[own], score[own], bool(plus[g]), p)
    rest = np.flatnonzero(~alone & (size > 0))
    rest = rest[np.lexsort((reach[rest], size[rest]))]
    at = 0
    while at < len(rest):
        most, few = size[rest[at : at + CELLS]], at + 1
        few = at + int(np.searchsorted(np.maximum(most, 1) * np.arange(1, len(most) + 1), CELLS, side="right"))
        few = min(max(few, at + 1), at + int(np.searchsorted(most, 2 * most[0], side="right")))
        these = rest[at:few]
        most = int(size[these].max())
        place = begins[these][:, None] + np.minimum(np.arange(most), size[these][:, None] - 1)
        there = np.arange(most) < size[these][:, None]
        # Padded rows stand too far off for any step.
        far = np.where(there, 0, 2 * int(p.max_gap) + 2)
        found = _side_by_side(ref[place] + far, along[place] + far, np.where(there, score[place], -np.inf), p, int(reach[these].max()))
        for g, x in zip(these.tolist(), found):
            out[g] = x
        at = few
    return out


#: A chain: its track and stretch, place among the stretch's chains, sums, bounds, and its rows in order.
_FIELDS = (
    "q string, t string, strand string, stretch long, place long, anchors long, both long, raw_score double, ref_start long, ref_end long, query_start long, query_end long, "
    "rows array<struct<ts: bigint, qs: bigint, score: double, both: boolean>>"
)
#: Rows of a task that are chained at once, and at least, unless it ends.
TOGETHER = 1 << 17


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each track and pair of places, with the best score and whether any row is supported both ways."""
    both = F.col("both") if "both" in pairs.columns else F.lit(False)
    return pairs.groupBy(*TRACK, "qs", "ts").agg(F.max("score").cast("double").alias("score"), F.max(both).alias("both"))


def _with_stretch(rows: DataFrame, p: Params) -> DataFrame:
    """Rows with the stretch of their track between gaps that no step crosses.

    Only the cells of ``max_gap`` that have rows are put in order, with their first and last row, so no
    task sorts the rows of a track.
    """
    cell = F.expr(f"ts div {int(p.max_gap)}")
    celled = rows.withColumn("cell", cell)
    over = Window.partitionBy(*TRACK).orderBy("cell")
    cells = celled.groupBy(*TRACK, "cell").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    far = F.coalesce(F.col("first") - F.lag("last").over(over) > p.max_gap, F.lit(False)).cast("bigint")
    numbered = cells.withColumn("far", far).withColumn("stretch", F.sum("far").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return celled.join(numbered.select(*TRACK, "cell", "stretch"), [*TRACK, "cell"]).drop("cell")


def _chained(table: pa.Table, p: Params) -> pa.RecordBatch | None:
    """Chains of whole stretches, sorted rows (q, t, strand, stretch, ts, qs, score, both)."""
    track = [table.column(c).combine_chunks() for c in (*TRACK, "stretch")]
    n = table.num_rows
    begins = np.zeros(n, dtype=bool)
    begins[:1] = True
    for column in track:
        codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    bounds = np.append(np.flatnonzero(begins), n)
    ref, query, score, both = (table.column(c).to_numpy() for c in ("ts", "qs", "score", "both"))
    plus = pc.equal(track[2].take(pa.array(bounds[:-1])), "+").to_numpy(zero_copy_only=False)
    heads, places, totals, rows = [], [], [], []
    for head, found in zip(bounds[:-1].tolist(), extract_all(bounds, ref, query, score, plus, p)):
        for place, (own, total) in enumerate(found):
            if len(own) >= p.min_anchors:
                heads.append(head)
                places.append(place)
                totals.append(total)
                rows.append(own + head)
    if not rows:
        return None
    flat = np.concatenate(rows)
    ends = np.cumsum([len(x) for x in rows])
    first = np.concatenate(([0], ends[:-1]))
    supported = np.add.reduceat(both[flat].astype(np.int64), first)
    least = [f.reduceat(x[flat], first) for x in (ref, query) for f in (np.minimum, np.maximum)]
    anchors = pa.StructArray.from_arrays([pa.array(x[flat]) for x in (ref, query, score, both)], ["ts", "qs", "score", "both"])
    columns = [c.take(pa.array(heads)) for c in track] + [pa.array(places, pa.int64()), pa.array(ends - first), pa.array(supported), pa.array(totals, pa.float64()), *map(pa.array, least)]
    out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1:]).astype(np.int32)), anchors)], [f.split()[0] for f in _FIELDS.split("rows")[0].rstrip(", ").split(", ")] + ["rows"])
    return out.filter(pa.array(supported >= p.min_both))


def _stretches(pairs: DataFrame, p: Params) -> DataFrame:
    """All chains of distinct anchor pairs that are long enough, by stretches of tracks.

    Stretches are dealt to tasks by number, not by bytes, as chaining takes long for few bytes; a task holds the
    rows of some stretches at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(table.num_rows - 1)
            same = np.logical_and.reduce([pc.equal(table.column(c), last.column(c)[0]).to_numpy() for c in (*TRACK, "stretch")])
            at = table.num_rows - int(same.sum())
            held = table.slice(at).to_batches()
            if at and (found := _chained(table.slice(0, at), p)):
                yield found
        if held and sum(b.num_rows for b in held) and (found := _chained(pa.Table.from_batches(held), p)):
            yield found

    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*TRACK, "stretch"]
    rows = _with_stretch(distinct_pairs(pairs), p).select(*keys, F.col("ts").cast("bigint"), F.col("qs").cast("bigint"), "score", F.col("both").cast("boolean"))
    ordered = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "ts", F.when(F.col("strand") == "+", F.col("qs")).otherwise(-F.col("qs")))
    return ordered.mapInArrow(run, _FIELDS)


def chains_with_rows(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """chains() with ``rows`` (ts, qs, score, both) of each chain in order."""
    best_first = Window.partitionBy(*TRACK).orderBy(F.desc("raw_score"), "stretch", "place")
    found = _stretches(pairs, p).withColumn("chain_no", (F.row_number().over(best_first) - 1).cast("bigint"))
    share = F.col("both") / F.col("anchors")
    scored = found.withColumn("both_rate", share).withColumn("chain_score", F.col("raw_score") * ((1 - p.both_weight) + p.both_weight * share))
    return scored.select(*TRACK, "chain_no", "anchors", "both", "both_rate", "raw_score", "chain_score", "ref_start", "ref_end", "query_start", "query_end", "rows")


def chains(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """(q, t, strand, chain_no, anchors, both, both_rate, raw_score, chain_score, ref_start, ref_end, query_start, query_end) of distinct anchor pairs (q, t, strand, qs, ts, score[, both]).

    Each track's best chain is taken out and the rest chained again, until the best scores too little;
    chains of too few anchors are taken out too, but not returned.  A track is one sequence pair and
    strand; it is dealt in stretches between gaps over ``max_gap`` of the reference axis.
    """
    return chains_with_rows(pairs, p).drop("rows")


def chain_anchors(found: DataFrame) -> DataFrame:
    """(q, t, strand, chain_no, rank, ts, qs, score, both): the anchors of chains_with_rows(), in order, from rank 0."""
    return found.select(*TRACK, "chain_no", F.posexplode("rows").alias("rank", "x")).select(*TRACK, "chain_no", F.col("rank").cast("bigint").alias("rank"), "x.*")


def leftovers(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Anchor pairs that no returned chain has."""
    used = chain_anchors(found).select(*TRACK, "qs", "ts").distinct()
    return pairs.join(used, [*TRACK, "qs", "ts"], "left_anti")


def path_scores(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """(q, t, strand, chain_no, path_score): each chain's anchor scores less the costs of its steps, from chain_anchors() rows alone."""
    over = Window.partitionBy(*TRACK, "chain_no").orderBy("rank")
    dr, dq = F.col("ts") - F.lag("ts").over(over), F.abs(F.col("qs") - F.lag("qs").over(over))
    x = F.abs(dr - dq) / (F.greatest(F.lit(1), F.least(dr, dq)) if p.relative else F.lit(p.gap_unit))
    cost = F.lit(p.gap_weight) * x + (F.sqrt(1 + x) - 1 if p.relative else F.log2(1 + x))
    return rows.withColumn("gain", F.col("score") - F.coalesce(cost, F.lit(0.0))).groupBy(*TRACK, "chain_no").agg(F.sum("gain").alias("path_score"))
