"""More chains from what primary chains left over: in a window around each, and in the gaps between neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chains import TRACK, Params, best_chain, chain_anchors, distinct_pairs


@dataclass(frozen=True)
class Refinement:
    """How far around a primary chain is looked, and how many anchors a refined chain has at least."""

    window: int = 100_000
    min_anchors: int = 20


_FIELDS = (
    "q string, t string, strand string, place long, refinement string, parent_no long, left_no long, right_no long, anchors long, both long, raw_score double, "
    "ref_start long, ref_end long, query_start long, query_end long, rows array<struct<ts: bigint, qs: bigint, score: double, both: boolean>>"
)


_ROW = pa.struct([("ts", pa.int64()), ("qs", pa.int64()), ("score", pa.float64()), ("both", pa.bool_())])
_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _FIELDS.split(", rows")[0].split(", ")] + [("rows", pa.list_(_ROW))])


class _Free:
    """Leftover anchor pairs of both strands of a sequence pair, looked up in boxes while chains use them up.

    A strand's rows are sorted by reference, so a box is a slice of it, sifted by query.  An anchor pair
    that a chain of either strand has used is used for both: it is looked up in the other strand's rows.
    """

    def __init__(self, left: pa.Table):
        self.rows = {}
        for strand in pc.unique(left.column("strand")).drop_null().to_pylist():
            part = left.filter(pc.equal(left.column("strand"), strand))
            ref, query, score, both = (part.column(c).to_numpy() for c in ("ts", "qs", "score", "both"))
            order = np.lexsort((query if strand == "+" else -query, ref))
            self.rows[strand] = (*(x[order] for x in (ref, query, score, both)), np.ones(len(order), dtype=bool))

    def in_box(self, strand: str, ref_start: int, ref_end: int, query_start: int, query_end: int) -> np.ndarray:
        """Free rows of a strand inside a box, its edges included, in order."""
        if strand not in self.rows:
            return np.empty(0, dtype=np.int64)
        ref, query, _, _, free = self.rows[strand]
        a, b = np.searchsorted(ref, ref_start, "left"), np.searchsorted(ref, ref_end, "right")
        return a + np.flatnonzero(free[a:b] & (query[a:b] >= query_start) & (query[a:b] <= query_end))

    def use(self, strand: str, rows: np.ndarray) -> None:
        ref, query, _, _, free = self.rows[strand]
        free[rows] = False
        for other, (far, far_query, _, _, far_free) in self.rows.items():
            if other != strand:
                begins, ends = np.searchsorted(far, ref[rows], "left"), np.searchsorted(far, ref[rows], "right")
                for k in np.flatnonzero(ends > begins).tolist():
                    far_free[begins[k] : ends[k]] &= far_query[begins[k] : ends[k]] != query[rows[k]]


def refine_pair(chains: pd.DataFrame, left: pa.Table, p: Params, r: Refinement) -> list[tuple]:
    """Refined chains of one sequence pair: (strand, kind, parent, left, right, rows, score), in the order in which they use up what is left.

    ``chains`` are boxes; ``left`` holds no pair that one of them has, and ``rows`` are (ts, qs, score, both) as arrays.
    First around every primary chain, strand by strand and best first; then between chains that
    follow each other on the reference without overlap on either axis.
    """
    free, out = _Free(left), []

    def attempt(strand: str, box: tuple[int, int, int, int], kind: str, parent, before, after) -> None:
        at = free.in_box(strand, *box)
        if len(at) < r.min_anchors:
            return
        ref, query, score, both = (x[at] for x in free.rows[strand][:4])
        own, total = best_chain(ref, query, score, strand == "+", p)
        if len(own) < r.min_anchors or total < p.min_score or both[own].sum() < p.min_both:
            return
        free.use(strand, at[own])
        out.append((strand, kind, parent, before, after, tuple(x[own] for x in (ref, query, score, both)), total))

    place = ["chain_no", "ref_start", "ref_end", "query_start", "query_end"]
    tracks = [(strand, part.sort_values("chain_no")[place]) for strand, part in sorted(chains.groupby("strand"))]
    for strand, part in tracks:
        for no, r0, r1, q0, q1 in part.itertuples(index=False):
            attempt(strand, (max(0, r0 - r.window), r1 + r.window, max(0, q0 - r.window), q1 + r.window), "around", no, None, None)
    for strand, part in tracks:
        order = list(part.sort_values(["ref_start", "chain_no"]).itertuples(index=False))
        for (no, _, end, q0, q1), (next_no, start, _, next_q0, next_q1) in zip(order, order[1:]):
            low, high = (q1, next_q0) if strand == "+" else (next_q1, q0)
            if end <= start and low <= high:
                attempt(strand, (end, start, low, high), "between", None, no, next_no)
    return out


def refined_chains(primary: DataFrame, left: DataFrame, p: Params = Params(), r: Refinement = Refinement()) -> DataFrame:
    """Refined chains with their rows, numbered on from each track's primaries.

    ``primary`` is of chains_with_rows(); ``left`` are anchor pairs (q, t, strand, qs, ts, score[, both]) that may be used, as
    ``leftovers`` returns them and others of less certain origin.  A sequence pair, both strands together, is
    one group, as what one chain uses no later one can have; a group holds the boxes of its primary chains, not
    their anchors, and four numbers for each leftover, as arrays.  Pairs without primary chains are never grouped.
    """

    def run(chains: pa.Table, rest: pa.Table) -> pa.Table:
        if not chains.num_rows or not rest.num_rows:
            return _SCHEMA.empty_table()
        made = refine_pair(chains.to_pandas(), rest, p, r)
        strand, kind, parent, before, after, rows, total = zip(*made) if made else ((),) * 7
        flat = [np.concatenate([x[k] for x in rows]) if made else [] for k in range(4)]
        anchors = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, _ROW)], fields=list(_ROW))
        ends = np.cumsum([0, *(len(x[0]) for x in rows)]).astype(np.int32)
        sums = [[f(x[k]) for x in rows] for k, f in ((0, len), (3, np.sum))]
        bounds = [[f(x[k]) for x in rows] for k in (0, 1) for f in (np.min, np.max)]
        names = [[chains.column(c)[0].as_py()] * len(made) for c in ("q", "t")]
        columns = [*names, strand, range(len(made)), kind, parent, before, after, sums[0], sums[1], total, *bounds]
        return pa.table([*(pa.array(list(x), f.type) for x, f in zip(columns, _SCHEMA)), pa.ListArray.from_arrays(pa.array(ends), anchors)], schema=_SCHEMA)

    pairs = primary.select("q", "t").distinct()
    used = chain_anchors(primary).select("q", "t", "qs", "ts")
    rest = distinct_pairs(left).join(pairs, ["q", "t"], "left_semi").join(used, ["q", "t", "qs", "ts"], "left_anti")
    rest = rest.select(*TRACK, F.col("qs").cast("bigint"), F.col("ts").cast("bigint"), "score", F.col("both").cast("boolean"))
    boxes = primary.select(*TRACK, "chain_no", "ref_start", "ref_end", "query_start", "query_end")
    found = boxes.groupBy("q", "t").cogroup(rest.groupBy("q", "t")).applyInArrow(run, _FIELDS)
    share = F.col("both") / F.col("anchors")
    after = primary.groupBy(*TRACK).agg((F.max("chain_no") + 1).alias("after"))
    numbered = found.join(after, TRACK, "left").withColumn("chain_no", F.coalesce("after", F.lit(0)) + F.row_number().over(Window.partitionBy(*TRACK).orderBy("place")) - 1)
    scored = numbered.withColumn("both_rate", share).withColumn("chain_score", F.col("raw_score") * ((1 - p.both_weight) + p.both_weight * share))
    return scored.select(*TRACK, F.col("chain_no").cast("bigint").alias("chain_no"), "refinement", "parent_no", "left_no", "right_no", "anchors", "both", "both_rate", "raw_score", "chain_score", "ref_start", "ref_end", "query_start", "query_end", "rows")
