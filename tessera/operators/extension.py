"""Extension of bundles into the gap before the next one, and why a gap stays open.

Bundles are chains as boxes (TRACK, chain_no, ref_start, ref_end, query_start, query_end, score); candidates are anchor pairs
(TRACK, ts, qs, score, both) whose centres may stand in a gap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chains import TRACK, Params, path_value, step_gains


@dataclass(frozen=True)
class Extension:
    """Bounds of an extension: its steps cost as a chain's, over gaps of ``steps.max_gap`` at most.

    ``half`` is half an anchor's length; ``min_copies`` anchors that both directions support make an open
    axis a copy.  Gaps meet candidates in cells of ``cell`` bases, so a gap is in max_gap / cell cells at most.
    """

    steps: Params = Params(max_gap=1_000_000, max_ratio=1.05, gap_weight=0.002, gap_unit=10.0)
    min_anchors: int = 5
    min_score: float = 100.0
    min_copies: int = 1
    half: int = 20
    cell: int = 16_384


def open_gaps(bundles: DataFrame) -> DataFrame:
    """Neighbours on a track that follow each other without overlap on either axis: (TRACK, left_no, right_no, both boxes as l_ and r_, ref_gap, query_gap)."""
    sides = ["ref_start", "ref_end", "query_start", "query_end"]
    over = Window.partitionBy(*TRACK).orderBy(*sides, "chain_no")
    next_ = F.lead(F.struct("chain_no", *sides)).over(over)
    rows = bundles.withColumn("r", next_).where("r is not null").select(*TRACK, F.col("chain_no").alias("left_no"), F.col("r.chain_no").alias("right_no"), *(F.col(c).alias(f"l_{c}") for c in sides), *(F.col(f"r.{c}").alias(f"r_{c}") for c in sides))
    plus = F.col("strand") == "+"
    query_gap = F.when(plus, F.col("r_query_start") - F.col("l_query_end")).otherwise(F.col("l_query_start") - F.col("r_query_end"))
    gaps = rows.withColumn("ref_gap", F.col("r_ref_start") - F.col("l_ref_end")).withColumn("query_gap", query_gap)
    # Between them on the query axis, whichever way the strand runs.
    return gaps.where("ref_gap >= 0 and query_gap >= 0").withColumn("q_low", F.when(plus, F.col("l_query_end")).otherwise(F.col("r_query_end"))).withColumn("q_high", F.when(plus, F.col("r_query_start")).otherwise(F.col("l_query_start")))


def _between(gaps: DataFrame, candidates: DataFrame, low: str, high: str, at: str, cell: int) -> DataFrame:
    """Gaps with the candidates of their track whose ``at`` stands strictly between two of their columns."""
    cells = F.expr(f"sequence(`{low}` div {cell}, `{high}` div {cell})")
    left = gaps.withColumn("cell", F.explode(cells))
    right = candidates.withColumn("cell", F.expr(f"`{at}` div {cell}"))
    return left.join(right, [*TRACK, "cell"]).where((F.col(at) > F.col(low)) & (F.col(at) < F.col(high))).drop("cell")


def _meet(a0: int, a1: int, b0: int, b1: int) -> bool:
    return max(a0, b0) < min(a1, b1)


def attempt(gap: dict, ts: np.ndarray, qs: np.ndarray, score: np.ndarray, e: Extension) -> dict:
    """One gap's extension from the end of its left bundle, over candidates inside it.

    The best path over candidates that the seed reaches is cut where its anchors would make the two bundles overlap
    anew (on both axes, if they already do on one).
    """
    plus = gap["strand"] == "+"
    order = np.lexsort((qs if plus else -qs, ts))
    ts, qs, score = ts[order], qs[order], score[order]
    ref = np.concatenate([[gap["l_ref_end"]], ts])
    query = np.concatenate([[gap["l_query_end"] if plus else gap["l_query_start"]], qs])
    value = np.concatenate([[0.0], score])
    total, back = np.full(len(ref), -np.inf), np.full(len(ref), -1)
    total[0] = 0.0
    gains = step_gains(ref, query, 0, len(ref), plus, e.steps)
    for i in range(1, len(ref)):
        before = total[max(0, i - e.steps.predecessors) : i][::-1] + gains[i, : min(i, e.steps.predecessors)]
        at = int(before.argmax())
        if before[at] > -np.inf:
            total[i], back[i] = value[i] + before[at], i - 1 - at
    out = {"stop_reason": "no_reachable_candidate", "anchors": 0, "extension_score": 0.0}
    if len(ref) < 2 or not np.isfinite(total[1:]).any():
        return out | ({} if len(ref) > 1 else {"stop_reason": "no_candidate"})
    k, path = 1 + int(np.argmax(total[1:])), []
    best = float(total[k])
    while k > 0:
        path.append(k)
        k = int(back[k])
    path.reverse()
    l, r = [gap[f"l_{c}"] for c in ("ref_start", "ref_end", "query_start", "query_end")], [gap[f"r_{c}"] for c in ("ref_start", "ref_end", "query_start", "query_end")]
    already = _meet(*l[:2], *r[:2]) or _meet(*l[2:], *r[2:])
    safe = 0
    for k in path:
        on_ref = _meet(l[0], max(l[1], ref[k] + e.half), *r[:2])
        on_query = _meet(min(l[2], query[k] - e.half), max(l[3], query[k] + e.half), *r[2:])
        if (on_ref and on_query) if already else (on_ref or on_query):
            break
        safe += 1
    clipped = safe < len(path)
    if clipped:
        path = path[:safe]
        best = path_value(ref[[0, *path]], query[[0, *path]], value[[0, *path]], e.steps) if path else 0.0
    if not path:
        return out | {"stop_reason": "overlap_clipped"}
    out |= {"anchors": len(path), "extension_score": best}
    if len(path) < e.min_anchors or best < e.min_score:
        return out | {"stop_reason": "below_threshold"}
    last = path[-1]
    out |= {"classification": "partial_extension", "stop_reason": "best_partial_path_overlap_clipped" if clipped else "best_partial_path"}
    out |= {"new_ref_end": max(l[1], int(ref[last]) + e.half), "new_query_start": min(l[2], int(query[last]) - e.half), "new_query_end": max(l[3], int(query[last]) + e.half)}
    rest = r[2] - (int(query[last]) + e.half) if plus else int(query[last]) - e.half - r[3]
    return out | {"remaining_ref_gap": max(0, r[0] - (int(ref[last]) + e.half)), "remaining_query_gap": max(0, rest)}


_ADDED = {
    "classification": "string", "stop_reason": "string", "candidates": "bigint", "anchors": "bigint", "extension_score": "double", "copy_side": "string", "copy_support": "bigint",
    "remaining_ref_gap": "bigint", "remaining_query_gap": "bigint", "new_ref_end": "bigint", "new_query_start": "bigint", "new_query_end": "bigint",
}


def extension_attempts(bundles: DataFrame, candidates: DataFrame, e: Extension = Extension()) -> DataFrame:
    """Every gap of open_gaps() with its ``classification``, why it stopped, and what is left of it.

    Classes: ``partial_extension`` (with the left bundle's new bounds), ``query_dup_branch`` and ``ref_dup_branch`` where only
    one axis is open and anchors that both directions support stand there, ``query_insertion`` and ``query_deletion``
    where none do, and ``unresolved_gap``.
    """
    gaps = open_gaps(bundles).drop("l_chain_no")
    key, none = [*TRACK, "left_no"], {c: F.lit(None).cast(k) for c, k in _ADDED.items()}
    large = F.greatest("ref_gap", "query_gap") > e.steps.max_gap
    kind = F.when(large, "large").when((F.col("ref_gap") == 0) & (F.col("query_gap") > 0), "query").when((F.col("query_gap") == 0) & (F.col("ref_gap") > 0), "ref").otherwise("search")
    gaps = gaps.withColumn("kind", kind)
    zero = F.lit(0).cast("bigint")
    base = none | {"classification": F.lit("unresolved_gap"), "candidates": zero, "anchors": zero, "extension_score": F.lit(0.0), "copy_support": zero, "remaining_ref_gap": F.col("ref_gap"), "remaining_query_gap": F.col("query_gap")}
    columns = [*gaps.columns, *_ADDED]

    def filled(rows: DataFrame, **some: Column) -> DataFrame:
        return rows.withColumns(base | some).select(columns)

    out = filled(gaps.where("kind = 'large'"), stop_reason=F.lit("gap_too_large"))
    both = candidates.where("both").select(*TRACK, "ts", "qs")
    for side, low, high, at, copy, plain in (("query", "q_low", "q_high", "qs", "query_dup_branch", "query_insertion"), ("ref", "l_ref_end", "r_ref_start", "ts", "ref_dup_branch", "query_deletion")):
        own = gaps.where(f"kind = '{side}'")
        found = _between(own.select(*key, low, high), both, low, high, at, e.cell).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        rows = own.join(found, key, "left").withColumn("n", F.coalesce("n", zero))
        copied = F.col("n") >= e.min_copies
        out = out.unionByName(filled(rows, copy_side=F.lit(side), copy_support=F.col("n"), classification=F.when(copied, copy).otherwise(plain), stop_reason=F.when(copied, "copy_support").otherwise("single_axis_reached")))
    search = gaps.where("kind = 'search'")
    inside = _between(search.select(*key, "l_ref_end", "r_ref_start", "q_low", "q_high"), candidates.select(*TRACK, "ts", "qs", F.col("score").cast("double").alias("score")), "l_ref_end", "r_ref_start", "ts", e.cell)
    inside = inside.where("qs > q_low and qs < q_high").groupBy(*key).agg(F.collect_list(F.struct("ts", "qs", "score")).alias("rows"))
    lists = search.join(inside, key, "left").select(*gaps.columns, *(F.coalesce(F.col(f"rows.{c}"), F.array().cast(f"array<{k}>")).alias(f"c_{c}") for c, k in (("ts", "bigint"), ("qs", "bigint"), ("score", "double"))))
    fields = ", ".join(f"{c} {k}" for c, k in [*((c, dict(gaps.dtypes)[c]) for c in gaps.columns), *_ADDED.items()])

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_dict("records"):
                lists = [np.asarray(row.pop(f"c_{c}"), dtype=k) for c, k in (("ts", np.int64), ("qs", np.int64), ("score", np.float64))]
                said = {"classification": "unresolved_gap", "candidates": len(lists[0]), "copy_support": 0, "remaining_ref_gap": row["ref_gap"], "remaining_query_gap": row["query_gap"]}
                made.append(row | said | attempt(row, *lists, e))
            frame = pd.DataFrame(made, columns=columns)
            frame["copy_side"] = pd.Series([None] * len(made), dtype=object)
            yield frame.astype({c: "Int64" for c, k in _ADDED.items() if k == "bigint"})

    return out.unionByName(lists.mapInPandas(run, fields)).drop("kind", "q_low", "q_high")


def extended(bundles: DataFrame, attempts: DataFrame) -> DataFrame:
    """Bundles with the bounds and score that partial extensions give them, and whether they have one."""
    new = attempts.where("classification = 'partial_extension'").select(*TRACK, F.col("left_no").alias("chain_no"), "extension_score", "new_ref_end", "new_query_start", "new_query_end")
    rows = bundles.join(new, [*TRACK, "chain_no"], "left")
    return rows.select(*TRACK, "chain_no", "ref_start", F.coalesce("new_ref_end", "ref_end").alias("ref_end"), F.coalesce("new_query_start", "query_start").alias("query_start"), F.coalesce("new_query_end", "query_end").alias("query_end"), (F.col("score") + F.coalesce("extension_score", F.lit(0.0))).alias("score"), F.col("extension_score").isNotNull().alias("extended"))
