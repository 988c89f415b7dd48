"""Chains against each other on one track: trimming of overlaps, the skeleton, and what stands off it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chains as chaining
from tessera.operators.chains import TRACK


@dataclass(frozen=True)
class Params:
    """Overlaps, as shares of the shorter interval, that cut a chain on both axes or drop it on one."""

    trim_overlap: float = 0.01
    multimap_overlap: float = 0.5


#: Fixed values of the context test: a diagonal excursion's least bases and share of its span and greatest return
#: ratio, the scale and weight of a skeleton step's gap penalty, the share of its span by which a chain must leave its bracket to
#: be rejected, and the slack of a bracket's boundary (bases, and one part of the span).
EXCURSION_BASES, EXCURSION_SHARE, RETURN_RATIO = 2000, 0.5, 0.25
GAP_SCALE, GAP_WEIGHT = 1000.0, 1600.0
REJECT_SHARE, SLACK_BASES, SLACK_PART = 0.5, 500, 10


class Overlaps:
    """Intervals in classes of length by powers of two, each class sorted by start.

    An interval of a class that overlaps [a, b) starts less than the class's length before a, so a lookup is
    one slice a class; at most half of a slice misses in the mean.
    """

    def __init__(self):
        self.classes: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}

    def add(self, start: int, end: int, name: int) -> None:
        starts, rows = self.classes.setdefault((end - start).bit_length(), ([], []))
        at = bisect_right(starts, start)
        starts.insert(at, start)
        rows.insert(at, (end, name))

    def find(self, start: int, end: int) -> list[int]:
        found = []
        for size, (starts, rows) in self.classes.items():
            for stop, name in rows[bisect_right(starts, start - (1 << size)) : bisect_left(starts, end)]:
                if stop > start:
                    found.append(name)
        return found


@dataclass
class Part:
    """A chain or what is left of it: its anchors in order, bounds and scores."""

    source: int
    number: int
    ts: np.ndarray
    qs: np.ndarray
    score: np.ndarray
    two: np.ndarray
    raw: float
    total: float

    def __post_init__(self):
        self.both = int(self.two.sum())
        self.bounds = int(self.ts[0]), int(self.ts[-1]), int(self.qs.min()), int(self.qs.max())

    def priority(self) -> tuple:
        n = len(self.ts)
        return (-self.total, -self.both / n, -self.both, -n, *self.bounds, self.source)

    def cut(self, rows: np.ndarray, number: int, p: chaining.Params) -> Part:
        """The part of some of its rows, scored anew."""
        ts, qs, score, two = self.ts[rows], self.qs[rows], self.score[rows], self.two[rows]
        raw = chaining.path_value(ts, qs, score, p)
        return Part(self.source, number, ts, qs, score, two, raw, raw * ((1 - p.both_weight) + p.both_weight * float(two.mean())))


def shares(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[float, float]:
    """Overlap of two boxes on either axis over the shorter side's length (1 at least)."""
    out = []
    for k in (0, 2):
        shared = max(0, min(a[k + 1], b[k + 1]) - max(a[k], b[k]))
        out.append(shared / min(max(a[k + 1] - a[k], 1), max(b[k + 1] - b[k], 1)))
    return out[0], out[1]


def trim_track(parts: list[Part], filters: chaining.Params, p: Params) -> list[Part]:
    """What is left of a track's chains, best first: each is cut by all that were accepted before it.

    A chain that a better one covers on one axis but hardly meets on the other goes.  Where they meet on both axes,
    its anchors inside the better one's box that only one direction supports go, and what lies
    between them is a part of its own.  Only accepted chains that share a stretch of an axis are looked at, in the order
    in which they were accepted.
    """
    if p.trim_overlap <= 0:
        return parts
    accepted: list[Part] = []
    on_ref, on_query = Overlaps(), Overlaps()
    for chain in sorted(parts, key=Part.priority):
        r0, r1, q0, q1 = chain.bounds
        pieces = [chain]
        for k in sorted({*on_ref.find(r0, r1), *on_query.find(q0, q1)}):
            high, rest = accepted[k].bounds, []
            for piece in pieces:
                ref, query = shares(piece.bounds, high)
                if p.multimap_overlap > 0 and ((ref >= p.multimap_overlap and query < p.trim_overlap) or (query >= p.multimap_overlap and ref < p.trim_overlap)):
                    continue
                if ref >= p.trim_overlap and query >= p.trim_overlap:
                    stays = piece.two | (piece.ts < high[0]) | (piece.ts > high[1]) | (piece.qs < high[2]) | (piece.qs > high[3])
                    kept = np.flatnonzero(stays)
                    rest += [piece.cut(rows, 0, filters) for rows in np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(rows)]
                else:
                    rest.append(piece)
            pieces = rest
            if not pieces:
                break
        good = [x for x in pieces if len(x.ts) >= filters.min_anchors and x.both >= filters.min_both and x.total >= filters.min_score]
        for number, piece in enumerate(good):
            piece.number = number
            on_ref.add(*piece.bounds[:2], len(accepted))
            on_query.add(*piece.bounds[2:], len(accepted))
            accepted.append(piece)
    return accepted


class Skeleton:
    """Chains in the order in which a skeleton takes them, and their ranks on the query; made once, asked again while chains leave.

    Chains are taken by start on the reference; those that ended by then stand in a tree of maxima over ends on the
    query, so each finds its best predecessor in logarithmic time.  What stands before the first chain that left is not
    searched for again.
    """

    def __init__(self, r0: np.ndarray, r1: np.ndarray, q0: np.ndarray, q1: np.ndarray, weight: np.ndarray):
        self.order = np.lexsort((r1, q0, r0))
        ends = np.unique(q1)
        self.size = len(ends)
        self.start, self.weight = r0[self.order].tolist(), np.asarray(weight, dtype=np.float64)[self.order].tolist()
        self.stands, self.asks = (np.searchsorted(ends, x[self.order], "right").tolist() for x in (q1, q0))
        self.place = np.empty(len(r0), dtype=np.int64)
        self.place[self.order] = np.arange(len(r0))
        by_end = np.lexsort((np.arange(len(r0)), r1[self.order]))
        self.ended = list(zip(r1[self.order][by_end].tolist(), by_end.tolist()))
        self.alive = [True] * len(r0)
        self.total, self.back = [0.0] * len(r0), [-1] * len(r0)
        self.since = 0

    def leave(self, k: int) -> None:
        """Take a chain out."""
        at = int(self.place[k])
        self.alive[at] = False
        self.since = min(self.since, at)

    def heaviest(self) -> list[int]:
        """Indices of the heaviest sequence of chains in which none ends behind the next one's start on either axis; the first found of equal ones."""
        n, size, start, alive, total, back, asks, stands = len(self.start), self.size, self.start, self.alive, self.total, self.back, self.asks, self.stands
        best: list[tuple[float, int]] = [(0.0, 1)] * (size + 1)  # prefix maxima: (total, minus the place)
        ended, next_ = self.ended, 0
        for i in range(self.since, n):
            if not alive[i]:
                continue
            while next_ < n and ended[next_][0] <= start[i] and ended[next_][1] < i:
                j = ended[next_][1]
                next_ += 1
                if alive[j]:
                    at, value = stands[j], (total[j], -j)
                    while at <= size and best[at] < value:  # else those that hold it are as large
                        best[at] = value
                        at += at & -at
            at, found = asks[i], (0.0, 1)
            while at:
                if found < best[at]:
                    found = best[at]
                at &= at - 1
            total[i], back[i] = self.weight[i], -1
            if found[1] <= 0:
                total[i] += found[0]
                back[i] = -found[1]
        self.since = n
        k = max((i for i in range(n) if alive[i]), key=lambda i: (total[i], -i), default=-1)
        out = []
        while k >= 0:
            out.append(int(self.order[k]))
            k = back[k]
        return out[::-1]


def skeleton(r0: np.ndarray, r1: np.ndarray, q0: np.ndarray, q1: np.ndarray, weight: np.ndarray) -> list[int]:
    """``heaviest`` of all chains."""
    return Skeleton(r0, r1, q0, q1, weight).heaviest()


#: What the context test says about a chain beside its class.
CONTEXT = {
    "left_no": "bigint", "right_no": "bigint", "bracket_axis": "string", "violation": "bigint", "normalized_violation": "double", "left_gap": "bigint", "right_gap": "bigint", "boundary_supported": "boolean",
    "left_jump": "bigint", "right_jump": "bigint", "net_shift": "bigint", "excursion": "bigint", "normalized_excursion": "double", "return_ratio": "double", "local_gain": "double",
}
_NOTHING = {c: {"bigint": 0, "double": 0.0, "boolean": False, "string": None}[k] for c, k in CONTEXT.items()} | {"left_no": None, "right_no": None}


class Track:
    """Chains of a track as boxes, the query axis turned round on the minus strand."""

    def __init__(self, r0, r1, q0, q1, score, plus: bool):
        self.r0, self.r1 = np.asarray(r0), np.asarray(r1)
        q0, q1 = np.asarray(q0), np.asarray(q1)
        self.q0, self.q1 = (q0, q1) if plus else (-q1, -q0)
        self.span = np.minimum(np.maximum(self.r1 - self.r0, 1), np.maximum(self.q1 - self.q0, 1))
        self.weight = np.maximum(np.asarray(score, dtype=np.float64), 0) + self.span
        self.diagonal = [int(a) + int(b - a) // 2 - int(c) - int(d - c) // 2 for a, b, c, d in zip(self.q0, self.q1, self.r0, self.r1)]

    def penalty(self, left: int, right: int) -> float:
        """The cost of a skeleton step: how much its gaps on both axes differ."""
        differ = abs((self.r0[right] - self.r1[left]) - (self.q0[right] - self.q1[left]))
        return GAP_WEIGHT * float(np.log1p(differ / GAP_SCALE))

    def excursion(self, path: list[int]) -> tuple[int, dict] | None:
        """The chain of a skeleton that leaves the diagonal and comes back, whose place in it costs most (the first of equal ones)."""
        worst = None
        for left, k, right in zip(path, path[1:], path[2:]):
            out, home = self.diagonal[k] - self.diagonal[left], self.diagonal[right] - self.diagonal[k]
            net, less = abs(self.diagonal[right] - self.diagonal[left]), min(abs(out), abs(home))
            if out * home >= 0 or less - net < EXCURSION_BASES or net / less > RETURN_RATIO or (less - net) / self.span[k] < EXCURSION_SHARE:
                continue
            gain = float(self.weight[k]) - self.penalty(left, k) - self.penalty(k, right) + self.penalty(left, right)
            if gain < 0 and (worst is None or gain < worst[1]["local_gain"]):
                found = {"left_jump": abs(out), "right_jump": abs(home), "net_shift": net, "excursion": less - net, "normalized_excursion": (less - net) / float(self.span[k]), "return_ratio": net / less, "local_gain": gain}
                worst = k, {"left_no": left, "right_no": right, "bracket_axis": "diagonal"} | found
        return worst

    def axis(self, path: np.ndarray, on_query: bool) -> tuple:
        """One axis, the other one, and the starts and ends on the first of a skeleton's chains."""
        a0, a1, b0, b1 = (self.q0, self.q1, self.r0, self.r1) if on_query else (self.r0, self.r1, self.q0, self.q1)
        return a0, a1, b0, b1, a0[path], a1[path], path, on_query

    def bracket(self, k: int, axis: tuple) -> dict | None:
        """How far a chain lies outside of what its neighbours on one axis leave between them on the other.

        A skeleton is in order on both axes, so neighbours are found by bisection.
        """
        a0, a1, b0, b1, starts, ends, path, on_query = axis
        left, right = np.searchsorted(ends, a0[k], "right") - 1, np.searchsorted(starts, a1[k], "left")
        if left < 0 or right >= len(path):
            return None
        left = np.searchsorted(ends, ends[left], "left")  # the first of those that end alike
        low, high = path[left], path[right]
        violation = int(max(0, b1[low] - b0[k], b1[k] - b0[high]))
        if b1[low] > b0[high] or not violation:
            return None
        span = int(max(1, self.r1[k] - self.r0[k], self.q1[k] - self.q0[k]))
        gaps, slack = (int(a0[k] - a1[low]), int(a0[high] - a1[k])), max(SLACK_BASES, span // SLACK_PART)
        return {"left_no": int(low), "right_no": int(high), "bracket_axis": "query" if on_query else "ref", "violation": violation, "normalized_violation": violation / span, "left_gap": gaps[0], "right_gap": gaps[1], "boundary_supported": max(gaps) <= slack}

    def classes(self) -> list[tuple[str, dict]]:
        """Each chain's class and what decided it; the chain of the worst excursion leaves the skeleton until there is none."""
        out, bones = {}, Skeleton(self.r0, self.r1, self.q0, self.q1, self.weight)
        while (found := self.excursion(path := bones.heaviest())) is not None:
            bones.leave(found[0])
            out[found[0]] = "off_skeleton_excursion", found[1]
        on = set(path)
        on_query, on_ref = (self.axis(np.array(path, dtype=np.int64), x) for x in (True, False))
        for k in range(len(self.r0)):
            if k in out:
                continue
            if k in on:
                out[k] = "syntenic_skeleton", {}
                continue
            found, other = self.bracket(k, on_query), self.bracket(k, on_ref)
            if found is None or (other is not None and other["normalized_violation"] > found["normalized_violation"]):
                found = other
            supported = found is not None and found["boundary_supported"]
            rejected = found is not None and found["normalized_violation"] >= REJECT_SHARE
            out[k] = ("off_skeleton_structural_candidate" if supported else "orphan_gap_cross_copy_rejected" if rejected else "off_skeleton_retained"), found or {}
        return [out[k] for k in range(len(self.r0))]


#: Classes whose chains go.
REJECTED = ["off_skeleton_excursion", "orphan_gap_cross_copy_rejected"]
_LISTS = ("ts", "qs", "score", "both")
_TRIMMED = (
    "q string, t string, strand string, chain_no long, source_no long, part long, anchors long, both long, both_rate double, raw_score double, chain_score double, "
    "ref_start long, ref_end long, query_start long, query_end long, ts_list array<bigint>, qs_list array<bigint>, score_list array<double>, both_list array<boolean>"
)


def trim_chains(found: DataFrame, filters: chaining.Params = chaining.Params(), p: Params = Params()) -> DataFrame:
    """Parts of chains (see trim_track) with their rows, numbered by place on their track; ``source_no`` is the chain they were.

    ``found`` has TRACK, chain_no, raw_score, chain_score and rows, as chains_with_rows() and refined_chains() return
    them.  A track's chains, not its anchors' other pairs, are one group: their order decides what is left.
    """
    columns = [f.split()[0] for f in _TRIMMED.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kinds = (np.int64, np.int64, np.float64, bool)
        parts = [Part(no, 0, *(np.asarray(x, dtype=kind) for x, kind in zip(lists, kinds)), raw, total) for no, raw, total, *lists in group[["chain_no", "raw_score", "chain_score", *(f"{c}_list" for c in _LISTS)]].itertuples(index=False)]
        kept = sorted(trim_track(parts, filters, p), key=lambda x: (x.bounds[0], x.bounds[2], x.bounds[1], x.bounds[3], x.source, x.number))
        head = tuple(group[c].iloc[0] for c in TRACK)
        rows = [(*head, k, x.source, x.number, len(x.ts), x.both, x.both / len(x.ts), x.raw, x.total, *x.bounds, x.ts, x.qs, x.score, x.two) for k, x in enumerate(kept)]
        return pd.DataFrame(rows, columns=columns)

    lists = found.select(*TRACK, "chain_no", "raw_score", "chain_score", *(F.col(f"rows.{c}").alias(f"{c}_list") for c in _LISTS))
    trimmed = lists.groupBy(*TRACK).applyInPandas(run, _TRIMMED)
    zipped = F.arrays_zip(*(F.col(f"{c}_list").alias(c) for c in _LISTS))
    return trimmed.withColumn("rows", zipped).drop(*(f"{c}_list" for c in _LISTS))


def chain_context(found: DataFrame) -> DataFrame:
    """Chains (TRACK, chain_no, chain_score, bounds and any other columns) with their ``classification`` on their track and what decided it."""
    columns = [c for c in found.columns if c not in CONTEXT]
    bounds = ["chain_no", "chain_score", "ref_start", "ref_end", "query_start", "query_end"]
    fields = "q string, t string, strand string, chain_no long, classification string, " + ", ".join(f"{c} {k}" for c, k in CONTEXT.items())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(bounds[2:] + ["chain_no"], ignore_index=True)
        track = Track(*(group[c].to_numpy() for c in bounds[2:]), group["chain_score"].to_numpy(), group["strand"].iloc[0] == "+")
        number, out = group["chain_no"].tolist(), []
        for no, (kind, why) in zip(number, track.classes()):
            named = {c: number[why[c]] for c in ("left_no", "right_no") if c in why}
            out.append(dict(zip(TRACK, group[TRACK].iloc[0])) | {"chain_no": no, "classification": kind} | _NOTHING | why | named)
        made = pd.DataFrame(out)
        return made.astype({"left_no": "Int64", "right_no": "Int64"})

    said = found.select(*TRACK, *bounds).groupBy(*TRACK).applyInPandas(run, fields)
    return found.select(*columns).join(said, [*TRACK, "chain_no"])
