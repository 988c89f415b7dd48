"""Whether the alignment of a gap is good enough to patch it: identities, worst window, and rescue by long gaps."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Quality:
    """Thresholds of a patch; a gap of ``long_indel`` bases splits it into segments and is no error of theirs."""

    window: int = 500
    long_indel: int = 100
    flank: int = 200
    flank_identity: float = 0.95
    extra_indel: int = 100
    endpoint_identity: float = 0.85
    error_density: float = 0.15
    segment_identity: float = 0.99
    multi_short_indel: int = 100
    multi_error_density: float = 0.15
    allow_deletions: bool = True


_RUN = re.compile(r"([0-9]+)([=XID])")


def worst_window(lengths: np.ndarray, errors: np.ndarray, window: int) -> float:
    """The greatest share of errors in any ``window`` bases of runs that are errors or not (in all, if there are fewer).

    The number of errors up to a place is linear between ends of runs, so a window with most begins or ends at
    one; errors up to any place come from prefix sums.
    """
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if not ends[-1]:
        return 0.0
    upto = np.concatenate([[0], np.cumsum(lengths * errors)])
    window = min(window, int(ends[-1]))
    starts = np.clip(np.concatenate([ends, ends - window]), 0, ends[-1] - window)
    return float((np.interp(starts + window, ends, upto) - np.interp(starts, ends, upto)).max() / window)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def patch_quality_of(cigar: str, p: Quality) -> dict:
    """What patch_quality() says of one CIGAR."""
    ops = [(int(n), op) for n, op in _RUN.findall(cigar)]
    long_at = [k for k, (n, op) in enumerate(ops) if op in "ID" and n >= p.long_indel]
    segments, own = [], []
    for k, x in enumerate(ops):
        if k in set(long_at):
            segments.append(own)
            own = []
        else:
            own.append(x)
    segments.append(own)
    matches, block = sum(n for n, op in ops if op == "="), sum(n for n, _ in ops)
    density = max(worst_window(np.array([n for n, _ in s], dtype=np.int64), np.array([op != "=" for _, op in s], dtype=np.int64), p.window) for s in segments)

    def endpoint(rows: list[tuple[int, str]]) -> float:
        seen = wrong = 0
        for n, op in rows:
            take = min(n, p.window - seen)
            seen, wrong = seen + take, wrong + take * (op != "=")
        return 1.0 - wrong / seen if seen else 0.0

    short = [x for s in segments for x in s]
    left, right = endpoint(short), endpoint(short[::-1])
    ends_fine = left >= p.endpoint_identity and right >= p.endpoint_identity
    out = {"identity": matches / block if block else 1.0, "left_identity": left, "right_identity": right, "error_density": density, "long_indels": len(long_at), "low_quality": not ends_fine or density > p.error_density}
    aligned = [sum(n for n, op in s if op in "=X") for s in segments]
    equal = [sum(n for n, op in s if op == "=") for s in segments]
    extra = sum(n for n, op in short if op in "ID")
    out |= {"extra_indel": extra if long_at else 0, "rescue": "none"}
    kinds = {ops[k][1] for k in long_at}
    if len(long_at) == 1:
        flanks = all(a >= p.flank and _share(e, a) >= p.flank_identity for a, e in zip(aligned, equal))
        out["rescue"] = "long_indel" if flanks and extra <= p.extra_indel else "none"
    elif len(long_at) > 1:
        clean = all(a >= p.flank and _share(e, a) >= p.segment_identity for a, e in zip(aligned, equal))
        one_kind = kinds == {"I"} or (p.allow_deletions and kinds == {"D"})
        if one_kind and clean and extra <= p.multi_short_indel and density <= p.multi_error_density and ends_fine:
            out["rescue"] = "multi_event"
    return out


_FIELDS = "identity double, left_identity double, right_identity double, error_density double, long_indels bigint, low_quality boolean, extra_indel bigint, rescue string"


def patch_quality(rows: DataFrame, p: Quality = Quality()) -> DataFrame:
    """(cigar, identity, left_identity, right_identity, error_density, long_indels, low_quality, extra_indel, rescue) of distinct CIGARs of =, X, I and D.

    ``identity`` is over all columns, those of the ends over the first and last ``window`` columns without long gaps, and
    ``error_density`` that of the worst window between long gaps.  A patch of low quality is rescued by one long gap
    with good flanks (``long_indel``), or by several of one kind with very good segments (``multi_event``).
    """
    names = ["cigar", *(f.split()[0] for f in _FIELDS.split(", "))]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([{"cigar": c} | patch_quality_of(c, p) for c in batch["cigar"]], columns=names)

    return rows.where("cigar is not null").select("cigar").distinct().mapInPandas(run, f"cigar string, {_FIELDS}")
