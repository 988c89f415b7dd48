"""Pairwise alignment kernels and token edit distance, as vectorised tasks over rows of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.batched import global_alignments
from tessera.operators.wavefront import wave_alignment


def global_alignment(ref: str, query: str) -> tuple[str, int, int]:
    """(CIGAR of =, X, I, D; score; matches) of a unit-cost global alignment: match +1, mismatch and gap -1.

    Rows are filled as whole vectors: along a row, a run of insertions is a running maximum.  Of equal
    scores the diagonal is taken first, then the insertion, then the deletion.
    """
    r, q = np.frombuffer(ref.encode(), dtype=np.uint8), np.frombuffer(query.encode(), dtype=np.uint8)
    n, m = len(r), len(q)
    offset = np.arange(m + 1)
    row = -offset
    rows = np.empty((n + 1, m + 1), dtype=np.int32)
    rows[0] = row
    for i in range(1, n + 1):
        best = row - 1
        best[1:] = np.maximum(best[1:], row[:-1] + np.where(q == r[i - 1], 1, -1))
        row = np.maximum.accumulate(best + offset) - offset
        rows[i] = row
    ops, i, j, matches = [], n, m, 0
    while i or j:
        if i and j and rows[i, j] == rows[i - 1, j - 1] + (1 if r[i - 1] == q[j - 1] else -1):
            same = r[i - 1] == q[j - 1]
            ops.append("=" if same else "X")
            matches += int(same)
            i, j = i - 1, j - 1
        elif j and rows[i, j] == rows[i, j - 1] - 1:
            ops.append("I")
            j -= 1
        else:
            ops.append("D")
            i -= 1
    out, k = [], len(ops)
    while k:
        e = k
        while k and ops[k - 1] == ops[e - 1]:
            k -= 1
        out.append(f"{e - k}{ops[e - 1]}")
    return "".join(out), int(rows[n, m]), matches


def align_pairs(pairs: DataFrame, most_cells: int = 1_000_000) -> DataFrame:
    """(pair_id, cigar, score, matches) of rows (pair_id, ref, query).

    Pairs of up to ``most_cells`` cells fill the whole table; longer ones are aligned by wavefronts, with the same score
    in memory that doesn't grow with the product of their lengths (of equal alignments another may be returned).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            few = (batch["ref"].str.len() + 1) * (batch["query"].str.len() + 1) <= most_cells
            done = pd.Series(index=batch.index, dtype=object)
            done[few] = pd.Series(global_alignments(batch["ref"][few].tolist(), batch["query"][few].tolist()), index=batch.index[few], dtype=object)
            done[~few] = pd.Series([wave_alignment(a, b) for a, b in zip(batch["ref"][~few], batch["query"][~few])], index=batch.index[~few], dtype=object)
            out = pd.DataFrame(done.tolist(), columns=["cigar", "score", "matches"])
            yield out.assign(pair_id=batch["pair_id"].to_numpy())[["pair_id", "cigar", "score", "matches"]]

    return pairs.select("pair_id", "ref", "query").mapInPandas(run, "pair_id long, cigar string, score long, matches long")


def bounded_distance(left: list, right: list, limit: int) -> int:
    """Edit distance of two token lists, or limit + 1 if it is larger; only the band of width 2 * limit + 1 is filled."""
    if abs(len(left) - len(right)) > limit:
        return limit + 1
    row = {j: j for j in range(min(limit, len(right)) + 1)}
    for i, a in enumerate(left, 1):
        new = {}
        for j in range(max(0, i - limit), min(len(right), i + limit) + 1):
            best = min(row.get(j, limit + 1), new.get(j - 1, limit + 1)) + 1
            if j:
                best = min(best, row.get(j - 1, limit + 1) + (a != right[j - 1]))
            new[j] = min(best, limit + 1)
        if min(new.values()) > limit:
            return limit + 1
        row = new
    return min(row.get(len(right), limit + 1), limit + 1)


def token_distances(pairs: DataFrame, limit: int = 12) -> DataFrame:
    """(pair_id, distance, reversed_distance) of rows (pair_id, left array, right array): bounded distances to the right list as it is and reversed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, bounded_distance(list(a), list(b), limit), bounded_distance(list(a), list(b)[::-1], limit)) for i, a, b in zip(batch["pair_id"], batch["left"], batch["right"])]
            yield pd.DataFrame(rows, columns=["pair_id", "distance", "reversed_distance"])

    return pairs.select("pair_id", "left", "right").mapInPandas(run, "pair_id long, distance long, reversed_distance long")


def edit_steps(left: list, right: list) -> list[tuple[str, int]]:
    """(operation, index of the left token) along a least-cost alignment of two token lists: match, substitution, deletion, insertion.

    Rows of the table are filled as whole vectors.  Read from the end, of equal costs the diagonal comes
    first, then the deletion, then the insertion; an insertion carries the index of the left token that
    follows it.
    """
    codes: dict = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in tokens], dtype=np.int64) for tokens in (left, right))
    n, m = len(a), len(b)
    offset = np.arange(m + 1)
    table = np.empty((n + 1, m + 1), dtype=np.int64)
    table[0] = offset
    for i in range(1, n + 1):
        best = table[i - 1] + 1
        best[1:] = np.minimum(best[1:], table[i - 1, :-1] + (b != a[i - 1]))
        table[i] = np.minimum.accumulate(best - offset) + offset
    out, i, j = [], n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitution", i))
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            out.append(("deletion", i))
        else:
            j -= 1
            out.append(("insertion", i))
    return out[::-1]


def operation_histogram(pairs: DataFrame) -> DataFrame:
    """(left_index, operation, n) over the alignments of rows (left array, right array); each batch is counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for a, b in zip(batch["left"], batch["right"]):
                for step in edit_steps(list(a), list(b)):
                    counts[step] = counts.get(step, 0) + 1
            yield pd.DataFrame([(i, op, n) for (op, i), n in counts.items()], columns=["left_index", "operation", "n"])

    return pairs.select("left", "right").mapInPandas(run, "left_index long, operation string, n long").groupBy("left_index", "operation").agg(F.sum("n").alias("n"))
