"""The alignments of many short pairs of texts at once: what ``near_alignment`` and ``global_alignment`` give pair by pair, as array passes over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.operators.wavefront import GAP, MISMATCH

#: Cells of the tables that are held at once.
CELLS = 1 << 21
_NEVER = -(1 << 30)
Alignment = tuple[str, int, int]


def _letters(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, dtype=np.uint8)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode(), dtype=np.uint8)
    return out


def _parts(places: list[int], cells: list[int]) -> Iterator[list[int]]:
    """Places, which come in order of their number of cells, in parts that hold CELLS cells if all are as large as the last one."""
    part: list[int] = []
    for at, n in zip(places, cells):
        if part and n * (len(part) + 1) > CELLS:
            yield part
            part = []
        part.append(at)
    if part:
        yield part


def _joined(found: list[tuple[str, int]]) -> Alignment:
    out: list[list] = []
    for op, n in found:
        if n and out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    matches = sum(n for n, op in out if op == "=")
    return "".join(f"{n}{op}" for n, op in out), matches - sum(n for n, op in out if op != "="), matches


def _near(refs: list[str], queries: list[str], most: list[int]) -> list[Alignment | None]:
    n, m, limit = (np.array(x) for x in ([len(x) for x in refs], [len(x) for x in queries], most))
    size, wide, side = len(n), int(n.max()), int(limit.max()) // GAP + 1
    diagonal = np.arange(-side, side + 1)
    ref, query = _letters(refs, wide + 1, 0), np.full((size, wide + 1 + 2 * side), 255, dtype=np.uint8)
    own = _letters(queries, int(m.max()), 255)[:, : wide + 1 + side]
    query[:, side : side + own.shape[1]] = own
    # Where the letters on each diagonal differ next, from each place of the reference on.
    places = np.arange(wide + 1, dtype=np.int32)
    next_ = np.empty((size, len(diagonal), wide + 1), dtype=np.int32)
    for k in range(len(diagonal)):
        far = np.where(ref != query[:, k : k + wide + 1], places, np.int32(wide))
        next_[:, k] = np.minimum.accumulate(far[:, ::-1], axis=1)[:, ::-1]
    rows, columns = np.arange(size)[:, None], np.arange(len(diagonal))[None, :]

    def extended(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, next_[own, columns, np.maximum(at, 0)], _NEVER)

    def allowed(at: np.ndarray, own: np.ndarray) -> np.ndarray:
        on = at + diagonal
        return np.where((at >= 0) & (at <= n[own]) & (on >= 0) & (on <= m[own]), at, _NEVER)

    start = np.full((size, len(diagonal)), _NEVER)
    start[:, side] = 0
    kept, cost = [extended(rows, start)], np.full(size, -1)
    goal = side + np.clip(m - n, -side, side)
    never = np.full((size, len(diagonal)), _NEVER)
    cost[kept[0][np.arange(size), goal] == n] = 0
    active = np.flatnonzero((cost < 0) & (limit > 0))
    while len(active):
        c, one = len(kept), active[:, None]
        mismatch = (kept[c - MISMATCH] if c >= MISMATCH else never)[active] + 1
        gap = (kept[c - GAP] if c >= GAP else never)[active]
        at = allowed(mismatch, one)
        at[:, 1:] = np.maximum(at[:, 1:], allowed(np.pad(gap, ((0, 0), (1, 0)), constant_values=_NEVER)[:, :-1], one)[:, 1:])
        at[:, :-1] = np.maximum(at[:, :-1], allowed(np.pad(gap + 1, ((0, 0), (0, 1)), constant_values=_NEVER)[:, 1:], one)[:, :-1])
        front = never.copy()
        front[active] = extended(one, at)
        kept.append(front)
        cost[active[front[active, goal[active]] == n[active]]] = c
        active = active[(cost[active] < 0) & (limit[active] > c)]

    def trace(s: int) -> Alignment:
        found, c, k, i = [], int(cost[s]), int(m[s] - n[s]), int(n[s])
        while c:
            ways = []
            for back, step, add in ((MISMATCH, 0, 1), (GAP, -1, 0), (GAP, 1, 1)):
                at = int(kept[c - back][s, k + step + side]) + add if c >= back and 0 <= k + step + side < len(diagonal) else _NEVER
                ways.append(at if 0 <= at <= n[s] and 0 <= at + k <= m[s] else _NEVER)
            before = max(ways)
            way = ways.index(before)
            found += [("=", i - before), ("XID"[way], 1)]
            c, k, i = c - (MISMATCH, GAP, GAP)[way], k + (0, -1, 1)[way], before - (1, 0, 1)[way]
        return _joined([*found, ("=", i)][::-1])

    return [trace(s) if cost[s] >= 0 else None for s in range(size)]


def near_alignments(refs: list[str], queries: list[str], most: list[int]) -> list[Alignment | None]:
    """``near_alignment`` of every pair."""
    out: list[Alignment | None] = [None] * len(refs)
    cells = [(len(r) + 1) * (2 * (x // GAP + 1) + 1) for r, x in zip(refs, most)]
    order = sorted((at for at in range(len(refs)) if GAP * abs(len(refs[at]) - len(queries[at])) <= most[at]), key=lambda at: (cells[at], at))
    for part in _parts(order, [cells[at] for at in order]):
        for at, x in zip(part, _near([refs[at] for at in part], [queries[at] for at in part], [most[at] for at in part])):
            out[at] = x
    return out


def _global(refs: list[str], queries: list[str]) -> list[Alignment]:
    n, m = max(map(len, refs)), max(map(len, queries))
    ref, query = _letters(refs, n, 0), _letters(queries, m, 255)
    kind = np.int16 if n + m < 1 << 14 else np.int32
    offset = np.arange(m + 1, dtype=kind)
    row = np.broadcast_to(-offset, (len(refs), m + 1))
    ways = np.empty((len(refs), n + 1, m + 1), dtype=np.uint8)
    ways[:, 0] = 2
    for i in range(1, n + 1):
        same = query == ref[:, i - 1, None]
        through = row[:, :-1] + np.where(same, kind(1), kind(-1))
        best = row - 1
        np.maximum(best[:, 1:], through, out=best[:, 1:])
        row = np.maximum.accumulate(best + offset, axis=1) - offset
        ways[:, i, 0] = 3
        ways[:, i, 1:] = np.where(row[:, 1:] == through, ~same, np.where(row[:, 1:] == row[:, :-1] - 1, np.uint8(2), np.uint8(3)))
    out = []
    for s, (a, b) in enumerate(zip(refs, queries)):
        i, j, table, wide, ops = len(a), len(b), ways[s].tobytes(), m + 1, bytearray()
        at = i * wide + j
        while at:
            way = table[at]
            ops.append(way)
            at -= (wide + 1, wide + 1, 1, wide)[way]
        ops.reverse()
        code = np.frombuffer(bytes(ops), dtype=np.uint8)
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), dtype=bool), code[1:] != code[:-1])))
        out.append(_joined([("=XID"[code[x]], y - x) for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(code)])]))
    return out


def global_alignments(refs: list[str], queries: list[str]) -> list[Alignment]:
    """``global_alignment`` of every pair; a pair's table has a byte a cell."""
    out: list[Alignment] = [("", 0, 0)] * len(refs)
    # Of pairs in order of length, a part's table is as high and as wide as its largest.
    order = sorted(range(len(refs)), key=lambda at: (len(refs[at]), len(queries[at])))
    part: list[int] = []
    high = wide = 0

    def done() -> None:
        for at, x in zip(part, _global([refs[at] for at in part], [queries[at] for at in part])):
            out[at] = x

    for at in order:
        high_, wide_ = max(high, len(refs[at]) + 1), max(wide, len(queries[at]) + 1)
        if part and (high_ * wide_ * (len(part) + 1) > CELLS or high_ * wide_ > 2 * (len(refs[at]) + 1) * (len(queries[at]) + 1)):
            done()
            part, high_, wide_ = [], len(refs[at]) + 1, len(queries[at]) + 1
        part.append(at)
        high, wide = high_, wide_
    if part:
        done()
    return out
