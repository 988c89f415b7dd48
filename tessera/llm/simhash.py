"""SimHash near-duplicates with pigeonring candidate filtering.

Equal fingerprints become one class first, so copies cost one row each.  A fingerprint of 64 bits is
a ring of five segments.  If two differ in at most t bits, some segment starts a chain in which the
first l segments differ in at most l*t/5 bits together, for every l up to 5.  With t <= 4 such a
chain begins with an equal segment and continues with one that differs in at most one bit; that pair
of segments with one bit masked is the key that fingerprints are dealt by.  Within a key the longer
chain is tested before the whole Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_count, utf8_list
from tessera.operators.components import connected_components
from tessera.operators.lineage import checkpointed

#: Bits of the ring's five segments, from the lowest bit on.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
#: A run of equal keys up to this length is compared pair by pair; a longer one is merged first.
SMALL_RUN = 64
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def simhash64(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; shingles of
    ``shingle`` space-joined words count as often as they occur; a bit is 1 if it is set in over half
    of their XXH64 hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest, stops = xxhash.xxh64_intdigest, ends[shingle - 1 :].tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(begins)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash64(x, shingle) for x in utf8_list(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, fp long")


def segment(words: np.ndarray, k: int) -> np.ndarray:
    """The k-th segment of the ring, for any k."""
    k %= len(WIDTHS)
    return (words >> np.uint64(SHIFTS[k])) & np.uint64((1 << WIDTHS[k]) - 1)


def chain_keys(fp: str) -> Column:
    """65 keys: for each segment, itself and the next segment with one of its bits masked."""
    keys = []
    for i in range(len(WIDTHS)):
        nxt = (i + 1) % len(WIDTHS)
        this = f"(shiftrightunsigned({fp}, {SHIFTS[i]}) & {(1 << WIDTHS[i]) - 1})"
        follow = f"(shiftrightunsigned({fp}, {SHIFTS[nxt]}) & {(1 << WIDTHS[nxt]) - 1})"
        keys.append(f"transform(sequence(0, 12), j -> shiftleft({this}, 13) + shiftleft(cast({i} * 13 + j as bigint), 26) + ({follow} & ~shiftleft(1L, j)))")
    return F.expr(f"concat({', '.join(keys)})")


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, threshold: int) -> np.ndarray:
    """Which pairs pass the ring's chain from segment ``start`` and then the whole Hamming test (the arrays are broadcast)."""
    diff = a ^ b
    ok, total = np.ones(diff.shape, dtype=bool), np.zeros(diff.shape, dtype=np.uint8)
    shifts, masks = np.array(SHIFTS, dtype=np.uint64), np.array([(1 << w) - 1 for w in WIDTHS], dtype=np.uint64)
    for l in range(1, len(WIDTHS)):
        at = (start + l - 1) % len(WIDTHS)
        total = total + np.bitwise_count((diff >> shifts[at]) & masks[at])
        ok &= total.astype(np.int64) * len(WIDTHS) <= l * threshold
    near = np.zeros(diff.shape, dtype=bool)
    near[ok] = np.bitwise_count(diff[ok]) <= threshold
    return near


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def run_edges(words: np.ndarray, start: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect a long run of different fingerprints of one key as its chains would.

    Neighbours at one bit, which pass every chain from an equal segment, are found by sorting with each
    bit masked.  Only fingerprints outside the largest class that this makes are then tested with all
    others, by the same chain, in blocks; so a dense group of near copies costs sorts, not all its pairs.
    """
    n, from_, to = len(words), [], []
    if threshold >= 2:
        for bit in range(64):
            masked = words & ~np.uint64(1 << bit)
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            from_.append(order[same])
            to.append(order[same + 1])
    label = components(n, np.concatenate(from_), np.concatenate(to)) if from_ else np.arange(n)
    a, b = [np.flatnonzero(label != np.arange(n))], [label[label != np.arange(n)]]
    names, sizes = np.unique(label, return_counts=True)
    outside = np.flatnonzero(label != names[np.argmax(sizes)])
    block = max(1, (1 << 20) // n)
    for at in range(0, len(outside), block):
        own = outside[at : at + block]
        i, j = np.nonzero(linked(words[own][:, None], words[None, :], start, threshold))
        u, v = label[own[i]], label[j]
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)])[:, u != v], axis=1)
        a.append(pair[0])
        b.append(pair[1])
    return np.concatenate(a), np.concatenate(b)


def _links(threshold: int, start_of=lambda key: (key >> 26) // 13):
    """Edges between fingerprints that share a key, of rows sorted by key; ``start_of`` a key is its segment."""

    def of(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(bounds)
        a, b = [], []
        for run in np.flatnonzero(size > SMALL_RUN).tolist():
            own = words[bounds[run] : bounds[run + 1]]
            i, j = run_edges(own, int(start_of(key[bounds[run]])), threshold)
            a.append(own[i])
            b.append(own[j])
        small = np.repeat(size <= SMALL_RUN, size)
        left = np.repeat(bounds[1:], size) - np.arange(len(key)) - 1  # rows of the run that follow
        start = start_of(key).astype(np.int64)
        for step in range(1, SMALL_RUN):
            i = np.flatnonzero(small & (left >= step))
            if not len(i):
                break
            keep = i[linked(words[i], words[i + step], start[i], threshold)]
            a.append(words[keep])
            b.append(words[keep + step])
        return (np.concatenate(a), np.concatenate(b)) if a else (words[:0], words[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key's rows, which may go on in the next batch
        found = [np.zeros((2, 0), dtype=np.int64)]  # the task's links so far

        def add(rows: np.ndarray) -> None:
            u, v = of(rows[0], rows[1].view(np.uint64))
            found.append(np.stack([u.view(np.int64), v.view(np.int64)]))
            if sum(x.shape[1] for x in found) > 1 << 20:
                found[:] = [forest(np.concatenate(found, axis=1))]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
            if held and held[-1][0, -1] == rows[0, -1]:
                held.append(rows)  # one key throughout
                if rows[0, 0] == rows[0, -1]:
                    continue
                rows = np.concatenate(held, axis=1)
            elif held:
                rows = np.concatenate([*held, rows], axis=1)
            at = int(np.searchsorted(rows[0], rows[0, -1]))
            held = [rows[:, at:]]
            if at:
                add(rows[:, :at])
        if held:
            add(np.concatenate(held, axis=1))
        edges = forest(np.concatenate(found, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key of rows (place, fp) sorted by place: the 13 keys of each segment are made in its task."""
    held: list[np.ndarray] = []  # the last place's rows, which may go on in the next batch

    def keys(rows: np.ndarray) -> pa.RecordBatch:
        words = rows[1].view(np.uint64)
        follow = np.select([rows[0] >> 13 == i for i in range(len(WIDTHS))], [segment(words, i + 1) for i in range(len(WIDTHS))]).astype(np.int64)
        j = np.arange(13)[:, None]
        key = ((rows[0] << 17) + (j << 13) + (follow & ~(1 << j))).ravel()
        order = np.argsort(key, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(np.tile(rows[1], 13)[order])], ["key", "fp"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        at = int(np.searchsorted(rows[0], rows[0, -1]))
        if held and (at or held[-1][0, -1] != rows[0, 0]):
            yield keys(np.concatenate([*held, rows[:, :at]], axis=1))
            held = []
        elif at:
            yield keys(rows[:, :at])
        held.append(rows[:, at:])
    if held:
        yield keys(np.concatenate(held, axis=1))


def ring_links(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (u, v) that connect the different fingerprints of (fp) as the ring does; five rows a fingerprint are shuffled, and a task's links are a forest."""
    places = F.array(*(F.expr(f"{i * 8192}L + (shiftrightunsigned(fp, {SHIFTS[i]}) & {(1 << WIDTHS[i]) - 1})") for i in range(len(WIDTHS))))
    dealt = prints.distinct().select(F.explode(places).alias("place"), "fp").repartition("place").sortWithinPartitions("place")
    links = _links(threshold, lambda key: key >> 30)
    return dealt.mapInArrow(lambda batches: links(_chained(batches)), "u long, v long").distinct()


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges (2, n) that connect the same nodes: each node of a component with its smallest one."""
    names, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(edges.shape)
    label = components(len(names), a, b)
    own = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[own], names[label[own]]])


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``threshold`` differing bits.

    A null or empty text has fingerprint 0 and links like any other.  Repeated rows come back as often
    as they stand; a null id takes its class's smallest id (null if the class has none).  Other columns
    are ignored; an empty table gives no rows.  ``threshold`` is at most 4 (the keys prove no more).
    """
    if not 0 <= threshold <= 4:
        raise ValueError("threshold must be from 0 to 4")
    prints = checkpointed(fingerprints(docs, id_column, text_column, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    keys = classes.select(F.explode(chain_keys("fp")).alias("key"), "fp")
    # The 13 keys of one segment lie in one task, which returns its links as a forest: a row or less a fingerprint and segment.
    segment_of = F.expr("shiftright(key, 26) div 13 * 8192 + (shiftright(key, 13) & 8191)")
    edges = keys.repartition(segment_of).sortWithinPartitions("key").mapInArrow(_links(threshold), "u long, v long").distinct()
    parts = connected_components(edges)
    named = classes.join(parts, classes.fp == parts.node).select("fp", "first_id", "component")
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("fp", "component_id")
    labels = checkpointed(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n"))
    return join_by_count(prints, labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """The documents without all but one of each near-duplicate group: the one with the smallest id stays.

    Rows that repeat that id are one document and come back once; rows without an id all stay, since
    nothing tells them apart from others.  All columns of ``docs`` are kept.
    """
    groups = near_duplicates(docs, id_column=id_column, text_column=text_column, shingle=shingle, threshold=threshold)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_column] == kept["__kept_id"], "left_semi").dropDuplicates([id_column]).unionByName(docs.where(F.col(id_column).isNull()))
