"""Low-copy windows of sequences: k-mer counts, window scores, plateaus and non-maximum suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed

K, LENGTH = 6, 50


#: Base codes by byte; 4 for anything else.
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
#: k-mers up to this long are counted in tables of 4**k entries.
MOST_K = 10


def kmer_codes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(base-4 number of the k-mer at each place, whether it has another letter than A, C, G and T)."""
    codes = _CODE[np.frombuffer(seq, dtype=np.uint8)]
    n = max(0, len(codes) - k + 1)
    place, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for j in range(k):
        part = codes[j : j + n]
        place = place * 4 + (part & 3)
        bad |= part == 4
    return place, bad


def kmer_name(code: int, k: int) -> str:
    """The letters of a base-4 number."""
    return "".join("ACGT"[(code >> (2 * j)) & 3] for j in range(k - 1, -1, -1))


def _counted_as_text(sequences: DataFrame, k: int) -> DataFrame:
    places = sequences.where(F.length("seq") >= k).select("seq", F.explode(F.expr(f"sequence(1, length(seq) - {int(k) - 1})")).alias("at"))
    return places.select(F.substring("seq", F.col("at"), F.lit(k)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$")).groupBy("kmer").agg(F.count("*").alias("freq"))


def kmer_frequency(sequences: DataFrame, k: int = K) -> DataFrame:
    """(kmer, freq) of the k-mers of A, C, G and T over all sequences, forward strand.

    Each batch is counted into a table of 4**k entries before the shuffle, so that at most that many
    rows leave a batch; k-mers of over MOST_K letters, which have no such table, are grouped as text.
    """
    if k > MOST_K:
        return _counted_as_text(sequences, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, held, size = np.zeros(4**k, dtype=np.int64), [], 0
            for seq in [*batch.column(0).cast(pa.binary()).to_pylist(), None]:
                if seq is not None:
                    place, bad = kmer_codes(seq, k)
                    held.append(place[~bad])
                    size += len(place)
                if held and (seq is None or size > 1 << 21):
                    counts += np.bincount(np.concatenate(held), minlength=4**k)
                    held, size = [], 0
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([kmer_name(x, k) for x in found.tolist()], pa.string()), pa.array(counts[found])], ["kmer", "freq"])

    return sequences.select("seq").mapInArrow(run, "kmer string, freq long").groupBy("kmer").agg(F.sum("freq").alias("freq"))


def kmer_frequency_hamming(sequences: DataFrame, k: int = K) -> DataFrame:
    """(kmer, freq) where freq counts occurrences within one mismatch: each distinct k-mer's count goes to its neighbours that occur."""
    counts = kmer_frequency(sequences, k)
    places = F.sequence(F.lit(1), F.lit(k))
    swaps = F.flatten(F.transform(places, lambda i: F.transform(F.array(*map(F.lit, "ACGT")), lambda c: F.concat(F.substring(F.col("kmer"), F.lit(1), i - 1), c, F.substring(F.col("kmer"), i + 1, F.lit(k))))))
    spread = counts.select(F.explode(F.array_distinct(swaps)).alias("kmer"), "freq").groupBy("kmer").agg(F.sum("freq").alias("freq"))
    return spread.join(counts.select("kmer"), "kmer", "left_semi")


def frame_sums(seq: bytes, table: np.ndarray, k: int, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, sum of the table's entries) of every run of ``frame`` k-mers that are all of A, C, G and T."""
    place, bad = kmer_codes(seq, k)
    if len(place) < frame:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(np.where(bad, 0, table[place]))))
    holes = np.concatenate(([0], np.cumsum(bad)))
    start = np.flatnonzero(holes[frame:] == holes[:-frame])
    return start, total[start + frame] - total[start]


def score_table(sequences: DataFrame, k: int = K) -> np.ndarray:
    """round(1e9 * log(1 + saturated count)) of each k-mer by its base-4 number; at most 4**k entries, so k is at most MOST_K."""
    if k > MOST_K:
        raise ValueError(f"windows are scored with k-mers of up to {MOST_K} letters")
    counted = kmer_frequency(sequences, k).select("kmer", F.round(F.log1p(F.least(F.col("freq"), F.lit(65535)).cast("double")) * 1e9).cast("bigint").alias("q"))
    table = np.zeros(4**k, dtype=np.int64)
    for row in counted.collect():
        table[int("".join(str("ACGT".index(c)) for c in row.kmer), 4)] = row.q
    return table


def plateaus(start: np.ndarray, score: np.ndarray, min_distance: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(plateau number from 1, doubled distance from the plateau's centre) of windows in order: runs of equal score whose starts are at most ``min_distance`` apart."""
    if not len(start):
        return start, start
    new = np.concatenate(([True], (score[1:] != score[:-1]) | (np.diff(start) > min_distance)))
    number = np.cumsum(new)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    return number, np.abs(2 * start - (start[first] + start[last])[number - 1])


def _window_min(values: np.ndarray, reach: int) -> np.ndarray:
    """The smallest value within ``reach`` places of each, by doubling."""
    width, out = 1, np.concatenate((np.full(reach, values.max(initial=0) + 1), values, np.full(reach, values.max(initial=0) + 1)))
    while 2 * width <= 2 * reach + 1:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = 2 * reach + 1 - width
    return np.minimum(out[: len(values)], out[rest : rest + len(values)])


def suppressed(start: np.ndarray, score: np.ndarray, dist2: np.ndarray, min_center_distance: int = 60, rounds: int = 12) -> np.ndarray:
    """Which windows greedy suppression in the order (score, dist2, start) keeps: none within ``min_center_distance`` of a better kept one.

    All windows that are best in their reach are kept at once, and their neighbours dropped; what is
    left after some rounds is gone through in order.
    """
    keep = np.zeros(len(start), dtype=bool)
    if not len(start):
        return keep
    rank = np.empty(len(start), dtype=np.int64)
    rank[np.lexsort((start, dist2, score))] = np.arange(len(start))
    low, n = int(start[0]), len(start)
    at = start - low
    place = np.full(int(at[-1]) + 1, n, dtype=np.int64)  # the rank of the open window at each place
    place[at] = rank
    for _ in range(rounds):
        found = np.flatnonzero((place < n) & (place == _window_min(place, min_center_distance)))
        if not len(found):
            break
        keep[np.searchsorted(at, found)] = True
        steps = np.zeros(len(place) + 1, dtype=np.int32)
        np.add.at(steps, np.maximum(found - min_center_distance, 0), 1)
        np.add.at(steps, np.minimum(found + min_center_distance + 1, len(place)), -1)
        place[np.cumsum(steps[:-1]) > 0] = n
    left = np.flatnonzero(place < n)
    taken = np.zeros(len(place), dtype=bool)
    for x in left[np.argsort(place[left])].tolist():
        if not taken[x]:
            taken[max(0, x - min_center_distance) : x + min_center_distance + 1] = True
            keep[np.searchsorted(at, x)] = True
    return keep


def scanned_windows(sequences: DataFrame, k: int = K, length: int = LENGTH, min_distance: int = 20, suppress_within: int | None = None) -> DataFrame:
    """(sequence_id, start, end, score_q, plateau_id, dist2_from_center) of windows of ``length`` bases; with ``suppress_within`` only of those that suppression keeps.

    A window's score is the sum over its k-mers of round(1e9 * log(1 + saturated count)).  Scaled
    integers keep equal scores equal.  The table of counts goes to every task; windows, plateaus and
    suppression are then one pass over each sequence, where its row is, without a shuffle.  A k-mer with
    another letter than A, C, G and T breaks windows.
    """
    frame, table = length - k + 1, score_table(sequences, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, seq in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                start, score = frame_sums(seq or b"", table, k, frame)
                number, dist2 = plateaus(start, score, min_distance)
                columns = [start, score, number, dist2]
                if suppress_within is not None:
                    keep = suppressed(start, score, dist2, suppress_within)
                    columns = [c[keep] for c in columns]
                for at in range(0, len(columns[0]), 1 << 20):
                    start, score, number, dist2 = (pa.array(c[at : at + (1 << 20)]) for c in columns)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(start), row))), start, pc.add(start, length), score, number, dist2], ["sequence_id", "start", "end", "score_q", "plateau_id", "dist2_from_center"])

    kind = sequences.schema["sequence_id"].dataType.simpleString()
    return sequences.select("sequence_id", "seq").mapInArrow(run, f"sequence_id {kind}, start long, end long, score_q long, plateau_id long, dist2_from_center long")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` from 0 in the order of columns, without bringing them into one task.

    Rows are dealt by ranges and sorted; a row's number is its rank in its range plus the rows of
    earlier ranges, of which there is one count a partition.  Ranges are sampled, so they are fixed by a
    checkpoint before they are counted.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__rank", rank).join(F.broadcast(before), "__part").withColumn("number", F.col("__rank") + F.col("__before")).drop("__rank", "__before", "__part")


def select_anchors(kept: DataFrame, total_bases: int, density: float = 2000.0) -> DataFrame:
    """The best floor(total_bases * density / 1e6) kept windows (a top-k) with dense ids in (sequence, start) order.

    The number kept grows with the input, so places are numbered by ranges, not by one sorted limit.
    """
    budget = int(total_bases * density // 1_000_000)
    best = numbered(kept, ["score_q", "dist2_from_center", "sequence_id", "start"]).where(F.col("number") < budget).drop("number")
    return numbered(best, ["sequence_id", "start"]).select(F.format_string("anchor_%08d", "number").alias("anchor_id"), "sequence_id", "start", "end", "score_q")


def anchor_groups(anchors: DataFrame) -> DataFrame:
    """(group_key, group_id, n, samples) of groupable anchors by the SHA-256 of their group."""
    return anchors.where("groupable").groupBy(F.sha2("group_id", 256).alias("group_key")).agg(F.min("group_id").alias("group_id"), F.count("*").alias("n"), F.countDistinct("sample").alias("samples"))
