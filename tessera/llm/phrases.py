"""Document fingerprints by locally consistent parsing with deterministic coin tossing.

A text's bytes are cut into short phrases where labels, got from neighbouring symbols alone by
repeated coin tossing, have a local maximum; the phrases' names are cut again, level by level.  So a
phrase depends only on the bytes near it, and equal substrings share their interior phrases wherever
they stand.  A fingerprint keeps the smallest name hash in each of 64 bins over all levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, mix64, span_hashes, utf8_list

#: Bins of a fingerprint, and the hex digits that each shows.
BINS = 64
DIGITS = 4
#: Levels of names; those under FIRST, which unrelated long texts share too, fill only bins that no higher level fills.
LEVELS, FIRST = 5, 3
EMPTY_BIN = np.iinfo(np.uint64).max
EMPTY = "-" * DIGITS


def _toss(bits: int) -> np.ndarray:
    """Labels of (previous, own) symbols of ``bits`` bits: twice the lowest bit where they differ, plus own's bit there; equal symbols: 0 below all."""
    size = 1 << bits
    previous, own = np.arange(size)[:, None], np.arange(size)[None, :]
    differ = previous ^ own
    lowest = np.zeros_like(differ)
    for k in range(bits - 1, -1, -1):
        lowest[(differ >> k) & 1 == 1] = k
    return np.where(differ == 0, 0, 1 + 2 * lowest + ((own >> lowest) & 1)).astype(np.uint8).ravel()


#: Bytes to labels up to 16, those to labels up to 10, those to labels up to 8.
_TOSS8, _TOSS5, _TOSS4 = _toss(8), _toss(5), _toss(4)


def phrase_ends(symbols: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """The ends (exclusive) of phrases of symbols (bytes or 64-bit names) of texts with the given ends; no label looks beyond its text.

    Labels get from 8 or 64 bits down to a few values by tossing: that of each symbol comes from it and
    the one before it.  A phrase ends where labels have a local maximum, and at the text's end.
    """
    first = np.concatenate(([0], text_end[:-1]))
    previous = np.empty_like(symbols)
    previous[0], previous[1:] = 0, symbols[:-1]
    if symbols.dtype == np.uint8:
        label, tables = _TOSS8[(previous.astype(np.uint16) << 8) | symbols], ((_TOSS5, 5), (_TOSS4, 4))
    else:
        differ = previous ^ symbols
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)  # the lowest bit where they differ
        label, tables = np.where(differ == 0, 0, 1 + 2 * low + ((symbols >> (low & np.uint64(63))) & np.uint64(1))).astype(np.uint8), ((_TOSS8, 8), (_TOSS5, 5), (_TOSS4, 4))
    previous = np.zeros_like(label)
    label[first] = 0
    for table, bits in tables:
        previous[1:] = label[:-1]
        label = table[(previous.astype(np.uint16) << np.uint16(bits)) | label]
        label[first] = 0
    peak = np.zeros(len(symbols), dtype=bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    peak[text_end - 1] = True
    return np.flatnonzero(peak) + 1


def text_names(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level, (level, text of each phrase, its name); texts of no bytes have none."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    owner = np.flatnonzero(size)
    if not len(owner):
        return
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text_end = np.cumsum(size[owner])
    names: np.ndarray = symbols
    for level in range(1, LEVELS + 1):
        ends = phrase_ends(symbols, text_end)
        begins = np.concatenate(([0], ends[:-1]))
        names = span_hashes(names, begins, ends)
        text_end = np.searchsorted(ends, text_end) + 1
        symbols = names
        yield level, np.repeat(owner, np.diff(np.concatenate(([0], text_end)))), names


def signatures(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS) 16-bit codes, -1 where a bin is empty: a mix of the smallest name hash of the bin, so that no code depends on how small it is."""
    out = np.full(len(texts) * BINS, EMPTY_BIN, dtype=np.uint64)
    for level, owner, names in text_names(texts):
        hashed = mix64(names + np.uint64(level))
        rank = (hashed & np.uint64((1 << 56) - 1)) | np.uint64(max(FIRST - level, 0) << 56)
        np.minimum.at(out, owner * BINS + (hashed >> np.uint64(58)).astype(np.int64), rank)
    return np.where(out == EMPTY_BIN, -1, (mix64(out) & np.uint64(0xFFFF)).astype(np.int32)).reshape(len(texts), BINS)


def shown(signature: np.ndarray) -> list[str]:
    """Fingerprints as text: four hex digits a bin, dashes for an empty one."""
    blank = signature < 0
    rows = signature.astype(">u2")
    out = []
    for digits, empty in zip(rows, blank):
        text = digits.tobytes().hex()
        if empty.any():
            text = "".join(EMPTY if e else text[DIGITS * k : DIGITS * (k + 1)] for k, e in enumerate(empty.tolist()))
        out.append(text)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either has; 1 for two empty fingerprints."""
    either = (a >= 0) | (b >= 0)
    n = either.sum(axis=1)
    return np.where(n == 0, 1.0, (either & (a == b)).sum(axis=1) / np.maximum(n, 1))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null counts as empty, whose bins are all dashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_list(batch.column(1))
            for a, b in byte_slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x.decode()) for x in texts[a:b]], pa.int64()), pa.array(shown(signatures(texts[a:b])))], ["doc_id", "n_chars", "fingerprint"]
                )

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, parts: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(part, doc_id, text, extra): rows dealt into ranges of ids, each range sorted and followed by a copy of the next range's first row.

    Only the range limits, at most one for each part, come to the driver.  After the last range comes
    the first row again.  Rows of equal ids are ordered by their text's hash; null ids come first.
    """
    slim = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col(id_column).isNull().alias("no_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ids = slim.select("doc_id")
    limits = np.array(sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else [], dtype=np.float64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(limits, own)), batch.column(0)], ["part", "doc_id"])

    first = {r["part"]: r["first"] for r in ids.mapInArrow(number, "part long, doc_id long").groupBy("part").agg(F.min("doc_id").alias("first")).collect()}
    filled = sorted(first)
    firsts = np.array([first[p] for p in filled], dtype=np.int64)
    before = np.array(filled[-1:] + filled[:-1], dtype=np.int64)  # the first range's first row follows the last range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, own)
            again = np.flatnonzero((at < len(firsts)) & (firsts[np.minimum(at, len(firsts) - 1)] == own))
            rows = pa.array(np.concatenate([np.arange(len(own)), again]))
            part = np.concatenate([np.searchsorted(limits, own), before[at[again]]])
            extra = np.concatenate([np.zeros(len(own), dtype=np.int32), np.ones(len(again), dtype=np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(part), *(c.take(rows) for c in batch.columns), pa.array(extra)], ["part", "doc_id", "no_id", "text", "extra"])

    # Numbers that Spark's hash deals to different partitions, so that each range has a task of its own.
    n = max(1, len(filled))
    spare = docs.sparkSession.range(16 * n, numPartitions=1 + n // 4096).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    names = np.arange(int(limits.size) + 1)
    free = {r["at"]: r["id"] for r in spare}
    for k, part in enumerate(filled):
        names[part] = free.get(k, 16 * n + k)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in deal(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names[batch.column(0).to_numpy(zero_copy_only=False)]), *batch.columns[1:]], batch.schema.names)

    spread = slim.mapInArrow(rename, "part long, doc_id long, no_id boolean, text string, extra int")
    return spread.repartition(n, "part").sortWithinPartitions("part", "extra", "doc_id", F.xxhash64("text"), "text")


def with_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_per_part: int = 16_384) -> DataFrame:
    """Each text's fingerprint, that of an edited text, and their likeness.

    The edited text has the last floor(n / 4) code points replaced by the first as many (or all) of the
    next document's, in ascending id order; after the last comes the first.  A null text counts as
    empty; rows of equal ids are ordered by their text's hash; rows without an id come first and keep
    a null id; a single row is its own next one; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (part, id, no id, text, extra), the last of them without its next one so far

        def out(pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [text for _, text, _ in pairs]
            for a, b in byte_slices(texts, 2 << 20):
                own, following = texts[a:b], [nxt for _, _, nxt in pairs[a:b]]
                edited, chars = [], []
                for x, y in zip(own, following):
                    text = x.decode()
                    cut = len(text) // 4
                    chars.append(len(text))
                    edited.append((text[: len(text) - cut] + y[: 4 * cut].decode(errors="ignore")[:cut]).encode() if cut else x)
                s, e, n = signatures(own), signatures(edited), signatures(following)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in pairs[a:b]], pa.int64()), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                        pa.array(shown(s)), pa.array(shown(e)), pa.array(likeness(s, e)), pa.array(likeness(s, n)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8_list(batch.column(3)), batch.column(4).to_pylist())
            pairs = [(None if this[2] else this[1], this[3], nxt[3]) for this, nxt in zip(rows, rows[1:]) if this[4] == 0 and nxt[0] == this[0]]
            rows = rows[-1:]
            yield from out(pairs)

    parts = max(1, docs.count() // rows_per_part)
    return in_order(docs, parts, id_column, text_column).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
