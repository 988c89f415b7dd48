"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its bytes and words and those of the lines before and after it; the field
labels each line good or bad, and a document's quality is the length-weighted mean of its lines'
probabilities from the forward-backward recursions, calibrated to the labels.  All features are
computed over whole batches with numpy; scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, id_bucket, span_hashes, train_in_task, utf8_list


@dataclass(frozen=True)
class Params:
    """Bounds of the training sample (texts of each label, each of them whole, and the bytes of the longest one taken), and the training's length."""

    documents_per_class: int = 1500
    sample_bytes: int = 1 << 16
    steps: int = 150
    rounds: int = 2
    rate: float = 0.1
    penalty: float = 1e-3


#: Bytes of texts that are worked on at once.
SLICE = 1 << 20
NAMES = ("upper", "digit", "symbol", "bar", "wide", "words", "word_length", "repeat", "run", "blank", "again")
_bytes = np.arange(256)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_LOWER = (_bytes >= 97) & (_bytes <= 122)
_DIGIT = (_bytes >= 48) & (_bytes <= 57)
_SPACE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
_SYMBOL = (_bytes > 32) & (_bytes < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~np.isin(_bytes, [ord(c) for c in ".,;:'\"-()?"])
#: Each byte's class: 0 other, 1 upper, 2 digit, 3 symbol, 4 bar, 5 white space, 6 above ASCII.
KIND = np.select([_UPPER, _DIGIT, _bytes == ord("|"), _SYMBOL, _SPACE, _bytes > 127], [1, 2, 4, 3, 5, 6], 0).astype(np.uint8)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its weight: bytes plus one, number of lines of each text); a text has one line at least."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    text_end = np.cumsum(size)
    ends = np.flatnonzero(flat == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    n_lines = np.diff(np.concatenate(([0], np.searchsorted(ends, text_end - 1, side="right"))))
    length = (ends - begins).astype(np.float32)
    kind = KIND[flat]

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, begins, dtype=np.int32).astype(np.float32)

    one = np.maximum(length, 1)
    space = kind == 5
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    line_of = np.searchsorted(ends, starts)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float32)
    hashes = span_hashes(flat, starts, stops)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[same], minlength=len(ends)).astype(np.float32)
    symbol = (kind == 3) | (kind == 4)
    runs = symbol & np.concatenate(([False], symbol[:-1]))
    owner = np.repeat(np.arange(len(texts)), n_lines)
    whole = span_hashes(flat, begins, ends)
    order = np.lexsort((np.arange(len(ends)), whole, owner))
    again = np.zeros(len(ends), dtype=np.float32)
    again[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again[length == 0] = 0
    many = np.maximum(words, 1)
    columns = (
        per_line(kind == 1) / one, per_line(kind == 2) / one, per_line(kind == 3) / one, per_line(kind == 4) / many, per_line(kind == 6) / one,
        np.log1p(words) / 5, np.minimum(length / many, 40) / 20, repeats / many, per_line(runs) / many, (words == 0).astype(np.float32), again,
    )
    return np.stack(columns, axis=1), length + 1, n_lines


def features_in_slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of any number of texts, made SLICE bytes at a time: a byte takes over 50 while it is hashed."""
    parts = [line_features(texts[a:b]) for a, b in byte_slices(texts, SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """A constant, each line's features, those of the line before and of the line after (zeros beyond the text)."""
    last = np.cumsum(n_lines) - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[last - n_lines + 1] = 0
    after[last] = 0
    return np.concatenate([np.ones((len(own), 1), dtype=own.dtype), own, before, after], axis=1)


@dataclass
class Model:
    """Weights of the line features for the label good, the gain of keeping a label from line to line, and the calibration."""

    weights: np.ndarray
    stay: np.ndarray
    scale: float = 8.0
    shift: float = -4.0


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def forward_backward(emit: np.ndarray, n_lines: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of good for each line, expected use of each (label, next label) pair between a line and the one before).

    ``emit`` is each line's score for good (bad: 0); ``stay`` scores the pairs (good, good) and (bad,
    bad).  Messages are log odds, so each step is one formula for all texts that have that many lines.
    """
    first = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    lengths = n_lines[order]
    gg, bb = float(stay[0]), float(stay[1])
    forward, backward = np.array(emit, dtype=np.float64), np.zeros(len(emit))
    for t in range(1, int(lengths[0]) if len(lengths) else 0):
        live = order[: np.searchsorted(-lengths, -t, side="left")]
        at = first[live] + t
        m = forward[at - 1]
        forward[at] += np.logaddexp(m + gg, 0) - np.logaddexp(m, bb)
    for t in range((int(lengths[0]) if len(lengths) else 0) - 2, -1, -1):
        live = order[: np.searchsorted(-lengths, -(t + 1), side="left")]
        at = first[live] + t
        m = backward[at + 1] + emit[at + 1]
        backward[at] = np.logaddexp(m + gg, 0) - np.logaddexp(m, bb)
    odds = forward + backward
    pairs = np.zeros((len(emit), 2))
    inner = np.ones(len(emit), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    f, b = forward[at - 1], emit[at] + backward[at]
    logs = np.stack([f + b + gg, f, b, np.full(len(at), bb)])
    logs -= logs.max(axis=0)
    p = np.exp(logs)
    p /= p.sum(axis=0)
    pairs[at, 0], pairs[at, 1] = p[0], p[3]
    return odds, pairs


def fit_field(features: np.ndarray, n_lines: np.ndarray, good: np.ndarray, line_weight: np.ndarray, p: Params) -> Model:
    """Maximum conditional likelihood of the line labels by Adam."""
    theta = np.zeros(features.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(good), dtype=bool)
    inner[np.cumsum(n_lines) - n_lines] = False
    before = np.concatenate(([0.0], good[:-1]))
    pair_gg, pair_bb = inner * good * before, inner * (1 - good) * (1 - before)
    total = line_weight.sum()
    for step in range(1, p.steps + 1):
        odds, pairs = forward_backward(features @ theta[:-2], n_lines, theta[-2:])
        error = (1 / (1 + np.exp(-odds)) - good) * line_weight
        grad = np.concatenate([error @ features, [((pairs[:, 0] - pair_gg) * line_weight).sum(), ((pairs[:, 1] - pair_bb) * line_weight).sum()]]) / total + p.penalty * theta
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-2].copy(), theta[-2:].copy())


def document_good(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length-weighted mean of the lines' probabilities of good, their probabilities, number of lines of each text, number of bad lines)."""
    own, weight, n_lines = features_in_slices(texts)
    odds, _ = forward_backward(with_neighbours(own, n_lines) @ model.weights, n_lines, model.stay)
    good = 1 / (1 + np.exp(-odds))
    first = np.cumsum(n_lines) - n_lines
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight.astype(np.float64), first), good, n_lines, np.add.reduceat((good < 0.5).astype(np.int64), first)


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(calibrated quality, number of lines, number of lines more likely bad than good) of each text."""
    mean, _, n_lines, bad = document_good(model, texts)
    return 1 / (1 + np.exp(-(model.scale * mean + model.shift))), n_lines, bad


def train(texts: list[bytes], labels: list[int], p: Params = Params()) -> Model:
    """Fit on documents: a good text's lines are good; a bad text's lines start as bad, and those that look good to the fitted field, short of half the text, become good for the next round."""
    if not texts or len(set(labels)) < 2:
        width = 1 + 3 * len(NAMES)
        return Model(np.zeros(width), np.zeros(2), 0.0, 2.0 if not labels or labels[0] else -2.0)
    own, weight, n_lines = features_in_slices(texts)
    features = with_neighbours(own, n_lines).astype(np.float64)
    label = np.asarray(labels, dtype=np.float64)
    owner = np.repeat(np.arange(len(texts)), n_lines)
    good = label[owner]
    # Each text counts alike and each class half; within a text its lines count alike.
    class_weight = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    line_weight = (class_weight / n_lines)[owner]
    model = fit_field(features, n_lines, good, line_weight, p)
    for _ in range(p.rounds - 1):
        odds, _ = forward_backward(features @ model.weights, n_lines, model.stay)
        share = np.bincount(owner, weights=weight * (odds < 0)) / np.bincount(owner, weights=weight)
        good = np.where((label[owner] == 0) & (odds > 0) & (share[owner] > 0.5), 1.0, label[owner])
        model = fit_field(features, n_lines, good, line_weight, p)
    mean = document_good(model, texts)[0]
    a, b = 8.0, -4.0
    for _ in range(50):  # Newton steps of a penalised logistic regression on the mean
        prob = 1 / (1 + np.exp(-(a * mean + b)))
        e, h = prob - label, np.maximum(prob * (1 - prob), 1e-9)
        grad = np.array([(e * mean).sum() + 0.01 * a, e.sum() + 0.01 * b])
        hess = np.array([[(h * mean * mean).sum() + 0.01, (h * mean).sum()], [(h * mean).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.scale, model.shift = float(max(a, 0.0)), float(b)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """A bounded sample (id, text, label) of labelled texts, at most ``documents_per_class`` of each label, chosen by a hash of the id.

    Ids whose crc32 has the remainder ``held_out`` are never taken.  Only the sample's ids are broadcast
    (their number is a parameter); sampled texts are whole, and texts of over ``sample_bytes`` bytes are
    not learned from (they are scored like any other).
    """
    modulus, rest = held_out
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & (id_bucket(id_column, modulus) != rest)).groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).alias("__label"))
    parts = [usable.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(p.documents_per_class) for value in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("__text")).where(F.length("__text") <= p.sample_bytes).join(F.broadcast(chosen), "__id")
    return rows.select(F.col("__id").cast("bigint").alias("id"), F.col("__text").alias("text"), F.col("__label").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), **columns) -> Model:
    """The model of a bounded sample of labelled documents; with one label only, or none, a constant one."""
    return train_in_task(training_sample(docs, labels, p, **columns), lambda texts, known: train(texts, known, p), 2 * p.documents_per_class)


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, bad_lines) of every whole text, row by row.

    A null or empty text is one blank line and scored as such.  Very long texts are scored over all
    their lines.  Repeated rows and null ids are scored like any others; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_list(batch.column(1))
            for a, b in byte_slices(texts, SLICE):
                score, n_lines, bad = score_texts(model, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(n_lines), pa.array(bad)], ["doc_id", "score", "n_lines", "bad_lines"])

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, score double, n_lines long, bad_lines long")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """``docs`` without rows that score under ``threshold``; each row is judged by its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_list(batch.column(text_column))
            for a, b in byte_slices(texts, SLICE):
                yield batch.slice(a, b - a).filter(pa.array(score_texts(model, texts[a:b])[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)
