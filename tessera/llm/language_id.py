"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every training text is counted whole, in the task that reads it; only (language, bucket, count) rows are shuffled.
The log-probability matrix has ``buckets`` columns and one row a language, at most ``most_languages`` of them, and is
broadcast.  Texts are scored batch by batch: the buckets of all n-grams of a batch gather from the
matrix, and one segmented sum gives each text's likelihoods.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, id_bucket, utf8_list


@dataclass(frozen=True)
class Params:
    """``most_languages`` * ``buckets`` bounds the matrix (64 MB as 32-bit floats); more languages are an error.

    ``worth``: a text's likelihoods count like those of at most so many n-grams in its score, as n-grams that
    overlap aren't independent; the predicted language doesn't depend on it.
    """

    orders: tuple[int, ...] = (1, 2, 3, 4)
    buckets: int = 1 << 15
    smoothing: float = 0.1
    most_languages: int = 512
    worth: int = 48


@dataclass
class Model:
    """Languages in order, log priors, and log probabilities (languages, buckets)."""

    params: Params
    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray


UNKNOWN = "und"
_kinds: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For all code points: whether it is a letter, and whether it is a letter or a mark."""
    if not _kinds:
        first = np.array([ord(unicodedata.category(chr(k))[0]) for k in range(0x110000)], dtype=np.uint8)
        _kinds.extend([first == ord("L"), (first == ord("L")) | (first == ord("M"))])
    return _kinds[0], _kinds[1]


def grams(texts: list[bytes], params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, how many each text has, and whether it has a letter.

    Texts are lower-cased; every run of characters that are neither letters nor marks is one space,
    and each text stands between two spaces.  N-grams don't reach over the ends of a text.
    """
    letter, word = _letters()
    points = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    space, closing = np.full(1, 32, "<u4"), len(texts)
    flat = np.concatenate([x for p in points for x in (space, p)] + [space]).astype(np.int64)
    owner = np.repeat(np.arange(closing + 1), np.append(sizes + 1, 1))
    has = np.zeros(closing + 1, dtype=bool)
    has[owner[letter[flat]]] = True
    flat[~word[flat]] = 32
    # One space of a run stays, the first one of a text always; then those that end a text go, as the next one's first closes it.
    begins = np.append(True, owner[1:] != owner[:-1])
    keep = (flat != 32) | (np.append(0, flat[:-1]) != 32) | begins
    flat, owner, begins = flat[keep], owner[keep], begins[keep]
    keep = (flat != 32) | begins | np.append(owner[1:] == owner[:-1], True)
    flat, owner = flat[keep].astype(np.uint64), owner[keep]
    length = np.bincount(owner, minlength=closing + 1)[:-1]
    begin = np.cumsum(length) - length
    found, rows = [], []
    for n in params.orders:
        # A text of a space, m - 1 characters and the closing space; a lone space is no n-gram.
        count = np.where(length > 1, np.maximum(length - 1 if n == 1 else length + 2 - n, 0), 0)
        at = np.repeat(begin + (n == 1), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        code = np.full(len(at), n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                code = (code ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
        found.append((code % np.uint64(params.buckets)).astype(np.int64))
        rows.append(np.repeat(np.arange(closing), count))
    order = np.argsort(np.concatenate(rows), kind="stable")
    return np.concatenate(found)[order], np.bincount(np.concatenate(rows), minlength=closing), has[:-1]


def counts(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """N-gram counts of (text, lang) rows: (lang, bucket, n); bucket -1 counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(found[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            texts, langs = utf8_list(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in byte_slices(texts, 1 << 20):
                found, per_text, _ = grams(texts[lo:hi], params)
                names = np.array(langs[lo:hi], dtype=object)
                owner = np.repeat(np.arange(hi - lo), per_text)
                for lang in sorted(set(langs[lo:hi])):
                    if lang not in held:
                        if len(held) >= 64:
                            yield from flush()
                        held[lang] = np.zeros(params.buckets + 1, dtype=np.int64)
                    mine = names == lang
                    held[lang][1:] += np.bincount(found[mine[owner]], minlength=params.buckets)
                    held[lang][0] += int(mine.sum())
        yield from flush()

    partial = rows.select("text", F.col("lang").cast("string")).mapInArrow(run, "lang string, bucket long, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, held_out: tuple[int, int] | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", params: Params = Params()) -> Model:
    """The model of all texts with a language; with ``held_out`` = (m, r), rows whose id's crc32 leaves r modulo m are not read.

    Null texts and null languages teach nothing, empty texts count for the prior only.
    """
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    if held_out:
        rows = rows.where(id_bucket(id_column, held_out[0]) != held_out[1])
    rows = rows.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    languages = [r.lang for r in rows.select("lang").distinct().limit(params.most_languages + 1).collect()]
    if len(languages) > params.most_languages:
        raise ValueError(f"over {params.most_languages} languages; raise Params.most_languages, with which the broadcast matrix grows")
    languages = sorted(languages)
    table = np.zeros((len(languages), params.buckets))
    texts = np.zeros(len(languages))
    index = {lang: k for k, lang in enumerate(languages)}
    for r in counts(rows, params).toLocalIterator() if languages else ():
        if r.bucket < 0:
            texts[index[r.lang]] = r.n
        else:
            table[index[r.lang], r.bucket] = r.n
    table += params.smoothing
    matrix = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    priors = np.log(np.maximum(texts, 1) / max(texts.sum(), 1))
    return Model(params, languages, priors, matrix)


def likelihoods(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log posterior weights (texts, languages), numbers of n-grams, and whether a text has a letter."""
    found, per_text, has = grams(texts, model.params)
    out = np.tile(model.priors, (len(texts), 1))
    filled = np.flatnonzero(per_text)
    if len(filled):
        starts = (np.cumsum(per_text) - per_text)[filled]
        for k, weights in enumerate(model.matrix):  # a language at a time, so that memory doesn't grow with their number
            out[filled, k] += np.add.reduceat(weights[found].astype(np.float64), starts)
    return out, per_text, has


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text and its tempered posterior.

    A null text, one without a letter, and any text when nothing was learned give ``und`` with score 0.
    Ties take the language that comes first by name.  Repeated rows each have their row; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = utf8_list(batch.column(1))
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in byte_slices(texts, 1 << 20) if known.languages else ():
                weight, n, has = likelihoods(texts[lo:hi], known)
                best = weight.argmax(1)
                tempered = (weight - weight.max(1, keepdims=True)) * (known.params.worth / np.maximum(n, known.params.worth))[:, None]
                top = 1.0 / np.exp(tempered).sum(1)
                for k in np.flatnonzero(has):
                    names[lo + k] = known.languages[best[k]]
                    scores[lo + k] = top[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)
