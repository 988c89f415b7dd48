"""Toxicity of whole texts: a bidirectional GRU with attention pooling over character and word inputs.

Every word enters as a hashed word vector and the mean of its hashed character n-gram vectors.  A text
is its overlapping windows of words; a document is as toxic as its most toxic window, in training (the
loss follows the windows that decide) and in scoring (all windows of the whole text).  The network is
trained in numpy on a bounded sample of labelled documents; scoring runs where the rows are read,
without a shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, id_bucket, span_hashes, train_in_task, utf8_list


@dataclass(frozen=True)
class Params:
    """Sizes of the network, its windows and its training (at least ``epochs`` passes and ``steps`` batches).

    At most ``toxic_documents`` and ``clean_documents`` labelled texts of at most ``sample_bytes`` bytes
    are learned from, each of them whole.
    """

    window: int = 20
    stride: int = 14
    hidden: int = 8
    word_buckets: int = 1 << 16
    gram_buckets: int = 1 << 16
    size: int = 8
    toxic_documents: int = 800
    clean_documents: int = 2000
    sample_bytes: int = 1 << 16
    epochs: int = 10
    steps: int = 250
    batch: int = 128
    word_documents: int = 3
    gram_documents: int = 4
    rate: float = 0.01
    decay: float = 0.1
    echo: float = 0.15
    seed: int = 7


#: What words lose at both ends before they are looked up.
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
#: Words a scoring worker remembers before it starts afresh.
CACHE_WORDS = 200_000


def grams(words: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word, buckets of all character n-grams, first n-gram of each word); every word has an n-gram."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)))
    begins = np.concatenate(([0], ends[:-1]))
    whole = (span_hashes(flat, begins, ends) % np.uint64(p.word_buckets)).astype(np.int64)
    owner = np.repeat(np.arange(len(marked)), ends - begins)
    at, ids, whose = np.arange(len(flat)), [], []
    for n in (3, 4):
        fits = np.flatnonzero((at + n <= ends[owner]) | (at == begins[owner]))  # a short word is one n-gram
        ids.append(span_hashes(flat, fits, np.minimum(fits + n, ends[owner[fits]])) % np.uint64(p.gram_buckets))
        whose.append(owner[fits])
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    return whole, np.concatenate(ids)[order].astype(np.int64), np.searchsorted(whose_all[order], np.arange(len(marked)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    """Weights by name; both directions of the GRU hold update, reset and candidate side by side."""

    params: Params
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    frozen: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, p: Params) -> Model:
        rng, d, h = np.random.default_rng(p.seed), 2 * p.size, p.hidden
        shapes = {"word": (p.word_buckets, p.size), "gram": (p.gram_buckets, p.size), "attend": (2 * h, h), "query": (h,), "out": (2 * h,)}
        for way in ("f", "b"):
            shapes |= {f"w{way}": (d, 3 * h), f"u{way}": (h, 3 * h)}
        weights = {k: rng.normal(0, 0.1 if k in ("word", "gram") else 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        weights |= {"cf": np.zeros(3 * h), "cb": np.zeros(3 * h), "bias": np.full(1, -1.0)}
        return cls(p, {k: v.astype(np.float32) for k, v in weights.items()})

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input vector of each (normal) word, and what its gradient needs."""
        whole, ids, first = grams(words, self.params)
        counts = np.diff(np.concatenate((first, [len(ids)]))).astype(np.float32)
        chars = np.add.reduceat(self.weights["gram"][ids], first, axis=0) / counts[:, None]
        return np.concatenate([self.weights["word"][whole], chars], axis=1), (whole, ids, counts)

    def gru(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, hidden) of projected inputs (steps, windows, 3 * hidden); a masked step keeps the state."""
        h, u = self.params.hidden, self.weights["u" + way]
        state, out = np.zeros((x.shape[1], h), dtype=np.float32), np.empty((*x.shape[:2], h), dtype=np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            rec = state @ u
            gates = sigmoid(x[t, :, : 2 * h] + rec[:, : 2 * h])
            new = np.tanh(x[t, :, 2 * h :] + gates[:, h:] * rec[:, 2 * h :])
            nxt = new + gates[:, :h] * (state - new)
            nxt = np.where(mask[t][:, None], nxt, state)
            if keep is not None:
                keep.append((t, state, gates, new, rec))
            out[t] = state = nxt
        return out

    def pooled(self, both: np.ndarray, mask: np.ndarray) -> tuple:
        """(logits, attention, hidden attention layer, pooled states)."""
        layer = np.tanh(both @ self.weights["attend"])
        scores = np.where(mask, layer @ self.weights["query"], np.float32(-1e9))
        weight = np.exp(scores - scores.max(axis=0))
        weight /= weight.sum(axis=0)
        pool = np.einsum("tb,tbd->bd", weight, both)
        return pool @ self.weights["out"] + self.weights["bias"][0], weight, layer, pool

    def projected(self, words: list[bytes]) -> np.ndarray:
        """Both directions' projected inputs of words, side by side."""
        w = self.weights
        return self.inputs(words)[0] @ np.concatenate([w["wf"], w["wb"]], axis=1) + np.concatenate([w["cf"], w["cb"]])

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as rows (steps, windows) of ``table``."""
        h3 = 3 * self.params.hidden
        x = table[index]
        both = np.concatenate([self.gru("f", x[:, :, :h3], mask), self.gru("b", x[:, :, h3:], mask)], axis=2)
        return self.pooled(both, mask)[0]

    def gradients(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss of windows (steps, windows) over ``words``."""
        w, h = self.weights, self.params.hidden
        x, (whole, ids, counts) = self.inputs(words)
        own = x[index]
        kept = {"f": [], "b": []}
        states = {way: self.gru(way, own @ w["w" + way] + w["c" + way], mask, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logit, attention, layer, pool = self.pooled(both, mask)
        d_logit = (sigmoid(logit) - target) * weight
        grads = {"out": pool.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * w["out"]
        d_both = attention[:, :, None] * d_pool
        d_attention = np.einsum("tbd,bd->tb", both, d_pool)
        d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
        grads["query"] = np.einsum("tbh,tb->h", layer, d_score)
        d_layer = d_score[:, :, None] * w["query"] * (1 - layer**2)
        grads["attend"] = np.einsum("tbd,tbh->dh", both, d_layer)
        d_both = d_both + d_layer @ w["attend"].T
        d_own = np.zeros_like(own)
        for way, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            gu, d_state = np.zeros_like(w["u" + way]), np.zeros_like(part[0])
            d_x = np.zeros((*index.shape, 3 * h), dtype=np.float32)
            for t, state, gates, new, rec in reversed(kept[way]):
                live = mask[t][:, None]
                d_next = d_state + part[t]
                d_go = np.where(live, d_next, 0)
                z, r = gates[:, :h], gates[:, h:]
                d_new = d_go * (1 - z) * (1 - new**2)
                d_z = d_go * (state - new) * z * (1 - z)
                d_r = d_new * rec[:, 2 * h :] * r * (1 - r)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_x[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                gu += state.T @ d_rec
                d_state = np.where(live, d_go * z + d_rec @ w["u" + way].T, d_next)
            flat = d_x.reshape(-1, 3 * h)
            grads |= {"u" + way: gu, "c" + way: flat.sum(axis=0), "w" + way: own.reshape(len(flat), -1).T @ flat}
            d_own += d_x @ w["w" + way].T
        d_words = np.zeros_like(x)
        np.add.at(d_words, index.ravel(), d_own.reshape(-1, x.shape[1]) * mask.reshape(-1, 1))
        size = self.params.size
        for name, rows, values in (("word", whole, d_words[:, :size]), ("gram", ids, np.repeat(d_words[:, size:] / counts[:, None], counts.astype(np.int64), axis=0))):
            grads[name] = np.zeros_like(w[name])
            np.add.at(grads[name], rows, values)
        return grads


def layout(flat: np.ndarray, lengths: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, mask) of shape (steps, windows) and the text of each window, of texts of ``lengths`` word numbers in ``flat``.

    Windows overlap and together hold all words: one starts every ``stride`` words, the last ends with the text.
    """
    count = np.maximum(-(-(lengths - p.window) // p.stride), 0) + 1
    owner = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(place * p.stride, np.maximum(lengths - p.window, 0)[owner])
    step = np.arange(p.window)[:, None]
    mask = step < (lengths[owner] - first)[None, :]
    base = (np.cumsum(lengths) - lengths)[owner] + first
    return np.where(mask, flat[np.minimum(base[None, :] + step, len(flat) - 1)], 0), mask, owner


class Sample:
    """Tokenised training documents: their words' features once, and all their windows."""

    def __init__(self, texts: list[bytes], p: Params):
        names: dict[bytes, int] = {}
        known, lengths, flat = [], [], array("q")
        for k, text in enumerate(texts):  # one text's words at a time: those of all together take ten times the texts' room
            words = text.split()
            if words:
                known.append(k)
                lengths.append(len(words))
                flat.extend(names.setdefault(w.strip(EDGES).lower(), len(names)) for w in words)
        self.known, self.lengths, self.flat = (np.array(x, dtype=np.int64) for x in (known, lengths, flat))
        self.words = list(names)
        if len(self.known):
            self.index, self.mask, self.owner = layout(self.flat, self.lengths, p)

    def frequent(self, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """Which word buckets and n-gram buckets occur in enough of the documents to be learned."""
        parts = [grams(self.words[a : a + 20_000], p) for a in range(0, len(self.words), 20_000)]
        before = np.cumsum([0, *(len(x[1]) for x in parts)])
        whole, ids, first = (np.concatenate(x) for x in zip(*((w, i, f + n) for (w, i, f), n in zip(parts, before.tolist()))))
        per_word = np.diff(np.concatenate((first, [len(ids)])))
        words, pieces = np.zeros(p.word_buckets, dtype=np.int64), np.zeros(p.gram_buckets, dtype=np.int64)
        for end, n in zip(np.cumsum(self.lengths).tolist(), self.lengths.tolist()):
            own = np.unique(self.flat[end - n : end])
            words[np.unique(whole[own])] += 1
            counts = per_word[own]
            at = np.repeat(first[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            pieces[np.unique(ids[at])] += 1
        return words >= p.word_documents, pieces >= p.gram_documents


def window_scores(model: Model, sample: Sample) -> np.ndarray:
    """Logits of all windows of the sample."""
    table = np.concatenate([model.projected(sample.words[a : a + 20_000]) for a in range(0, len(sample.words), 20_000)])
    return np.concatenate([model.logits(table, sample.index[:, a : a + 4096], sample.mask[:, a : a + 4096]) for a in range(0, len(sample.owner), 4096)])


def train(texts: list[bytes], labels: list[int], p: Params = Params()) -> Model:
    """Fit on documents by the windows that decide.

    At first some windows of each text stand for it; then, after each pass, all windows are scored and a
    toxic text stands for its most toxic window, a clean text for its few most toxic ones.  Words and
    n-grams of very few documents keep zero vectors, so that they can't be learned by heart.
    """
    model, rng = Model.fresh(p), np.random.default_rng(p.seed)
    sample = Sample(texts, p)
    label = np.asarray(labels, dtype=np.float32)[sample.known] if len(sample.known) else np.zeros(0)
    if not len(label):
        return model
    for name, keep in zip(("word", "gram"), sample.frequent(p)):
        model.weights[name][~keep] = 0
        model.frozen[name] = ~keep
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    share, owner, step = float(np.clip(label.mean(), 0.02, 0.98)), sample.owner, 0
    epochs = max(p.epochs, -(-p.steps * p.batch // (4 * len(label))))
    toxic = label[owner] > 0
    for epoch in range(epochs):
        warm = 4 * epoch < epochs
        rank = np.lexsort((rng.random(len(owner)) if warm else -window_scores(model, sample), owner))
        place = np.empty(len(owner), dtype=np.int64)
        place[rank] = np.arange(len(owner)) - np.searchsorted(owner, owner[rank])
        pick = np.flatnonzero((place < np.where(toxic, 8, 8 if warm else 3)) if warm else (place < np.where(toxic, 1, 3)) | (~toxic & (rng.random(len(owner)) < 0.03)))
        weight = (np.where(toxic, 0.5 / share, 0.5 / (1 - share)) / np.bincount(owner[pick], minlength=len(label))[owner].clip(1))[pick]
        weight /= weight.mean()
        order = rng.permutation(len(pick))
        for at in range(0, len(order), p.batch):
            part = order[at : at + p.batch]
            rows = sample.index[:, pick[part]]
            mask = sample.mask[:, pick[part]].copy()
            echo = np.flatnonzero(~toxic[pick[part]] & (rng.random(len(part)) < p.echo))  # a clean word said over and over is clean
            rows[:, echo], mask[:, echo] = rows[:1, echo], True
            used, local = np.unique(rows, return_inverse=True)
            grads = model.gradients([sample.words[k] for k in used.tolist()], local.reshape(rows.shape), mask, toxic[pick[part]].astype(np.float32), (weight[part] / len(part)).astype(np.float32))
            step += 1
            rate = p.rate * min(1, 2 * (1 - (epoch + at / len(order)) / epochs))
            for k, g in grads.items():
                if k in model.frozen:
                    g[model.frozen[k]] = 0
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.weights[k] *= np.float32(1 - rate * p.decay)
                model.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model.frozen.clear()
    return centred(model, sample, label)


def centred(model: Model, sample: Sample, label: np.ndarray) -> Model:
    """Move the bias so that probability 0.5 lies in the middle of the gap that separates the sample's classes best."""
    if label.min() == label.max():
        return model
    top = np.maximum.reduceat(window_scores(model, sample), np.searchsorted(sample.owner, np.arange(len(label)))).astype(np.float64)
    order = np.argsort(top, kind="stable")
    values, is_toxic = top[order], label[order] > 0
    right = np.cumsum(~is_toxic)[:-1] / (~is_toxic).sum() + (is_toxic.sum() - np.cumsum(is_toxic)[:-1]) / is_toxic.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    cut = best[np.argmax(values[best + 1] - values[best])]
    model.weights["bias"] = model.weights["bias"] - np.float32((values[cut] + values[cut + 1]) / 2)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """A bounded sample (id, text, label) of labelled texts, at most ``toxic_documents`` and ``clean_documents``, chosen by a hash of the id.

    Ids whose crc32 has the remainder ``held_out`` are never taken.  Only the sample's ids are broadcast
    (their number is a parameter); sampled texts are whole, and texts of over ``sample_bytes`` bytes are
    not learned from (they are scored like any other).
    """
    modulus, rest = held_out
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & (id_bucket(id_column, modulus) != rest)).groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).alias("__label"))
    parts = [usable.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(limit) for value, limit in ((1, p.toxic_documents), (0, p.clean_documents))]
    rows = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("__text")).where(F.length("__text") <= p.sample_bytes)
    chosen = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "__id")
    return chosen.select(F.col("__id").cast("bigint").alias("id"), F.col("__text").alias("text"), F.col("__label").cast("int").alias("label"))


class Scorer:
    """Scores texts with a model; remembers the projected inputs of words."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.table = np.empty((1 << 12, 6 * model.params.hidden), dtype=np.float32)

    def learn(self, words: list[bytes]) -> None:
        base = len(self.cache)
        self.cache.update(zip(words, range(base, base + len(words))))
        if base + len(words) > len(self.table):
            self.table = np.concatenate([self.table[:base], np.empty((base + 2 * len(words), self.table.shape[1]), dtype=np.float32)])
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            self.table[base + at : base + at + len(part)] = self.model.projected([w.strip(EDGES).lower() for w in part])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(highest window probability, number of windows, first word of that window); a text without words: 0, 0, 0."""
        p = self.model.params
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [text.split() for text in texts]
        fresh = set().union(*split).difference(self.cache)
        if fresh:
            self.learn(sorted(fresh))
        best, count, where = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        some = [k for k, words in enumerate(split) if words]
        if not some:
            return best, count, where
        lengths = np.fromiter((len(split[k]) for k in some), dtype=np.int64, count=len(some))
        flat = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(lengths.sum()))
        index, mask, owner = layout(flat, lengths, p)
        scores = np.concatenate([self.model.logits(self.table, index[:, a : a + 4096], mask[:, a : a + 4096]) for a in range(0, len(owner), 4096)])
        first = np.searchsorted(owner, np.arange(len(some)))
        top = np.maximum.reduceat(scores, first)
        hit = np.flatnonzero(scores == top[owner])
        hit = hit[np.searchsorted(owner[hit], np.arange(len(some)))]
        count[some] = np.diff(np.concatenate((first, [len(owner)])))
        best[some] = sigmoid(top.astype(np.float64))
        where[some] = np.minimum((hit - first) * p.stride, np.maximum(lengths - p.window, 0))
        return best, count, where


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, n_windows, top_window) of every whole text, row by row.

    A null or empty text, or one of white space, has score 0 and no windows.  Very long texts are
    scored over all their windows.  Repeated rows and null ids are scored like any others; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = utf8_list(batch.column(1))
            for a, b in byte_slices(texts, 1 << 20):
                best, count, where = scorer(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(best), pa.array(count), pa.array(where)], ["doc_id", "score", "n_windows", "top_window"])

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, score double, n_windows long, top_window long")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), **columns) -> Model:
    """The model of a bounded sample of labelled documents; without any, an untrained one."""
    return train_in_task(training_sample(docs, labels, p, **columns), lambda texts, known: train(texts, known, p), p.toxic_documents + p.clean_documents)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; each row is judged by its own text, so rows that share an id may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = utf8_list(batch.column(text_column))
            for a, b in byte_slices(texts, 1 << 20):
                best = scorer(texts[a:b])[0]
                yield batch.slice(a, b - a).filter(pa.array(best < threshold))

    return docs.mapInArrow(run, docs.schema)
