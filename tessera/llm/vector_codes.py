"""Vector codes: product quantisation with integer codebooks from member-resident Lloyd rounds.

A vector is cut into equal parts, and each part becomes the index of its nearest codebook entry.  The
parts of all vectors live in partitions by (position, entry, salt); the salt spreads an entry that very
many parts have.  In a round, owners find the nearest entry of each resident part; parts whose entry
stays don't leave their partition, only those that change are shuffled to their new owner.  Owners then
add up what is resident, and the sums of salts give the new entries.  Everything is integer arithmetic, so
results don't depend on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_count
from tessera.operators.lineage import checkpointed


@dataclass(frozen=True)
class Params:
    """``entries`` of at most 256 and ``parts`` bound the codebooks, which are all that is broadcast."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    salts: int = 8


@dataclass
class Codebooks:
    """Integer entries by part: ``books[position]`` is a list of entries, each a list of ``width`` integers."""

    params: Params
    width: int
    books: list[list[list[int]]]
    bound: int
    _tables: list = field(default_factory=list, repr=False)

    def digest(self) -> str:
        """SHA-256 of all components as decimal text, by part, entry and position within the part."""
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def nearest(self, position: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of equals) and the squared distance for each row of one part."""
        if not self.width or not len(rows):
            return np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=object)
        if not self._tables:
            self._tables.extend([None] * self.params.parts)
        reach = 4 * self.width * max(self.bound, 1) ** 2
        kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
        if self._tables[position] is None:
            book = np.array(self.books[position], dtype=object).reshape(-1, self.width).astype(kind)
            self._tables[position] = (book.T.copy(), (book * book).sum(1))
        book, norms = self._tables[position]
        found, far = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=object if kind is object else np.int64)
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096].astype(kind)
            # Squared distance less the row's own norm: the same order, one product.
            scores = norms[None, :] - 2 * (some @ book)
            best = scores.argmin(1)
            found[at : at + 4096] = best
            far[at : at + 4096] = (scores[np.arange(len(some)), best] + (some * some).sum(1)).astype(far.dtype)
        return found, far


#: What a partition of members is chosen by.
OWNERS = ["position", "entry", "salt"]


def kept_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = 1024) -> DataFrame:
    """Rows whose vector is there and all finite, as (id, label, ints): components are floor(scale * x), held within +-2^62."""
    x = F.col(vector_column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    limit = float(1 << 62)
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-limit)), F.lit(limit))).cast("long"))
    return rows.where(x.isNotNull() & fine).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), whole.alias("ints"))


def _cut(ints: pa.ListArray, width: int, parts: int) -> np.ndarray:
    """A batch of lists as an array (rows, parts, width); shorter lists are filled with zeros at the end."""
    n, whole = len(ints), width * parts
    sizes = np.asarray(ints.value_lengths())
    flat = np.asarray(ints.flatten())
    if n and (sizes == whole).all():
        return flat.reshape(n, parts, width)
    out = np.zeros((n, whole), dtype=np.int64)
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(n, parts, width)


def _storage(bound: int) -> np.dtype:
    """The narrowest little-endian integer that holds all components."""
    return np.dtype("<i2" if bound < 1 << 15 else "<i4" if bound < 1 << 31 else "<i8")


def first_books(kept: DataFrame, params: Params = Params()) -> Codebooks:
    """Entries from the vectors with the smallest ids (null ids last, equal ids by vector): a bounded number of rows."""
    size = F.max(F.size("ints"))
    reach = F.max(F.array_max(F.transform("ints", lambda v: F.abs(v))))
    shape = kept.agg(size.alias("size"), reach.alias("reach")).first()
    width = -(-(shape["size"] or 0) // params.parts)
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(params.entries).select("ints").collect()
    whole = [list(r.ints) + [0] * (width * params.parts - len(r.ints)) for r in rows]
    books = [[v[p * width : (p + 1) * width] for v in whole] for p in range(params.parts)]
    return Codebooks(params, width, books, int(shape["reach"] or 0))


def _members(kept: DataFrame, shared) -> DataFrame:
    """One row for each different part of a batch: (position, entry, salt, n, part), with its first nearest entry."""
    salts = shared.value.params.salts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind, names = _storage(model.bound), ["position", "entry", "salt", "n", "part"]
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(batch.column(0), model.width, model.params.parts)
            for p in range(model.params.parts):
                rows = np.ascontiguousarray(cut[:, p, :].astype(kind))
                # Copies within a batch are one row with a weight, so that a very common vector stays small.
                raw, size = rows.tobytes(), rows.itemsize * model.width
                index: dict[bytes, list[int]] = {}
                for k in range(len(rows)):
                    index.setdefault(raw[k * size : (k + 1) * size], []).append(k)
                first = np.array([v[0] for v in index.values()])
                entry, _ = model.nearest(p, rows[first])
                count = np.array([len(v) for v in index.values()], dtype=np.int64)
                salt = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "little") % salts for t in index], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt), pa.array(count), pa.array(list(index), pa.binary())], names
                )

    return kept.select("ints").mapInArrow(run, "position int, entry int, salt int, n long, part binary")


def _nearest_now(shared) -> Column:
    """The nearest entry of each resident part under the codebooks of this round."""

    @F.pandas_udf("int")
    def find(position: pd.Series, part: pd.Series) -> pd.Series:
        model = shared.value
        out = np.zeros(len(part), dtype=np.int32)
        places = position.to_numpy()
        for p in np.unique(places):
            at = np.flatnonzero(places == p)
            rows = np.frombuffer(b"".join(part.iloc[at]), dtype=_storage(model.bound)).reshape(len(at), model.width)
            out[at] = model.nearest(int(p), rows)[0]
        return pd.Series(out)

    return find.asNondeterministic()("position", "part")  # so that a filter and a projection don't each ask


def _owner_sums(members: DataFrame, shared) -> DataFrame:
    """What owners add up: one row for each (position, entry) of a partition and component; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = _storage(model.bound)
        exact = object if model.bound >= 1 << 20 else np.int64
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = np.asarray(batch.column(0)).astype(np.int64) * model.params.entries + np.asarray(batch.column(1))
            weight = np.asarray(batch.column(2)).astype(exact)
            rows = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=kind).reshape(len(keys), model.width).astype(exact)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                at = order[lo:hi]
                add = np.concatenate([[weight[at].sum()], (rows[at] * weight[at][:, None]).sum(0)]).astype(object)
                key = divmod(int(keys[at[0]]), model.params.entries)
                sums[key] = sums[key] + add if key in sums else add
        found = [(p, e, c - 1, str(v)) for (p, e), total in sums.items() for c, v in enumerate(total)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["position", "entry", "component", "total"])

    parts = members.select("position", "entry", "n", "part").mapInArrow(run, "position int, entry int, component int, total string")
    return parts.groupBy("position", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _updated(model: Codebooks, members: DataFrame, shared) -> Codebooks:
    """Entries become floor(sum / count) of their members; entries without members stay."""
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for r in _owner_sums(members, shared).collect():  # at most parts * entries * (width + 1) rows
        totals.setdefault((r.position, r.entry), {})[r.component] = int(r.total)
    books = [[list(e) for e in book] for book in model.books]
    for (p, e), found in totals.items():
        books[p][e] = [found[c] // found[-1] for c in range(model.width)]
    return Codebooks(model.params, model.width, books, model.bound)


def _migrated(state: DataFrame, shared, n: int) -> DataFrame:
    """Members under the next codebooks: those whose entry stays keep their partition, only the others are shuffled.

    What arrives stands in ``n`` partitions of its own beside the others', so owners have one partition for each round.
    """
    placed = state.withColumn("to", _nearest_now(shared))
    stay = placed.where(F.col("to") == F.col("entry")).select(*OWNERS, "n", "part")
    moved = placed.where(F.col("to") != F.col("entry")).select("position", F.col("to").alias("entry"), "salt", "n", "part")
    return stay.union(moved.repartition(n, *OWNERS))


def train(kept: DataFrame, params: Params = Params()) -> Codebooks:
    """Codebooks after all rounds over ``kept`` (see kept_vectors).

    A state is checkpointed before it is used twice, for what stays and for what moves, so lost executors
    cost one round at most.  The last state is only added up.
    """
    spark = kept.sparkSession
    model = first_books(kept, params)
    if not model.books[0]:
        return model
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(model)
    state = _members(kept, shared).repartition(n, *OWNERS)
    for k in range(params.rounds):
        if k:
            state = _migrated(state, shared, n)
        if k < params.rounds - 1:
            state = checkpointed(state)
        model = _updated(model, state, shared)
        shared = spark.sparkContext.broadcast(model)
    return model


def encode(kept: DataFrame, model: Codebooks) -> DataFrame:
    """Codes of all vectors: (id, label, entries array<int>, error long), errors over 2^63 - 1 held there."""
    shared = kept.sparkSession.sparkContext.broadcast(model)
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            cut = _cut(batch.column(2), books.width, books.params.parts)
            found = [books.nearest(p, cut[:, p, :]) for p in range(books.params.parts)]
            entries = np.stack([f[0] for f in found], 1).astype(np.int32) if batch.num_rows else np.zeros((0, books.params.parts), np.int32)
            error = sum((f[1].astype(object) for f in found[1:]), found[0][1].astype(object))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * books.params.parts), pa.array(entries.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array([min(int(x), most) for x in error], pa.int64())], ["id", "label", "entries", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("id", "label", "ints").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, entries array<int>, error long")


def compress(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", params: Params = Params()) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors of ``rows``, and the codebooks.

    Nulls: a null vector or one with a null, NaN or infinite component gives no row; null ids and labels are
    kept (null ids come last where entries are chosen).  Vectors of different lengths, empty ones included, and lengths
    that ``parts`` doesn't divide are filled with zeros at the end up to the least common length.  Repeated rows each
    have their row; fewer vectors than ``entries`` make fewer entries.  An empty table gives no rows.  Other
    columns, whatever their names, are left out.
    """
    kept = kept_vectors(rows, id_column, vector_column, label_column, params.scale)
    model = train(kept, params)
    return encode(kept, model), model


def with_label_errors(codes: DataFrame, share: int = 10_000) -> DataFrame:
    """Codes with ``label_error``, the sum of errors of all rows of a label (null labels together).

    The sums are one row a label.  Labels of over one in ``share`` rows, fewer than ``share`` of them, are
    broadcast; the others meet by a shuffle.
    """
    named = codes.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = checkpointed(named.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return join_by_count(named, sums, "__label").drop("__label")
