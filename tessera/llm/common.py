"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_by_count(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", share: int = 10_000) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a ``key`` and, in ``n``, about how many of ``rows`` have it.

    Keys that over one in ``share`` of the counted rows have, fewer than ``share`` of them whatever the
    input's size, are broadcast, so that no task gets all rows of a hot key; the others are joined by
    a shuffle.  ``side`` is read several times: give a checkpointed or a small one.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    total = side.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    marked = side.join(F.broadcast(total)).withColumn("__hot", F.col("n") * share > F.col("total")).drop("total", "n")
    hot, cold = marked.where("__hot").drop("__hot"), marked.where("not __hot").drop("__hot")
    common = rows.join(F.broadcast(hot), key)
    return common.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def utf8_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; nulls become empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def byte_slices(texts: list[bytes], limit: int = 1 << 22):
    """Ranges (begin, end) of texts with about ``limit`` bytes together, at least one text each."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd base, so that powers have inverses modulo 2**64 and any span's hash comes from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of the symbol spans [start, end), mixed."""
    n = len(symbols)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, n), out=prefix[1:])
        down = _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)
        return mix64((prefix[ends] - prefix[starts]) * down[starts])


def train_in_task(sample: DataFrame, train: Callable, most: int):
    """``train(texts, labels)`` of a bounded sample (id, text binary, label int), run in one task; only the model comes to the driver.

    Rows are sorted first, so that a task that runs again gives the same model; at most ``most`` are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([("id", "ascending"), ("text", "ascending")]).slice(0, most)
        model = train(rows.column("text").to_pylist(), rows.column("label").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else train([], [])
