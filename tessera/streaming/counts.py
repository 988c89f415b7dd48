"""Running counts over files that keep arriving: the batch operators' expressions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.anchors import kmer_frequency

SEQUENCES = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("sample", T.StringType()), T.StructField("seq", T.StringType())])


def sequence_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Sequences from the Parquet files of a folder as they arrive, at most ``files`` a trigger."""
    return spark.readStream.schema(SEQUENCES).option("maxFilesPerTrigger", files).parquet(folder)


def running_kmer_counts(sequences: DataFrame, k: int = 6) -> DataFrame:
    """(kmer, freq) of all sequences so far, each file counted before the shuffle; the state has at most 4**k keys."""
    return kmer_frequency(sequences, k)


def gap_alerts(events: DataFrame, late: str = "1 hour", width: str = "6 hours", least: int = 10) -> DataFrame:
    """(window, sequence_id, n) of event-time windows in which a sequence has fewer than ``least`` anchors, once the watermark ``late`` has passed them."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "sequence_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") < least)


def write_counts(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Start the counts into a table in memory (for a look; a cluster writes to a real sink), with its progress in ``checkpoint``."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
