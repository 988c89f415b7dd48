"""Streams give what the batch operators give."""

from tessera.operators.anchors import kmer_frequency
from tessera.streaming import counts


def test_running_counts_equal_batch_counts(spark, tmp_path):
    rows = [(k, "s", "ACGTACGTTGCA" * (k + 1)) for k in range(6)]
    frame = spark.createDataFrame(rows, counts.SEQUENCES)
    for part in range(3):
        frame.where(f"sequence_id % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = counts.write_counts(counts.running_kmer_counts(counts.sequence_stream(spark, str(tmp_path / "in"), 1)), "kmers", str(tmp_path / "ckpt"))
    query.processAllAvailable()
    query.stop()
    got = {(r.kmer, r.freq) for r in spark.table("kmers").collect()}
    assert got == {(r.kmer, r.freq) for r in kmer_frequency(frame).collect()}
