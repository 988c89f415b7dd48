"""The subpackage's registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, language_id, line_dedup, media, packing, phrases, piece_codec, quality_crf, simhash, toxicity, url_rules, vector_codes, warc
from tessera.llm.common import id_bucket, table
from tessera.operators.lineage import checkpoint_folder


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages removed from every document: doc_id, the text that stays, and counts."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines", "removed_chunks")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows whose id's crc32 leaves 2 modulo 4 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_crf.score_documents(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels"), held_out=(4, 2)))
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "bad_lines")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return phrases.with_edited(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC bundles in the shared folder, and every record read back from them."""
    path = warc.write_archives(table(spark, sf_dir, "pages"), checkpoint_folder(spark))
    return warc.read_archives(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to piece ids and decoded again: counts and digests of ids and of the decoded text, and whether it equals the document."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    return piece_codec.round_trip(docs, path)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by curated rules, and elsewhere by rules mined from labels."""
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a PNG and read back, with hashes of both and a cosine hash."""
    return media.image_features(media.store_images(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose id's crc32 leaves 0 modulo 5 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=(5, 0)))
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "top_window")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the class that each belongs to."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by a fixed rule and repaired by the cheapest edits: counts, cost, edits and a digest."""
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose id's crc32 leaves 2 modulo 4 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, held_out=(4, 2)))
    return found.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in four parts of one byte, their errors, and the digest of the codebooks."""
    codes, model = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.concat(*[F.lpad(F.lower(F.hex(F.col("entries")[k])), 2, "0") for k in range(4)])
    found = vector_codes.with_label_errors(codes)
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_quality, op4_fingerprints, op5_warc, op6_pieces, op7_url_rules, op8_toxicity, op9_media, op10_simhash, op11_conversation_repair, op12_language_id, op13_vector_codes)}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.oracle(), "op5_warc": warc.oracle()}
