"""Text formats of sequences and variants as Spark rows: FASTA records, VCF lines, dotted TSV and graph lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sequence alphabet.
IUPAC = "ACGTRYSWKMBDHVN"


def sample_name(path: Column) -> Column:
    """A file's sample: its name without ``.gz`` and without a FASTA suffix."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.gz$", ""), r"\.(fasta|fna|fas|fa)$", "")


def read_cigars(spark: SparkSession, path: str) -> DataFrame:
    """(name, cigar) of files that hold one CIGAR each, plain or compressed; the name is the file's, without ``.gz`` and its suffix, and white space goes."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", ""), r"\.[^.]*$", "")
    return rows.select(name.alias("name"), F.regexp_replace("value", r"\s", "").alias("cigar"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """(sequence_id, seq, valid) of rows (value) that each hold the text after one ``>``: the header's first word, and the bases without white space, upper-cased.

    ``valid`` is false for an empty sequence or one with letters beyond the alphabet.
    """
    parts = F.split("value", "\n", 2)
    seq = F.upper(F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", ""))
    rows = records.where(F.trim("value") != "").select("*", F.regexp_extract(parts[0], r"^\s*(\S*)", 1).alias("sequence_id"), seq.alias("seq")).drop("value")
    return rows.withColumn("valid", F.col("seq").rlike(f"^[{IUPAC}]+$"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(sample, sequence_id, seq, valid) of FASTA files, plain or compressed; one row a record, split where a line begins with ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("sample", sample_name(F.input_file_name()))
    return parse_fasta(rows.withColumn("value", F.regexp_replace("value", r"\A>", "")))  # that of the file's first line


def fasta_records(sequences: DataFrame, width: int = 80) -> DataFrame:
    """(value) records of (sequence_id, seq), without their ``>``: a header line and lines of ``width`` bases."""
    return sequences.select(F.concat(F.col("sequence_id").cast("string"), F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n")).alias("value"))


def info_map(info: Column) -> Column:
    """A VCF INFO field as a map; flags map to ``true``, a dot to an empty map, and the last of equal keys stays."""
    fields = F.filter(F.split(F.when(info == ".", "").otherwise(info), ";"), lambda x: x != "")
    keys = F.transform(fields, lambda x: F.substring_index(x, "=", 1))
    names = F.array_distinct(keys)
    values = F.transform(names, lambda n: F.element_at(F.transform(F.filter(fields, lambda x: F.substring_index(x, "=", 1) == n), lambda x: F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(n) + 2, F.length(x))).otherwise("true")), -1))
    return F.map_from_arrays(names, values)


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alt, kind, size, end, info) of VCF lines (value); the kind comes from SVTYPE or the allele lengths."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(c[0].alias("chrom"), c[1].cast("bigint").alias("pos"), c[2].alias("id"), c[3].alias("ref"), c[4].alias("alt"), info_map(c[7]).alias("info"))
    change = F.length("alt") - F.length("ref")
    kind = F.coalesce(F.col("info")["SVTYPE"], F.when(change > 0, "INS").when(change < 0, "DEL").otherwise("SNV"))
    size = F.coalesce(F.abs(F.col("info")["SVLEN"].cast("bigint")), F.abs(change).cast("bigint"))
    end = F.coalesce(F.col("info")["END"].cast("bigint"), F.col("pos") + F.length("ref") - 1)
    return rows.select("chrom", "pos", "id", "ref", "alt", kind.alias("kind"), size.alias("size"), end.alias("end"), "info")


def write_vcf_lines(events: DataFrame) -> DataFrame:
    """(value) VCF lines of (event_id, chrom, pos, kind, size) with symbolic alleles."""
    stop = F.col("pos") + F.when(F.col("kind") == "DEL", F.col("size")).otherwise(0)
    info = F.concat(F.lit("SVTYPE="), "kind", F.lit(";SVLEN="), F.when(F.col("kind") == "DEL", -F.col("size")).otherwise(F.col("size")).cast("string"), F.lit(";END="), stop.cast("string"), F.lit(";IMPRECISE"))
    return events.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("event_id").cast("string"), F.lit("N"), F.concat(F.lit("<"), "kind", F.lit(">")), F.lit("."), F.lit("PASS"), info).alias("value"))


def dotted(rows: DataFrame) -> DataFrame:
    """All columns as text with a dot for null, as the TSV tables have it."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in rows.columns))


def undotted(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns with dots as nulls and cast to ``kinds``; a value that does not fit raises, where ANSI mode is on."""
    return rows.select(*(F.when(F.col(c) != ".", F.col(c)).cast(kinds.get(c, "string")).alias(c) for c in rows.columns))


def graph_lines(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """(value) GFA 1.0 lines of segments (segment, seq) and paths (path, step_no, segment, orient); links are the distinct neighbours in paths."""
    over = Window.partitionBy("path").orderBy("step_no")
    steps = paths.withColumn("to_segment", F.lead("segment").over(over)).withColumn("to_orient", F.lead("orient").over(over)).where("to_segment is not null")
    links = steps.select("segment", "orient", "to_segment", "to_orient").distinct()
    walked = paths.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", F.concat("segment", "orient").alias("x")))), lambda s: s.x), ",").alias("walk"))
    tab = lambda *x: F.concat_ws("\t", *x).alias("value")
    return (
        segments.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string")
        .unionByName(segments.select(tab(F.lit("S"), "segment", "seq")))
        .unionByName(links.select(tab(F.lit("L"), "segment", "orient", "to_segment", "to_orient", F.lit("0M"))))
        .unionByName(walked.select(tab(F.lit("P"), "path", "walk", F.lit("*"))))
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``updates`` and those rows of ``base`` whose key they lack; columns that one side lacks are null."""
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates, allowMissingColumns=True)
