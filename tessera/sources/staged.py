"""Tab-separated tables of the stages: written with a header, read by the header's names, with bad lines in a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.formats import dotted

#: Columns of the tables that stages hand on, and their kinds.
GROUPED_ANCHORS = {"anchor_id": "string", "sequence_id": "string", "start": "bigint", "end": "bigint", "anchor_group_id": "string", "groupable": "boolean"}
CHAINS = {"chain_id": "bigint", "sample_a": "string", "sample_b": "string", "sequence_a": "string", "sequence_b": "string", "strand": "string", "score": "double", "ref_start": "bigint", "ref_end": "bigint", "query_start": "bigint", "query_end": "bigint"}
CORRESPONDENCES = {"anchor_a": "string", "anchor_b": "string", "sample_a": "string", "sample_b": "string", "support_direction": "string", "score": "double", "strand": "string"}


def write_stage(rows: DataFrame, path: str) -> None:
    """Write ``rows`` as tab-separated text with a header a file and a dot for null; texts must have no tabs or line breaks."""
    dotted(rows).write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _reason(value: Column, name: str | Column, kind: str, nullable: bool) -> Column:
    """Why a field is none of ``kind``; null if it is one.  A dot is only one where the column may be null."""
    missing = F.concat(F.lit("missing field: "), F.lit(name) if isinstance(name, str) else name)
    wrong = lambda what: F.concat(F.lit(f"invalid {what} in "), F.lit(name) if isinstance(name, str) else name, F.lit(": "), value)
    said = F.when(value.isNull(), missing)
    if nullable:
        said = said.when(value == ".", F.lit(None))
    if kind == "bigint":
        said = said.when(~value.rlike("^[0-9]+$") | value.try_cast("bigint").isNull(), wrong("integer"))
    elif kind == "double":
        said = said.when(~value.rlike(r"^\S+$") | value.try_cast("double").isNull(), wrong("number"))
    elif kind == "boolean":
        said = said.when(~value.isin("true", "false"), wrong("flag"))
    return said


def read_stage(spark: SparkSession, path: str, kinds: dict[str, str], nullable: tuple[str, ...] = (), block: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of tab-separated files whose header names the columns, in any order; other columns are left out.

    ``rows`` have the columns of ``kinds``, strictly typed: whole numbers without a sign, no white space around numbers, dots
    only in ``nullable`` columns.  With ``block`` = (name, suffix), columns that end with the suffix are one more column, a
    map of what stands before it to a whole number.  ``rejected`` has (file, line, reason) of the other lines, by the
    first field that is wrong.  A missing column is an error; an empty file has no header.  All files of a path share
    one header, a line with another one is rejected; blank lines are left out.
    """
    first = spark.read.text(path).where("value <> ''").limit(1).collect()
    if not first:
        raise ValueError(f"empty table: {path}")
    header = first[0].value
    names = header.split("\t")
    lost = [c for c in kinds if c not in names]
    if lost:
        raise ValueError(f"missing column: {lost[0]}")
    lines = spark.read.text(path).where((F.col("value") != "") & (F.col("value") != header)).select("value", F.col("_metadata.file_name").alias("file"))
    fields = F.split("value", "\t", -1)
    rows = lines.select("file", "value", *(F.get(fields, F.lit(names.index(c))).alias(f"f_{k}") for k, c in enumerate(kinds)), fields.alias("fields"))
    reasons = [_reason(F.col(f"f_{k}"), c, kind, c in nullable) for k, (c, kind) in enumerate(kinds.items())]
    value = lambda k, c, kind: F.when(F.col(f"f_{k}") != ".", F.col(f"f_{k}")) if c in nullable else F.col(f"f_{k}")
    typed = [value(k, c, kind).try_cast(kind).alias(c) for k, (c, kind) in enumerate(kinds.items())]
    if block:
        name, suffix = block
        own = [(k, c[: -len(suffix)]) for k, c in enumerate(names) if c.endswith(suffix)]
        cells = [F.get("fields", F.lit(k)) for k, _ in own]
        reasons += [_reason(x, names[k], "bigint", False) for x, (k, _) in zip(cells, own)]
        pairs = [y for x, (_, sample) in zip(cells, own) for y in (F.lit(sample), x.try_cast("bigint"))]
        typed.append((F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string, bigint>)")).alias(name))
    judged = rows.withColumn("reason", F.coalesce(*reasons))
    return judged.where("reason is null").select(*typed), judged.where("reason is not null").select("file", F.col("value").alias("line"), "reason")
