"""Tab-separated pairwise alignment lines: 12 columns, then TAG:TYPE:VALUE fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a line, in order, and their kinds.
COLUMNS = {
    "qname": "string", "qlen": "bigint", "qs": "bigint", "qe": "bigint", "strand": "string", "tname": "string", "tlen": "bigint", "ts": "bigint", "te": "bigint", "matches": "bigint", "block": "bigint", "mapq": "bigint",
}


def to_lines(rows: DataFrame) -> DataFrame:
    """(value) lines of rows with all of COLUMNS and ``tags``, a map of TAG:TYPE to value (null or empty: none)."""
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.expr("map()")))), lambda e: F.concat_ws(":", e["key"], e["value"]))
    fields = F.concat(F.array(*(F.col(c).cast("string") for c in COLUMNS)), tags)
    return rows.select(F.array_join(fields, "\t", ".").alias("value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows of lines (value), without comments and blank lines: COLUMNS, and the tags as a map of TAG:TYPE to value, the first of equal tags staying."""
    c = F.split("value", "\t")
    fields = F.filter(F.slice(c, 13, F.greatest(F.size(c) - 12, F.lit(0))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    names = F.array_distinct(F.transform(fields, lambda x: F.substring(x, 1, 4)))
    values = F.transform(names, lambda n: F.element_at(F.transform(F.filter(fields, lambda x: x.startswith(n)), lambda x: F.substring(x, 6, F.length(x))), 1))
    kept = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return kept.select(*(F.when(F.get(c, k) != ".", F.get(c, k)).cast(kind).alias(name) for k, (name, kind) in enumerate(COLUMNS.items())), F.map_from_arrays(names, values).alias("tags"))
